"""Encoding of conversations against direct use of the tokenizers' own libraries and rules written out."""

import base64

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.operators import encode as E
from parley.operators import render as R

PLAIN = R.TEMPLATES["plain"]
SCHEMA = "i int, messages array<struct<role:string,content:string,loss:double>>, `a.b` string"


def rows(spark, *told):
    return spark.createDataFrame([(i, None if t is None else [(r, c, None) for r, c in t], "x") for i, t in enumerate(told)], SCHEMA)


def ids(text):
    return list(text.encode())


def test_labels_and_lengths(spark):
    d = rows(spark, [("user", "Wo?"), ("assistant", "Süd")], None, [], [("assistant", "Ja")], [("user", "Wo?")])
    got = {r.i: r for r in E.encode(d, PLAIN, E.Encoder()).collect()}
    assert sorted(got) == [0, 2, 3, 4]  # null messages have no form
    assert (got[0].input_ids, got[0].labels, got[0].length) == (ids("Wo?Süd"), [-100] * 3 + ids("Süd"), 7) and got[0].loss_scale is None
    assert (got[2].input_ids, got[2].labels, got[2].length) == ([], [], 0)
    assert (got[3].input_ids, got[3].labels) == (ids("Ja"), [-100, ord("a")])  # the first label is never trained
    assert got[4].labels == [-100] * 3 and got[0]["a.b"] == "x"
    asked = {r.i: r for r in E.encode(d, PLAIN, E.Encoder(training=False)).collect()}
    assert asked[0].input_ids == ids("Wo?") and asked[0].labels is None and asked[3].input_ids == []
    assert E.encode(d.limit(0), PLAIN, E.Encoder()).count() == 0
    assert [r.lengths for r in E.with_lengths(E.encode(d.where("i = 0"), PLAIN, E.Encoder())).collect()] == [[7]]


@pytest.mark.parametrize(
    "strategy, protected, want",
    [("delete", (), []), ("right", (), ["abcd"]), ("left", (), ["efgh"]), ("split", (), ["abcd", "efgh"]), ("right", (ord("h"),), ["abch"]), ("left", (ord("a"),), ["afgh"]), ("right", tuple(b"abcdef"), ["abcdef"])],
)
def test_strategies(spark, strategy, protected, want):
    d = rows(spark, [("user", "ab"), ("assistant", "cdefgh")], [("user", "a"), ("assistant", "b")])
    got = E.encode(d, PLAIN, E.Encoder(most=4, strategy=strategy, protected=protected)).collect()
    assert [bytes(r.input_ids).decode() for r in got if r.i == 0] == want and [r.length for r in got if r.i == 1] == [2]
    for r in got:
        assert r.labels[0] == -100 and r.length == len(r.input_ids) == len(r.labels) and all(y in (-100, x) for x, y in zip(r.input_ids, r.labels))


def test_weights_split_responses(spark):
    d = rows(spark, [("user", "q"), ("assistant", "Thought: t\nAction: f")])
    weights = tuple((k, tuple(w)) for k, w in R.WEIGHT_MAPS["react"].items())
    r = E.encode(d, PLAIN, E.Encoder(weights=weights)).first()
    assert r.loss_scale == [0.0] + [1.0] * len("Thought: t\n") + [2.0] * len("Action: f") and bytes(r.input_ids).decode() == "qThought: t\nAction: f"


def test_preference(spark):
    pair = "i int, messages array<struct<role:string,content:string,loss:double>>, rejected_messages array<struct<role:string,content:string,loss:double>>, margin double"
    q, a, b, long = ("user", "q", None), ("assistant", "a", None), ("assistant", "bb", None), ("assistant", "c" * 9, None)
    d = spark.createDataFrame([(0, [q, a], [q, b], 0.5), (1, [q, a], None, None), (2, [q, a], [q, long], None), (3, None, [q, b], None)], pair)
    both = E.encode_preference(d, PLAIN, E.Encoder(most=5)).collect()
    assert [(r.i, r.chosen_length, r.rejected_length, r.margin) for r in both] == [(0, 2, 3, 0.5)] and both[0].rejected_labels == [-100, *ids("bb")]
    some = E.encode_preference(d, PLAIN, E.Encoder(most=5), rejected=False).collect()
    assert [(r.i, r.rejected_input_ids) for r in some] == [(0, ids("qbb")), (1, None)]
    with pytest.raises(ValueError):
        E.encode_preference(d, PLAIN, E.Encoder(most=5, strategy="split"))


def test_libraries(spark):
    """Each kind of tokenizer gives what its library gives for the texts of one weight, joined."""
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer as Library

    texts = ["Grüße, it's 7 <|endoftext|>\n\n 東京", "", "word " * 300]
    d = rows(spark, *[[("user", t), ("assistant", "ok " + t)] for t in texts])
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    byte_level = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    library = Library.from_file(public.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    kinds = {
        E.Tokenizer("ranks", path, public.PATTERN): byte_level,
        E.Tokenizer("json", public.path("byte_bpe_50k.json")): lambda t: library.encode(t, add_special_tokens=False).ids,
        E.Tokenizer("model", public.path("piece_bpe_32k.model")): model.encode,
    }
    for spec, one in kinds.items():
        got = {r.i: r for r in E.encode(d, PLAIN, E.Encoder(spec)).collect()}
        for i, t in enumerate(texts):
            query, answer = one(t) if t else [], one("ok " + t)
            assert got[i].input_ids == query + answer and got[i].labels[len(query) or 1 :] == answer[0 if query else 1 :]
    with pytest.raises(ValueError):
        E.batch_encoder(E.Tokenizer("none"))


@pytest.mark.parametrize("pair", [False, True])
def test_a_batch_is_worked_on_in_parts(spark, monkeypatch, pair):
    """However many rows a batch has, about SLICE_BYTES of text are tokens at a time; nothing is lost or moved."""
    monkeypatch.setattr(E, "SLICE_BYTES", 100, raising=False)
    told = [None, [], *[[("user", "q" * n), ("assistant", "a")] for n in (250, 30, 30, 30, 0, 99, 20)], None]
    d, held = rows(spark, *told), []
    if pair:
        d = d.withColumn("rejected_messages", F.col("messages"))

    def local(source, run, schema):
        held.extend(run(iter([pa.concat_batches(source.orderBy("_0").toArrow().to_batches()).slice(1)])))
        return source.limit(0).mapInPandas(lambda parts: parts, source.schema).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])

    monkeypatch.setattr(type(d), "mapInArrow", local)
    E.encode_preference(d, PLAIN, E.Encoder()) if pair else E.encode(d, PLAIN, E.Encoder())
    ids_at = [i for i, n in enumerate(held[0].schema.names) if n.endswith("input_ids")]
    made = [[len(x) for x in b.column(i).to_pylist()] for i in ids_at for b in held]
    assert [i for b in held for i in b.column(0).to_pylist()] == list(range(1, 9))
    assert sum(made, []) == [0, 251, 31, 31, 31, 1, 100, 21] * len(ids_at)
    assert len(held) > 3 and all(sum(b) <= 100 or sum(n > 0 for n in b) == 1 for b in made)
