"""Goldens and invariants of rendering, packing, rewards, agents, metrics and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from parley.operators import agent as A
from parley.operators import tools as TL
from parley.operators import groupstats as G
from parley.operators import metrics as M
from parley.operators import normalize as N
from parley.operators import ordering as O
from parley.operators import pack as P
from parley.operators import preference as S
from parley.operators import render as R
from parley.operators import rewards as RW
from parley.operators import windows as W


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def chat(*pairs):
    return F.array(*[N.message(r, F.lit(c)) for r, c in pairs])


def test_render(spark):
    pieces = R.segments(R.TEMPLATES["chatml"], F.lit("S"), chat(("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")), "last_round")
    got = value(spark, pieces)
    assert "".join(p.text for p in got) == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n"
    assert [p.text for p in got if p.weight > 0] == ["d", "<|im_end|>\n"]
    merged = value(spark, R.merge_segments(pieces))
    assert len(merged) == 2
    assert value(spark, R.replace_in_order(F.lit("x<b>y<b>z<b>"), "<b>", F.array(F.lit("1"), F.lit("2")))) == "x1y2z<b>"
    assert value(spark, R.split_windows(F.array(*map(F.lit, "abcde")), 2)) == [["a", "b"], ["c", "d"], ["e"]]
    assert value(spark, R.find_sublists(F.array(*map(F.lit, [1, 2, 1, 2, 3])), F.array(F.lit(1), F.lit(2)))) == [0, 2]


def test_split_parts_put_together_again():
    text = "lead Action: x Action Input: {} Action: y"
    parts = R.split_parts(text, ["Action:", "Action Input:"])
    assert "".join(k + c for k, c in parts) == text and parts[0] == ("", "lead ")
    assert R.weighted_parts("a<tool_call>b</tool_call>", R.WEIGHT_MAPS["hermes"]) == [("a", 1.0), ("<tool_call>b</tool_call>", 2.0)]
    assert R.parse_strategy("last_round+react") == ("last_round", "react") and R.parse_strategy("react") == ("default", "react")
    assert R.is_binary(R.WEIGHT_MAPS["ignore_empty_think"]) and not R.is_binary(R.WEIGHT_MAPS["react"])


@pytest.mark.parametrize("finished", [True, False])
def test_best_fit(finished):
    items = [(i, (i * 37) % 50 + 1) for i in range(300)]
    bins, carry = P.best_fit(items, 100, finished)
    assert sorted(x for b in [*bins, carry] for x in b) == items
    assert all(sum(n for _, n in b) <= 100 for b in [*bins, carry]) and bool(carry) != finished


def test_pack_table(spark):
    df = spark.range(2500).select(F.col("id"), (F.col("id") * 37 % 50 + 1).alias("n"))
    packed = P.pack_table(df, "id", "n", 100, shards=3)
    assert packed.select("id").distinct().count() == 2500
    assert packed.groupBy("shard", "pack").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0] <= 100
    rows = [(i, i * 37 % 50 + 1) for i in range(2500)]
    carry, bins = [], []
    for at in range(0, 2500, 1000):
        made, carry = P.best_fit(carry + rows[at : at + 1000], 100, at + 1000 >= 2500)
        bins += made
    got = P.pack_table(df, "id", "n", 100).collect()  # a single shard, as one sequential run over chunks
    assert {(r.id, r["pack"], r.pos) for r in got} == {(k, i, j) for i, b in enumerate(bins) for j, (k, _) in enumerate(b)}
    odd = spark.createDataFrame([(1, None), (None, 7), (2, 500)], "id int, n int")
    assert sorted((r.id or 0, r.n) for r in P.pack_table(odd, "id", "n", 100).collect()) == [(0, 7), (1, 0), (2, 500)]
    assert P.pack_table(df.limit(0), "id", "n", 100).count() == 0


def test_running_sums_and_runs_over_buckets(spark):
    """Buckets of the order, with a hot group, an outlier, nulls and ties of no groups, give what one pass gives."""
    n = 9000
    rows = [(None if i == 5 else 10**15 if i == n - 1 else i, i % 3 if i % 2 else None, None if i % 7 == 0 else i % 5 // 2) for i in range(n)]
    df = spark.createDataFrame(rows, "o bigint, g int, v int")
    for by in ([], ["g"]):
        sums, before, want, runs = {}, {}, {}, {}
        for o, g, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            k = g if by else 0
            if v is not None:
                sums[k] = sums.get(k, 0) + v
            fresh = k not in before or before[k][0] != v
            before[k] = (v, before.get(k, (0, 0))[1] + fresh)
            want[o], runs[o] = sums.get(k), before[k][1]
        assert {r.o: r.s for r in O.running(df, F.col("v"), by, "o", "s").collect()} == want
        assert {r.o: r["run"] for r in W.runs(df, "v", by, "o").collect()} == runs
        assert W.runs(df, "v", by, "o").columns == ["o", "g", "v", "run"]
    text = spark.createDataFrame([("b", 1), ("a", 2)], "o string, v int")
    assert {r.o: r.s for r in O.running(text, F.col("v"), [], "o", "s").collect()} == {"a": 2, "b": 3}



def test_rewards(spark):
    assert value(spark, RW.think_answer_format(F.lit("<think>a</think>\n<answer>b</answer>"))) == 1.0
    assert value(spark, RW.think_answer_format(F.lit("x\n<think>a</think><answer>b</answer>"))) == 0.0
    assert value(spark, RW.repetition(F.lit("a b c a b c"))) == -0.25
    assert value(spark, RW.soft_overlong(F.lit(90), 100, 20)) == -0.5
    for a, b, same in (("\\boxed{1/2}", "\\boxed{0.5}", 1.0), ("<answer>1,000</answer>", "\\boxed{1000}", 1.0), ("\\boxed{x}", "\\boxed{y}", 0.0)):
        assert value(spark, RW.math_accuracy(F.lit(a), F.lit(b))) == same
    assert RW.action_score('Action: f\nAction Input: {"a": 1}', 'Action: f\nAction Input: {"a": 1}') == 1.0
    assert RW.action_score('Action: f\nAction Input: {"a": 2}', 'Action: f\nAction Input: {"a": 1}') == 0.0
    assert RW.countdown_score("<answer>(3+4)*2</answer>", 14, [2, 3, 4]) == 1.0 and RW.countdown_score("<answer>7*2</answer>", 14, [2, 3, 4]) == 0.0
    assert value(spark, RW.mean_judgement(F.array(F.lit("Reward: 0.5"), F.lit("none"), F.lit("Reward: 1")))) == 0.75


@pytest.mark.parametrize("form", sorted(A.FORMATS))
def test_formats_read_what_they_write(form):
    f = A.FORMATS[form]
    assert f.calls(f.render_calls([("find", '{"q": "x"}')]))[0][0] == "find"
    assert f.calls("nothing here") == []
    if f.fallback and form != "mistral":  # whose missing block means no calls
        assert f.calls("Action: a\nAction Input: {}") == [("a", "{}")]


def test_merge_calls(spark):
    ms = chat(("user", "u"), ("tool_call", '{"name": "f", "arguments": {"a": 1}}'), ("tool_response", "ok"), ("assistant", "done"))
    got = value(spark, A.merge_calls(ms, "hermes"))
    assert [m.role for m in got] == ["user", "assistant", "tool_response", "assistant"] and '"name": "f"' in got[1].content
    two = chat(("tool_call", '{"name": "f", "parameters": {"a": 1}}'), ("tool_call", '{"name": "g", "arguments": {}}'), ("tool", "x"), ("tool_response", "y"))
    assert [(m.role, m.content) for m in value(spark, A.merge_calls(two, "minimax_m2"))] == [
        ("assistant", '<minimax:tool_call>\n<invoke name="f">\n<parameter name="a">1</parameter>\n</invoke>\n<invoke name="g">\n\n</invoke>\n</minimax:tool_call>'),
        ("tool_response", "<response>x</response>\n<response>y</response>"),
    ]
    assert [m.content for m in value(spark, A.merge_calls(two, "react_en"))] == ["Action: f\nAction Input: {'a': 1}\nAction: g\nAction Input: {}\nObservation:", "x\nObservation:y\n"]
    assert [m.content for m in value(spark, A.merge_calls(chat(("tool_call", "not a call")), "hermes"))] == ['<tool_call>\n{"name": "", "arguments": "not a call"}\n</tool_call>']


def test_bare_objects_with_nested_arguments():
    said = 'Sure. {"name": "f", "parameters": {"a": {"b": "}{"}, "c": [1, {}]}} and {"x": {"name": "g", "parameters": {}}} {"name": "h"} {'
    assert A.FORMATS["llama3"].calls(said) == [("f", '{"a": {"b": "}{"}, "c": [1, {}]}'), ("g", "{}")]
    assert A.FORMATS["hunyuan_hermes"].calls('<tool_calls>\n<tool_call>f\n```json\n{"a": 1}\n```</tool_call>\n</tool_calls>') == [("f", '{"a": 1}')]
    assert A.FORMATS["seed_oss"].calls("<seed:tool_call><function=f><parameter=a> 1 </parameter></function></seed:tool_call>") == [("f", '{"a": " 1 "}')]


TOOLS = [
    {"type": "function", "function": {"name": "tides", "description": "High water at a port", "parameters": {"type": "object", "properties": {"port": {"type": "string", "description": " Its name "}, "day": {"type": "integer", "minimum": 1}}, "required": ["port"]}}},
    {"name": "knots", "description": "Speed", "returns": {"properties": {"speed": {"type": "number", "description": "in knots"}}}},
]


FIXED_LENGTHS = {"react_en": 530, "react_zh": 254, "react_grpo": 987, "toolbench": 1427, "qwen_en": 389, "qwen_zh": 147, "qwen_en_parallel": 522, "qwen_zh_parallel": 258, "hermes": 374, "hunyuan_hermes": 436, "llama3": 270, "llama4": 270, "chatglm4": 85, "glm4": 8, "glm4_5": 445, "glm4_7": 439, "qwen3_coder": 890, "qwen3_5": 888, "deepseek_v3_1": 506, "minimax_m2": 414, "mistral": 35, "seed_oss": 0, "youtu": 356}


def test_tool_prompts():
    """The lengths are of the fixed texts; each format shows every tool and the system prompt where it has a place."""
    import re

    fixed = {k: len(re.sub(r"\{\{[A-Z]+\}\}", "", p.prompt)) for k, p in TL.PROMPTS.items()}
    assert fixed == FIXED_LENGTHS
    assert set(TL.PROMPTS) == set(A.FORMATS)
    for form in TL.PROMPTS:
        system, query = TL.fill_prompt(form, TOOLS, "Be {{TOOLS}} brief.", "When?")
        both = system + query
        assert both.count("tides") and both.count("knots") and both.count("When?") == 1
        assert ("Be {{TOOLS}} brief." in system) == (form not in ("react_en", "react_zh", "react_grpo", "toolbench", "chatglm4", "glm4")) or form in ("chatglm4", "glm4")
    assert TL.fill_prompt("glm4_7", TOOLS)[0].startswith("\n# Tools") and TL.fill_prompt("qwen3_coder", TOOLS)[0].startswith("You are Qwen")
    assert "def tides(port: str,day: int):" in TL.fill_prompt("seed_oss", TOOLS)[0] and "    - speed (int): in knots" in TL.fill_prompt("seed_oss", TOOLS)[0]
    coder = TL.fill_prompt("qwen3_coder", TOOLS)[0]
    assert "<name>day</name>\n<type>integer</type>\n<minimum>1</minimum>\n</parameter>\n<required>[\"port\"]</required>\n</parameters>" in coder


def test_tool_prompts_of_rows(spark):
    rows = [(1, json.dumps(TOOLS), "S", "q"), (2, None, "S", "q"), (3, "[]", None, None), (4, '[{"description": "nameless"}]', "S", "q"), (5, "no list", "S", "q"), (6, json.dumps([json.dumps(t) for t in TOOLS]), None, "q")]
    d = spark.createDataFrame(rows, "i int, t string, s string, q string")
    got = {r.i: r.p for r in d.select("i", TL.tool_prompt(F.col("t"), F.col("s"), F.col("q"), "react_en").alias("p")).collect()}
    assert got[1].system == got[6].system and "one of [tides,knots]" in got[1].system and got[1].query == "q"
    assert (got[2].system, got[2].query) == ("S", "q") and (got[3].system, got[3].query) == (None, None)
    assert (got[4].system, got[4].query) == (None, None) and (got[5].system, got[5].query) == ("S", "q")


def test_sampling_counts(spark):
    df = spark.range(10)
    got = O.sample(df, 23, "id").groupBy("id").count().collect()
    assert sum(r["count"] for r in got) == 23 and {r["count"] for r in got} == {2, 3}
    train, val = O.train_val_split(df, 0.3, "id")
    assert val.count() == 3 and train.join(val, "id").count() == 0
    with pytest.raises(ValueError):
        O.train_val_split(df, 0.5, "id", 1)
    assert O.max_steps(100, 2, 2, 2, 1.5) == 18
    every = O.interleave([df, spark.range(5)], ["id", "id"], [0.5, 0.5], stop="all_exhausted")
    assert every.select("src", "id").distinct().count() == 15


def test_group_statistics(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "g int, r double")
    got = {(x.g, x.r): x.advantage for x in G.advantages(df, "r", "g").collect()}
    assert math.isclose(got[1, 3.0], 1 / (math.sqrt(2) + 1e-4)) and got[2, 5.0] == 0
    rows = spark.createDataFrame([(1, 1, 0, 1.0), (1, 1, 1, 1.0), (1, 2, 2, 3.0)], "g int, q int, o int, r double")
    assert len(G.request_advantages(rows, "r", "g", "q", "o").collect()) == 3
    draws = lambda i: spark.createDataFrame([(10 + i, 0.0), (10 + i, 1.0)], "g int, r double")
    assert G.dynamic_sampling(df, draws, "r", "g", 2).select("g").distinct().count() == 2
    assert math.isclose(value(spark, G.entropy(F.array(F.lit(0.0), F.lit(0.0)))), math.log(2))


def test_metrics(spark):
    assert M.rouge_l_value("a b c d".split(), "a c d".split()) == 6 / 7
    assert math.isclose(M.bleu4_value(list("abcdef"), list("abcdef")), 1.0)
    assert math.isclose(value(spark, M.rouge_n(F.lit("a b c"), F.lit("a b d"), 2)), 0.5)
    t = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 0.0, 0.0)], "t int, c int, s double, u double")
    assert abs(M.jensen_shannon(t, "t", "c", "s", "u").first().jsd) < 1e-12
    pairs = spark.createDataFrame([([(1, 1), (-100, 5), (2, 3)],)], "p array<struct<label:int,pred:int>>")
    assert M.token_accuracy(pairs, "p").first().acc == 0.5 and M.token_accuracy(pairs, "p", "sequence").first().acc == 0.0
    assert M.flatten_metrics({"a": 1.0, "b": {"x": 2.0, "y": None}}) == {"a": 1.0, "b_x": 2.0}


def test_windows(spark):
    got = value(spark, W.ema(F.array(F.lit(1.0), F.lit(2.0)), 0.5))
    assert got[0] == 1.0 and math.isclose(got[1], 2.5 / 1.5)
    assert value(spark, W.position_ids(F.array(F.lit(2), F.lit(0), F.lit(3)))) == [0, 1, 0, 1, 2]


def test_preference(spark):
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "id bigint, text string")
    got = S.negatives(df, "id", "text", 3).join(df, "id").collect()
    assert len(got) == 60 and all(r.negative != r.text for r in got)
    ms = N.rejected_messages(chat(("user", "a"), ("assistant", "b")), F.lit("z"))
    assert [m.content for m in value(spark, ms)] == ["a", "z"]


def test_streams(spark, tmp_path):
    from parley.streaming import streams as T

    src = str(tmp_path / "in")
    spark.range(20).select("id", F.lit(0).cast("bigint").alias("shard"), (F.col("id") % 4 + 1).alias("n"), (F.col("id") == 19).alias("done")).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    T.run_to_end(T.take_skip(T.read_stream(spark, src, schema), 5, 3, "id"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [3, 4, 5, 6, 7]
    T.run_to_end(T.pack_stream(T.read_stream(spark, src, schema), "shard", "id", "n", 8, "done"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    out = spark.read.parquet(str(tmp_path / "o2"))
    assert out.count() == 19 and out.groupBy("pack").agg(F.sum("length").alias("s")).agg(F.max("s")).first()[0] <= 8


def test_token_arrays(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, R.end_tokens(a(1, 2, 8, 9, 3, 8, 9), a(-100, 2, -100, -100, -100, -100, -100), [8, 9])) == [-100, 2, 8, 9, -100, -100, -100]
    got = value(spark, R.extend_tokens(a(1, 7, 2), a(1, 7, 2), 7, a(5, 5)))
    assert got.ids == [1, 5, 5, 2] and got.labels == [1, -100, -100, 2]
    ms = chat(("user", "u"), ("assistant", "a"), ("user", "v"), ("assistant", "b"))
    assert [m.content for m in value(spark, R.replace_responses(ms, a("z")))] == ["u", "a", "v", "z"]
    assert value(spark, R.decode_classes(a(0.1, 0.9, 0.3))) == 1 and value(spark, R.decode_classes(a(0.1, -0.9, 0.3), True)) == [0, 2]
    assert [p.cls for p in value(spark, R.top_logprobs(a(0.1, 0.9, 0.3), 2))] == [1, 2]


def test_round_trips_of_own_arguments(spark):
    """Each row's own call goes through every format; a null has none."""
    d = spark.createDataFrame([(1, '{"k": 7}'), (2, '{"k": 88}'), (3, None)], "i int, a string")
    got = {r.i: r.c for r in d.select("i", A.round_trips("lookup", F.col("a")).alias("c")).collect()}
    for i, k in ((1, 7), (2, 88)):
        assert [c.format for c in got[i]] == list(A.FORMATS) and {c.name for c in got[i]} == {"lookup"}
        assert {c.arguments for c in got[i]} == {f'{{"k": {k}}}', f'{{"k": "{k}"}}', f"{{'k': {k}}}"}
    assert got[3] is None


def test_rows_with_null_keys_and_outliers_stay(spark):
    from parley.operators import ordering as O

    keys = [None, 1, 2, 3, None] + [10**15] + [i << 40 for i in range(4, 9)]
    df = spark.createDataFrame([(k,) for k in keys], "id bigint")
    for ranked in (O.hash_rank(df, "id"), O.key_rank(df, "id")):
        assert sorted(r.rn for r in ranked.collect()) == list(range(1, len(keys) + 1))
    assert [r.id for r in O.key_rank(df, "id").orderBy("rn").collect()] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert O.sample(df, 7, "id").count() == 7 and O.sample(df, 30, "id").count() == 30
    train, val = O.train_val_split(df, 0.3, "id")
    assert train.count() + val.count() == len(keys)


def test_key_order_is_dealt_in_even_buckets(spark):
    from parley.operators import ordering as O

    df = spark.range(20000).selectExpr("CASE WHEN id < 19990 THEN id ELSE id << 40 END AS k").repartition(3)
    buckets = [r["count"] for r in df.groupBy(O.quantile_bucket(df, "k").alias("b")).count().collect()]
    assert len(buckets) > 4 and max(buckets) < 3 * 20000 / len(buckets)
    ranked = O.key_rank(df, "k").collect()
    assert [r.k for r in sorted(ranked, key=lambda r: r.rn)] == sorted(r.k for r in ranked)


def test_packed_rows_join_several_arrays(spark):
    from parley.operators import pack as P

    packed = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 0)], "id long, shard int, pack long, pos long")
    values = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [3], ["c"])], "id long, x array<int>, y array<string>")
    row = P.packed_rows(packed, values, "id", ["x", "y"]).first()
    assert (row.lengths, row.x, row.y) == ([1, 2], [3, 1, 2], ["c", "a", "b"])


def test_boxed_answers_may_have_braces(spark):
    from pyspark.sql import functions as F

    from parley.operators import rewards as RW

    df = spark.createDataFrame([(r"so \boxed{\frac{4}{2}}", r"\boxed{2}"), (r"\boxed{\sqrt{\frac{1}{2}}} or 3", r"\boxed{3}")], "a string, b string")
    assert [r.x for r in df.select(RW.math_accuracy(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0]


def test_exact_quantiles(spark):
    import numpy as np

    from parley.operators import groupstats as G

    rng = np.random.default_rng(1)
    for values in (rng.normal(size=9000).tolist(), [1.0], [2.0, 1.0], [3.0] * 5000 + [1e12]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        for share in (0.0, 0.2, 0.5, 0.973, 1.0):
            assert abs(G.exact_quantile(df, "v", share) - np.quantile(values, share)) <= 1e-9 * max(1, abs(np.quantile(values, share)))
    assert G.exact_quantile(df.where("false"), "v", 0.5) is None


def test_quantiles_are_exact_whatever_a_second_sketch_would_say(spark, monkeypatch):
    """Sketches of the same rows differ with the order in which tasks end; here each call cuts elsewhere."""
    from itertools import count

    from pyspark.sql import functions as F

    from parley.operators import groupstats as G
    from parley.operators import ordering as O

    widths = count(7)
    monkeypatch.setattr(O, "quantile_bucket", lambda df, key: F.floor(F.col(key) / next(widths)))
    df = spark.range(100).selectExpr("CAST(id AS double) AS v").repartition(3)
    assert [G.exact_quantile(df, "v", share) for share in (0.0, 0.25, 0.5, 1.0)] == [0.0, 24.75, 49.5, 99.0]


def test_row_functions_give_any_number_of_rows(spark):
    import pytest

    from parley.operators import normalize as N

    df = spark.range(6)

    def odd(row):
        if row["id"] == 5:
            raise ValueError("no")
        return None if row["id"] % 2 else [{"x": row["id"], "y": None}] * row["id"]

    got = N.map_rows(df, odd, "x bigint, y string", strict=False).collect()
    assert sorted(r.x for r in got) == [2, 2, 4, 4, 4, 4]
    with pytest.raises(Exception, match="no"):
        N.map_rows(df, odd, "x bigint, y string").collect()


def test_results_are_written_in_shards(spark, tmp_path):
    from parley.sources import sinks

    df = spark.range(10).selectExpr("id", "concat('r', id) AS answer", "id % 2 AS y")
    for _ in range(2):  # a second run overwrites the shards
        sinks.write_results(df, str(tmp_path / "out"), "id", 4, "answer", "y")
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.shard, r.id, r.response, r.labels) for r in back.collect()) == [(i // 4, i, f"r{i}", i % 2) for i in range(10)]
    assert sinks.save_validation(None, str(tmp_path)) is None
    at = sinks.save_validation(df, str(tmp_path))
    assert at.endswith("val_dataset.jsonl") and spark.read.json(at).count() == 10


def test_values_of_negatives_are_shuffled_once(spark, tmp_path):
    """Shuffles hold about one copy of the values, not one for each negative; rows are those of the ring written out."""
    import hashlib
    import random

    from parley.operators import preference as S

    made = random.Random(1)
    texts = [made.randbytes(4000).hex() for _ in range(300)]
    rows = [(i, None if i == 7 else texts[i % 250]) for i in range(300)]
    spark.createDataFrame(rows, "id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/t")

    def written():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    got = {(r.id, r.rank): r.negative for r in S.negatives(spark.read.parquet(f"{tmp_path}/t"), "id", "text", 3).collect()}
    assert written() - before < 2.5 * sum(len(t or "") for _, t in rows)
    digest = lambda x: hashlib.md5(f"{x}-42".encode()).hexdigest()
    ring = sorted({t for _, t in rows if t}, key=digest)
    want = {}
    for i, own in rows:
        at = int(digest(i)[:8], 16) % len(ring)
        others = [t for t in (ring[(at + j) % len(ring)] for j in range(4)) if t != own][:3]
        want |= {(i, j + 1): t for j, t in enumerate(others)}
    assert got == want


def test_calls_are_made_once_for_each_distinct_text_of_a_part(monkeypatch):
    import pyarrow as pa

    from parley.operators import agent as A

    monkeypatch.setattr(A, "PART_BYTES", 6, raising=False)
    made = []
    parts = list(A.by_distinct(pa.array(["aa", None, "aa", "b", "long long", "aa", "aa", None]), pa.list_(pa.string()), lambda t: made.append(t) or [t, t]))
    assert [x for p in parts for x in p.to_pylist()] == [t and [t, t] for t in ("aa", None, "aa", "b", "long long", "aa", "aa", None)]
    assert made == ["aa", "b", "long long", "aa"]


def test_prompts_of_several_formats_are_one_worker_s(spark):
    from pyspark.sql import functions as F

    from parley.operators import tools as TL

    tool = '[{"name": "f", "description": "d", "parameters": {}}]'
    rows = [(tool, "s", "q"), (None, "s", None), ("[{}]", None, "q"), ('[{"description": 1}]', "s", "q")]
    df = spark.createDataFrame(rows, "t string, s string, q string").coalesce(1)
    told, forms = [F.col(c) for c in "tsq"], list(TL.PROMPTS)
    got = df.select(TL.tool_prompts(*told, forms).alias("p"))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = df.select(*[TL.tool_prompt(*told, f).alias(f) for f in forms[::4]]).collect()
    for made, row in zip(got.collect(), want):
        assert [p.format for p in made.p] == forms and {p.format: (p.system, p.query) for p in made.p if p.format in row} == {f: tuple(row[f]) for f in forms[::4]}
