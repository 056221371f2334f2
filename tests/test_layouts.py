"""Layouts of instruction, chat and preference corpora to the same canonical rows."""

import json

import pytest
from pyspark.sql import functions as F

from parley.operators import normalize as N
from parley.operators import transforms as X
from parley.operators import validate as V
from parley.plans.load import load
from parley.sources.catalog import Catalog, Dataset, Reference, Subset, parse_reference
from parley.sources.readers import json_option, read_cached, read_file
from parley.sources.sinks import sanitize, write_jsonl, write_store


def turns(df):
    return [[(m.role, m.content) for m in r.messages] for r in df.orderBy("_n").collect()]


def numbered(df):
    return df.withColumn("_n", F.monotonically_increasing_id())


def write(tmp_path, name, text):
    at = tmp_path / name
    at.write_text(text, encoding="utf-8")
    return str(at)


TIDES = [
    {"instruction": "When is high water?", "input": "Port: Husum", "output": "At noon."},
    {"instruction": "And at night?", "input": "", "output": "Shortly after twelve.", "system": "You keep the tide tables.", "history": [["Hello", "Good day"], ["Are you there?", "Always"]]},
    {"instruction": "Thanks", "input": None, "output": "Fair winds!", "history": []},
]


def test_instruction_rows(spark, tmp_path):
    """Instruction and input join by a line break, where there is an input; history and system prompt come first."""
    at = write(tmp_path, "tides.jsonl", "\n".join(map(json.dumps, TIDES)))
    first, second, third = turns(N.auto(numbered(read_file(spark, at))))
    assert first == [("user", "When is high water?\nPort: Husum"), ("assistant", "At noon.")]
    assert second[0] == ("system", "You keep the tide tables.") and [r for r, _ in second[1:]] == ["user", "assistant"] * 3
    assert [c for _, c in second[1:]] == ["Hello", "Good day", "Are you there?", "Always", "And at night?", "Shortly after twelve."]
    assert third == [("user", "Thanks"), ("assistant", "Fair winds!")]


def test_empty_csv_cells_are_empty_texts(spark, tmp_path):
    at = write(tmp_path, "depths.csv", "instruction,input,output,system\nDepth?,Buoy 7,4.25,Answer in metres\nWind?,,calm,\n")
    assert turns(N.auto(numbered(read_file(spark, at)))) == [
        [("system", "Answer in metres"), ("user", "Depth?\nBuoy 7"), ("assistant", "4.25")],
        [("system", ""), ("user", "Wind?"), ("assistant", "calm")],
    ]


SAID = (("Pilot", "You are a pilot."), ("user", "Which channel?"), ("assistant", "The northern one."))


@pytest.mark.parametrize(
    "row",
    [
        {"messages": [{"role": "system", "content": SAID[0][1]}, *({"role": r, "content": c} for r, c in SAID[1:])]},
        {"conversations": [{"from": f, "value": v} for f, (_, v) in zip(("system", "human", "gpt"), SAID)]},
        {"conversation": [{"human": SAID[1][1], "assistant": SAID[2][1]}], "system": SAID[0][1]},
        {"response": SAID[2][1], "query": SAID[1][1], "system": SAID[0][1]},
    ],
    ids=["roles", "speakers", "pairs", "columns"],
)
def test_chat_spellings(spark, tmp_path, row):
    at = write(tmp_path, "pilots.json", json.dumps([row]))
    assert turns(N.auto(numbered(read_file(spark, at)))) == [[("system", SAID[0][1]), *SAID[1:]]]


def test_literal_history(spark):
    df = numbered(spark.createDataFrame([("q", "r", "[['a', 'b'], ['c', None]]"), ("q", "r", None)], "query string, response string, history string"))
    assert turns(N.query_response(df)) == [[("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "q"), ("assistant", "r")], [("user", "q"), ("assistant", "r")]]


def test_rename_collisions(spark):
    df = spark.createDataFrame([("a", "b", "c")], "Prompt string, query string, Output string")
    assert N.safe_rename(df, N.synonym_map()).columns == ["Prompt", "query", "response"]


def test_objects_and_media(spark):
    df = spark.range(1).select(F.struct(F.array(F.lit("r")).alias("ref"), F.array(F.array(F.lit(9.0), F.lit(8.0), F.lit(1.0), F.lit(2.0))).alias("bbox"), F.lit("real").alias("bbox_type"), F.lit(None).cast("array<bigint>").alias("image_id")).alias("o"), F.lit("x.png").alias("images"), F.lit("v.mp4").alias("videos"))
    assert df.select(N.normalize_objects(F.col("o")).alias("o")).first().o.bbox == [[1.0, 2.0, 9.0, 8.0]]
    row = N.cast_media(df).first()
    assert row.images[0].path == "x.png" and row.videos == ["v.mp4"]


def test_validity(spark):
    df = spark.range(1).select(F.array(N.message("user", F.lit("a"))).alias("messages"))
    bad = df.select(F.array(N.message("narrator", F.lit("a"))).alias("messages"))
    good, rejects = V.split_valid(df.union(bad), V.message_fault(F.col("messages")))
    assert good.count() == 1 and [r.reason for r in rejects.collect()] == ["illegal role"]
    with pytest.raises(Exception, match="illegal role"):
        V.split_valid(bad, V.message_fault(F.col("messages")), strict=True)[0].collect()
    spans = spark.createDataFrame([([(0, 3), (2, 5)],), ([(4, 6), (0, 4)],), ([],)], "s array<struct<start:int,end:int>>")
    assert [r[0] for r in spans.select(V.has_overlap(F.col("s"))).collect()] == [True, False, False]


def test_references():
    there = {"/data/a:b#c"}.__contains__
    assert parse_reference("hf::org/name:s1/ s2#10", there) == Reference("org/name", ("s1", "s2"), 10, "hf")
    assert parse_reference("/data/a:b#c", there) == Reference("/data/a:b#c")
    assert parse_reference("/data/a:b#c#5", there) == Reference("/data/a:b#c", (), 5)
    assert parse_reference("ms::x:y#1", there).text() == "ms::x:y#1"


def test_catalog():
    c = Catalog()
    d = Dataset(hub_ids=("org/name",), subsets=(Subset("a", "a"), Subset("b", "b", weak=True)))
    c.register(d)
    with pytest.raises(ValueError):
        c.register(d)
    assert c.find(parse_reference("/x/datasets--org--name/snapshots/1", lambda p: False)) is d
    assert [s.name for s in d.select(("all",))] == ["a"] and d.select(("zz",))[0].subset == "zz"
    with pytest.raises(ValueError):
        d.select()
    assert c.register_info('[{"dataset_name": "n", "columns": {"q": "query"}}]')[0].name == "n"


def test_load(spark, tmp_path):
    rows = [{"query": f"q{i}", "response": f"r{i}"} for i in range(50)] + [{"query": None, "response": None}]
    at = write(tmp_path, "d.jsonl", "\n".join(map(json.dumps, rows)))
    train, val = load(spark, f"{at}#40", ratio=0.1)
    assert (train.count(), val.count()) == (36, 4)
    assert not {r.messages[0].content for r in train.collect()} & {r.messages[0].content for r in val.collect()}
    both, none = load(spark, [at, at])
    assert both.count() == 100 and none is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"x"), "t")], "a int, b binary, my_token string")
    assert tuple(sanitize(df).first()) == (1, "<<<bytes>>>", None)
    write_jsonl(df, str(tmp_path / "o"))
    write_jsonl(df, str(tmp_path / "o"), append=True)
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    write_store(spark.range(100), str(tmp_path / "s"), "id", 10)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
    spark.createDataFrame([(1, 5), (2, 50)], "id int, length int").write.parquet(str(tmp_path / "c"))
    assert [r.id for r in read_cached(spark, str(tmp_path / "c"), 10).collect()] == [1]
    assert json_option("{'a': 1,}") == {"a": 1}


def test_transforms(spark):
    d = spark.createDataFrame([("\n\nHuman: a\n\nAssistant: b", "\n\nHuman: a\n\nAssistant: c")], "chosen string, rejected string")
    r = X.TRANSFORMS["dialogue_preference"](d).first()
    assert [(m.role, m.content) for m in r.messages] == [("user", "a"), ("assistant", "b")] and r.rejected_messages[1].content == "c"
    q = spark.createDataFrame([([3, 4], 7)], "nums array<int>, target int")
    assert "[3, 4]" in X.TRANSFORMS["countdown"](q).first().messages[0].content
    h = spark.createDataFrame([(1, "q", ["h"], ["m"])], "id int, question string, human_answers array<string>, machine_answers array<string>")
    assert [r.messages[-1].content for r in X.TRANSFORMS["answers_by_source"](h).collect()] == ["h", "m"]
    m = spark.createDataFrame([([0, 1, 1],)], "npy array<int>")
    assert X.TRANSFORMS["multi_label"](m).first().label == [1, 2]
