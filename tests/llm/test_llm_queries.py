"""The registered queries on the smallest given tables, against their SQL, and the pipeline."""

import os
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


def test_sql(spark):
    import duckdb

    from parley.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        at = Path(SF, f"{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        result = db.execute(sql)
        names = sorted(c[0] for c in result.description)
        place = {c[0]: i for i, c in enumerate(result.description)}
        want = sorted(str([row[place[c]] for c in names]) for row in result.fetchall())
        assert sorted(df.columns) == names
        assert sorted(str([row[c] for c in names]) for row in df.collect()) == want, name


def test_pipeline(spark):
    """Every stage against brute force on what its predecessor kept."""
    import hashlib

    import corpus_pipeline
    import test_llm_operators as brute
    from parley.llm import bpe, toxicity

    tiktoken = pytest.importorskip("tiktoken")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept, before = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, SF).cache()
        assert before.columns == docs.columns, name
        kept.append({r.doc_id: r.text for r in before.collect()})
    clean, single, uncontaminated, redacted = kept
    scores = toxicity.toxicity_report(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0")
    assert set(clean) == {r.doc_id for r in scores.collect()}
    assert set(single) == {d for d, _, c in brute.classes(sorted(clean.items())) if d == c}
    found = {d: brute.leaks(t, items) for d, t in single.items()}
    assert set(uncontaminated) == {d for d, f in found.items() if f[2] < 2}
    for d, t in uncontaminated.items():
        assert len(brute.decontaminate.words_of(t)) == found[d][0] - found[d][1] or found[d][1]
        assert found[d][1] or t == single[d]
    assert set(redacted) == set(uncontaminated)
    assert all(brute.base_spans(t)[:3] == (0, 0, 0) for t in redacted.values())
    assert all(t == redacted[d] for d, t in uncontaminated.items() if brute.base_spans(t)[:3] == (0, 0, 0) and "[SECRET]" not in (redacted[d] or ""))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = set()
    for d, t in redacted.items():
        ids = coder.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_take_odd_tables(spark):
    """Nulls, empty texts, repeated rows, clashing and dotted columns, and no rows at all."""
    import corpus_pipeline
    import test_llm_operators as brute

    docs = brute.documents(spark).withColumnRenamed("_row", "_found").cache()
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            n = out.count()
            assert n <= frame.count() and (name == "byte-level BPE" or out.columns == frame.columns), name
            assert n == frame.count() or name in ("toxicity", "n-gram Jaccard join"), name
