"""The registered queries on the smallest given tables, against their SQL."""

import math
import os
from pathlib import Path

import pytest

from parley.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for at in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {at.stem} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    result = db.execute(ORACLE_SQL[name])
    names = sorted(c[0] for c in result.description)
    place = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(df.columns) == names
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(plain(r[place[c]]) for c in names) for r in result.fetchall())


def test_entry_works_without_the_corpus_operators(tmp_path):
    """A copy of the repository without the llm folders imports and registers the other queries."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_render_conversations' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
