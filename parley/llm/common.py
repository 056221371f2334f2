"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local master, as in tests, gets one of
    our own; a cluster doesn't, since its executors couldn't see each other's files there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="parley-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of the tables that stage_alone's innermost make() has staged so far.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    Void columns aren't supported; an empty frame keeps its schema.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/parley/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    passing = _PASSING.get()
    if passing is not None:
        passing.append(at)
    return spark.read.schema(df.schema).parquet(at)


def stage_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """stage(make(), name), after which the tables that make has staged on the way are deleted, and the driver's garbage is
    collected, so that Spark drops the shuffles that made them. What make stages mustn't be read elsewhere.

    Calls may be nested, and threads don't touch each other's tables. If make fails, its tables stay.
    """
    made: list[str] = []
    token = _PASSING.set(made)
    try:
        out = stage(make(), name)
    finally:
        _PASSING.reset(token)
    outer = _PASSING.get()
    if outer is not None:
        outer.append(made[-1])
    spark = out.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for at in made[:-1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def training_row(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id's decimal text isn't 0 modulo folds; a null id counts as the empty text."""
    return held_out(doc_id, folds) == F.lit(False)


def held_out(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id's decimal text is 0 modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def most_frequent(counts: DataFrame, key: str, most: int) -> pa.Table:
    """At most `most` rows of counts (key, n), those of greatest n, in order of falling n, then key. What is collected is bounded.

    Levels of n, eight to a doubling, are counted first; of the level that is too large to be taken whole, as many of 1024
    parts by hash of the key as there is room for. No task sorts or gathers all rows.
    """
    level, part = F.floor(F.log2("n") * 8), F.pmod(F.xxhash64(key), F.lit(1024))
    room, last, parts = most, None, 0
    for at, n in sorted((tuple(r) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        if n > room:
            last = at
            break
        room -= n
    if last is not None:
        sizes = {r["part"]: r["count"] for r in counts.where(level == last).groupBy(part.alias("part")).count().collect()}
        while parts < 1024 and sizes.get(parts, 0) <= room:
            room -= sizes.get(parts, 0)
            parts += 1
        counts = counts.where((level > last) | ((level == last) & (part < parts)))
    return counts.select(key, "n").toArrow().sort_by([("n", "descending"), (key, "ascending")])


def release() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker process keeps for its next task, by the operator that keeps it.
HELD: dict[str, dict] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives freed memory back to the system when a task ends. Python workers are kept for later
    tasks, also of other stages, and would hold on to it beside the executor's heap. What other operators than `keeps` have
    left in HELD goes when a task begins."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [name for name in HELD if name != keeps]
        for name in others:
            del HELD[name]
        if others:
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
