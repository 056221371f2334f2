"""Readers of files, folders and caches."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_file(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A table by its extension: jsonl and json (an array of objects), csv with empty cells as empty texts, txt, parquet and
    whatever else Spark reads by name."""
    kind = kind or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
        return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])  # a cell is never null
    if kind == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    return spark.read.format(kind).load(path)


def read_folder(spark: SparkSession, path: str, subset: str = "default", splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """A folder of subset=name/split=name partitions, or of one file per split; splits are united in order."""
    out = None
    for split in splits:
        tries = [f"{path}/subset={subset}/split={split}", *(f"{path}/{subset}/{split}.{k}" for k in ("parquet", "jsonl", "json", "csv", "txt")), *(f"{path}/{split}.{k}" for k in ("parquet", "jsonl", "json", "csv", "txt"))]
        found = next((t for t in tries if _exists(spark, t)), None)
        if found is None:
            raise FileNotFoundError(f"{path} has no split {split} of {subset}")
        d = spark.read.parquet(found) if found.startswith(f"{path}/subset=") else read_file(spark, found)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one JSON value of any type per line, as text."""
    return spark.read.text(path).where(F.trim("value") != "")


def read_cached(spark: SparkSession, path: str, most: int | None = None, rows: int | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """A table with lengths; an older `length` column counts as one. Rows beyond the limit go; rows samples."""
    from parley.operators.ordering import sample

    df = spark.read.parquet(path)
    if "lengths" not in df.columns and "length" in df.columns:
        c = F.col("length")
        df = df.withColumn("lengths", c if df.schema["length"].dataType.typeName() == "array" else F.array(c)).drop("length")
    if most is not None:
        df = df.where(F.array_max("lengths") <= most)
    return df if rows is None else sample(df, rows, key, seed)


def read_choices(spark: SparkSession, paths: list[str], key: str = "id") -> DataFrame:
    """Choices by id over files: the last message of each row. Missing files are left out."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], f"{key} string, choices array<string>")
    rows = spark.read.json(found)
    return rows.groupBy(key).agg(F.collect_list(F.element_at("messages", -1)["content"]).alias("choices"))


def json_option(value: str | dict | None, strict: bool = True) -> dict:
    """A dict from a dict, a file or JSON text; text that doesn't parse is repaired (quotes, trailing commas) or raises."""
    if value is None or isinstance(value, dict):
        return value or {}
    if os.path.exists(value):
        with open(value, encoding="utf-8") as f:
            value = f.read()
    try:
        return json.loads(value)
    except ValueError:
        import re

        fixed = re.sub(r",\s*([}\]])", r"\1", value.strip().replace("'", '"'))
        fixed = fixed if fixed.startswith("{") else "{" + fixed + "}"
        try:
            return json.loads(fixed)
        except ValueError:
            if strict:
                raise
            return {}
