"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sanitize(df: DataFrame) -> DataFrame:
    """Binary values as <<<bytes>>>, and texts under names with _token as null."""

    def clean(c, kind, name: str):
        if isinstance(kind, T.BinaryType):
            return F.when(c.isNotNull(), F.lit("<<<bytes>>>"))
        if isinstance(kind, T.StringType) and "_token" in name:
            return F.lit(None).cast("string")
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType, name))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    sanitize(df).write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_cached(train: DataFrame | None, val: DataFrame | None, path: str) -> None:
    for name, df in (("train", train), ("val", val)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_store(df: DataFrame, path: str, order: str, rows_a_file: int = 1_000_000) -> None:
    """Parquet in order, of bounded files, whose statistics serve point look-ups by the order key."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)


def lookup(df: DataFrame, order: str, index: int) -> DataFrame:
    """One row of a store by its ordinal; negative ones count from the end."""
    if index < 0:
        index += df.count()
    return df.where(F.col(order) == index)


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """A batch's own partition, overwritten when it is written again: a resumed run repeats a batch without harm."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def save_validation(val: DataFrame | None, folder: str) -> str | None:
    """Keeps a validation set that was split off as val_dataset.jsonl in the folder; none of no set."""
    if val is None:
        return None
    write_jsonl(val, f"{folder}/val_dataset.jsonl")
    return f"{folder}/val_dataset.jsonl"


def write_results(df: DataFrame, path: str, order: str, rows_a_shard: int, response: str = "response", labels: str | None = None) -> None:
    """Inference results in shards of rows_a_shard rows in order, a folder each that a resumed run overwrites: response, labels
    and the input's columns."""
    from parley.operators.ordering import key_rank

    lead = [F.col(response).alias("response"), *([F.col(labels).alias("labels")] if labels else [])]
    rest = [c for c in df.columns if c not in (response, labels)]
    placed = key_rank(df, order, "_rn").withColumn("shard", F.floor((F.col("_rn") - 1) / rows_a_shard))
    rows = sanitize(placed.select(*lead, *rest, "shard"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("shard").json(path)
