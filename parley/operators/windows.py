"""Window-shaped operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordering import key_rank, running


def previous_in_batch(df: DataFrame, value: str, batch: str, order: str, out: str = "rejected_response") -> DataFrame:
    """Each row gets the value of the row before it in its batch, the first one that of the batch's last row."""
    w = Window.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.lag(value).over(w), F.last(value).over(whole)))


def ema(values: Column, smooth: float = 0.9) -> Column:
    """Debiased exponential averages of an array: x = x * s + v, n = n * s + 1, x / n; null of null. One pass over the array."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = []
            for row in part:
                x = n = 0.0
                out = None if row is None else []
                for v in () if row is None else row:
                    x, n = x * smooth + v, n * smooth + 1
                    out.append(x / n)
                rows.append(out)
            yield pd.Series(rows, dtype=object)

    return run(values.cast("array<double>"))


def last_user_round(messages: Column) -> Column:
    """Index of the last user turn of an array of messages, -1 without one."""
    return F.coalesce(F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i).otherwise(-1))), F.lit(-1))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(key, *[F.col(f"_last.`{c}`").alias(c) for c in rest]).select(*df.columns)


def dense_ids(df: DataFrame, key: str, order: str, out: str = "prompt_id") -> DataFrame:
    """Dense ids of key in order of first appearance, from 0. Distinct keys are ranked, not rows."""
    first = key_rank(df.groupBy(key).agg(F.min(order).alias("_first")), "_first", "_rank")
    named = first.select(F.col(key).alias("_key"), (F.col("_rank") - 1).alias(out))
    return df.join(named, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def groups_at(df: DataFrame, starts: Column, by: list[str], order: str, out: str = "grp") -> DataFrame:
    """Number of rows so far, within `by`, at which a group starts; 0 before the first one."""
    return running(df, F.when(starts, 1).otherwise(0), by, order, out)


def sessions(df: DataFrame, starts: Column, by: list[str], order: str, items: list[str]) -> DataFrame:
    """Runs of rows from one start to the next, as arrays of structs in order; rows before the first start are a session."""
    grouped = groups_at(df, starts, by, order, "session")
    return grouped.groupBy(*by, "session").agg(F.array_sort(F.collect_list(F.struct(order, *items))).alias("items"))


def running_boundaries(df: DataFrame, length: str, by: list[str], order: str) -> DataFrame:
    """start and end of each row in the concatenation of its group."""
    return running(df, F.col(length), by, order, "end").withColumn("start", F.col("end") - F.col(length))


def position_ids(lengths: Column) -> Column:
    """Positions that start again at 0 for each length."""
    return F.flatten(F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))))


def shifted_pairs(labels: Column, preds: Column) -> Column:
    """Pairs of labels[1:] and preds[:-1]."""
    n = F.greatest(F.least(F.size(labels), F.size(preds)) - 1, F.lit(0))
    return F.arrays_zip(F.slice(labels, 2, n).alias("label"), F.slice(preds, 1, n).alias("pred"))


def runs(df: DataFrame, value: str, by: list[str], order: str, out: str = "run") -> DataFrame:
    """Number of the run of equal values that a row is in."""
    same = F.col("_before").isNotNull() & F.col(value).eqNullSafe(F.col("_before.v"))
    return running(df, F.when(same, 0).otherwise(1), by, order, out, value)


def early_stop(df: DataFrame, metric: str, order: str, by: list[str] = (), patience: int = 3, greater: bool = True) -> DataFrame:
    """stale: evaluations since the best metric last improved strictly; stop where it reaches the patience. A row is an
    evaluation of a training run, so a group is short."""
    w = Window.partitionBy(*by).orderBy(order)
    best = (F.max if greater else F.min)(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = best.isNull() | ((F.col(metric) > best) if greater else (F.col(metric) < best))
    marked = df.withColumn("_better", better).withColumn("_at", F.row_number().over(w))
    last = F.max(F.when(F.col("_better"), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("stale", F.col("_at") - last).withColumn("stop", F.col("stale") >= patience).drop("_better", "_at")
