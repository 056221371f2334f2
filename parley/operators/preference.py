"""Preference and retrieval shapes, and rejection sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordering import hash_key


def scaled(values: Column, low: Column, high: Column) -> Column:
    """Min-max between the extremes, with 1e-5 in the denominator; a constant v becomes min(1, v)."""
    return F.when(high > low, (values - low) / (high - low + 1e-5)).otherwise(F.least(F.lit(1.0), values.cast("double")))


def rejection_sample(df: DataFrame, key: str, prm: str, orm: str, order: str, keep: int, prm_threshold: float = 0.0, orm_threshold: float = 0.0, easy: float | None = None) -> DataFrame:
    """The best `keep` candidates of each key that pass both thresholds and aren't its minimum, paired with that minimum.

    The score is the scaled prm plus ten times the scaled orm. Keys without passing candidates are left out, and those
    with too many right answers if easy is a share. Adds score, rank and rejected, the order key of the minimum.
    """
    # extremes are aggregated and joined back, so that a hot key is reduced where its rows lie
    ends = df.groupBy(F.col(key).alias("_by")).agg(*[f(c).alias(f"_{n}{k}") for k, c in (("p", prm), ("o", orm)) for n, f in (("low", F.min), ("high", F.max))])
    d = df.join(ends, F.col(key).eqNullSafe(F.col("_by")))
    d = d.withColumn("_p", scaled(F.col(prm), F.col("_lowp"), F.col("_highp"))).withColumn("_o", scaled(F.col(orm), F.col("_lowo"), F.col("_higho"))).drop("_by", "_lowp", "_highp", "_lowo", "_higho")
    d = d.withColumn("score", F.col("_p") + 10 * F.col("_o")).withColumn("_ok", (F.col(prm) > prm_threshold) & (F.col(orm) > orm_threshold))
    low = d.groupBy(key).agg(F.min_by(order, F.struct("score", order)).alias("rejected"), F.count(F.lit(1)).alias("_n"), F.sum((F.col(orm) > orm_threshold).cast("int")).alias("_right")).withColumnRenamed(key, "_key")
    d = d.join(low, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("_ok") & (F.col(order) != F.col("rejected")))
    if easy is not None:
        d = d.where(F.col("_right") - 1 < F.floor(F.col("_n") * easy))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order)))
    return d.where(F.col("rank") <= keep).drop("_p", "_o", "_ok", "_n", "_right", "_key")


def negatives(df: DataFrame, key: str, value: str, k: int = 7, seed: int = 42) -> DataFrame:
    """k other values of the table for each row, in pseudo-random order and without its own: pairs (key, negative, rank).

    Distinct values lie on a ring in hash order; a row takes the k that follow its own hash, skipping its value. Places and
    ranks are found with digests in place of values, so values are shuffled once, each distinct one to the rows that take it.
    Values of equal SHA-256 are taken for equal.
    """
    from parley.operators.ordering import global_rank

    order = hash_key(F.col(value), seed)
    name = F.unhex(F.sha2(F.col(value).cast("string").cast("binary"), 256))
    named = df.select(key, F.unhex(order).alias("_order"), F.when(F.col(value).isNotNull(), name).alias("_name"))
    distinct = named.where("_name IS NOT NULL").select("_order", "_name").distinct()
    n = distinct.count()
    if not n:
        return df.select(key, F.lit(None).cast("string").alias("negative"), F.lit(0).alias("rank")).limit(0)
    ring = global_rank(distinct, [F.col("_order"), F.col("_name")], F.conv(F.substring(F.hex("_order"), 1, 3), 16, 10).cast("int"), "_at").select("_at", "_name")
    start = F.pmod(F.conv(F.substring(hash_key(F.col(key), seed), 1, 8), 16, 10).cast("bigint"), F.lit(n))
    own = named.drop("_order").join(ring.withColumnRenamed("_at", "_own"), "_name", "left")
    places = F.transform(F.sequence(F.lit(0), F.lit(min(k, n - 1))), lambda i: F.pmod(start + i, F.lit(n)) + 1)
    others = F.slice(F.filter(places, lambda at: ~at.eqNullSafe(F.col("_own"))), 1, k)
    seats = own.select(key, F.posexplode(others).alias("_i", "_at")).join(ring, "_at").select(key, "_name", (F.col("_i") + 1).alias("rank"))
    values = df.where(F.col(value).isNotNull()).groupBy(name.alias("_name")).agg(F.first(value).alias("negative"))
    return seats.join(values, "_name").select(key, "negative", "rank")


def embedding_rows(anchor: Column, positives: Column, negatives_: Column, label: Column | None = None) -> Column:
    """struct(texts, labels): anchor, the first positive, all negatives."""
    first = F.coalesce(label.cast("double"), F.lit(1.0)) if label is not None else F.lit(1.0)
    return F.struct(F.concat(F.array(anchor), F.slice(positives, 1, 1), negatives_).alias("texts"), F.concat(F.array(first), F.transform(negatives_, lambda x: F.lit(0.0))).alias("labels"))


def rerank_rows(anchor: Column, positives: Column, negatives_: Column) -> Column:
    """array<struct<messages, label>>: the anchor with each candidate."""
    def rows(c: Column, y: int) -> Column:
        return F.transform(c, lambda x: F.struct(F.concat(anchor, x).alias("messages"), F.lit(y).alias("label")))

    return F.concat(rows(positives, 1), rows(negatives_, 0))


def distilled(thinking: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>"), thinking, F.lit("</think>\n\n<answer>"), answer, F.lit("</answer>"))


def row_id(df: DataFrame, leave: tuple[str, ...] = ("choices",)) -> Column:
    """md5 of the row as JSON with sorted keys, some left out."""
    return F.md5(F.to_json(F.struct(*sorted(c for c in df.columns if c not in leave))))


def cached_choices(df: DataFrame, cache: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(served, rest): rows with n cached choices, and those to generate."""
    full = cache.where(F.size("choices") == n).select(F.col(key).alias("_k"), "choices")
    served = df.join(full, F.col(key) == F.col("_k")).drop("_k")
    return served, df.join(full, F.col(key) == F.col("_k"), "left_anti")


def outputs_to_inputs(inputs: DataFrame, outputs: DataFrame, key: str, order: str) -> DataFrame:
    """Outputs with their input, the first of each key; an output without input raises."""
    from parley.operators.ordering import keep_first

    first = keep_first(inputs, [key], order)
    marked = outputs.join(first.withColumn("_there", F.lit(True)), key, "left")
    return marked.where(F.assert_true(F.coalesce("_there", F.lit(False)), "an output has no input").isNull()).drop("_there")


def trajectories(rows: DataFrame, local: DataFrame, key: str, order: str, items: list[str]) -> DataFrame:
    """Rows whose key occurs locally, as arrays by key."""
    kept = rows.join(local.select(key).distinct(), key, "left_semi")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *items))).alias("items"))


def consistent_logps(masks: Column, logps: Column) -> Column:
    """Log-probabilities by turn, cleared where their number isn't that of the tokens whose mask is 1."""
    ones = F.aggregate(F.flatten(masks), F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(F.size(F.flatten(logps)) == ones, logps).otherwise(F.array().cast("array<array<double>>"))


def positional_join(inputs: DataFrame, outputs: DataFrame, input_order: str, output_order: str) -> DataFrame:
    """The i-th row of outputs beside the i-th of inputs; tables of different lengths raise. Adds place."""
    from parley.operators.ordering import key_rank

    if inputs.count() != outputs.count():
        raise ValueError("inputs and outputs have different lengths")
    return key_rank(inputs, input_order, "place").join(key_rank(outputs, output_order, "place"), "place")


def preference_rows(chosen: Column, rejected: Column, margin: Column | None = None, label: Column | None = None) -> dict[str, Column]:
    """Columns of an encoded pair: the fields of both sides under their prefixes; for KTO the rejected side may be null, and the
    label is a boolean."""
    out = {"chosen": chosen, "rejected": rejected}
    if margin is not None:
        out["margin"] = margin.cast("double")
    if label is not None:
        out["label"] = label.cast("boolean")
    return out


def preference_collate(df: DataFrame, batch: str, order: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(batch, place, side, value): the chosen rows of a batch in order, then the rejected ones; null sides are left out."""
    from pyspark.sql import Window

    sides = F.array(F.struct(F.lit(0).alias("_s"), F.lit("chosen").alias("side"), F.col(chosen).alias("value")), F.struct(F.lit(1).alias("_s"), F.lit("rejected").alias("side"), F.col(rejected).alias("value")))
    rows = df.select(batch, order, F.inline(sides)).where("value IS NOT NULL")
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(batch).orderBy("_s", order)) - 1)).drop("_s")
