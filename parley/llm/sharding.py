"""Sharding by sampled splitters: near-equal bytes per shard, records range-partitioned by key. Native operations only.

Keys are (md5 of the text, id), so that equal texts lie side by side and a hot text is still divisible by id.

1. One pass reduces every record to a slim row (key, size, crc), which is staged in the shared folder.
2. A size-weighted Poisson sample of keys is drawn by hashing; its quantiles become the splitters of fine ranges.
3. Exact bytes per range are counted. A range that is overfull is sampled again, more densely, and subdivided.
4. Ranges are laid end to end. Within a range, running sums give each record its exact byte offset in key order, and
   the shard is the part of the total bytes in which the record begins; so shards differ by less than one record.

The sample, the splitters and the counts per range are bounded by parameters; no other data reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import stage

#: Records per fine range aimed at, and the bounds of the number of ranges.
RECORDS_A_RANGE, LEAST_RANGES, MOST_RANGES = 250_000, 64, 4096
#: Sampled keys per range in the first draw, and per new range when a range is subdivided.
SAMPLES_A_RANGE = 24
#: A range is overfull beyond this multiple of the mean.
OVERFULL = 2.0
ROUNDS = 3


def _range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters that are <= key, found in two steps of about sqrt(n) comparisons each."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    heads, table = F.array(*map(F.lit, [b[0] for b in blocks])), F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    block = F.size(F.filter(heads, lambda s: s <= key))
    inside = F.size(F.filter(F.element_at(table, F.greatest(block, F.lit(1))), lambda s: s <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inside)


def _quantiles(sample: DataFrame, n: int) -> list[str]:
    """At most n keys that cut the sorted sample into equal parts. The sample is bounded by its sampling rate."""
    keys = [r[0] for r in sample.select("_k").distinct().orderBy("_k").collect()]
    return sorted({keys[i * len(keys) // (n + 1)] for i in range(1, n + 1)}) if keys else []


def _sample(slim: DataFrame, salt: int, rate: float) -> DataFrame:
    """Keeps a row with probability min(1, rate * size), by a hash of its key: the same rows at any partitioning."""
    u = F.pmod(F.xxhash64(F.lit(salt), "_k"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return slim.where(u < F.col("_size") * F.lit(rate))


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Deals all rows of docs to shards of near-equal size; returns id, size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes of the text plus overhead; a null text has no bytes and the crc of the empty text. Null ids are
    ordered before others of the same text. Rows that are equal in id and text take neighbouring slots. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    ident = F.col(id_col)
    order = F.coalesce(F.lpad(F.hex(ident.cast("bigint")), 16, "0"), F.lit(""))
    slim = docs.select(
        ident.alias("_id"),
        (F.length(body) + F.lit(overhead)).cast("bigint").alias("_size"),
        F.crc32(body).alias("_crc"),
        F.concat(F.md5(body), order).alias("_k"),
    )
    slim = stage(slim, "shard-slim")
    n, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    n_ranges = int(min(MOST_RANGES, max(LEAST_RANGES, n // RECORDS_A_RANGE)))
    splitters = _quantiles(_sample(slim, 0, n_ranges * SAMPLES_A_RANGE / max(total, 1)), n_ranges - 1)
    for salt in range(1, ROUNDS + 1):
        counts = _counts(slim, splitters)
        mean = total / max(1, len(splitters) + 1)
        over = {r: b for r, (b, c) in counts.items() if b > OVERFULL * mean and c > 1}
        if not over or len(splitters) >= 2 * MOST_RANGES:
            break
        dense = _sample(slim.where(_range_of(F.col("_k"), splitters).isin(list(over))), salt, SAMPLES_A_RANGE / max(mean, 1))
        drawn = [r[0] for r in dense.select("_k").distinct().orderBy("_k").collect()]
        new: set[str] = set()
        for r, b in over.items():
            own = [k for k in drawn if bisect_right(splitters, k) == r]
            parts = int(b // mean) + 1
            new |= {own[i * len(own) // parts] for i in range(1, parts)} if own else set()
        if not new - set(splitters):
            break
        splitters = sorted(new | set(splitters))
    else:
        counts = _counts(slim, splitters)
    ranges = sorted(counts)
    before_bytes = dict(zip(ranges, accumulate([0, *(counts[r][0] for r in ranges)])))
    before_rows = dict(zip(ranges, accumulate([0, *(counts[r][1] for r in ranges)])))
    spark = docs.sparkSession
    # at most 2 * MOST_RANGES rows, each of three numbers
    starts = spark.createDataFrame([(r, before_bytes[r], before_rows[r]) for r in ranges], "_range int, _b0 bigint, _r0 bigint")
    w = Window.partitionBy("_range").orderBy("_k")
    placed = (
        slim.withColumn("_range", _range_of(F.col("_k"), splitters).cast("int"))
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("_run", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(starts), "_range")
        .withColumn("_row", F.col("_r0") + F.col("_rn") - 1)
        .withColumn("shard", F.expr(f"cast((_b0 + _run - _size) * {int(n_shards)} div {max(int(total), 1)} as int)"))
    )
    placed = stage(placed.select("_id", "_size", "_crc", "shard", "_row"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard"),
        (F.col("_row") - F.col("_first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _counts(slim: DataFrame, splitters: list[str]) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range that has rows; at most 2 * MOST_RANGES entries."""
    ranged = slim.select(_range_of(F.col("_k"), splitters).cast("int").alias("_range"), "_size")
    return {r[0]: (r[1], r[2]) for r in ranged.groupBy("_range").agg(F.sum("_size"), F.count(F.lit(1))).collect()}
