"""Deterministic order, sampling, splitting, combination and sharding.

Every operator takes an explicit key, because Spark has no row order. Pseudo-random order is the order of md5(key-seed).
Global ranks are computed in two steps, within buckets of the order and over bucket counts, so that no task sorts the
whole table; bucket counts are at most BUCKETS rows and are broadcast. Rows with a null key are rows as others: null counts
as the empty text in pseudo-random order and comes first in key order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most buckets (a power of two), and rows that a bucket of key order should have at least.
BUCKETS, BUCKET_ROWS = 4096, 2000


def hash_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"-{seed}")))


def global_rank(df: DataFrame, order: list[Column], bucket: Column, name: str = "rn", by: list[str] = ()) -> DataFrame:
    """df with name: the rank from 1 in the given order, within the columns `by`. bucket must not fall along the order and
    have at most BUCKETS values."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_slot"), "_start")
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.col("_bucket") == F.col("_slot"))
    side = F.broadcast(starts) if not by else starts
    return local.join(side, same).withColumn(name, F.col("_start") + F.col("_local")).drop("_bucket", "_local", "_slot", "_start", *[f"_by_{c}" for c in by])


def hash_rank(df: DataFrame, key: str, seed: int = 42, name: str = "rn", by: list[str] = ()) -> DataFrame:
    """Rank in pseudo-random order."""
    digest = hash_key(F.col(key), seed)
    return global_rank(df, [digest, F.col(key)], F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"), name, by)


def quantile_bucket(df: DataFrame, key: str) -> Column:
    """The number of the approximate quantile that a numeric key is in: buckets have about equal rows however the keys are
    spread. Null is before all others. Quantiles come from one pass with mergeable sketches; a row's is found by bisection."""
    found = _bucket(df, key)
    return F.lit(0) if found is None else found


def _bucket(df: DataFrame, key: str) -> Column | None:
    """quantile_bucket, or None where a single bucket holds all rows."""
    rows = df.count()
    levels = min(BUCKETS, 1 << max(0, (rows // BUCKET_ROWS).bit_length()))
    if levels < 2:
        return None
    points = df.agg(F.percentile_approx(key, [(i + 1) / levels for i in range(levels - 1)], 4 * levels).alias("p")).first()["p"]
    kind = df.schema[key].dataType.simpleString()
    bounds = F.split(F.lit(",".join(map(str, points or []))), ",").cast(f"array<{kind}>")
    steps = F.array(*[F.lit(levels >> i) for i in range(1, levels.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= F.col(key), F.lit(False)), at + step).otherwise(at))


def _match(names: list[str]) -> Column:
    """Equality of columns with those of the other side of a join, which are named alike behind a mark."""
    return reduce(lambda a, c: a & F.col(f"`{c}`").eqNullSafe(F.col(f"`_by_{c}`")), names, F.lit(True))


def running(df: DataFrame, value: Column, by: list[str], order: str, out: str, previous: str | None = None) -> DataFrame:
    """df with out: the sum of value over the rows up to each one in the order, within `by`.

    Sums are taken within buckets of the order and over the buckets' totals, so neither a whole table nor a hot group is one
    task's. An order that isn't numeric has one bucket. With `previous`, value may use the column _before: a struct of that
    column of the row before, null in the first row.
    """
    numeric = isinstance(df.schema[order].dataType, T.NumericType)
    bucket = _bucket(df, order) if numeric else None
    slot = [] if bucket is None else ["_slot"]
    d = df if bucket is None else df.withColumn("_slot", bucket)
    ordered = Window.partitionBy(*by, *slot).orderBy(order)
    earlier = Window.partitionBy(*by).orderBy("_slot")

    def per_slot(total: Column, name: str, before: Column) -> DataFrame:
        """A row for each bucket of each group with what the buckets before it come to."""
        sums = d.groupBy(*by, "_slot").agg(total.alias("_t")).withColumn(name, before)
        return sums.select(*[F.col(f"`{c}`").alias(f"_by_{c}") for c in [*by, "_slot"]], name)

    marks = [f"_by_{c}" for c in [*by, "_slot"]]
    if previous is not None:
        d = d.withColumn("_before", F.lag(F.struct(F.col(previous).alias("v"))).over(ordered))
        if slot:
            ends = per_slot(F.max_by(F.struct(F.col(previous).alias("v")), F.struct(order)), "_end", F.lag("_t").over(earlier))
            d = d.join(ends, _match([*by, "_slot"])).withColumn("_before", F.coalesce("_before", "_end")).drop("_end", *marks)
    d = d.withColumn("_addend", value)
    d = d.withColumn(out, F.sum("_addend").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    if slot:
        so_far = F.sum("_t").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
        starts = per_slot(F.sum("_addend"), "_start", so_far)
        # a null sum has no values so far; it stays null where none came before either
        d = d.join(starts, _match([*by, "_slot"])).withColumn(out, F.coalesce(F.col(out) + F.col("_start"), F.col(out), F.col("_start"))).drop("_start", *marks)
    return d.drop("_slot", "_addend", "_before")


def key_rank(df: DataFrame, key: str, name: str = "rn", by: list[str] = ()) -> DataFrame:
    """Rank by a numeric key."""
    return global_rank(df, [F.col(key)], quantile_bucket(df, key), name, by)


def sample(df: DataFrame, n: int | None, key: str, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """Exactly n rows, with repetition where n exceeds the table: n // len whole copies and n % len more rows, the first
    in pseudo-random order or, without shuffle, in key order. None: unchanged. Adds copy, the number of the copy."""
    if n is None:
        return df
    total = df.count()
    if not total:
        return df.withColumn("copy", F.lit(0)).limit(0)
    whole, rest = divmod(n, total)
    ranked = hash_rank(df, key, seed, "_rn") if shuffle else key_rank(df, key, "_rn")
    copies = F.lit(whole) + F.when(F.col("_rn") <= rest, 1).otherwise(0)
    if not whole:
        return ranked.where(F.col("_rn") <= rest).withColumn("copy", F.lit(0)).drop("_rn")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_rn")


def train_val_split(df: DataFrame, ratio: float, key: str, n: int | None = None, seed: int = 42) -> tuple[DataFrame | None, DataFrame | None]:
    """(train, val): ratio 0 samples only, ratio 1 makes everything val; otherwise val has max(int(min(len, n) * ratio), 1)
    rows, disjoint from train, which is sampled up to the n rows asked for in all."""
    if ratio == 0:
        return sample(df, n, key, seed), None
    total = df.count()
    if ratio == 1:
        if n is not None and n > total:
            raise ValueError("the sample of a validation set can't exceed it")
        return None, sample(df, n, key, seed)
    wanted = total if n is None else n
    val = max(int(min(total, wanted) * ratio), 1)
    if wanted - val <= 0:
        raise ValueError("no training rows are left")
    ranked = hash_rank(df, key, seed, "_rn")
    train = ranked.where(F.col("_rn") > val).drop("_rn")
    return sample(train, None if n is None else wanted - val, key, seed), ranked.where(F.col("_rn") <= val).drop("_rn")


def stream_split(df: DataFrame, ratio: float, key: str, n: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The split of a stream: never shuffled; without n the ratio must be 0 or 1, with it val is the first int(n * ratio)."""
    if n is None:
        if ratio not in (0, 1):
            raise ValueError("a stream of unknown length can't be split by a ratio")
        return (df, None) if ratio == 0 else (None, df)
    val = int(n * ratio)
    ranked = key_rank(df, key, "_rn").where(F.col("_rn") <= n)
    return ranked.where(F.col("_rn") > val).drop("_rn"), ranked.where(F.col("_rn") <= val).drop("_rn") if val else None


def concat(dfs: list[DataFrame]) -> DataFrame | None:
    """UNION ALL with src, the position of the table; columns are united by name. None of no tables."""
    if not dfs:
        return None
    if len(dfs) == 1:
        return dfs[0]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("src", F.lit(i)) for i, d in enumerate(dfs)])


def slot_draw(slot: Column, seed: int) -> Column:
    """A number in [0, 1) by seed and slot."""
    return F.conv(F.substring(hash_key(slot, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def interleave(dfs: list[DataFrame], keys: list[str], probabilities: list[float] | None = None, seed: int = 42, stop: str = "first_exhausted") -> DataFrame:
    """Rows of several tables in one sequence, with src, slot and k (the row's number within its table). Slot i takes the
    next row of the table that its draw names; the sequence ends with the slot that uses up the first table, or the last
    one, in which case tables start again. A single table is returned as it is."""
    if len(dfs) == 1:
        return dfs[0]
    shares = probabilities or [1 / len(dfs)] * len(dfs)
    counts = [d.count() for d in dfs]
    need = max(c / p for c, p in zip(counts, shares) if p > 0) if stop == "all_exhausted" else min(c / p for c, p in zip(counts, shares) if p > 0)
    spark, slots = dfs[0].sparkSession, int(need * 1.5 + 10 * need**0.5 + 100)
    bounds, at = [], 0.0
    for p in shares:
        at += p
        bounds.append(at)
    while True:
        draw = slot_draw(F.col("slot"), seed)
        source = F.lit(len(dfs) - 1)
        for i in range(len(dfs) - 2, -1, -1):
            source = F.when(draw < bounds[i], i).otherwise(source)
        drawn = global_rank(spark.range(slots).select(F.col("id").alias("slot")).withColumn("src", source), [F.col("slot")], F.floor(F.col("slot") * BUCKETS / slots).cast("int"), "k", ["src"])
        lengths = F.create_map(*[F.lit(x) for i, c in enumerate(counts) for x in (i, c)])
        ends = {r["src"]: r["end"] for r in drawn.where(F.col("k") == lengths[F.col("src")]).groupBy("src").agg(F.min("slot").alias("end")).collect()}
        wanted = [i for i, c in enumerate(counts) if c and shares[i] > 0]
        if stop == "first_exhausted" and ends or all(i in ends for i in wanted):
            break
        slots *= 2
    last = min(ends.values()) if stop == "first_exhausted" else max(ends.values())
    drawn = drawn.where(F.col("slot") <= last).withColumn("_row", F.pmod(F.col("k") - 1, lengths[F.col("src")]) + 1)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [key_rank(d, k, "_row").withColumn("src", F.lit(i)) for i, (d, k) in enumerate(zip(dfs, keys))])
    return drawn.join(rows, ["src", "_row"]).drop("_row")


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_key(F.col(key), seed), key)


def chunk_even(df: DataFrame, n: int, key: str, name: str = "chunk") -> DataFrame:
    """ntile(n) from 0: even chunks, the remainder to the first ones."""
    q, r = divmod(df.count(), n)
    rn = F.col("_rn") - 1
    big = r * (q + 1)
    tile = F.when(rn < big, F.floor(rn / (q + 1))).otherwise(F.lit(r) + F.floor((rn - big) / max(q, 1)))
    return key_rank(df, key, "_rn").withColumn(name, tile.cast("int")).drop("_rn")


def shard_contiguous(df: DataFrame, n: int, key: str, name: str = "shard") -> DataFrame:
    """Shards between the whole numbers of n + 1 even points of the length."""
    total = df.count()
    rn = F.col("_rn") - 1
    # the last shard whose first row, floor(i * total / n), isn't behind the row
    shard = F.floor(((rn + 1) * n - 1) / max(total, 1))
    return key_rank(df, key, "_rn").withColumn(name, F.least(shard, F.lit(n - 1)).cast("int")).drop("_rn")


def shard_strided(df: DataFrame, n: int, key: str, name: str = "shard") -> DataFrame:
    """Row i goes to shard i mod n; round-robin assignment is the same."""
    return key_rank(df, key, "_rn").withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(n)).cast("int")).drop("_rn")


def piece(df: DataFrame, k: int, total: int, key: str, keep_rest: bool = True) -> DataFrame:
    """Piece k (from 0) of pieces of floor(len / total) rows; the last takes the remainder unless keep_rest is false."""
    size = df.count() // total
    ranked = key_rank(df, key, "_rn")
    end = F.col("_rn") > 0 if keep_rest and k == total - 1 else F.col("_rn") <= (k + 1) * size
    return ranked.where((F.col("_rn") > k * size) & end).drop("_rn")


def batches(df: DataFrame, size: int, key: str, drop_last: bool = False, name: str = "batch") -> DataFrame:
    out = key_rank(df, key, "_rn").withColumn(name, F.floor((F.col("_rn") - 1) / size))
    return (out.where(F.col(name) < df.count() // size) if drop_last else out).drop("_rn")


def batch_shards(df: DataFrame, size: int, world: int, key: str, seed: int = 42, epoch: int = 0, drop_last: bool = False, random: bool = True) -> DataFrame:
    """batch and rank of every row: a permutation by seed + epoch, batches dealt to ranks in strides, and an incomplete
    round cut to a multiple of the ranks."""
    total = df.count()
    whole = total // (size * world) * (size * world) if drop_last else total // world * world
    ranked = hash_rank(df, key, seed + epoch, "_rn") if random else key_rank(df, key, "_rn")
    at = F.col("_rn") - 1
    return ranked.where(at < whole).withColumn("rank", F.pmod(at, F.lit(world)).cast("int")).withColumn("batch", F.floor(at / (size * world))).drop("_rn")


def length_grouped(df: DataFrame, length: str, batch: int, key: str, seed: int = 42, mega: int = 50) -> DataFrame:
    """Position in length-grouped order: a pseudo-random order cut into blocks of batch * mega rows, each sorted by falling
    length. Adds mega and pos."""
    size = batch * mega
    ranked = hash_rank(df, key, seed, "_rn").withColumn("mega", F.floor((F.col("_rn") - 1) / size))
    w = Window.partitionBy("mega").orderBy(F.desc(length), "_rn")
    return ranked.withColumn("pos", F.col("mega") * size + F.row_number().over(w) - 1).drop("_rn")


def pretraining_order(df: DataFrame, key: str, micro: int, world: int, consumed: int = 0, seed: int | None = None, sharded: bool = False) -> DataFrame:
    """rank and step of rows behind the consumed ones of this epoch: sequential without a seed, else by the epoch's
    permutation - of all rows, or with `sharded` of each rank's own contiguous bucket. Incomplete rounds are dropped."""
    total = df.count()
    round_ = micro * world
    active = total // round_ * round_
    epoch, done = divmod(consumed, active) if active else (0, 0)
    if sharded and seed is not None:
        bucket = active // world
        base = key_rank(df, key, "_rn").where(F.col("_rn") <= active).withColumn("rank", F.floor((F.col("_rn") - 1) / max(bucket, 1)).cast("int")).drop("_rn")
        own = hash_rank(base, key, seed + epoch, "_own", ["rank"]).where(F.col("_own") > done // world)
        return own.withColumn("step", F.floor((F.col("_own") - 1 - done // world) / micro)).drop("_own")
    ranked = key_rank(df, key, "_rn") if seed is None else hash_rank(df, key, seed + epoch, "_rn")
    at = F.col("_rn") - 1 - done
    kept = ranked.where((F.col("_rn") > done) & (F.col("_rn") <= active))
    return kept.withColumn("rank", F.floor(F.pmod(at, F.lit(round_)) / micro).cast("int")).withColumn("step", F.floor(at / round_)).drop("_rn")


def pad_to_ranks(df: DataFrame, world: int, key: str) -> DataFrame:
    """Every rank gets the same number of rows: the first rows come again at the end. Adds slot and rank."""
    total = df.count()
    extra = -total % world if total else 0
    ranked = key_rank(df, key, "_rn")
    again = F.when(F.col("_rn") <= extra, F.array(F.col("_rn") - 1, F.col("_rn") - 1 + total)).otherwise(F.array(F.col("_rn") - 1))
    return ranked.withColumn("slot", F.explode(again)).withColumn("rank", F.pmod("slot", F.lit(world)).cast("int")).drop("_rn")


def repeat_each(df: DataFrame, k: int, name: str = "copy") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def cycle(df: DataFrame, slots: int, key: str) -> DataFrame:
    """`slots` rows by going round the table. Adds slot."""
    total = df.count()
    if not total:
        return df.withColumn("slot", F.lit(0).cast("bigint")).limit(0)
    ranked = key_rank(df, key, "_rn").where(F.col("_rn") <= slots)
    return ranked.withColumn("slot", F.explode(F.sequence(F.col("_rn") - 1, F.lit(slots - 1).cast("bigint"), F.lit(total).cast("bigint")))).drop("_rn")


def take(df: DataFrame, n: int, key: str, skip: int = 0) -> DataFrame:
    return key_rank(df, key, "_rn").where((F.col("_rn") > skip) & (F.col("_rn") <= skip + n)).drop("_rn")


def skip_batches(df: DataFrame, k: int, batch: str = "batch") -> DataFrame:
    return df.where(F.col(batch) >= k)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. Firsts are found by a partial aggregate, so a hot key isn't gathered in one task."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.`{c}`").alias(c) for c in rest]).select(*df.columns)


def max_steps(rows: int, batch: int, accumulation: int, world: int, epochs: float, fixed: int | None = None) -> int:
    """ceil(epochs * max(rows // (batch * accumulation * world), 1)) unless fixed."""
    if fixed and fixed > 0:
        return fixed
    return -int(-(epochs * max(rows // (batch * accumulation * world), 1)) // 1)


def step_source(step: Column, seed: int, share: float) -> Column:
    """Whether a step draws from the first source, by seed + step."""
    return slot_draw(step + seed, 0) < share


def dense_ids_limit(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The rows of n keys, chosen in pseudo-random order."""
    kept = hash_rank(df.select(key).distinct(), key, seed, "_rn").where(F.col("_rn") <= n).select(F.col(key).alias("_key"))
    return df.join(kept, F.col(key) == F.col("_key"), "left_semi")


def step_seeds(seed: int, names: list[str]) -> dict[str, int]:
    """A 31-bit seed for each named step. It depends on the step's name alone, not on which steps came before."""
    import hashlib

    return {n: int(hashlib.md5(f"{n}-{seed}".encode()).hexdigest()[:8], 16) & 0x7FFFFFFF for n in names}
