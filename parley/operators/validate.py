"""Row validity: predicates, and the split of a table into good rows and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.schema import ROLES


def valid_messages(messages: Column) -> Column:
    """Not empty, legal roles, no null content."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False)) & m["content"].isNotNull()), F.lit(False))


def message_fault(messages: Column) -> Column:
    """The reason why messages are rejected, null if they aren't."""
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "no messages")
        .when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))), "illegal role")
        .when(F.exists(messages, lambda m: m["content"].isNull()), "null content")
    )


def valid_rejected(rejected: Column, messages: Column) -> Column:
    return F.coalesce(rejected.isNotNull() & (rejected != F.try_element_at(messages, F.lit(-1))["content"]), F.lit(False))


def split_valid(df: DataFrame, fault: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with reason); strict raises on the first reject instead."""
    marked = df.withColumn("reason", fault)
    if strict:
        marked = marked.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("string")))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def within_length(lengths: Column, most: int) -> Column:
    """Lengths of a row, a number or an array of them, are within the limit."""
    return F.array_max(lengths) <= most


def has_overlap(spans: Column) -> Column:
    """Sorted (start, end) spans of which one starts before the previous one ends."""
    s = F.array_sort(spans)
    pairs = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: b["start"] < a["end"])
    return F.exists(pairs, lambda x: x)


def mentions(messages: Column, pattern: str) -> Column:
    return F.exists(messages, lambda m: F.lower(m["content"]).rlike(pattern))


def distinct_matches(text: Column, pattern: str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)))


def with_existing_media(df: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """Rows whose path is in the listing (path)."""
    return df.join(listing.select(F.col("path").alias("_path")), F.col(path) == F.col("_path"), "left_semi")


def replace_failures(df: DataFrame, ok: Column, key: str, seed: int = 42) -> DataFrame:
    """Rows that fail are replaced by valid ones in pseudo-random order, round and round; key names the slot, source the
    row that fills it. No valid row raises."""
    from parley.operators.ordering import hash_rank

    good = df.where(ok)
    total = good.count()
    if not total:
        raise ValueError("no valid rows are left")
    pool = hash_rank(good, key, seed, "_rn").withColumnRenamed(key, "source")
    failed = hash_rank(df.where(~F.coalesce(ok, F.lit(False))).select(key), key, seed + 1, "_f").withColumn("_rn", F.pmod(F.col("_f") - 1, F.lit(total)) + 1)
    return good.withColumn("source", F.col(key)).unionByName(failed.join(pool, "_rn").drop("_rn", "_f"))


def drop_overlong(df: DataFrame, lengths: Column, most: int, strategy: str = "delete") -> DataFrame:
    """Rows beyond the limit go under `delete`, and raise under `raise`."""
    over = ~within_length(lengths, most)
    if strategy == "raise":
        return df.where(F.assert_true(~over, "a row is too long").isNull())
    return df.where(~over)


def without_truncated(mask: Column, truncated: Column) -> Column:
    """A completion's token mask, all zeros where the completion was cut off."""
    return F.transform(mask, lambda m: F.when(F.coalesce(truncated, F.lit(False)), F.lit(0)).otherwise(m.cast("int")))


def refill(df: DataFrame, ok: Column, backup: DataFrame, backup_ok: Column, key: str, seed: int = 42, rounds: int = 10) -> DataFrame:
    """Failing rows are replaced from a backup table in pseudo-random order, taken round and round: at most `rounds` times as
    many of its rows as there are failures are looked at. source names the row that fills a slot; no filling row raises."""
    from parley.operators.ordering import hash_rank

    failed = hash_rank(df.where(~F.coalesce(ok, F.lit(False))).select(key), key, seed + 1, "_f")
    wanted = failed.count()
    if not wanted:
        return df.withColumn("source", F.col(key))
    looked = hash_rank(backup, key, seed, "_rn").where(F.col("_rn") <= wanted * rounds).drop("_rn").where(backup_ok)
    pool = hash_rank(looked, key, seed, "_rn").withColumnRenamed(key, "source")
    total = pool.count()
    if not total:
        raise ValueError("no row of the backup can fill in")
    filled = failed.withColumn("_rn", F.pmod(F.col("_f") - 1, F.lit(total)) + 1).join(pool, "_rn").drop("_rn", "_f")
    return df.where(ok).withColumn("source", F.col(key)).unionByName(filled)
