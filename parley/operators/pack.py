"""Packing by length, and collation."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_fit(items: list[tuple[int, int]], most: int, finished: bool = True) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """(bins, carry) of (key, length) items: longest first, each into the fullest bin that has room, else a new one; ties by
    key. An item beyond the limit has a bin of its own. Unless finished, the last bin is carried."""
    bins: list[list[tuple[int, int]]] = []
    room: list[tuple[int, int]] = []  # (room left, -bin)
    for key, length in sorted(items, key=lambda x: (-x[1], x[0] is not None, x[0])):
        at = bisect_right(room, (length, -len(bins) - 1))
        if at < len(room):
            left, b = room.pop(at)
            bins[-b].append((key, length))
            insort(room, (left - length, b))
        else:
            insort(room, (most - length, -len(bins)))
            bins.append([(key, length)])
    if finished or not bins:
        return bins, []
    return bins[:-1], bins[-1]


#: Rows of a shard where the number of shards isn't given.
SHARD_ROWS = 1_000_000


def pack_table(df: DataFrame, key: str, length: str, most: int, shards: int | None = None, chunk: int = 1000) -> DataFrame:
    """(key, length, shard, pack, pos): rows dealt to contiguous shards, packed in chunks whose last bin is carried over.
    More shards pack in parallel and change the packs at their edges only; without a number, there is one for a million
    rows. A null length is 0. A task reads its shards in order of the key and holds one chunk
    and its carry."""
    from parley.operators.ordering import shard_contiguous

    if shards is None:
        shards = max(1, -(-df.count() // SHARD_ROWS))
    dealt = shard_contiguous(df.select(F.col(key).alias("key"), F.coalesce(F.col(length).cast("bigint"), F.lit(0)).alias("length")), shards, "key", "shard")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, rows, carry, kind = None, 0, [], [], None

        def pack(finished: bool) -> list[tuple]:
            nonlocal made, rows, carry
            bins, carry = best_fit(carry + rows, most, finished)
            out = [(k, x, shard, made + i, j) for i, b in enumerate(bins) for j, (k, x) in enumerate(b)]
            made, rows = made + len(bins), []
            return out

        def batch(out: list[tuple]) -> pa.RecordBatch:
            types = {"key": kind, "length": pa.int64(), "shard": pa.int32(), "pack": pa.int64(), "pos": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types.values())], list(types))

        for p in parts:
            out, kind = [], p.schema.field("key").type
            for s, k, x in zip(*[p.column(c).to_pylist() for c in ("shard", "key", "length")]):
                if s != shard:
                    out += pack(True)
                    shard, made = s, 0
                elif len(rows) == chunk:  # more of the shard follows
                    out += pack(False)
                rows.append((k, x))
            yield batch(out)
        if rows or carry:
            yield batch(pack(True))

    kind = df.schema[key].dataType.simpleString()
    placed = dealt.repartition("shard").sortWithinPartitions("shard", "key")
    return placed.mapInArrow(run, f"key {kind}, length bigint, shard int, pack bigint, pos bigint").withColumnsRenamed({"key": key, "length": length})


def packed_rows(packed: DataFrame, values: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """A row per pack with the arrays of its members joined in order, and their lengths."""
    joined = packed.join(values, key)
    items = F.array_sort(F.collect_list(F.struct("pos", *arrays)))
    g = joined.groupBy("shard", "pack").agg(items.alias("_i"))
    return g.select("shard", "pack", F.transform("_i", lambda x: F.size(x[arrays[0]])).alias("lengths"), *[F.flatten(F.col("_i").getField(a)).alias(a) for a in arrays])


def pad(values: Column, to: Column, fill, left: bool = False) -> Column:
    extra = F.array_repeat(F.lit(fill), F.greatest(to - F.size(values), F.lit(0)).cast("int"))
    return F.concat(extra, values) if left else F.concat(values, extra)


def collate(df: DataFrame, batch: str, ids: str, others: dict[str, object], pad_id: int = 0, multiple: int = 1, left: bool = False) -> DataFrame:
    """Arrays of a batch padded to its longest, up to a multiple; adds attention_mask."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    to = F.ceil(longest / multiple) * multiple
    d = df.withColumn("_to", to).withColumn("attention_mask", pad(F.transform(ids, lambda x: F.lit(1)), F.col("_to"), 0, left))
    for c, fill in ({ids: pad_id} | others).items():
        d = d.withColumn(c, pad(F.col(c), F.col("_to"), fill, left))
    return d.drop("_to")


def round_up(length: Column, multiple: int) -> Column:
    return (F.ceil(length / multiple) * multiple).cast("int")


def multi_hot(labels: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(labels, i).cast("double"))
