"""Structured Streaming counterparts: the same expressions on unbounded tables, and stateful operators.

Global counters keep their state under one key, which serialises that operator: they are for bounded counts. Streams are
replayed with availableNow; what is left in a state at the end is emitted by the flush row of the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.pack import best_fit


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files).load(path)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is available to Parquet and stops."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def append_jsonl(df: DataFrame, path: str, checkpoint: str):
    """An append sink of JSON lines, exactly once by the checkpoint."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take_skip(stream: DataFrame, n: int, skip: int, order: str) -> DataFrame:
    """Rows skip + 1 to skip + n of the stream, in order within a micro-batch. State: a counter."""
    schema = stream.schema

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        whole = pd.concat(list(parts)).sort_values(order)
        yield whole.iloc[max(skip - seen, 0) : max(skip + n - seen, 0)]
        state.update((seen + len(whole),))

    return stream.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandasWithState(lambda k, p, s: (d[schema.names] for d in run(k, p, s)), schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def assign_slots(stream: DataFrame, source: str, order: str) -> DataFrame:
    """k, the number of a row within its source, for interleaving by a slot table. State: a counter for each source."""
    from pyspark.sql import types as T

    schema = T.StructType([*stream.schema.fields, T.StructField("k", T.LongType())])

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        whole = pd.concat(list(parts)).sort_values(order)
        yield whole.assign(k=range(seen + 1, seen + len(whole) + 1))[schema.names]
        state.update((seen + len(whole),))

    return stream.groupBy(source).applyInPandasWithState(run, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def pack_stream(stream: DataFrame, shard: str, key: str, length: str, most: int, flush: str) -> DataFrame:
    """(shard, pack, key, length): per micro-batch all bins but the last one are emitted, which is carried to the next; a
    row whose flush column is true ends a shard and emits what is carried. State: the open bin and a counter."""

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, lengths, packs = state.get if state.exists else ([], [], 0)
        whole = pd.concat(list(parts))
        done = bool(whole[flush].any())
        rows = whole[~whole[flush].astype(bool)]
        bins, carry = best_fit(list(zip(keys, lengths)) + sorted(zip(rows[key].tolist(), rows[length].tolist())), most, done)
        out = [(k[0], packs + i, a, n) for i, b in enumerate(bins) for a, n in b]
        state.update(([a for a, _ in carry], [n for _, n in carry], packs + len(bins)))
        yield pd.DataFrame(out, columns=["shard", "pack", "key", "length"])

    return stream.groupBy(shard).applyInPandasWithState(run, "shard long, pack long, key long, length long", "keys array<long>, lengths array<long>, packs long", "append", GroupStateTimeout.NoTimeout)


def build_sessions(stream: DataFrame, by: str, order: str, starts: str, item: str) -> DataFrame:
    """(by, session, items): a session is emitted when the next one starts. State: the open session."""

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, n = state.get if state.exists else ([], 0)
        out = []
        for row in pd.concat(list(parts)).sort_values(order).itertuples():
            if getattr(row, starts) and items:
                out.append((k[0], n, items))
                items, n = [], n + 1
            items = [*items, getattr(row, item)]
        state.update((items, n))
        yield pd.DataFrame(out, columns=["by", "session", "items"])

    return stream.groupBy(by).applyInPandasWithState(run, "by long, session long, items array<string>", "items array<string>, n long", "append", GroupStateTimeout.NoTimeout)


def shuffle_batches(stream: DataFrame, key: str, seed: int, path: str, checkpoint: str):
    """Each micro-batch in pseudo-random order, in a folder of its own that a replay overwrites: a buffered shuffle whose buffer
    is the micro-batch."""
    from parley.operators.ordering import hash_key

    def write(batch: DataFrame, number: int) -> None:
        batch.orderBy(hash_key(F.col(key), seed), key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_rounds(df: DataFrame, batch: str, world: int, rounds: int) -> DataFrame:
    """Batches of complete rounds over the ranks; rank is the batch's place within its round."""
    return df.where(F.col(batch) < rounds * world).withColumn("rank", F.pmod(F.col(batch), F.lit(world)).cast("int"))
