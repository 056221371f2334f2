"""Conversations as token arrays: rendered, tokenised, labelled and cut to a length.

The pieces of a conversation become texts of one weight each and are tokenised one by one, about a megabyte of rows at a time,
so that a worker's memory doesn't follow the size of its batches. A tokenizer is a file that every worker can read, named by
a path.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import normalize as N
from parley.operators.render import Template, is_binary, segments, weighted_parts

IGNORE = -100
STRATEGIES = ("delete", "left", "right", "split")
#: Bytes of text that are tokenised together, or one row that has more.
SLICE_BYTES = 1 << 20
#: ids and weights of a row or of a part of it.
Form = tuple[np.ndarray, np.ndarray]
FIELDS = {"input_ids": T.ArrayType(T.IntegerType()), "labels": T.ArrayType(T.IntegerType()), "loss_scale": T.ArrayType(T.FloatType()), "length": T.IntegerType()}


@dataclass(frozen=True)
class Tokenizer:
    """kind: bytes (UTF-8 bytes, no file), ranks (a rank file with a pattern), json or model (files of tokenizer libraries)."""

    kind: str = "bytes"
    path: str = ""
    pattern: str = ""


@lru_cache(maxsize=4)
def batch_encoder(spec: Tokenizer) -> Callable[[list[str]], list[Sequence[int]]]:
    """A function from texts to ids without special tokens."""
    if spec.kind == "bytes":
        return lambda texts: [np.frombuffer(t.encode(), np.uint8) for t in texts]
    if spec.kind == "ranks":
        import tiktoken

        with open(spec.path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        one = tiktoken.Encoding("own", pat_str=spec.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [one(t) for t in texts]
    if spec.kind == "json":
        from tokenizers import Tokenizer as Library

        library = Library.from_file(spec.path)
        library.encode_special_tokens = True  # their spellings in a text are text
        return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    if spec.kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=spec.path)
        return lambda texts: pieces.encode(texts, num_threads=1)
    raise ValueError(f"unknown kind of tokenizer {spec.kind}")


def cut(ids: np.ndarray, most: int, side: str, protected: tuple[int, ...]) -> np.ndarray:
    """Which tokens stay of a row beyond the limit: all protected ones, and of the others as many as there is room for."""
    keep = np.isin(ids, protected)
    others = np.flatnonzero(~keep)
    room = max(most - int(keep.sum()), 0)
    keep[others[len(others) - room :] if side == "left" else others[:room]] = True
    return keep


def windows_of(ids: np.ndarray, scale: np.ndarray, most: int | None, strategy: str, protected: tuple[int, ...]) -> list[Form]:
    """(ids, weights) of what a row becomes: itself, a part of it, consecutive parts, or nothing where it is too long."""
    if most is None or len(ids) <= most:
        return [(ids, scale)]
    if strategy == "delete":
        return []
    if strategy == "split":
        return [(ids[at : at + most], scale[at : at + most]) for at in range(0, len(ids), most)]
    keep = cut(ids, most, strategy, protected)
    return [(ids[keep], scale[keep])]


@dataclass(frozen=True)
class Encoder:
    """labels are the ids of positive weight, else -100, the first one always; loss_scale are the weights, the first one 0,
    and null where all are 0 or 1. `weights` splits trained responses further. Without training, both are null. Beyond
    `most` tokens a row has no form (delete), one of the tokens to keep (left, right) or one for each window (split)."""

    tokenizer: Tokenizer = Tokenizer()
    most: int | None = None
    strategy: str = "delete"
    weights: tuple[tuple[str, tuple[float, ...]], ...] = ()
    protected: tuple[int, ...] = ()
    training: bool = True

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")

    def parts(self, pieces: list[dict]) -> Iterator[tuple[float, str]]:
        """Texts of one weight each of a row's pieces (text, weight, kind)."""
        weights = dict(self.weights)
        fine = [p for x in pieces for p in (weighted_parts(x["text"], weights) if weights and x["kind"] == "response" and x["weight"] > 0 else [(x["text"], x["weight"])])]
        return ((w, "".join(t for t, _ in same)) for w, same in groupby(fine, lambda p: p[1]))

    def rows(self, pieces: pa.Array) -> list[list[Form] | None]:
        """The forms of each row; None of a null one. All texts of the rows are tokenised together."""
        rows = [None if row is None else list(self.parts(row)) for row in pieces.to_pylist()]
        tokens = iter(batch_encoder(self.tokenizer)([t for row in rows for _, t in row or ()]))
        out: list[list[Form] | None] = []
        for row in rows:
            if row is None:
                out.append(None)
                continue
            mine = [next(tokens) for _ in row]
            ids = np.concatenate([np.empty(0, np.int32), *[np.asarray(t, np.int32) for t in mine]])
            scale = np.repeat(np.asarray([w for w, _ in row], np.float32), [len(t) for t in mine])
            out.append(windows_of(ids, scale, self.most, self.strategy, self.protected))
        return out

    def columns(self, forms: list[Form | None]) -> list[pa.Array]:
        """The arrays of FIELDS; null of no form."""
        absent = pa.array([f is None for f in forms], pa.bool_())
        lengths = np.asarray([0 if f is None else len(f[0]) for f in forms], np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        ids = np.concatenate([np.empty(0, np.int32), *[f[0] for f in forms if f is not None]])
        scale = np.concatenate([np.empty(0, np.float32), *[f[1] for f in forms if f is not None]])
        first = offsets[:-1][lengths > 0]
        labels = np.where(scale > 0, ids, IGNORE).astype(np.int32)
        labels[first], scale[first] = IGNORE, 0

        def lists(values: np.ndarray, there: bool) -> pa.Array:
            kind = pa.list_(pa.from_numpy_dtype(values.dtype))
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=absent) if there else pa.nulls(len(forms), kind)

        scaled = self.training and bool(self.weights) and not is_binary(dict(self.weights))
        return [lists(ids, True), lists(labels, self.training), lists(scale, scaled), pa.array(lengths, mask=absent.to_numpy(False))]


def slices(batch: pa.RecordBatch, *pieces: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, as many at a time as hold SLICE_BYTES of text in the columns of pieces, and at least one."""
    ends = np.zeros(batch.num_rows + 1, np.int64)  # the first is where row 0 begins
    for name in pieces:
        column = batch.column(name)
        sizes = pc.fill_null(pc.binary_length(column.values.field("text")), 0).to_numpy(zero_copy_only=False)
        ends += np.concatenate([[0], np.cumsum(sizes)])[column.offsets.to_numpy()]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode(df: DataFrame, template: Template, encoder: Encoder, base: str = "default", messages: str = "messages") -> DataFrame:
    """df without messages, with input_ids, labels, loss_scale and length of each form of a row. Without training the response
    behind the last query is left out. Null messages have no form, empty ones one of no tokens."""
    told = F.col(messages)
    if not encoder.training:
        last = F.try_element_at(told, F.lit(-1))
        told = F.when(last["role"] == "assistant", F.slice(told, 1, F.greatest(F.size(told) - 1, F.lit(0)))).otherwise(told)
    kept, names = _numbered(df, messages)
    source = df.select(*kept, _pieces(told, template, base, encoder.training).alias("_pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "_pieces")):
            rows = encoder.rows(b.column("_pieces"))
            owner = pa.array([i for i, row in enumerate(rows) for _ in row or ()], pa.int64())
            rest = b.drop_columns(["_pieces"]).take(owner)
            yield pa.RecordBatch.from_arrays([*rest.columns, *encoder.columns([f for row in rows for f in row or ()])], [*rest.schema.names, *FIELDS])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *[T.StructField(n, k) for n, k in FIELDS.items()]])).toDF(*names, *FIELDS)


def encode_preference(df: DataFrame, template: Template, encoder: Encoder, base: str = "default", rejected: bool = True, messages: str = "messages", rejected_messages: str = "rejected_messages") -> DataFrame:
    """df with chosen_ and rejected_ forms of input_ids, labels, loss_scale and length; a pair goes where either is deleted.
    Without `rejected` that side may be null, and its columns are null then. Splitting isn't defined for pairs."""
    if encoder.strategy == "split":
        raise ValueError("pairs can't be split into windows")
    kept, names = _numbered(df, messages, rejected_messages)
    sides = [_pieces(F.col(c), template, base, encoder.training).alias(f"_{k}") for c, k in ((messages, "chosen"), (rejected_messages, "rejected"))]
    source = df.select(*kept, *sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "_chosen", "_rejected")):
            pairs = list(zip(encoder.rows(b.column("_chosen")), encoder.rows(b.column("_rejected"))))
            stay = [i for i, (c, r) in enumerate(pairs) if c and (r or (r is None and not rejected))]
            rest = b.drop_columns(["_chosen", "_rejected"]).take(pa.array(stay, pa.int64()))
            made = [a for side in (0, 1) for a in encoder.columns([(pairs[i][side] or [None])[0] for i in stay])]
            yield pa.RecordBatch.from_arrays([*rest.columns, *made], [*rest.schema.names, *[f"{k}_{n}" for k in ("chosen", "rejected") for n in FIELDS]])

    fields = [T.StructField(f"{k}_{n}", kind) for k in ("chosen", "rejected") for n, kind in FIELDS.items()]
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-2], *fields])).toDF(*names, *[f.name for f in fields])


def _numbered(df: DataFrame, *leave: str) -> tuple[list[Column], list[str]]:
    """The other columns under numbers, since names with dots don't pass through a map, and their names."""
    names = [c for c in df.columns if c not in leave]
    return [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], names


def _pieces(messages: Column, template: Template, base: str, training: bool) -> Column:
    split = N.split_system(messages)
    return F.when(messages.isNotNull(), segments(template, split["system"], split["messages"], base, training))


def with_lengths(encoded_rows: DataFrame) -> DataFrame:
    """lengths: every column whose name ends with length, in the table's order."""
    names = [c for c in encoded_rows.columns if c.endswith("length")]
    return encoded_rows.withColumn("lengths", F.array(*[F.col(f"`{c}`") for c in names]))
