"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

Training takes a sample of labelled rows of bounded expected size. Tasks count, per hashed n-gram of characters, the toxic and
the other documents that have it; the log ratio r of the smoothed rates scales the feature, and the n-grams whose ratio is
significant stay, however many. Logistic regression on presence * r gives the weights. Scoring is one pass over all whole
texts, without a shuffle; the model has a weight for each of 2 ** BUCKET_BITS buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parley.llm.common import held_out, release, stage, tidy, training_row

#: Parameters: n-gram lengths in characters, log2 of hash buckets, expected labelled rows in the sample, tasks that count.
ORDERS, BUCKET_BITS, SAMPLE_ROWS, TASKS = (4, 5, 6), 20, 12_000, 8
#: Least z of a log ratio, smoothing in documents, strength of the L2 penalty per document, most steps, and the change of a
#: score's exponent in a step under which descent ends.
LEAST_Z, SMOOTH, PENALTY, STEPS, TOLERANCE = 3.0, 5.0, 1e-4, 300, 1e-2
#: Characters of text that are hashed at once.
CHUNK_CHARS = 1_000_000


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, starts, stops, buckets of one order) over runs of texts: text k of the run has buckets starts[k] up to
    stops[k]. Texts are lower-cased and set apart by zeros, so a text's n-grams don't depend on its neighbours."""
    pad, at = "\0" * ORDERS[-1], 0
    while at < len(texts):
        parts, size, end = [pad], len(pad), at
        starts, stops = [], []
        while end < len(texts) and (size < CHUNK_CHARS or end == at):
            body = texts[end].lower()
            starts.append(size - 1)  # the zero before the text marks its beginning
            parts += [body, pad]
            stops.append(size + len(body))
            size += len(body) + len(pad)
            end += 1
        raw = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        h, n = np.zeros(len(raw), np.uint32), 0
        for order in ORDERS:
            while n < order:
                h = h[: len(raw) - n] * np.uint32(0x01000193) + raw[n:]
                n += 1
            yield at, end, np.array(starts), np.array(stops), ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        at = end


def features(texts: list[str], flags: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct buckets of each text, of those that are flagged."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for first, last, starts, stops, buckets in grams(texts):
        at = np.flatnonzero(flags[buckets]) if flags is not None else np.arange(len(buckets))
        for k, (a, b) in enumerate(np.searchsorted(at, np.stack([starts, stops], 1)).tolist()):
            found[first + k].append(buckets[at[a:b]])
    return [np.unique(np.concatenate(f)) for f in found]


@dataclass
class Model:
    """Weights by bucket, with flags of those that aren't zero, and the bias."""

    flags: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for i, f in enumerate(features(texts, self.flags)):
            z[i] += self.weights[f].sum()
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def log_ratios(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-count ratio and its z for each bucket; classes are smoothed in proportion to their sizes, so that a
    bucket without documents has ratio 0."""
    share = n_p / (n_p + n_q)
    a, b = p + SMOOTH * share, q + SMOOTH * (1 - share)
    r = np.log((a / n_p) / (b / n_q))
    return r, r / np.sqrt(1 / a + 1 / b)


def regress(col: np.ndarray, sizes: np.ndarray, y: np.ndarray, r: np.ndarray, block: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty; accelerated descent. Row i has the next sizes[i] numbers of col, which name its
    features; a feature's value is its r. Rows are taken in blocks, so that a step needs little memory beyond col itself."""
    n, ends = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    blocks = [(at, min(at + block, n)) for at in range(0, n, block)]

    def forward(w: np.ndarray) -> np.ndarray:
        scaled, out = w * r, np.zeros(n)
        for a, b in blocks:
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), scaled[col[ends[a] : ends[b]]], minlength=b - a)
        return out

    def backward(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r))
        for a, b in blocks:
            out += np.bincount(col[ends[a] : ends[b]], np.repeat(g[a:b], sizes[a:b]), minlength=len(r))
        return r * out

    # a bound of the curvature by power iteration
    v, top = np.ones(len(r)) / max(1, len(r)) ** 0.5, 1.0
    for _ in range(12):
        u = backward(forward(v))
        top = max(np.linalg.norm(u), 1e-12)
        v = u / top
    rate = 1 / (0.25 * (1.2 * top / n + 1) + PENALTY)
    w = past = np.zeros(len(r))
    bias = past_bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    last = np.zeros(n)
    for t in range(STEPS):
        k = t / (t + 3)
        ahead, ahead_bias = w + k * (w - past), bias + k * (bias - past_bias)
        z = forward(ahead) + ahead_bias
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        past, past_bias = w, bias
        w = ahead - rate * (backward(g) / n + PENALTY * ahead)
        bias = ahead_bias - rate * g.mean()
        if t > 20 and np.abs(z - last).max() < TOLERANCE:
            break
        last = z
    return w * r, float(bias)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    for batch in batches:
        yield [t or "" for t in batch.column("text").to_pylist()], np.array(batch.column("y").to_pylist(), np.int64)


def train(sample: DataFrame) -> Model:
    """Fits a model to sample (text, y); without rows of both classes the model is the smoothed rate of class 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << BUCKET_BITS), np.uint32), [0, 0]
        for texts, y in _batches(batches):
            for f, label in zip(features(texts), y):
                counts[label, f] += 1
                n[label] += 1
        yield pa.RecordBatch.from_pydict({"n0": [n[0]], "n1": [n[1]], "counts": [zlib.compress(counts.tobytes(), 1)]})

    dealt = sample.repartition(TASKS)
    parts = dealt.mapInArrow(tidy(count), "n0 bigint, n1 bigint, counts binary").collect()  # TASKS rows
    n0, n1 = sum(r["n0"] for r in parts), sum(r["n1"] for r in parts)
    flags, weights = np.zeros(1 << BUCKET_BITS, bool), np.zeros(1 << BUCKET_BITS)
    if not n0 or not n1:
        return Model(flags, weights, float(np.log((n1 + 1) / (n0 + 1))))
    counts = np.zeros((2, 1 << BUCKET_BITS))
    for row in parts:
        counts += np.frombuffer(zlib.decompress(row["counts"]), np.uint32).reshape(2, -1)
    r, z = log_ratios(counts[1], counts[0], n1, n0)
    chosen = np.flatnonzero(np.abs(z) >= LEAST_Z)
    flags[chosen] = True
    shared = sample.sparkSession.sparkContext.broadcast(flags)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (np.cumsum(shared.value) - 1).astype(np.int32)
        for texts, y in _batches(batches):
            yield pa.RecordBatch.from_pydict({"y": y, "f": [number[f].tobytes() for f in features(texts, shared.value)]})

    rows = dealt.mapInArrow(tidy(pick), "y bigint, f binary").toArrow()  # about SAMPLE_ROWS rows
    y = rows["y"].to_numpy().astype(float)
    col = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(f.as_py(), np.int32) for f in rows["f"])])
    sizes = np.array([len(f.as_buffer()) // 4 for f in rows["f"]], np.int64)
    del rows
    w, bias = regress(col, sizes, y, r[chosen])
    weights[chosen] = w
    return Model(flags, weights, bias)


def sample_of(docs: DataFrame, labels: DataFrame, folds: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` labelled training rows at most, as (text, y), chosen by a hash of the id.

    The chosen labels are few by construction and are broadcast, so that texts aren't shuffled.
    """
    usable = labels.where(training_row(F.col("doc_id"), folds) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("bigint").alias("y"))
    rate = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "y")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Returns _row, a struct of the named columns of docs (doc_id by default), and score, for every row of docs.

    Trains on rows of labels (doc_id, toxic) outside of the held-out fold. A null or empty text has no n-grams and the
    score of the bias; a text of any length is scored whole. Null ids are scored, never trained on; equal texts have equal
    scores, whatever their rows; a document with several labels counts once for each, and so does each of several rows of
    one id. An empty table gives an empty result, empty labels a score of 0.5. Other columns are ignored.
    """
    model = train(stage(sample_of(docs, labels, folds), "toxic-sample"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    release()  # what training took on the driver
    frame = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns or ["doc_id"]]).alias("_row"), docs["text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(scores)], ["_row", "score"])

    return frame.mapInArrow(tidy(run), StructType([frame.schema["_row"], StructField("score", DoubleType())]))


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.5 or more) of every row of docs."""
    ident = F.col("_row.doc_id")
    return score_documents(docs, labels, folds).select(ident.alias("doc_id"), held_out(ident, folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of docs, with their columns, whose score is under 0.5. Nulls, empty and long texts, repeated rows and empty tables
    are as in score_documents; columns may have any names."""
    kept = score_documents(docs, labels, folds, docs.columns).where(F.col("score") < 0.5)
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
