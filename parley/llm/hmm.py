"""A hidden Markov language model, trained by Baum-Welch over all training documents.

Tokens are words and one end per document. The most frequent words are symbols of their own, all others share one rare
symbol, within which a word has its smoothed unigram share; so the model gives every text a probability.

1. Words are counted in each task, and counts are added by word. The full vocabulary stays a distributed table.
2. A bounded head of it is broadcast. One pass turns documents into symbols, sums what the head decides, and keeps the
   words beyond the head, whose counts come from a join by word. The result is staged in the shared folder.
3. Baum-Welch: tasks run scaled forward-backward over the staged sequences, whole ones, and give expected counts, which are
   added by index; the driver sees one row per parameter of the model. A long sequence is cut into segments only to work on
   them side by side: products of its steps' matrices give the exact messages that pass between them.
4. Scoring: the scaled forward recursion over whole sequences, plus the shares of rare words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import HELD, held_out, most_frequent, stage, tidy

#: Parameters: states, words that are symbols, rounds of Baum-Welch.
STATES, SYMBOL_WORDS, ROUNDS = 8, 30_000, 4
#: Tokens that a segment of a long sequence has, and tokens of a batch of forward-backward, about; neither changes results.
SEGMENT, BATCH_TOKENS = 1024, 400_000
#: Bounds of the broadcast head: words, bytes of a word, and bytes of a word that is a symbol.
HEAD_WORDS, HEAD_BYTES, SYMBOL_BYTES = 400_000, 64, 1024
#: Words that a counting task holds before it passes its counts on.
TABLE_WORDS = 500_000
ADD = 0.1  # of the smoothed unigram


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column("text"):
                for w in words_of(text.as_py()):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) >= TABLE_WORDS:
                    yield out()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(tidy(run, "hmm"), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The frequent part of the vocabulary, with the totals of all of it. Symbols: 0 rare, 1 to n_symbols the first words,
    n_symbols + 1 the end."""

    words: list[bytes]
    counts: np.ndarray
    n_symbols: int
    docs: int  # training documents, each with one end
    total: int  # training tokens, ends included
    distinct: int  # distinct training tokens, the end included

    def index(self) -> dict[bytes, int]:
        held = HELD.setdefault("hmm", {})
        if held.get("head") is not self:
            held["head"], held["index"] = self, {w: i for i, w in enumerate(self.words)}
        return held["index"]

    @property
    def spread(self) -> float:
        """Denominator of the unigram."""
        return self.total + ADD * (self.distinct + 1)

    @property
    def rare_total(self) -> int:
        return self.total - self.docs - int(self.counts[: self.n_symbols].sum())

    @property
    def rare_spread(self) -> float:
        """Denominator of a word's share of the rare symbol."""
        return self.rare_total + ADD * (max(0, self.distinct - self.n_symbols - (self.docs > 0)) + 1)


def head_of(vocab: DataFrame, docs: int) -> Head:
    """The head of (word, n): at most HEAD_WORDS words of bounded length, most frequent first, ties and those of nearly equal
    counts at its end by hash."""
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = F.octet_length("word")
    top = most_frequent(vocab.where(size <= SYMBOL_BYTES), "word", SYMBOL_WORDS)
    rest = most_frequent(vocab.where(size <= HEAD_BYTES), "word", HEAD_WORDS)
    words = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))
    n_symbols = len(words)
    words |= dict(zip(rest["word"].to_pylist(), rest["n"].to_pylist()))
    return Head([w.encode() for w in words], np.fromiter(words.values(), np.int64, len(words)), n_symbols, docs, total + docs, distinct + (docs > 0))


_CODED = "rid bigint, doc_id bigint, train boolean, ids binary, n_known bigint, log_sum double, n_rare bigint, rare_log double, rest array<struct<word:string,m:bigint>>"


def encode(docs: DataFrame, shared, folds: int) -> DataFrame:
    """Rows of docs as symbol sequences, with what the head decides: tokens known, the sum of log10(c + ADD) over tokens
    of the head and ends, the same over rare ones, and the words beyond the head. rid tells rows apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (~held_out(F.col("doc_id"), folds)).alias("train"), "text")
    rest_kind = pa.list_(pa.struct([("word", pa.string()), ("m", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        get = head.index().get
        logs, known, end = np.log10(head.counts + ADD), head.docs > 0, math.log10(head.docs + ADD)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                ws = words_of(text.as_py())
                at = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
                symbols = np.where((at >= 0) & (at < head.n_symbols), at + 1, 0)
                inside = at[at >= 0]
                rare = inside[inside >= head.n_symbols]
                rest: dict[bytes, int] = {}
                for i in np.flatnonzero(at < 0).tolist():
                    rest[ws[i]] = rest.get(ws[i], 0) + 1
                ids = np.append(symbols, head.n_symbols + 1).astype(np.int16).tobytes()
                row = (ids, len(inside) + known, float(logs[inside].sum()) + end, len(ws) - int((symbols > 0).sum()), float(logs[rare].sum()), [{"word": w.decode(), "m": m} for w, m in rest.items()])
                for c, v in zip(cols, row):
                    c.append(v)
            types = (pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), rest_kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "train")), *(pa.array(c, t) for c, t in zip(cols, types))], ["rid", "doc_id", "train", "ids", "n_known", "log_sum", "n_rare", "rare_log", "rest"])

    return rows.mapInArrow(tidy(run, "hmm"), _CODED)


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # (symbols, states)


def first_model(head: Head) -> Model:
    """Unigram emissions, each state's tilted by a fixed function of symbol and state; states tend to stay."""
    n = head.n_symbols + 2
    counts = np.concatenate([[head.rare_total], head.counts[: head.n_symbols], [head.docs]]) + ADD
    tilt = np.random.default_rng(0).uniform(0.2, 1.8, (n, STATES))
    emit = counts[:, None] * tilt
    step = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), step, emit / emit.sum(0))


def _layout(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: their order, all symbols, each one's first place, and how many go on at each step."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.concatenate([ids[i] for i in order]).astype(np.int64)
    going = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    return order, flat, np.cumsum(sizes) - sizes, going


def forward_log10(ids: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the probability of each whole symbol sequence, by the scaled forward recursion."""
    if not ids:
        return np.zeros(0)
    order, flat, first, going = _layout(ids)
    out = np.zeros(len(ids))
    alpha = model.start * model.emit[flat[first]]
    for t, n in enumerate(going):
        if t:
            alpha = (alpha[:n] @ model.step) * model.emit[flat[first[:n] + t]]
        scale = alpha.sum(1)
        out[:n] += np.log10(scale)
        alpha /= scale[:, None]
    back = np.empty(len(ids))
    back[order] = out
    return back


def transfers(ids: list[np.ndarray], model: Model) -> np.ndarray:
    """For each sequence of symbols the product of its steps' matrices, each a transition and the symbol's emission, up to a
    positive factor."""
    order, flat, first, going = _layout(ids)
    out = np.tile(np.eye(STATES), (len(ids), 1, 1))
    for t, n in enumerate(going):
        moved = (out[:n] @ model.step) * model.emit[flat[first[:n] + t]][:, None, :]
        out[:n] = moved if t % 8 else moved / moved.sum((1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out / out.sum((1, 2), keepdims=True)
    return back


def messages(whole: list[np.ndarray], model: Model, segment: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The segments of whole sequences, which of them begin one, the probabilities of the states before each of the others,
    given what precedes it, and in proportion those of what follows each, given the states at its end."""
    pieces, opens = [], []
    for ids in whole:
        for at in range(0, len(ids), segment):
            pieces.append(ids[at : at + segment])
            opens.append(at == 0)
    opens = np.array(opens)
    before, after = np.full((len(pieces), STATES), 1 / STATES), np.ones((len(pieces), STATES))
    parts = np.flatnonzero(~opens | np.append(~opens[1:], False))  # segments of sequences of several
    if len(parts):
        # the first step of a sequence has the start instead of a transition
        step = dict(zip(parts.tolist(), transfers([pieces[i][1:] if opens[i] else pieces[i] for i in parts.tolist()], model)))
        for i in parts.tolist():
            if opens[i]:
                own = model.start * model.emit[pieces[i][0]]
            else:
                before[i] = own
            own = own @ step[i]
            own /= own.sum()
        for i in parts[::-1].tolist():
            if not opens[i]:
                back = step[i] @ after[i]
                after[i - 1] = back / back.sum()
    return pieces, opens, before, after


def expected_counts(whole: list[np.ndarray], model: Model, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions over whole sequences, by scaled forward-backward; segment sets how they are
    cut to be worked on side by side, which doesn't change the result."""
    pieces, opens, before, after = messages(whole, model, segment)
    order, flat, first, going = _layout(pieces)
    opens, before, after = opens[order], before[order], after[order]
    alphas, emits, places = [], [], []
    for t, n in enumerate(going):
        place = flat[first[:n] + t]
        emit = model.emit[place]
        alpha = ((alphas[-1][:n] @ model.step) if t else np.where(opens[:, None], model.start, before @ model.step)) * emit
        scale = alpha.sum(1, keepdims=True)
        alpha /= scale
        emit /= scale
        alphas.append(alpha)
        emits.append(emit)
        places.append(place)
    steps, emissions = np.zeros((STATES, STATES)), np.zeros_like(model.emit)
    beta, gammas = np.zeros((0, STATES)), []
    for t in range(len(going) - 1, -1, -1):
        n, inner = going[t], len(beta)
        here = np.empty((n, STATES))
        if inner:
            right = beta * emits[t + 1]
            here[:inner] = right @ model.step.T
            steps += alphas[t][:inner].T @ right
        # what follows a segment, scaled so that the states at its end have probabilities that add up to 1
        here[inner:] = after[inner:n] / (alphas[t][inner:] * after[inner:n]).sum(1, keepdims=True)
        beta = here
        gammas.append(alphas[t] * beta)
    right = (beta * emits[0])[~opens]
    steps += before[~opens].T @ right  # between segments
    gamma, place = np.concatenate(gammas), np.concatenate(places[::-1])
    for s in range(STATES):
        emissions[:, s] = np.bincount(place, gamma[:, s], len(emissions))
    return gammas[-1][opens].sum(0), steps * model.step, emissions


def train(coded: DataFrame, head: Head, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the training rows of coded; a table without any leaves the first model."""
    model = first_model(head)
    sequences = coded.where("train").select("ids")
    n, unigram = head.n_symbols + 2, first_model(head).emit.mean(1)
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(STATES * (1 + STATES + n))
            held: list[np.ndarray] = []
            tokens = 0

            def add() -> None:
                sums[:] += np.concatenate([x.ravel() for x in expected_counts(held, shared.value)])
                held.clear()

            for batch in batches:
                for ids in batch.column("ids"):
                    held.append(np.frombuffer(ids.as_py(), np.int16))
                    tokens += len(held[-1])
                    if tokens >= BATCH_TOKENS:
                        add()
                        tokens = 0
            if held:
                add()
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["i", "v"])

        found = sequences.mapInArrow(tidy(run, "hmm"), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # one row a parameter
        sums = np.zeros(STATES * (1 + STATES + n))
        sums[found["i"].to_numpy()] = found["v"].to_numpy()
        start, step, emit = np.split(sums, np.cumsum([STATES, STATES * STATES]))
        start, step, emit = start + 1 / STATES, step.reshape(STATES, STATES) + 1 / STATES, emit.reshape(n, STATES) + unigram[:, None]
        model = Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def score_documents(docs: DataFrame, folds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    Learns from the rows outside of the held-out fold. A null or empty text is one end, a long one a sequence as any other;
    repeated rows count and are scored each, equal texts have equal scores; a null id counts as the empty text for its fold;
    an empty table gives an empty result. Without training rows the unigram gives every token probability 1. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out(F.col("doc_id"), folds))
    vocab = stage(count_words(training), "hmm-words")
    head = head_of(vocab, training.select("doc_id").count())
    coded = stage(encode(docs, spark.sparkContext.broadcast(head), folds), "hmm-coded")
    shared = spark.sparkContext.broadcast(train(coded, head, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.int16) for x in batch.column("ids")]
            cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array(forward_log10(ids, shared.value))]
            names = ["rid", "doc_id", "train", "n_known", "log_sum", "n_rare", "rare_log"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, "n_tokens", "forward"])

    kept = coded.select("rid", "doc_id", "train", "n_known", "log_sum", "n_rare", "rare_log", "ids")
    scored = kept.mapInArrow(tidy(run, "hmm"), "rid bigint, doc_id bigint, train boolean, n_known bigint, log_sum double, n_rare bigint, rare_log double, n_tokens bigint, forward double")
    # words beyond the head are rare, so no key of this join is hot
    rest = coded.select("rid", F.explode("rest").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.m").alias("m"))
    rest = rest.join(vocab, "word", "left").select("rid", "m", F.coalesce("n", F.lit(0)).alias("c"))
    rest = rest.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * F.log10(F.col("c") + ADD)).alias("more_log"))
    zero = F.lit(0.0)
    more_log = F.coalesce("more_log", zero)
    return scored.join(rest, "rid", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(head.total)).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") + more_log - F.col("n_tokens") * math.log10(head.spread)).alias("base_score"),
        (F.col("forward") + F.col("rare_log") + more_log - F.col("n_rare") * math.log10(head.rare_spread)).alias("score"),
    )
