"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task. Its words are numbered over the words of the test phrases; every other word
is one separator symbol, since no phrase can span it, and stretches shorter than the shortest phrase are left out. The
rest is indexed: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix with popcount ranks, and
suffix positions sampled at fixed distances and at the start of each stretch. All distinct phrases are found at once by
backward search, their occurrences are located by walking to a sampled position, and the word spans are merged.

Documents aren't shuffled: a document is searched where it is read. Phrases are sent in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.llm.common import stage, tidy

#: The bytes between words, and the word pattern over lower-cased text that they come from.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}

#: Words per phrase window, words per shard, distance of sampled positions, bytes of test items per broadcast block.
WINDOW, SHARD_WORDS, SAMPLE, BLOCK_BYTES = 8, 2_000_000, 16, 16 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        low = self.words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1


class WaveletMatrix:
    """Ranks of and access to symbols below 2 ** depth."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.levels = []
        for shift in range(depth - 1, -1, -1):
            ones = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where i falls in the last level among entries of the symbol; place(c, i) - place(c, 0) is c's rank at i."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and their places in the last level."""
        symbol = np.zeros(len(i), np.int64)
        for _, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one == 1, zeros + ones, i - ones)
        return symbol, i


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, where each separator (0) sorts before all words and by its own position, so that no
    comparison passes a separator. Prefix doubling over those suffixes that still are equal."""
    n = len(symbols)
    first = np.argsort(symbols, kind="stable")
    in_order = symbols[first]
    starts = np.searchsorted(in_order, in_order, side="left")
    starts[in_order == 0] = np.flatnonzero(in_order == 0)
    rank = np.empty(n, np.int64)
    rank[first] = starts
    left = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    step = 1
    while len(left):
        key = rank[left] * (n + 1) + np.where(left + step < n, rank[np.minimum(left + step, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        old = rank[left]
        at = np.arange(len(left))
        new_group, new_key = np.r_[True, old[1:] != old[:-1]], np.r_[True, key[1:] != key[:-1]]
        rank[left] = old + np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        alone = new_key & np.r_[new_key[1:], True]
        left = left[~alone]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """An index over symbols (0: separator) that counts and locates phrases of words."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        symbols = np.concatenate([symbols.astype(np.int64), [0]])
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the first suffix is preceded by the closing separator
        self.n, self.depth = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.tree = WaveletMatrix(before, self.depth)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])[:-1]
        self.zero = self.tree.place(np.arange(n_symbols), np.zeros(n_symbols, np.int64))
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase; phrases are padded at the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > j) & (low < high))
            c = phrases[live, j]
            base = self.start[c] - self.zero[c]
            low[live], high[live] = base + self.tree.place(c, low[live]), base + self.tree.place(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            here = rows[live]
            done = self.sampled.get(here) == 1
            out[live[done]] = self.samples[self.sampled.rank(here[done])] + steps
            live = live[~done]
            c, at = self.tree.access(rows[live])
            rows[live] = self.start[c] + at - self.zero[c]
            steps += 1
        return out


@dataclass
class Phrases:
    """A block of test items: word numbers from 1, distinct windows, and the items of each window."""

    numbers: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases_of(items: list[tuple[object, str | None]], width: int = WINDOW) -> Phrases:
    """Windows of items (id, text). Items without an id or without words have none."""
    numbers: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    names: dict[str, int] = {}
    for ident, text in items:
        ws = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)] if ident is not None else []
        if ws:
            item = names.setdefault(str(ident), len(names))
            for i in range(max(1, len(ws) - width + 1)):
                found.setdefault(tuple(ws[i : i + width]), set()).add(item)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    windows = np.zeros((len(found), width), np.int64)
    for row, w in zip(windows, found):
        row[: len(w)] = w
    sizes = np.fromiter(map(len, found.values()), np.int64, len(found))
    flat = np.fromiter((i for s in found.values() for i in sorted(s)), np.int64, int(sizes.sum()))
    return Phrases(numbers, windows, lengths, np.concatenate([[0], np.cumsum(sizes)]), flat, list(names))


def expand(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of [start, start + size) one after another, and the index of the range that each comes from."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(which)), which


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Merged word spans and item names of each document, given as word numbers (0: in no phrase)."""
    n = len(docs)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    names: list[list[str]] = [[] for _ in range(n)]
    if not len(phrases.lengths) or not n:
        return spans, names
    sizes = np.fromiter(map(len, docs), np.int64, n) + 1
    first = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int32)
    for at, d in zip(first, docs):
        text[at : at + len(d)] = d
    edges = np.diff(np.concatenate([[0], (text != 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    enough = end - begin >= phrases.lengths.min()
    begin, size = begin[enough], (end - begin)[enough] + 1  # each stretch with one separator behind it
    origin, _ = expand(begin, size)
    if not len(origin):
        return spans, names
    index = FMIndex(text[origin], len(phrases.numbers) + 1)
    low, high = index.search(phrases.windows, phrases.lengths)
    rows, window = expand(low, np.maximum(high - low, 0))
    if not len(rows):
        return spans, names
    start = origin[index.locate(rows)]
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + phrases.lengths[window], -1)
    inside = np.cumsum(change) > 0
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8)]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc = np.searchsorted(first, begin, side="right") - 1
    for d, a, b in zip(doc.tolist(), (begin - first[doc]).tolist(), (end - first[doc]).tolist()):
        spans[d].append((a, b))
    pairs = np.unique((np.searchsorted(first, start, side="right") - 1) * len(phrases.lengths) + window)
    doc, window = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    at, which = expand(phrases.item_starts[window], phrases.item_starts[window + 1] - phrases.item_starts[window])
    pairs = np.unique(doc[which] * len(phrases.names) + phrases.items[at])
    for d, i in zip((pairs // len(phrases.names)).tolist(), (pairs % len(phrases.names)).tolist()):
        names[d].append(phrases.names[i])
    return spans, names


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of code points, from the first word's start to the last word's end."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


_FOUND = "struct<n_words:bigint,spans:array<struct<a:bigint,b:bigint>>,cuts:array<struct<a:bigint,b:bigint>>,items:array<string>>"


def _search_block(frame: DataFrame, shared) -> DataFrame:
    """frame (_row, _text, _found): adds what one block of phrases finds to _found."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    kind = pa.struct([("n_words", pa.int64()), ("spans", span), ("cuts", span), ("items", pa.list_(pa.string()))])

    def finish(rows: list[tuple[str, dict | None, int, np.ndarray]], phrases: Phrases) -> list[dict]:
        out = []
        for (text, old, n, _), spans, names in zip(rows, *search_shard([r[3] for r in rows], phrases)):
            if old:
                spans = merge(spans + [(s["a"], s["b"]) for s in old["spans"]])
                names = names + old["items"]
            cuts = char_spans(text, spans) if spans else []
            out.append({"n_words": n, "spans": [{"a": a, "b": b} for a, b in spans], "cuts": [{"a": a, "b": b} for a, b in cuts], "items": sorted(set(names))})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        get = phrases.numbers.get
        for batch in batches:
            rows, held, start = [], 0, 0
            for i, (text, old) in enumerate(zip(batch.column("_text"), batch.column("_found"))):
                text = text.as_py() or ""
                ws = words_of(text)
                rows.append((text, old.as_py(), len(ws), np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws))))
                held += len(ws)
                if held >= SHARD_WORDS or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_text"), pa.array(finish(rows, phrases), kind)], ["_row", "_text", "_found"])
                    rows, held, start = [], 0, i + 1

    return frame.mapInArrow(tidy(run), StructType([frame.schema["_row"], *StructType.fromDDL(f"_text string, _found {_FOUND}").fields]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, columns: list[str], text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Searches every whole text of docs for every window of the benchmark's items (item_id, text).

    Returns _row, a struct of the named columns of docs, _text, and _found: n_words, spans (merged hit spans in words),
    cuts (the same in code points) and items (distinct item ids as strings, sorted). A null or empty text has no words.
    Benchmark rows without id or words have no windows; rows of the same id are one item. Empty tables give no rows or no
    hits. The benchmark is read in blocks of at most about BLOCK_BYTES, however large it is.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    frame = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_row"), docs[f"`{text_col}`"].alias("_text"), F.lit(None).cast(_FOUND).alias("_found"))
    for k in range(n_blocks):
        block = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k).toArrow()
        shared = spark.sparkContext.broadcast(phrases_of(list(zip(block["item_id"].to_pylist(), block["text"].to_pylist())), width))
        frame = _search_block(frame, shared)
        if n_blocks > 1:  # one block is held at a time
            frame = stage(frame, "leaks")
            shared.destroy()
    return frame


def contamination_report(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (least_items or more), items and cuts of each row. Nulls, empty
    and long texts, ties, repeated rows and empty tables are as in find_leaks; other columns are ignored."""
    f = "_found"
    return find_leaks(docs, benchmark, ["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col(f"{f}.n_words").alias("n_words"),
        F.aggregate(f"{f}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"]).alias("n_hit"),
        F.size(f"{f}.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f"{f}.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(f"{f}.items") >= least_items).alias("contaminated"),
        F.col(f"{f}.items").alias("items"),
        F.col(f"{f}.cuts").alias("cuts"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, text_col: str = "text") -> DataFrame:
    """docs without contaminated rows; from the others the removal spans are cut. Rows without hits stay as they are.

    Keeps docs' columns, whatever their names, and repeated rows; a null text stays null; an empty table gives an empty
    result, an empty benchmark leaves docs as they are. Where a text is cut, n_chars, if docs has it, becomes its new length.
    """
    found = find_leaks(docs, benchmark, docs.columns, text_col).where(F.size("_found.items") < least_items)
    text = F.col(f"_row.`{text_col}`")
    ends = F.concat(F.transform("_found.cuts", lambda s: s["a"]), F.array(F.length(text).cast("bigint")))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_found.cuts", lambda s: s["b"]))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
    found = found.withColumn("_kept", F.when(F.size("_found.cuts") > 0, kept).otherwise(text))

    def column(c: str):
        if c == text_col:
            return F.col("_kept").alias(c)
        if c == "n_chars":
            return F.when(F.size("_found.cuts") > 0, F.length("_kept").cast(docs.schema[c].dataType)).otherwise(F.col("_row.n_chars")).alias(c)
        return F.col(f"_row.`{c}`").alias(c)

    return found.select(*map(column, docs.columns))
