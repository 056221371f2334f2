"""Substring dedup: passages that repeat, exactly or nearly, within and across documents, are removed but for one.

Paragraphs are of two kinds, both of LEAST_WORDS words at least:

- A text's lines. A line becomes the set of 64-bit hashes of its word shingles, and equal sets are one set from here on. A
  distinct set has a MinHash signature of BANDS bands of ROWS minima; sets with an equal band collide. Colliding sets are
  joined and verified exactly on whole sets by the steps of the n-gram Jaccard join, and their components are taken.
- Passages that no line break marks: the LEAST_WORDS words behind each anchor, a place whose hash of two words is the least
  among REACH places to either side. What is an anchor depends on the words around it only, so a passage that repeats has
  the same anchors in it wherever it stands: about one every 2 * REACH + 1 words. Equal passages are one component.

Of each component the first by document id, row and place stays; the others are removed, lines with their line end. Words of
a passage that stays aren't removed by one that overlaps it.

A pair of lines of similarity s collides with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.75. Equal lines are always
found, and what is reported is always verified; equal passages are told by a 64-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from parley.llm.common import stage, stage_alone, tidy
from parley.llm.ngram_join import _FACTORS, _powers, grams_of, hashed_words, link_sets, mix, set_hash, sketch

#: Bands and minima per band; shingles whose minima are taken at once.
BANDS, ROWS, AT_ONCE = 12, 2, 20_000
#: Least words of a paragraph: what is shorter is common speech. Places to either side that an anchor is less than.
LEAST_WORDS, REACH = 20, 5

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS numbers for each set of one shingle or more."""
    out, at = [np.zeros((0, BANDS), np.int64)], 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size < AT_ONCE or end == at):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        begin = np.cumsum([0, *map(len, sets[at : end - 1])])
        minima = np.stack([np.minimum.reduceat(mix(flat ^ seed), begin) for seed in _SEEDS], 1)
        # a minimum's own place is part of the number, so that bands of different places don't collide
        out.append(mix(mix(minima + _SEEDS).reshape(-1, BANDS, ROWS).sum(2)).view(np.int64))
        at = end
    return np.concatenate(out)


def line_sets(raw: np.ndarray, edges: np.ndarray, start: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text, number within it, shingle set) of the lines of least words or more, from hashed words."""
    begin = np.sort(np.concatenate([edges, np.flatnonzero(raw == 10) + 1]))
    text = np.searchsorted(edges, begin, side="right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, edges)[text]
    first = np.searchsorted(start, np.append(begin, len(raw)))
    full = np.flatnonzero(np.diff(first) >= max(1, least))
    grams, sets = grams_of(words), []
    for a, b in zip(first[full].tolist(), first[full + 1].tolist()):
        sets.append(np.unique(grams[a : b - 4]) if b - a >= 5 else mix((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
    return text[full], number[full], sets


def passages(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the least words behind each anchor; first has each text's first word and their number."""
    most = np.uint64((1 << 64) - 1)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    two = grams_of(words, 2)
    # texts are set apart by reach places that are greater than all others
    spread = np.full(len(words) + reach * (len(sizes) + 1), most)
    at = np.arange(len(words)) + reach * (text + 1)
    inner = np.flatnonzero(text[:-1] == text[1:])
    spread[at[inner]] = np.minimum(two[inner], most - np.uint64(1))
    left = np.flatnonzero(first[1:][text] - np.arange(len(words)) >= least)
    for j in range(1, reach + 1):
        here = spread[at[left]]
        left = left[(here < spread[at[left] - j]) & (here <= spread[at[left] + j])]
    powers, inverse = _powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])])
    return text[left], left - first[text[left]], mix((sums[left + least] - sums[left]) * inverse[left])


def describe_paragraphs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """rid, id, pos, n, sid, sketch and bands (as prefix) of every paragraph of docs (rid, id, text). Lines have n, the size of
    their set; sketch and bands are null where the task has given them for an equal set before, or the set is of one or two
    shingles and can only link with equal ones. Passages have a null n and their hash as sid."""
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                for at, _, raw, edges, start, words in hashed_words(batch.column("text").to_pylist()):
                    of, number, sets = line_sets(raw, edges, start, words, least)
                    sids = [set_hash(s) for s in sets]
                    new = []
                    for k, s in enumerate(sets):
                        if len(s) > 2 and sids[k] not in seen:
                            seen.add(sids[k])
                            new.append(k)
                    sketches, keys = [None] * len(sets), [None] * len(sets)
                    for k, row in zip(new, bands([sets[k] for k in new])):
                        sketches[k], keys[k] = sketch(sets[k]), row
                    text, place, h = passages(words, np.searchsorted(start, np.append(edges, len(raw))), max(1, least))
                    rows = pa.array(np.concatenate([of, text]) + at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("rid").take(rows),
                            batch.column("id").take(rows),
                            pa.array(np.concatenate([number, place]).astype(np.int32)),
                            pa.concat_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(h), pa.int64())]),
                            pa.concat_arrays([pa.array(sids, pa.int64()), pa.array(h.view(np.int64))]),
                            pa.concat_arrays([pa.array(sketches, lists), pa.nulls(len(h), lists)]),
                            pa.concat_arrays([pa.array(keys, lists), pa.nulls(len(h), lists)]),
                        ],
                        ["rid", "id", "pos", "n", "sid", "sketch", "prefix"],
                    )

    kind = StructType([docs.schema["rid"], docs.schema["id"], *StructType.fromDDL("pos int, n bigint, sid bigint, sketch array<bigint>, prefix array<bigint>").fields])
    return docs.select("rid", "id", "text").mapInArrow(tidy(run, "shingles"), kind)


def repeats(held: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """rid with lines, the numbers of the lines to remove, and gone and kept, the places of repeated passages to remove and to
    keep, for the rows of held (rid, id, text) that have some."""
    first = F.struct(F.col("id").isNull().alias("none"), "id", "rid", "pos")
    # aggregated where the rows lie, so that a hot paragraph leaves a task once
    firsts = F.min(first).alias("first"), F.count(F.lit(1)).alias("times")

    def line_keepers(lines: DataFrame) -> DataFrame:
        texts = held.select(F.explode(F.split("text", "\n", -1)).alias("text"))
        linked = stage_alone(lambda: link_sets(texts, lines, ordered=False), "paragraph-links")
        each = stage(lines.groupBy("sid").agg(*firsts), "paragraph-firsts")
        classed = each.join(linked, each["sid"] == linked["node"], "left").select("sid", "first", "times", F.coalesce("component", "sid").alias("class"))
        classed = stage(classed, "paragraph-classes")
        several = classed.groupBy("class").agg(F.min("first").alias("least"), F.sum("times").alias("times")).where("times > 1")
        return classed.select("sid", "class").join(stage(several, "paragraph-least"), "class").select("sid", F.col("least.rid").alias("keep_rid"), F.col("least.pos").alias("keep_pos"))

    def passage_keepers(spots: DataFrame) -> DataFrame:
        return spots.groupBy("sid").agg(*firsts).where("times > 1").select("sid", F.col("first.rid").alias("keep_rid"), F.col("first.pos").alias("keep_pos"))

    def placed(some: DataFrame, keepers: Callable[[DataFrame], DataFrame], kind: str) -> DataFrame:
        # keepers are staged, so that the join may split a hot paragraph's rows
        met = some.select("rid", "pos", "sid").join(stage_alone(lambda: keepers(some), f"{kind}-keepers"), "sid")
        return met.select("rid", "pos", F.lit(kind).alias("kind"), ((F.col("rid") == F.col("keep_rid")) & (F.col("pos") == F.col("keep_pos"))).alias("keep"))

    def find() -> DataFrame:
        rows = stage(describe_paragraphs(held, least), "paragraphs")
        lines, spots = rows.where("n is not null"), rows.where("n is null")
        return placed(lines, line_keepers, "line").where("NOT keep").union(placed(spots, passage_keepers, "passage"))

    found = stage_alone(find, "paragraphs-found")

    def places(test: str, name: str):
        return F.collect_list(F.when(F.expr(test), F.col("pos"))).alias(name)

    return found.groupBy("rid").agg(places("kind = 'line'", "lines"), places("kind = 'passage' AND NOT keep", "gone"), places("kind = 'passage' AND keep", "kept"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans (start, end), in order; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def without(spans: list[tuple[int, int]], keep: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of merged spans isn't in the merged spans of keep."""
    out, k = [], 0
    for a, b in spans:
        while k < len(keep) and keep[k][1] <= a:
            k += 1
        i = k
        while a < b and i < len(keep) and keep[i][0] < b:
            if keep[i][0] > a:
                out.append((a, keep[i][0]))
            a, i = keep[i][1], i + 1
        if a < b:
            out.append((a, b))
    return out


def cut(text: str, lines: list[int], gone: list[int], kept: list[int], least: int) -> tuple[list[tuple[int, int]], str]:
    """The spans that go, none across lines, and the text that is left."""
    spans: list[tuple[int, int]] = []
    if gone:
        words = [m.span() for m in _WORD.finditer(text)]
        runs = without(merged([(g, g + least) for g in gone]), merged([(k, k + least) for k in kept]))
        spans = [(words[a][0], words[b - 1][1]) for a, b in runs]
    out, left, at, k, whole = [], [], 0, 0, set(lines)
    for i, line in enumerate(text.split("\n")):
        end = at + len(line)
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if i in whole:
            out.append((at, end))
        else:
            own, j, pieces, here = [], k, [], at
            while j < len(spans) and spans[j][0] < end:
                own.append((max(at, spans[j][0]), min(end, spans[j][1])))
                j += 1
            for a, b in own:
                pieces.append(text[here:a])
                here = b
            left.append("".join([*pieces, text[here:end]]))
            out += own
        at = end + 1
    return out, "\n".join(left)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """id, n_paragraphs (lines that aren't blank), n_removed (spans), chars_removed, removed and the text that is left, for every
    row of docs.

    removed has start:end in code points of the text as it was, end exclusive, without line ends. Null ids come last in the
    order that decides which paragraph stays, ties go by row and place; repeated rows are rows of their own; a null text
    stays null, an empty one empty, a long one is searched whole; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    held = stage(docs.select(F.monotonically_increasing_id().alias("rid"), docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), "paragraph-docs")
    rows = held.join(repeats(held, least).hint("shuffle_hash"), "rid", "left").select("id", "text", "lines", "gone", "kept")
    fields = [StructField(c, t()) for c, t in (("n_paragraphs", LongType), ("n_removed", LongType), ("chars_removed", LongType), ("removed", StringType), (text_col, StringType))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, *places in zip(*(batch.column(c).to_pylist() for c in ("text", "lines", "gone", "kept"))):
                spans, left = ([], text) if not any(places[:2]) else cut(text, *places, least)
                own = sum(1 for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r"))
                for c, v in zip(cols, (own, len(spans), sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans), left)):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, *(f.name for f in fields)])

    return rows.mapInArrow(tidy(run), StructType([StructField(id_col, held.schema["id"].dataType), *fields]))
