"""N-gram Jaccard join: exact set-similarity self-join of documents as sets of word shingles, by prefix lists with
set-relation skipping, and the classes of linked documents.

1. A text becomes the set of 64-bit hashes of its shingles. Equal sets are one set, named by its own hash, from here on.
2. Shingles are ordered globally: those that no task has seen in several documents first, by hash, then the frequent ones
   by their count. Two sets that link share a shingle among the first n - ceil(t n) + 1 of each: its prefix.
3. Prefixes are dealt by shingle into index lists, whose entries are in blocks of one set size, by position. Within a short
   list a set meets the blocks that its size and position allow, and of each the entries up to the last position that
   allows it; the rest is skipped unread. Candidates pass a bound on the overlap from parity sketches of about a bit a
   shingle (the symmetric difference of two sets is never less than the distance of their sketches). Of what is left each
   set is first verified with one partner.
4. Long lists are mostly many relatives of one set. Members that may link by sketch, directly or through others, form a family, whose
   members are dealt in blocks; a task takes a pair of blocks with their whole sets and derives a set's answers from the
   overlaps of the most similar set before it: partners are tried nearest first, overlaps are intersected only where that
   set's leave it open, all of a component that is reached are skipped at once, and only the links that join components
   leave the task, fewer than there are members.
5. Candidates whose ends these links have joined are skipped, and only the others are verified. Whole sets are made once,
   for those sets that are still wanted.

No pair is lost: filters are upper bounds, and a pair that is skipped is in one component already. Copies are never
expanded into pairs. Sets of different contents that have the same 64-bit hash and size would be taken for equal; among
10^9 sets that is expected 0.03 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import HELD, most_frequent, release, stage, tidy
from parley.llm.components import connected_components

#: Words per shingle, and the similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Documents of one task that have a shingle before it counts as frequent there; most frequent shingles that are broadcast
#: (16 bytes each; those beyond it keep the order of rare ones, which costs time but loses nothing).
LOCAL_DF, MOST_FREQUENT = 3, 500_000
#: Members of a short list; members of a block of a family; size of the map of wanted sets, in bits.
SHORT, BLOCK, WANTED_BITS = 16, 1024, 1 << 22
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1_000_000
#: Shingles that a task counts at once.
COUNT_SHINGLES = 3_000_000
#: Least and most bits of a sketch.
LEAST_BITS, MOST_BITS = 512, 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FACTORS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = HELD.setdefault("shingles", {})
    if len(held.get("powers", ((),))[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(max(n, CHUNK_BYTES + 150_000), base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        held["powers"] = made
    return held["powers"][0][:n], held["powers"][1][:n]


def hashed_words(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, bytes, edges, start, hash) over runs of texts: the run's bytes, where each of its texts begins in them,
    and where each word begins, with its hash."""
    at = 0
    while at < len(texts):
        parts, size, end, edges = [], 0, at, []
        while end < len(texts) and (size < CHUNK_BYTES or end == at):
            body = (texts[end] or "").encode().lower()
            edges.append(size)
            parts.append(body)
            size += len(body) + 1
            end += 1
        raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        space = _SPACE[raw]
        turn = np.flatnonzero(np.diff(np.concatenate([[True], space])))  # starts and ends of words in turn
        start, stop = turn[0::2], turn[1::2]
        powers, inverse = _powers(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        yield at, end, raw, np.array(edges), start, mix((sums[stop] - sums[start]) * inverse[start])
        at = end


def grams_of(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The hash of each run of width words."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width if len(out) else 0):
        out += words[k : len(words) - width + 1 + k] * _FACTORS[k]
    return mix(out)


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words, but some, has one shingle of all of them."""
    out: list[np.ndarray] = []
    for _, _, raw, edges, start, words in hashed_words(texts):
        first = np.searchsorted(start, np.append(edges, len(raw)))
        grams = grams_of(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    return int(mix(mix(s + np.uint64(0x632BE59BD9B4E019)).sum(keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles in each of 2 ** k buckets, at least as many as shingles within the bounds, as numbers of
    64 bits. Halves of a sketch add up, without carry, to the sketch of half as many buckets."""
    bits = min(max(1 << max(0, len(s) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _texts(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield part, shingle_sets(part.column("text").to_pylist())


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, ranks by rising count) of the shingles that tasks have seen in LOCAL_DF documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[n >= LOCAL_DF].view(np.int64)), pa.array(n[n >= LOCAL_DF])], ["token", "n"])

        for _, sets in _texts(batches):
            held += [s for s in sets if len(s)]
            if sum(map(len, held)) > COUNT_SHINGLES:
                yield out()
        if held:
            yield out()

    counts = docs.select("text").mapInArrow(tidy(run, "shingles"), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = most_frequent(stage(counts, "join-counts"), "token", MOST_FREQUENT)
    tokens, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def describe_sets(docs: DataFrame, id_col: str, shared) -> DataFrame:
    """id, n, sid, sketch and prefix of every row; sketch and prefix are null where the task has given them for an equal
    set before, or the set is empty."""
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs["text"].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        quick = np.zeros(1 << 22, bool)
        quick[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        for batch, sets in _texts(batches):
            sids, sketches, prefixes = [], [], []
            for s in sets:
                sid = set_hash(s) if len(s) else None
                sids.append(sid)
                if sid is None or sid in seen:
                    sketches.append(None)
                    prefixes.append(None)
                    continue
                seen.add(sid)
                sketches.append(sketch(s))
                maybe = np.flatnonzero(quick[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(tokens, s[maybe]), max(0, len(tokens) - 1))
                same = tokens[at] == s[maybe] if len(tokens) else np.zeros(0, bool)
                heavy = maybe[same]
                rank = counts[at[same]] if len(heavy) else np.zeros(0, np.int64)
                light = np.delete(s, heavy)
                size = prefix_length(len(s))
                if len(light) < size:
                    light = np.concatenate([light, s[heavy[np.lexsort((s[heavy], rank))]]])
                prefixes.append(light[:size].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))],
                ["id", "n", "sid", "sketch", "prefix"],
            )

    return rows.mapInArrow(tidy(run, "shingles"), f"id {kind}, n bigint, sid bigint, sketch array<bigint>, prefix array<bigint>")


def _lists(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, sid, n, pos, edges): the distinct entries of a task's index lists, each list in order of set size, then position,
    and where each begins; lists of one member are left out."""
    parts = [[batch.column(c).to_numpy() for c in ("token", "sid", "place")] for batch in batches if batch.num_rows]
    if not parts:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(1, np.int64))
    token, sid, place = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((sid, place, token))
    token, sid, place = token[order], sid[order], place[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (place[1:] != place[:-1]) | (sid[1:] != sid[:-1])])
    token, sid, place = token[new], sid[new], place[new]
    head = np.concatenate([[True], token[1:] != token[:-1]])
    size = np.diff(np.append(np.flatnonzero(head), len(token)))
    keep = np.repeat(size > 1, size)
    size = size[size > 1]
    return token[keep], sid[keep], place[keep] >> 31, place[keep] & ((1 << 31) - 1), np.concatenate([[0], np.cumsum(size)])


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least intersection of linked sets of n and m shingles."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def list_pairs(sid: np.ndarray, n: np.ndarray, pos: np.ndarray, edges: np.ndarray, short: int) -> np.ndarray:
    """Distinct pairs (a < b) within the lists of at most short members that size and position allow.

    A list's entries of one size are a block, in order of position. Blocks of sets too large for a set are skipped, and so is
    a block for whose size the set's own position is too late; of other blocks, entries behind the last position that leaves
    enough shingles are skipped. Linked sets are found at the first shingle that they share: none before it is common.
    """
    found, held = np.zeros((0, 2), np.int64), []

    def join(parts: list[np.ndarray]) -> np.ndarray:
        pairs = np.concatenate(parts)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])] if len(pairs) else pairs

    size = np.diff(edges)
    use = np.flatnonzero(np.repeat(size <= short, size))
    if not len(use):
        return found
    sid, n, pos = sid[use], n[use], pos[use]
    key = (np.repeat(np.arange(len(size)), size)[use] << 32) | n
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    block_key, block = key[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    within = (block << 32) | pos
    last = np.searchsorted(block_key, ((key >> 32) << 32) | (100 * n // PERCENT), side="right")
    for at in range(0, len(use), 100_000):
        own = np.arange(at, min(at + 100_000, len(use)))
        blocks = last[own] - block[own]
        i = np.repeat(own, blocks)
        b = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + block[i]
        need = least_overlap(n[i], n[start[b]])
        far = n[i] - pos[i] >= need
        i, b, need = i[far], b[far], need[far]
        begin = np.maximum(start[b], i + 1)
        end = np.searchsorted(within, (b << 32) | np.maximum(n[start[b]] - need, 0), side="right")
        count = np.maximum(end - begin, 0)
        left = np.repeat(i, count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        held.append(np.sort(np.stack([sid[left], sid[right]], 1), axis=1))
        if sum(map(len, held)) > 1_000_000:
            found, held = join([found, *held]), []
    pairs = join([found, *held])
    return pairs[pairs[:, 0] != pairs[:, 1]]


def _candidates_of(short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of short lists as (a, b, null); members of long lists as (null, sid, token)."""
        token, sid, n, pos, edges = _lists(batches)
        pairs = list_pairs(sid, n, pos, edges, short)
        size = np.diff(edges)
        long = np.repeat(size > short, size)
        count = int(long.sum())
        a = pa.concat_arrays([pa.array(pairs[:, 0]), pa.nulls(count, pa.int64())])
        b = pa.array(np.concatenate([pairs[:, 1], sid[long]]))
        t = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(token[long])])
        whole = pa.RecordBatch.from_arrays([a, b, t], ["a", "b", "token"])
        for at in range(0, whole.num_rows, 100_000):
            yield whole.slice(at, 100_000)

    return run


def _may_link(n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can link when their symmetric difference is at least distance."""
    overlap = np.minimum((n + m - distance) // 2, np.minimum(n, m))
    return (100 + PERCENT) * overlap >= PERCENT * (n + m)


def family_links(sets: list[np.ndarray], comps: list[int], block: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join the components of sorted sets, as pairs of places. With block, the sets' blocks, only pairs of
    different blocks are tried.

    A set's answers are derived from those of the most similar set that was done before it: with a shingles of theirs in
    common, its overlap with a third set differs from the other's by no more than the shingles of either beyond a. Only where
    these bounds leave it open are two sets intersected.
    """
    parent: dict[int, int] = {}
    done: list[dict[int, int]] = [{} for _ in sets]  # known overlaps with later sets
    similar: dict[int, tuple[int, int]] = {}  # the most similar set done before, and the overlap with it

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    bits = 4096
    sketches = np.stack([np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.uint64) for s in sets])
    order = np.argsort(sizes, kind="stable")
    links = []
    for at, i in enumerate(order.tolist()):
        rest = order[at + 1 :]
        rest = rest[PERCENT * sizes[rest] <= 100 * sizes[i]]
        if block is not None:
            rest = rest[block[rest] != block[i]]
        distance = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(1, dtype=np.int64)
        may = _may_link(sizes[rest], sizes[i], distance)
        other, shared = similar.get(i, (i, 0))
        for j in rest[may][np.argsort(distance[may], kind="stable")].tolist():
            a, b = root(comps[i]), root(comps[j])
            if a == b:
                continue
            need = int(least_overlap(sizes[i], sizes[j]))
            known = done[other].get(j)
            if known is None or known - (sizes[other] - shared) < need <= known + (sizes[i] - shared):
                k = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                done[i][j] = k
                if j not in similar or similar[j][1] * sizes[i] < k * sizes[similar[j][0]]:
                    similar[j] = i, k
                linked = k >= need
            else:
                linked = known - (sizes[other] - shared) >= need
            if linked:
                parent[a] = b
                links.append((i, j))
    return links


def _family(table: pa.Table) -> pa.Table:
    sid, lists = table["sid"].to_numpy(), table["body"].combine_chunks()
    flat, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
    sets = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    within = table["i"][0].as_py() == table["j"][0].as_py()
    links = family_links(sets, table["comp"].to_pylist(), None if within else table["own"].to_numpy())
    pairs = np.sort(sid[np.array(links, np.int64).reshape(-1, 2)], axis=1)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _distances(lead: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Distance of one sketch to each of others, at the smaller size of the two."""

    def fold(rows: np.ndarray, words: int) -> np.ndarray:
        while rows.shape[-1] > words:
            half = rows.shape[-1] // 2
            rows = rows[..., :half] ^ rows[..., half:]
        return rows

    out = np.zeros(len(others), np.int64)
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    for words in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == words)
        size = min(words, len(lead))
        rows = fold(np.stack([others[i] for i in at.tolist()]), size) ^ fold(lead, size)
        out[at] = np.bitwise_count(rows.view(np.uint64)).sum(1, dtype=np.int64)
    return out


def relatives(n: np.ndarray, sketches: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest over sets, as pairs of places, whose trees are the components of `may link by sketch`."""
    left, queue, found = np.arange(len(n)), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        if len(left):
            may = _may_link(n[left], n[i], _distances(sketches[i], [sketches[k] for k in left.tolist()]))
            queue += left[may].tolist()
            found += [(i, k) for k in left[may].tolist()]
            left = left[~may]
    return found


def _list_relatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The relatives within each long list of a task, fewer pairs than the list has members."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    token, sid, n = (table[c].to_numpy() for c in ("token", "sid", "n"))
    lists = table["sketch"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    order = np.lexsort((sid, token))
    edges = np.flatnonzero(np.concatenate([[True], np.diff(token[order]) != 0, [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = order[a:b]
        pairs = np.array(relatives(n[own], [flat[ends[i - 1] if i else 0 : ends[i]] for i in own.tolist()]), np.int64).reshape(-1, 2)
        ids = np.sort(sid[own][pairs], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0], pa.int64()), pa.array(ids[:, 1], pa.int64())], ["a", "b"])


def families(long: DataFrame, info: DataFrame) -> DataFrame:
    """(node, component): members of long lists (token, sid) that may link, directly or by others, in some list."""
    members = long.join(info, "sid").select("token", "sid", "n", "sketch").repartition("token")
    return connected_components(members.mapInArrow(tidy(_list_relatives, "shingles"), "a bigint, b bigint"))


def link_families(family: DataFrame, sets: DataFrame, comps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the components of the members of families."""
    sizes = family.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = family.join(sizes, "component").select(F.col("node").alias("sid"), F.col("component").alias("family"), "blocks")
    own = members.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = own.join(comps.withColumnsRenamed({"node": "sid", "component": "comp"}), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    dealt = named.join(sets.select("sid", "body"), "sid").select("sid", "comp", "own", "body", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.groupBy("family", "i", "j").applyInArrow(_family, "a bigint, b bigint")


def bound(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that the bounds on size and overlap leave."""
    left = info.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = info.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    words = F.least(F.size("ka"), F.size("kb"))

    def folded(c: str):
        # word i of the smaller sketch is the sum without carry of words i, i + words, ... of the larger one
        steps = F.sequence(F.lit(0), (F.size(c) / words - 1).cast("int"))
        at = lambda i: F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, k: s.bitwiseXOR(F.get(c, i + k * words)))
        return F.when(F.size(c) == words, F.col(c)).otherwise(F.transform(F.sequence(F.lit(0), words - 1), at))

    distance = F.aggregate(F.zip_with(folded("ka"), folded("kb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("na") + F.col("nb")
    overlap = F.least(F.floor((both - F.col("distance")) / 2), F.col("na"), F.col("nb"))
    pairs = pairs.distinct().join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return pairs.withColumn("distance", distance).where((100 + PERCENT) * overlap >= PERCENT * both).select("a", "b")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, n, body) of the sets whose sid is in wanted, each once.

    Sets are made again where their texts lie, and only wanted ones are shuffled. Which ones these are is told to the
    tasks by a map of WANTED_BITS hashed bits, so its size is fixed, and a set too many costs time only.
    """
    wanted = wanted.distinct()
    on = wanted.select(F.pmod("sid", F.lit(WANTED_BITS)).alias("bit")).distinct().toArrow()["bit"].to_numpy()
    bits = np.zeros(WANTED_BITS, bool)
    bits[on] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(shared.value).view(bool), set()
        for _, sets in _texts(batches):
            kept = []
            for s in sets:
                if len(s) and bits[(sid := set_hash(s)) % WANTED_BITS] and sid not in seen:
                    seen.add(sid)
                    kept.append((sid, len(s), s.view(np.int64)))
            cols = [[k[i] for k in kept] for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], ["sid", "n", "body"])

    sets = docs.select("text").mapInArrow(tidy(run, "shingles"), "sid bigint, n bigint, body array<bigint>")
    return sets.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, decided on whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("body").alias("xa"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("body").alias("xb"))
    whole = pairs.join(left, "a").join(right, "b").withColumn("k", F.size(F.array_intersect("xa", "xb")))
    return whole.where(100 * F.col("k") >= PERCENT * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")


def one_partner(pairs: DataFrame) -> DataFrame:
    """For each set the pair with its least partner."""
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", "b")).distinct()


def link_sets(docs: DataFrame, described: DataFrame, ordered: bool = True, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(node, component) of the sets that link with another set, among the described sets of docs. ordered: prefix has shingles
    in the global order, so their positions bound the overlap; else it has other keys that linked sets may share."""
    info = stage(described.where("sketch is not null").select("sid", "n", "sketch").dropDuplicates(["sid"]), "join-info")
    # size and position in one number, by which a list is ordered
    postings = described.select(F.posexplode("prefix").alias("pos", "token"), "sid", "n").select("token", "sid", (F.shiftleft("n", 31) + (F.col("pos") if ordered else 0)).alias("place"))
    found = stage(postings.repartition("token").mapInArrow(tidy(_candidates_of(short), "shingles"), "a bigint, b bigint, token bigint"), "join-candidates")
    pairs = stage(bound(found.where("token is null").select("a", "b"), info), "join-pairs")
    long = found.where("token is not null").select("token", F.col("b").alias("sid"))
    family = families(long, info)
    sets = stage(whole_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("sid")).union(family.select("node"))), "join-sets")

    first = stage(one_partner(pairs), "join-first")
    links = stage(verify(first, sets), "join-links")
    joined = connected_components(links)
    if not family.isEmpty():
        links = stage(links.union(link_families(family, sets, joined, block)), "join-links")
        joined = connected_components(links)
    left, right = joined.select(F.col("node").alias("a"), F.col("component").alias("ca")), joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = pairs.join(left, "a", "left").join(right, "b", "left").where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b")
    return connected_components(links.union(verify(apart.join(first, ["a", "b"], "left_anti"), sets)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """id, n_shingles and component_id, the smallest id that is reachable by links, for every row of docs.

    Null and empty texts have no shingles and are linked with nothing, not even each other. Rows of equal texts are linked;
    a null id is smaller than none, so a class of null ids only has a null component. An empty table gives an empty
    result; other columns are ignored.
    """
    slim = docs.select(docs[f"`{id_col}`"].alias(id_col), docs[f"`{text_col}`"].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(slim))
    release()
    described = stage(describe_sets(slim, id_col, shared), "join-described")
    linked = link_sets(slim, described, True, short, block)
    rows = described.select("id", "n", "sid")
    rows = rows.join(linked, rows["sid"] == linked["node"], "left").select("id", "n", F.coalesce("component", "sid").alias("class"))
    rows = stage(rows, "join-rows")
    # classes of several rows only, staged, so that the join may split a hot class's rows
    least = stage(rows.where("class is not null").groupBy("class").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "join-least")
    return rows.join(least, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that a row of their class comes before: one row of each class stays, with all its columns.

    Order is by id, nulls last, then a hash of the text, so repeated rows also leave one. Rows without words are linked with nothing and all
    stay. Columns may have any names; an empty table gives an empty result.
    """
    slim = stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")), "join-docs")
    rows = slim.select("rid", F.col(f"row.`{text_col}`").alias("text"))
    classed = classes(rows, "rid").select(F.col("rid").alias("of"), F.col("component_id").alias("class"))
    # classes of several rows: the others keep their one row
    order = F.struct(F.col(f"row.`{id_col}`").isNull(), F.col(f"row.`{id_col}`"), F.xxhash64(F.col(f"row.`{text_col}`")), F.col("rid"))
    several = stage(classed.join(classed.groupBy("class").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "class"), "join-several")
    placed = slim.join(several, slim["rid"] == several["of"]).select("rid", "class", order.alias("order"))
    kept = placed.groupBy("class").agg(F.min("order").alias("first")).select(F.col("first.rid").alias("rid"))
    gone = stage(several.join(kept, several["of"] == kept["rid"], "left_anti").select("of"), "join-gone")
    left = slim.join(gone, slim["rid"] == gone["of"], "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
