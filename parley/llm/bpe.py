"""Byte-level BPE by DuckDB queries inside each task.

Encoding: the distinct pre-tokens of a chunk of documents become token-position rows. A recursive query joins them with
the merge table and contracts, in each round, the leftmost pair of least rank of every word, until no word has a pair
left. Decoding: the id-position rows of the documents join the vocabulary, and an ordered aggregation puts each
document's bytes together.

Nothing is shuffled. A task holds one chunk of documents, the vocabulary, and a cache of encoded words, all bounded.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parley.llm.common import HELD, tidy

#: Characters of text per chunk, and words that the cache of a worker holds before it is emptied.
CHUNK_CHARS, CACHE_WORDS = 1_500_000, 500_000
#: Words of more bytes are merged with a heap instead, because rounds of one merge each would take quadratic time.
LONG_WORD = 256
#: Words that one recursive query encodes.
ENCODE_WORDS = 100_000

#: Rows are (spot, sym): a spot is word << 16 | position. A round finds the next symbol of every row, the best pair of
#: every word, and keeps the rows of words that had one, without the pair's second row.
ENCODE = """
WITH RECURSIVE s(spot, sym, round) AS (
  SELECT spot, sym, 0 FROM symbols
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT s.*, lead(spot) OVER w AS nspot, lead(sym) OVER w AS nsym FROM s WINDOW w AS (ORDER BY spot)
   ), b AS MATERIALIZED (
     SELECT p.spot >> 16 AS word, min(m.id::BIGINT << 16 | (p.spot & 65535)) AS best,
            arg_min(p.nspot, m.id::BIGINT << 16 | (p.spot & 65535)) AS gone
     FROM p JOIN merges m ON m.l = p.sym AND m.r = p.nsym WHERE p.spot >> 16 = p.nspot >> 16 GROUP BY 1
   )
   SELECT spot, CASE WHEN spot & 65535 = best & 65535 THEN (best >> 16)::INTEGER ELSE sym END, round + 1
   FROM p JOIN b ON spot >> 16 = word WHERE spot <> gone)
)
SELECT (spot >> 16)::INTEGER AS word, list(sym ORDER BY spot) AS ids
FROM s JOIN (SELECT spot >> 16 AS lword, max(round) AS last FROM s GROUP BY 1) ON spot >> 16 = lword AND round = last
GROUP BY spot >> 16
"""

#: One thread aggregates the rows in the order of the subquery.
DECODE = """
SELECT doc, string_agg(piece, '') AS body
FROM (SELECT doc, piece FROM tokens JOIN vocab USING (id) ORDER BY doc, pos) GROUP BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes with one vocabulary; one per worker and vocabulary."""

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        made = HELD.setdefault("bpe", {})
        if (path, pattern) not in made:
            made[path, pattern] = cls(load_ranks(path), pattern)
        return made[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.cache: dict[str, tuple[bytes, str]] = {}
        get, pairs = ranks.get, []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
        l, r, i = np.array(pairs, np.int32).reshape(-1, 3).T
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({"l": l, "r": r, "id": i})  # noqa: F841  (read by name below)
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")

    def _merge_long(self, word: bytes) -> list[int]:
        """The same contraction by a heap of pairs and a linked list, for one long word."""
        ranks = self.ranks
        part = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(ranks[a + b], i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j] = a + b, b""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(part) and part[x] + part[y] in ranks:
                    heapq.heappush(heap, (ranks[part[x] + part[y]], x, part[x], part[y]))
        return [ranks[p] for p in part if p]

    def learn(self, words: set[str]) -> None:
        """Encodes words that the cache doesn't hold."""
        queue: list[tuple[str, bytes]] = []
        for w in words:
            body = w.encode()
            if (whole := self.ranks.get(body)) is not None:
                self._keep(w, np.array([whole], np.int32))
            elif len(body) > LONG_WORD:
                self._keep(w, np.array(self._merge_long(body), np.int32))
            else:
                queue.append((w, body))
        for at in range(0, len(queue), ENCODE_WORDS):
            part = queue[at : at + ENCODE_WORDS]
            sizes = np.array([len(b) for _, b in part])
            starts = np.cumsum(sizes) - sizes
            n = int(sizes.sum())
            symbols = pa.table({  # noqa: F841
                "spot": (np.repeat((np.arange(len(part)) << 16) - starts, sizes) + np.arange(n)).astype(np.int64),
                "sym": self.single[np.frombuffer(b"".join(b for _, b in part), np.uint8)],
            })
            done = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
            lists = done["ids"].chunk(0)
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            for word, a, b in zip(done["word"].to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
                self._keep(part[word][0], flat[a:b])

    def _keep(self, word: str, ids: np.ndarray) -> None:
        self.cache[word] = ids.tobytes(), ",".join(map(self.names.__getitem__, ids.tolist()))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, and the same as decimal text."""
        words = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        known = self.cache.get
        found = [list(map(known, ws)) for ws in words]
        new = {w for ws, fs in zip(words, found) if None in fs for w, f in zip(ws, fs) if f is None}
        if new:
            self.learn(new)
            get = self.cache.__getitem__
            found = [list(map(get, ws)) if None in fs else fs for ws, fs in zip(words, found)]
        return [(np.frombuffer(b"".join([f[0] for f in fs]), np.int32), ",".join([f[1] for f in fs])) for fs in found]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        n = int(sizes.sum())
        tokens = pa.table({  # noqa: F841
            "doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes),
            "pos": (np.arange(n) - starts).astype(np.int32),
            "id": np.concatenate([np.zeros(0, np.int32), *ids]),
        })
        out = [b""] * len(ids)
        done = self.db.sql(DECODE).to_arrow_table()
        for doc, body in zip(done["doc"].to_pylist(), done["body"].to_pylist()):
            out[doc] = body.encode("latin-1")
        return out


def chunks(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts (null: empty) of runs of rows that have about most characters in all, one row at least."""
    for batch in batches:
        ids, texts = batch.column(id_col), [t or "" for t in batch.column(text_col).to_pylist()]
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= most:
                yield ids.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield ids.slice(start), texts[start:]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, ids array<int> for every row of docs; a null text has no ids. Equal rows give equal rows; an empty
    table gives an empty result; other columns are ignored."""
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for ids, texts in chunks(batches, id_col, "_text"):
            yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in codec.encode(texts)], pa.list_(pa.int32()))], [id_col, "ids"])

    return rows.mapInArrow(tidy(run, "bpe"), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Returns id, body binary for rows of id, ids array<int>; null ids give an empty body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            ids = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            for at in range(0, len(ids), 500):
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(at, 500), pa.array(codec.decode(ids[at : at + 500]), pa.binary())], [id_col, "body"])

    return encoded.select(id_col, "ids").mapInArrow(tidy(run, "bpe"), f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, body binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Ids are kept in the task between the two steps instead of being written. A null text counts as empty: no tokens, and
    digests of the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for ids, texts in chunks(batches, "doc_id", "text"):
            coded = codec.encode(texts)
            bodies = codec.decode([x for x, _ in coded])
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(x) for x, _ in coded], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in coded]),
                    pa.array([hashlib.sha256(b).hexdigest() for b in bodies]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run, "bpe"), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
