"""The queries of this subpackage over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.decontaminate import contamination_report

    found = contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.sharding import shard_by_bytes

    return shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=40)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.substrings import drop_repeats

    return drop_repeats(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.jpeg import media_report

    return media_report(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.ngram_join import classes

    return classes(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.warc import archive_and_read

    return archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parley.llm.bpe import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.hmm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_secrets": op6_secrets,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_bpe": op9_bpe,
    "op10_hmm": op10_hmm,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
  SELECT body, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY body
)
SELECT p.page_id, n AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN keeper IS NULL OR keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> p.page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.body = k.body AND p.n >= 1000
"""

#: Bytes of a text t as a list of numbers, its crc32 over a table of 256 entries, both in plain SQL.
ORACLE_SQL["op2_sharding"] = """
WITH RECURSIVE step(b, r, c) AS (
  SELECT b::UBIGINT, 0, b::UBIGINT FROM range(256) AS t(b)
  UNION ALL
  SELECT b, r + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM step WHERE r < 8
), tab AS (
  SELECT list(c ORDER BY b) AS crc FROM step WHERE r = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents
), crcs AS (
  SELECT t, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(hex(encode(t))) // 2),
           lambda i: (16 * (instr('0123456789ABCDEF', substr(hex(encode(t)), 1 + 2 * i, 1)) - 1)
                 + instr('0123456789ABCDEF', substr(hex(encode(t)), 2 + 2 * i, 1)) - 1)::UBIGINT)),
         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM (SELECT DISTINCT t FROM d), tab
), o AS (
  SELECT doc_id, t, size, row_number() OVER w AS rn,
         sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
  FROM d WINDOW w AS (ORDER BY md5(t), doc_id)
), s AS (
  SELECT *, (before * 40 // total)::INTEGER AS shard FROM o
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY rn) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s JOIN crcs USING (t)
"""

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE_SQL["op1_decontamination"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), i AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[k:k + 7], ' ') AS g
  FROM i, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(k) WHERE len(w) > 0
), dw AS (
  SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS t(k)
), hit AS (
  SELECT rid, k, n, item_id FROM dw JOIN win USING (n, g)
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS t(p) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ORACLE_SQL["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT rid, array_to_string(w[k:k + 4], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(k) WHERE len(w) > 0
), n AS (
  SELECT rid, count(*) AS n FROM g GROUP BY rid
), p AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r(rid, other) AS (
  SELECT rid, rid FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON r.other = e.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM r JOIN d USING (rid) JOIN d o ON o.rid = r.other LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id
"""
