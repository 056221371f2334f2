"""A corpus pipeline of five stages; each works on what its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one the encoded
documents. run() applies them in turn, writing each result as Parquet in the shared folder and reading it again.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any names; the
docstrings say what becomes of them. Columns other than text and n_chars pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.bpe import round_trip_digests
from parley.llm.common import stage
from parley.llm.decontaminate import remove_leaks
from parley.llm.ngram_join import keep_one
from parley.llm.secrets import redact_secrets
from parley.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the labels of sf_dir, outside of the held-out fold. Null and
    empty texts have the score of the bias, texts are scored whole, and of equal texts all stay or all go, in every row; an
    empty table stays empty."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the row of smallest doc_id stays, one with a null id only where it has no other; of
    repeated rows one stays. Null and empty texts are linked with nothing and all stay; an empty table stays empty."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; from the others what is hit is cut, in every row. Null and empty
    texts have no windows and stay; benchmark rows without id or words have none; an empty table stays empty."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, in every row; a null text stays null; an empty table stays empty."""
    return redact_secrets(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with token count and digests of ids and decoded bytes, a row for each row; a null text counts as empty; an empty
    table gives an empty result. Other columns don't stay."""
    import public_tokenizers

    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", bpe),
]

#: A trained classifier decides the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
    return docs
