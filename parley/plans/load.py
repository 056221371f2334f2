"""Loading: references to one (train, val) pair of lazy tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import normalize as N
from parley.operators import ordering as O
from parley.operators.validate import message_fault, split_valid
from parley.schema import prune
from parley.sources.catalog import CATALOG, Catalog, Dataset, Reference, parse_reference
from parley.sources.readers import read_file, read_folder


def load_one(spark: SparkSession, reference: Reference, dataset: Dataset, columns: dict[str, str] | None = None, strict: bool = False, remove_unused: bool = True) -> DataFrame:
    """The valid canonical rows of one reference, with _ord, an ordinal of each row. It follows Spark's
    splits of the files, so it is the same in every run as long as the files and the sizes of splits are."""
    import os

    path, parts = dataset.path or reference.name, []
    is_file = bool(os.path.splitext(path)[1])
    for subset in dataset.select(reference.subsets):
        raw = read_file(spark, path) if is_file else read_folder(spark, path, subset.subset, subset.split)
        raw = N.safe_rename(raw, columns or {}).withColumn("channel_ord", F.monotonically_increasing_id())
        made = N.cast_media(subset.preprocess(raw))
        good, _ = split_valid(made, message_fault(F.col("messages")), strict)
        ordinal = good.select("*").withColumnRenamed("channel_ord", "_ord")
        parts.append(prune(ordinal, ("_ord", "solution")) if remove_unused else ordinal)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_ord", F.col("_ord") + (i << 56)) for i, p in enumerate(parts)])
    return out


def load(spark: SparkSession, references: str | list[str], ratio: float = 0.0, seed: int = 42, shuffle: bool = False, columns: dict[str, str] | None = None, strict: bool = False, remove_unused: bool = True, probabilities: list[float] | None = None, stop: str = "first_exhausted", catalog: Catalog = CATALOG) -> tuple[DataFrame | None, DataFrame | None]:
    """(train, val) of all references: each loaded, sampled and split by itself, then concatenated or, with probabilities,
    interleaved, and put in pseudo-random order if asked. Either may be None."""
    trains, vals = [], []
    for text in [references] if isinstance(references, str) else references:
        reference = parse_reference(text)
        df = load_one(spark, reference, catalog.find(reference), columns, strict, remove_unused)
        train, val = O.train_val_split(df, ratio, "_ord", reference.rows, seed)
        trains += [train] if train is not None else []
        vals += [val] if val is not None else []

    def join(parts: list[DataFrame]) -> DataFrame | None:
        if not parts:
            return None
        out = O.interleave(parts, ["_ord"] * len(parts), probabilities, seed, stop) if probabilities and len(parts) > 1 else O.concat(parts)
        return O.shuffle(out, "_ord", seed) if shuffle else out

    return join(trains), join(vals)


def fill_identity(text, tag, names: tuple[str, str], authors: tuple[str, str]):
    """{{NAME}} and {{AUTHOR}} by the row's language tag, zh or en; pairs are (zh, en)."""
    zh = tag == "zh"
    name, author = F.when(zh, F.lit(names[0])).otherwise(F.lit(names[1])), F.when(zh, F.lit(authors[0])).otherwise(F.lit(authors[1]))
    return F.replace(F.replace(text, F.lit("{{NAME}}"), name), F.lit("{{AUTHOR}}"), author)
