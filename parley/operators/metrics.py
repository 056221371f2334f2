"""Evaluation aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import ngrams, words
from parley.operators.ordering import running
from parley.operators.windows import groups_at


def length_stats(df: DataFrame, length: str, by: list[str] = ()) -> DataFrame:
    """mean, population std, min, max and size of lengths; arrays of lengths are summed first."""
    c = F.col(length)
    if df.schema[length].dataType.typeName() == "array":
        c = F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.groupBy(*by).agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("size"))


def mean_metric(value: str, empty: float = 0.0) -> Column:
    return F.coalesce(F.avg(value), F.lit(empty))


def inference_stats(df: DataFrame, key: str, order: str, seconds: float) -> DataFrame:
    """Token sums, samples and rates; the last row of an id counts."""
    from parley.operators.windows import last_per_key

    last = last_per_key(df, key, order)
    return last.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("generated_tokens").alias("generated_tokens"), F.count(F.lit(1)).alias("samples")).select(
        "*", (F.col("samples") / seconds).alias("samples_per_s"), (F.col("generated_tokens") / seconds).alias("tokens_per_s")
    )


def token_accuracy(df: DataFrame, pairs: str, strategy: str = "token", ignore: int = -100) -> DataFrame:
    """One row: acc over the array of (label, pred) structs, by token or by whole sequence; ignored labels don't count."""
    kept = F.filter(pairs, lambda p: p["label"] != ignore)
    hits = F.size(F.filter(kept, lambda p: p["label"] == p["pred"]))
    if strategy == "sequence":
        return df.agg(F.avg((hits == F.size(kept)).cast("double")).alias("acc"))
    return df.agg((F.sum(hits) / F.sum(F.size(kept))).alias("acc"))


def exact_match(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.col(pred).eqNullSafe(F.col(label)).cast("double")).alias("acc"))


def multilabel_accuracy(df: DataFrame, logits: str, labels: str) -> DataFrame:
    """Rows of which all classes are right: logit > 0 against 1."""
    right = F.forall(F.arrays_zip(F.col(logits).alias("x"), F.col(labels).alias("y")), lambda p: (p["x"] > 0).cast("int") == p["y"])
    return df.agg(F.avg(right.cast("double")).alias("acc"))


def argmax(values: Column) -> Column:
    """Index of the first largest element."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def listwise_predictions(df: DataFrame, score: str, label: str, order: str, by: list[str] = ()) -> DataFrame:
    """Groups that begin at label 1: position of the best score, whose target is 0."""
    g = groups_at(df, F.col(label) == 1, by, order).where("grp > 0")
    items = F.array_sort(F.collect_list(F.struct(order, score)))
    return g.groupBy(*by, "grp").agg(items.alias("_i")).select(*by, "grp", argmax(F.transform("_i", lambda x: x[score])).alias("pred"), F.lit(0).alias("target"))


def mrr_ndcg(df: DataFrame, score: str, label: str, order: str, by: list[str] = ()) -> DataFrame:
    """One row: mean MRR and NDCG of the groups that begin at label 1; groups of one row don't count, ties go by order."""
    g = groups_at(df, F.col(label) == 1, by, order).where("grp > 0")
    keys = [*by, "grp"]
    ranked = g.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), order)))
    ranked = ranked.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(label), order)))
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    per = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(1 / F.min(F.when(F.col(label) == 1, F.col("_r"))), F.lit(0.0)).alias("mrr"),
        F.sum(gain / F.log2(F.col("_r") + 1.0)).alias("dcg"),
        F.sum(gain / F.log2(F.col("_i") + 1.0)).alias("ideal"),
    )
    per = per.where("n > 1").withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0))
    return per.agg(F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("groups"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


SIMILARITIES = {"cosine": cosine, "dot": dot, "euclidean": lambda a, b: -euclidean(a, b), "manhattan": lambda a, b: -manhattan(a, b)}


def value_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(_value, out): the rank of each distinct value with ties averaged. Ties are aggregated first; counts run within
    quantile buckets of the distinct values."""
    counts = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    return running(counts, F.col("_n"), [], "_value", "_up").select("_value", (F.col("_up") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))


def paired_metrics(pairs: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """One row: Pearson and Spearman correlation of the label with each similarity of the pair."""
    d = pairs.select(F.col(label).cast("double").alias("label"), *[f(F.col(a), F.col(b)).alias(k) for k, f in SIMILARITIES.items()])
    ranked = d
    for k in ("label", *SIMILARITIES):
        ranked = ranked.join(value_ranks(d, k, f"rank_{k}"), F.col(k).eqNullSafe(F.col("_value"))).drop("_value")
    return ranked.agg(*[x for k in SIMILARITIES for x in (F.corr("label", k).alias(f"pearson_{k}"), F.corr("rank_label", f"rank_{k}").alias(f"spearman_{k}"))])


def infonce_margins(queries: DataFrame, docs: DataFrame, query_vec: str, doc_vec: str, query_key: str, doc_key: str, block: str) -> DataFrame:
    """One row: mean positive, mean negative, and mean margin of the positive over the best negative, of normalised
    vectors. Pairs are formed within blocks (batches of bounded size), where a query's positive has its own key."""
    q = queries.select(F.col(query_key).alias("_q"), F.col(query_vec).alias("_qv"), F.col(block).alias("_b"))
    d = docs.select(F.col(doc_key).alias("_d"), F.col(doc_vec).alias("_dv"), F.col(block).alias("_b"))
    pairs = q.join(d, "_b").withColumn("s", cosine(F.col("_qv"), F.col("_dv")))
    per = pairs.groupBy("_b", "_q").agg(F.max(F.when(F.col("_q") == F.col("_d"), F.col("s"))).alias("pos"), F.max(F.when(F.col("_q") != F.col("_d"), F.col("s"))).alias("top"), F.sum(F.when(F.col("_q") != F.col("_d"), F.col("s"))).alias("sum_neg"), F.count(F.when(F.col("_q") != F.col("_d"), 1)).alias("n_neg"))
    return per.agg(F.avg(F.col("pos") - F.col("top")).alias("margin"), (F.sum("sum_neg") / F.sum("n_neg")).alias("mean_neg"), F.avg("pos").alias("mean_pos"))


def infonce_loss(pairs: DataFrame, query: str, positive: str, score: str, temperature: float = 0.01, false_negative_margin: float | None = None) -> DataFrame:
    """One row: mean of -log softmax of the positive over all scores of its query. A negative whose score exceeds the
    positive's by the margin is left out as a false negative."""
    # a query's scores are reduced where they lie: its ends first, then a sum of powers
    ends = pairs.groupBy(F.col(query).alias("_by")).agg(F.max(F.when(F.col(positive) == 1, F.col(score))).alias("_p"), F.max(score).alias("_m"))
    d = pairs.join(ends, F.col(query).eqNullSafe(F.col("_by")))
    top = F.col("_m")
    if false_negative_margin is not None:
        d = d.where((F.col(positive) == 1) | (F.col(score) <= F.col("_p") + false_negative_margin))
        top = F.least(top, F.col("_p") + false_negative_margin)
    return _softmax_loss(d, [query], score, top, F.col("_p"), temperature)


def _softmax_loss(df: DataFrame, by: list[str], score: str, top: Column, positive: Column, temperature: float) -> DataFrame:
    """One row: mean over groups of -log softmax of the positive's score; top is at least the scores and near to one."""
    d = df.withColumns({"_top": top, "_positive": positive})
    per = d.groupBy(*by).agg(F.sum(F.exp((F.col(score) - F.col("_top")) / temperature)).alias("z"), F.max("_top").alias("m"), F.max("_positive").alias("p"))
    return per.agg(F.avg(F.ln("z") - (F.col("p") - F.col("m")) / temperature).alias("loss"))


def listwise_loss(df: DataFrame, score: str, label: str, order: str, by: list[str] = (), temperature: float = 1.0, least: int = 2) -> DataFrame:
    """One row: mean over groups that begin at label 1 of -log softmax of the first member."""
    g = groups_at(df, F.col(label) == 1, by, order).where("grp > 0")
    ends = g.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("_n"), F.max(score).alias("_m"), F.min_by(score, order).alias("_p")).where(F.col("_n") >= least)
    ends = ends.withColumnsRenamed({c: f"_by_{c}" for c in [*by, "grp"]})
    d = g.join(ends, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.col("grp") == F.col("_by_grp")))
    return _softmax_loss(d, [*by, "grp"], score, F.col("_m"), F.col("_p"), temperature)


def pair_losses(df: DataFrame, a: str, b: str, label: str, margin: float = 0.5) -> DataFrame:
    """One row: cosine-similarity loss, contrastive loss, and its online form over hard pairs only."""
    d = df.select(F.col(label).cast("double").alias("y"), cosine(F.col(a), F.col(b)).alias("c")).withColumn("d", 1 - F.col("c"))
    far, near = F.max(F.when(F.col("y") == 1, F.col("d"))), F.min(F.when(F.col("y") == 0, F.col("d")))
    means = d.agg(far.alias("far"), near.alias("near"), F.avg(F.when(F.col("y") == 1, F.col("d"))).alias("mp"), F.avg(F.when(F.col("y") == 0, F.col("d"))).alias("mn"), F.count(F.when(F.col("y") == 1, 1)).alias("np"), F.count(F.when(F.col("y") == 0, 1)).alias("nn"))
    cut_n = F.when(F.col("np") > 1, F.col("far")).otherwise(F.col("mn"))
    cut_p = F.when(F.col("nn") > 1, F.col("near")).otherwise(F.col("mp"))
    gap = F.greatest(F.lit(margin) - F.col("d"), F.lit(0.0))
    online = F.when((F.col("y") == 0) & (F.col("d") < cut_n), gap * gap).when((F.col("y") == 1) & (F.col("d") > cut_p), F.col("d") * F.col("d")).otherwise(0.0)
    return d.join(F.broadcast(means)).agg(F.avg(F.pow(F.col("c") - F.col("y"), F.lit(2.0))).alias("cosine"), F.avg(0.5 * (F.col("y") * F.col("d") * F.col("d") + (1 - F.col("y")) * gap * gap)).alias("contrastive"), F.sum(online).alias("online"))


def channel_loss(tokens: DataFrame, loss: str, mask: str, channel: str) -> DataFrame:
    """Mean loss of unmasked tokens by channel; rows without a channel form the channel None."""
    return tokens.where(F.col(mask) == 1).groupBy(F.concat(F.lit("loss_"), F.coalesce(F.col(channel), F.lit("None"))).alias("name")).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("tokens"))


def kto_weights(df: DataFrame, label: str) -> DataFrame:
    """Class counts and the weight ranges that keep desirable and undesirable in 1 to 4/3."""
    d = df.agg(F.sum(F.col(label).cast("int")).alias("desirable"), F.sum(1 - F.col(label).cast("int")).alias("undesirable"))
    ratio = F.col("undesirable") / F.col("desirable")
    inverse = F.col("desirable") / F.col("undesirable")
    return d.select("*", F.bround(ratio, 2).alias("des_low"), F.bround(ratio * 1.33, 2).alias("des_high"), F.bround(inverse / 1.33, 2).alias("und_low"), F.bround(inverse, 2).alias("und_high"))


def pairwise_reward_metrics(df: DataFrame, chosen: str, rejected: str, margin: float = 0.0, centering: float = 0.0) -> DataFrame:
    c, r = F.col(chosen), F.col(rejected)
    return df.agg(
        F.avg(c).alias("mean_chosen"), F.avg(r).alias("mean_rejected"), F.avg((c > r).cast("double")).alias("accuracy"), F.avg(c - r).alias("mean_margin"),
        (F.avg(F.ln(1 + F.exp(-(c - r - margin)))) + centering * F.avg(F.pow(c + r, F.lit(2.0)))).alias("loss"),
    )


def jensen_shannon(df: DataFrame, token: str, cls: str, student: str, teacher: str, beta: float = 0.5, temperature: float = 1.0, topk: int | None = None) -> DataFrame:
    """One row: generalised Jensen-Shannon divergence of a (token, class) table of logits, mean over tokens; beta 0 and 1
    are the two Kullback-Leibler divergences. topk: the teacher's best classes only."""
    d = df
    if topk:
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy(token).orderBy(F.desc(teacher), cls))).where(F.col("_r") <= topk)
    d = d.select(F.col(token).alias("_k"), (F.col(student) / temperature).alias("_s"), (F.col(teacher) / temperature).alias("_t"))
    d = d.join(d.groupBy("_k").agg(F.max("_s").alias("ms"), F.max("_t").alias("mt")), "_k")
    norm = d.groupBy("_k").agg(F.ln(F.sum(F.exp(F.col("_s") - F.col("ms")))).alias("zs"), F.ln(F.sum(F.exp(F.col("_t") - F.col("mt")))).alias("zt"))
    d = d.join(norm, "_k").select("_k", (F.col("_s") - F.col("ms") - F.col("zs")).alias("ls"), (F.col("_t") - F.col("mt") - F.col("zt")).alias("lt"))
    if beta == 0:
        term = F.exp("lt") * (F.col("lt") - F.col("ls"))
    elif beta == 1:
        term = F.exp("ls") * (F.col("ls") - F.col("lt"))
    else:
        mix = F.ln((1 - beta) * F.exp("ls") + beta * F.exp("lt"))
        term = beta * F.exp("lt") * (F.col("lt") - mix) + (1 - beta) * F.exp("ls") * (F.col("ls") - mix)
    return d.groupBy("_k").agg(F.sum(term).alias("_d")).agg(F.avg("_d").alias("jsd"))


def token_loss_variants(loss: Column, other: Column | None = None, mu: float = 0.0) -> dict[str, Column]:
    """Weighted by the token's probability; by p * (1 - p); and mixed with another loss."""
    p = F.exp(-loss)
    out = {"dft": p * loss, "chord": p * (1 - p) * loss}
    return out if other is None else out | {"mixed": (1 - mu) * other + mu * loss}


def completion_log(df: DataFrame, order: str, columns: list[str], most: int) -> DataFrame:
    """The last `most` complete rows in order: rows without one of the driving columns are left out."""
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).orderBy(F.desc(order)).limit(most).orderBy(order)


def best_flags(df: DataFrame, metric: str, loss: str, score: str) -> DataFrame:
    """Marks rows that tie for the best metric and loss (smallest) and score (largest)."""
    best = df.agg(F.min(metric).alias("_m"), F.min(loss).alias("_l"), F.max(score).alias("_s"))
    return df.join(F.broadcast(best)).select(*df.columns, (F.col(metric) == F.col("_m")).alias("best_metric"), (F.col(loss) == F.col("_l")).alias("best_loss"), (F.col(score) == F.col("_s")).alias("best_score"))


def flatten_metrics(metrics: dict[str, dict[str, float | None] | float | None], prefix: str = "") -> dict[str, float]:
    """key of single values, key_suffix of several; None is dropped."""
    out: dict[str, float] = {}
    for key, value in metrics.items():
        parts = value if isinstance(value, dict) else {"": value}
        for suffix, v in parts.items():
            if v is not None:
                out[prefix + key + (f"_{suffix}" if len(parts) > 1 and suffix else "")] = v
    return out


def rouge_n(pred: Column, label: Column, n: int) -> Column:
    """ROUGE-n F1 over white-space words, n-grams counted as often as they occur in both."""
    def grams(c: Column) -> Column:
        return ngrams(words(c), n)

    def counted(g: Column) -> Column:
        return F.transform(F.array_distinct(g), lambda x: F.struct(x.alias("g"), F.size(F.filter(g, lambda y: y == x)).alias("n")))

    def score(g: Column) -> Column:
        p, r = g["p"], g["r"]
        both = F.aggregate(counted(p), F.lit(0), lambda s, x: s + F.least(x["n"], F.size(F.filter(r, lambda y: y == x["g"]))))
        # 2 * precision * recall / (precision + recall)
        return F.when((F.size(p) == 0) | (F.size(r) == 0), 0.0).otherwise(2 * both / (F.size(p) + F.size(r)))

    return F.transform(F.array(F.struct(grams(pred).alias("p"), grams(label).alias("r"))), score)[0]


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l_value(pred: list[str], label: list[str]) -> float:
    n = _lcs(pred, label)
    return 2 * n / (len(pred) + len(label)) if n else 0.0


def bleu4_value(pred: list[str], label: list[str]) -> float:
    """BLEU-4 with brevity penalty; a zero count of n-grams is smoothed by halves, once more for each."""
    import math
    from collections import Counter

    if not pred:
        return 0.0
    total, halves = 0.0, 1
    for n in range(1, 5):
        p, r = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (pred, label))
        hits, size = sum((p & r).values()), max(1, sum(p.values()))
        if n == 1 and not hits:
            return 0.0
        if not hits:
            hits, halves = 1 / 2**halves, halves + 1
        total += math.log(hits / size) / 4
    return math.exp(total) * (1.0 if len(pred) > len(label) else math.exp(1 - len(label) / len(pred)))


@F.pandas_udf(T.StructType([T.StructField("rouge_l", T.DoubleType()), T.StructField("bleu_4", T.DoubleType())]))
def sequence_scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """ROUGE-L and BLEU-4 of prediction and label; nulls where either has no words."""
    for pred, label in parts:
        rows = [((p or "").split(), (r or "").split()) for p, r in zip(pred, label)]
        yield pd.DataFrame({"rouge_l": [rouge_l_value(p, r) if p and r else None for p, r in rows], "bleu_4": [bleu4_value(p, r) if p and r else None for p, r in rows]}, dtype="float64")


def generation_scores(df: DataFrame, pred: str, label: str) -> DataFrame:
    """One row: means of ROUGE-1, 2, L and BLEU-4 times 100, over pairs with words on both sides."""
    usable = df.where((F.size(words(F.col(pred))) > 0) & (F.size(words(F.col(label))) > 0))
    d = usable.select(rouge_n(F.col(pred), F.col(label), 1).alias("rouge_1"), rouge_n(F.col(pred), F.col(label), 2).alias("rouge_2"), sequence_scores(F.col(pred), F.col(label)).alias("_s"))
    return d.agg(*[F.round(F.avg(c) * 100, 6).alias(n) for n, c in (("rouge_1", "rouge_1"), ("rouge_2", "rouge_2"), ("rouge_l", "_s.rouge_l"), ("bleu_4", "_s.bleu_4"))])
