"""Grouped reward statistics: advantages, dynamic sampling, importance weights and their diagnostics.

Rewards that don't apply are null; a group of one row has standard deviation 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.windows import last_per_key

EPS = 1e-4


def weighted_reward(rewards: list[str], weights: list[float], kl: str | None = None, beta: float = 0.0) -> Column:
    """Sum of the weighted rewards that apply, less beta times the divergence."""
    total = sum((F.coalesce(F.col(r) * w, F.lit(0.0)) for r, w in zip(rewards, weights)), F.lit(0.0))
    return total - F.coalesce(F.col(kl), F.lit(0.0)) * beta if kl else total


def stats(df: DataFrame, value: str, by: list[str], prefix: str) -> DataFrame:
    """df with the mean, sample deviation and count of value by group. Groups are aggregated and joined back, so that a
    hot group is reduced where its rows lie and no window gathers it."""
    made = df.groupBy(*by).agg(F.avg(value).alias(f"{prefix}_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{prefix}_std"), F.count(value).alias(f"{prefix}_n"))
    if not by:
        return df.join(F.broadcast(made))  # one row
    return df.join(made.select(*[F.col(c).alias(f"_{c}") for c in by], f"{prefix}_mean", f"{prefix}_std", f"{prefix}_n"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*[f"_{c}" for c in by])


#: Scaling by default for each estimator.
SCALES = {"grpo": "group", "rloo": "none", "reinforce_plus_plus": "batch"}


def advantages(df: DataFrame, reward: str, group: str, estimator: str = "grpo", scale: str | None = None, out: str = "advantage") -> DataFrame:
    """Advantage of every row over its group: reward less the group's mean, for rloo corrected by K / (K - 1), and divided
    by a deviation: of the group's rewards, of the batch's rewards - for reinforce_plus_plus of the advantages - or none."""
    scale = scale or SCALES[estimator]
    d = stats(df, reward, [group], "_g")
    base, k = F.col(reward) - F.col("_g_mean"), F.col("_g_n")
    raw = F.when(k > 1, base * k / (k - 1)).otherwise(base) if estimator == "rloo" else base
    d = d.withColumn("_raw", raw)
    if scale == "group":
        d = d.withColumn(out, F.col("_raw") / (F.col("_g_std") + EPS))
    elif scale == "batch":
        d = stats(d, "_raw" if estimator == "reinforce_plus_plus" else reward, [], "_b").withColumn(out, F.col("_raw") / (F.col("_b_std") + EPS)).drop("_b_mean", "_b_std", "_b_n")
    else:
        d = d.withColumn(out, F.col("_raw"))
    return d.drop("_raw", "_g_mean", "_g_std", "_g_n")


def gdpo_advantages(df: DataFrame, rewards: list[str], weights: list[float], group: str, out: str = "advantage") -> DataFrame:
    """Each reward standardised within its group, the weighted sum standardised over the batch."""
    aggs = [x for r in rewards for x in (F.avg(r).alias(f"_m_{r}"), F.stddev_samp(r).alias(f"_s_{r}"))]
    made = df.groupBy(group).agg(*aggs).withColumnRenamed(group, "_group")
    d = df.join(made, F.col(group).eqNullSafe(F.col("_group")))
    total = F.lit(0.0)
    for r, w in zip(rewards, weights):
        total = total + F.coalesce((F.col(r) - F.col(f"_m_{r}")) / (F.coalesce(F.col(f"_s_{r}"), F.lit(0.0)) + 1e-8), F.lit(0.0)) * w
    d = stats(d.withColumn("_sum", total), "_sum", [], "_b")
    return d.withColumn(out, (F.col("_sum") - F.col("_b_mean")) / (F.col("_b_std") + 1e-8)).select(*df.columns, out)


def request_advantages(df: DataFrame, reward: str, group: str, request: str, order: str, **how) -> DataFrame:
    """Advantages over the last row of each request, given back to all of its rows. A request whose rewards differ by more
    than 1e-6 raises."""
    spread = df.groupBy(request).agg((F.max(reward) - F.min(reward)).alias("_spread")).select(F.col(request).alias("_request"), F.assert_true(F.col("_spread") <= 1e-6, "a request has different rewards").alias("_ok"))
    last = advantages(last_per_key(df, request, order), reward, group, **how).select(F.col(request).alias("_request"), "advantage")
    return df.join(last.join(spread, "_request"), F.col(request) == F.col("_request")).where(F.col("_ok").isNull()).drop("_request", "_ok")


def varied_groups(df: DataFrame, reward: str, group: str) -> DataFrame:
    """The rows of groups whose rewards vary."""
    kept = df.groupBy(group).agg(F.stddev_samp(reward).alias("_s")).where("_s > 0").select(F.col(group).alias("_g"))
    return df.join(kept, F.col(group) == F.col("_g"), "left_semi")


def reward_metrics(df: DataFrame, reward: str, group: str) -> DataFrame:
    """One row: mean of group means, mean group deviation, share of groups that don't vary, number of groups."""
    g = df.groupBy(group).agg(F.avg(reward).alias("m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"))
    return g.agg(F.avg("m").alias("reward"), F.avg("s").alias("reward_std"), F.avg((F.col("s") == 0).cast("double")).alias("frac_zero_std"), F.count(F.lit(1)).alias("groups"))


def dynamic_sampling(first: DataFrame, draw: Callable[[int], DataFrame], reward: str, group: str, target_groups: int, rounds: int = 3) -> DataFrame:
    """Groups that vary, filled up from further draws until there are target_groups of them; the first batch where even
    `rounds` more draws don't give enough. Draws must have groups of their own."""
    from parley.operators.ordering import dense_ids_limit

    kept = varied_groups(first, reward, group)
    for i in range(rounds):
        if kept.select(group).distinct().count() >= target_groups:
            break
        kept = kept.unionByName(varied_groups(draw(i), reward, group))
    if kept.select(group).distinct().count() < target_groups:
        return first
    return dense_ids_limit(kept, group, target_groups)


def sequence_ratios(tokens: DataFrame, log_ratio: str, mask: str, sequence: str, level: str = "token", mode: str = "truncate", threshold: float = 2.0, out: str = "weight") -> DataFrame:
    """Importance weights of a token table. Log-ratios are held within 20; at sequence level the ratio is the geometric
    mean over unmasked tokens. truncate: at most the threshold; mask: 0 beyond it."""
    held = F.greatest(F.least(F.col(log_ratio), F.lit(20.0)), F.lit(-20.0))
    kept = tokens.columns
    if level == "sequence":
        # aggregated and joined back, so that a long sequence is reduced where its rows lie
        means = tokens.groupBy(F.col(sequence).alias("_sequence")).agg(F.avg(F.when(F.col(mask) == 1, held)).alias("_mean"))
        tokens = tokens.join(means, F.col(sequence).eqNullSafe(F.col("_sequence")))
        ratio = F.exp(F.greatest(F.least(F.coalesce("_mean", F.lit(0.0)), F.lit(20.0)), F.lit(-20.0)))
    else:
        ratio = F.exp(held)
    weight = F.least(ratio, F.lit(float(threshold))) if mode == "truncate" else F.when(ratio <= threshold, ratio).otherwise(0.0)
    return tokens.select(*kept, ratio.alias("ratio"), weight.alias(out))


def off_policy_mask(tokens: DataFrame, old: str, new: str, mask: str, advantage: str, sequence: str, delta: float) -> DataFrame:
    """One row per sequence: masked where the mean of old - new exceeds delta and the advantage is negative."""
    gap = F.avg(F.when(F.col(mask) == 1, F.col(old) - F.col(new)))
    return tokens.groupBy(sequence).agg(gap.alias("gap"), F.min(advantage).alias("adv")).select(sequence, "gap", ((F.col("gap") > delta) & (F.col("adv") < 0)).alias("masked"))


def off_policy_metrics(tokens: DataFrame, new: str, old: str, mask: str, sequence: str) -> DataFrame:
    """Diagnostics of sampling under old log-probabilities and training under new ones, over unmasked tokens."""
    t = tokens.where(F.col(mask) == 1).withColumn("_r", F.col(new) - F.col(old))
    s = t.groupBy(sequence).agg(F.avg(new).alias("n"), F.avg(old).alias("o"), F.sum("_r").alias("sum_r"), F.avg("_r").alias("avg_r"))
    by_sequence = s.agg(
        F.avg(F.exp(-F.col("n"))).alias("training_ppl"), F.avg(-F.col("n")).alias("training_log_ppl"), F.avg(F.exp(-F.col("o"))).alias("rollout_ppl"), F.avg(-F.col("o")).alias("rollout_log_ppl"),
        F.avg(F.col("o") - F.col("n")).alias("log_ppl_diff"), F.avg(F.exp(F.col("o") - F.col("n"))).alias("ppl_ratio"),
        (F.avg(F.exp(2 * F.greatest(F.least(F.col("sum_r"), F.lit(20.0)), F.lit(-20.0)))) - 1).alias("chi2_seq"),
    )
    by_token = t.agg(F.avg(-F.col("_r")).alias("kl"), F.avg(F.exp("_r") - F.col("_r") - 1).alias("k3_kl"), (F.avg(F.exp(2 * F.greatest(F.least(F.col("_r"), F.lit(20.0)), F.lit(-20.0)))) - 1).alias("chi2_token"))
    return by_sequence.join(F.broadcast(by_token))  # a row each


def weight_metrics(tokens: DataFrame, weight: str, ratio: str, mask: str, threshold: float) -> DataFrame:
    """Mean weight, effective sample size as a share, and the clipped share, over unmasked tokens."""
    t = tokens.where(F.col(mask) == 1)
    return t.agg(F.avg(weight).alias("mean_weight"), (F.pow(F.sum(weight), F.lit(2.0)) / (F.count(weight) * F.sum(F.col(weight) * F.col(weight)))).alias("ess"), F.avg((F.col(ratio) > threshold).cast("double")).alias("clipped"))


def policy_loss(tokens: DataFrame, ratio: str, advantage: str, mask: str, sequence: str, kind: str = "grpo", low: float = 0.2, high: float = 0.2, max_length: int | None = None) -> DataFrame:
    """One row: the clipped policy loss. grpo: mean of sequence means; bnpo and dapo: mean over tokens; dr_grpo: sum over
    sequences * max_length; cispo: tokens weighted by the clipped ratio, mean over tokens; sapo as grpo with a soft gate."""
    r, a = F.col(ratio), F.col(advantage)
    if kind == "cispo":
        loss = -F.least(r, F.lit(1 + high)) * a * F.ln(r)
    elif kind == "sapo":
        loss = -4 / (1 + F.exp(-(r - 1))) * a
    else:
        loss = -F.least(r * a, F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low)) * a)
    t = tokens.where(F.col(mask) == 1).withColumn("_l", loss)
    if kind in ("grpo", "sapo"):
        return t.groupBy(sequence).agg(F.avg("_l").alias("_l")).agg(F.avg("_l").alias("loss"))
    if kind == "dr_grpo":
        return t.agg((F.sum("_l") / (F.count_distinct(sequence) * max_length)).alias("loss"))
    return t.agg(F.avg("_l").alias("loss"))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.ln(total) - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top) * (x - top)) / total


def mix_schedule(step: Column, warmup: int, decay: int, peak: float, valley: float) -> Column:
    """Linear warm-up to the peak, cosine decay to the valley."""
    down = F.lit(valley) + (peak - valley) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (step - warmup) / decay))
    return F.when(step < warmup, step / warmup * peak).when(step >= warmup + decay, F.lit(valley)).otherwise(down)


def exact_quantile(df: DataFrame, value: str, share: float) -> float | None:
    """The exact quantile with linear interpolation, nulls left out; null of no values. Rows are counted in buckets of about
    equal size, and only those that hold the two values around the quantile are sorted, each value once."""
    from parley.operators.ordering import quantile_bucket

    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("_v"))
    bucket = quantile_bucket(d, "_v")  # once: sketches merge in the order in which tasks end, so another one may cut elsewhere
    counts = sorted((r["_b"], r["count"]) for r in d.groupBy(bucket.alias("_b")).count().collect())
    n = sum(c for _, c in counts)
    if not n:
        return None
    at = share * (n - 1)
    places, start, bounds = (int(at), min(int(at) + 1, n - 1)), 0, []
    for b, c in counts:
        if any(start <= p < start + c for p in places):
            bounds.append((b, start))
        start += c
    few = d.where(bucket.isin([b for b, _ in bounds])).groupBy("_v").count()
    # the running sum is over the distinct values of at most two buckets
    ends = few.withColumn("_end", F.sum("count").over(Window.orderBy("_v")) + bounds[0][1])
    there = reduce(lambda a, c: a | c, [(F.col("_end") > p) & (F.col("_end") - F.col("count") <= p) for p in places])
    values = sorted(r["_v"] for r in ends.where(there).collect())
    return values[0] + (at - int(at)) * (values[-1] - values[0])


def top_entropy_tokens(tokens: DataFrame, value: str, share: float) -> DataFrame:
    """The tokens at or above the exact (1 - share) quantile of value."""
    cut = exact_quantile(tokens, value, 1 - share)
    return tokens.where(F.col(value) >= F.lit(cut)) if cut is not None else tokens.limit(0)
