"""Registered queries: each applies operators of the library to whole given tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import groupstats as G
from parley.operators import metrics as M
from parley.operators import ordering as O
from parley.operators import windows as W
from parley.operators import agent as A
from parley.operators import tools as TL
from parley.operators import normalize as N
from parley.operators import pack as P
from parley.operators import preference as S
from parley.operators import render as R
from parley.operators import rewards as RW
from parley.operators import transforms as X
from parley.operators import validate as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (table) -> DataFrame, where table(name) reads a given table, under its own name."""

    def add(function):
        name = function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def r(c, digits: int = 4):
    return F.round(c, digits)


# ---------------------------------------------------------------- order, samples, splits

_RANKED = "(SELECT *, row_number() OVER (ORDER BY md5(concat({key}, '-42')), {key}) AS rn, count(*) OVER () AS total FROM {table})"


@query(f"SELECT o_orderkey FROM {_RANKED.format(key='o_orderkey', table='orders')} WHERE rn <= 1000")
def set01_sample_exact(table):
    return O.sample(table("orders"), 1000, "o_orderkey").select("o_orderkey")


@query(f"""SELECT doc_id, c AS copy FROM {_RANKED.format(key='doc_id', table='documents')}, range(0, 4) AS t(c)
WHERE c < (total * 2 + 321) // total + CASE WHEN rn <= (total * 2 + 321) % total THEN 1 ELSE 0 END""")
def set01_sample_repeat(table):
    docs = table("documents").select("doc_id")
    return O.sample(docs, docs.count() * 2 + 321, "doc_id").select("doc_id", "copy")


@query(f"SELECT doc_id, CASE WHEN rn <= greatest(floor(total * 0.1), 1) THEN 'val' ELSE 'train' END AS part FROM {_RANKED.format(key='doc_id', table='documents')}")
def set03_train_val_split(table):
    train, val = O.train_val_split(table("documents").select("doc_id"), 0.1, "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 40 THEN 'val' ELSE 'train' END AS part FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 200")
def set04_stream_split(table):
    train, val = O.stream_split(table("documents").select("doc_id"), 0.2, "doc_id", 200)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query("""SELECT src, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (
SELECT 0 AS src, text FROM documents UNION ALL SELECT 1, text FROM benchmark UNION ALL SELECT 2, text FROM conversations) GROUP BY src""")
def set05_concat(table):
    rows = O.concat([table("documents"), table("benchmark"), table("conversations")])
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""WITH draws AS (
  SELECT i AS slot, ('0x' || substr(md5(concat(i, '-42')), 1, 8))::BIGINT / 4294967296.0 AS u FROM range(0, 4 * (SELECT count(*) FROM documents)) AS t(i)
), named AS (
  SELECT slot, CASE WHEN u < 0.7 THEN 0 ELSE 1 END AS src FROM draws
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY slot) AS k FROM named
), rows AS (
  SELECT 0 AS src, doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k FROM documents
  UNION ALL SELECT 1, page_id, row_number() OVER (ORDER BY page_id) FROM pages
), ends AS (
  SELECT src, max(k) AS n FROM rows GROUP BY src
), stop AS (
  SELECT min(slot) AS last FROM drawn JOIN ends USING (src) WHERE k = n
)
SELECT slot, src, id FROM drawn JOIN rows USING (src, k), stop WHERE slot <= last""")
def set06_interleave(table):
    docs, pages = table("documents").select(F.col("doc_id").alias("id")), table("pages").select(F.col("page_id").alias("id"))
    return O.interleave([docs, pages], ["id", "id"], [0.7, 0.3]).select("slot", "src", "id")


@query(f"SELECT c_custkey, rn FROM {_RANKED.format(key='c_custkey', table='customer')}")
def set07_shuffle_ranks(table):
    return O.hash_rank(table("customer"), "c_custkey").select("c_custkey", "rn")


@query("""SELECT p_partkey, ntile(7) OVER (ORDER BY p_partkey) - 1 AS chunk, (rn * 6 + 5) // total AS shard, (rn % 5)::INTEGER AS strided FROM (
SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rn, count(*) OVER () AS total FROM part)""")
def set09_shards(table):
    part = table("part").select("p_partkey")
    out = O.shard_strided(O.shard_contiguous(O.chunk_even(part, 7, "p_partkey"), 6, "p_partkey"), 5, "p_partkey", "strided")
    return out.select("p_partkey", "chunk", "shard", "strided")


@query("SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn, count(*) OVER () AS total FROM supplier) WHERE rn > 2 * (total // 3)")
def set12_piece(table):
    return O.piece(table("supplier").select("s_suppkey"), 2, 3, "s_suppkey")


@query(f"SELECT o_orderkey, ((rn - 1) % 4)::INTEGER AS rank, (rn - 1) // 32 AS batch FROM {_RANKED.format(key='o_orderkey', table='orders')} WHERE rn <= total // 4 * 4")
def set15_batch_shards(table):
    return O.batch_shards(table("orders").select("o_orderkey"), 8, 4, "o_orderkey")


@query(f"""SELECT doc_id, mega, mega * 400 + row_number() OVER (PARTITION BY mega ORDER BY n_chars DESC, rn) - 1 AS pos
FROM (SELECT doc_id, n_chars, rn, (rn - 1) // 400 AS mega FROM {_RANKED.format(key='doc_id', table='documents')})""")
def set16_length_grouped(table):
    return O.length_grouped(table("documents").select("doc_id", "n_chars"), "n_chars", 8, "doc_id").select("doc_id", "mega", "pos")


@query("""SELECT o_orderkey, ((rn - 1 - 640) % 32 // 8)::INTEGER AS rank, (rn - 1 - 640) // 32 AS step FROM (
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS total FROM orders) WHERE rn > 640 AND rn <= total // 32 * 32""")
def set17_pretraining_order(table):
    return O.pretraining_order(table("orders").select("o_orderkey"), "o_orderkey", 8, 4, 640)


@query("""SELECT s_suppkey, slot, (slot % 7)::INTEGER AS rank FROM (
SELECT s_suppkey, rn - 1 AS slot FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier)
UNION ALL
SELECT s_suppkey, rn - 1 + total FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn, count(*) OVER () AS total FROM supplier) WHERE rn <= (7 - total % 7) % 7)""")
def set18_pad_to_ranks(table):
    return O.pad_to_ranks(table("supplier").select("s_suppkey"), 7, "s_suppkey")


@query("SELECT item_id, c AS copy FROM benchmark, range(0, 8) AS t(c)")
def set19_repeat_each(table):
    return O.repeat_each(table("benchmark").select("item_id"), 8)


@query("""SELECT n_nationkey, slot FROM range(0, 90) AS t(slot) JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation) ON rn = slot % (SELECT count(*) FROM nation)""")
def set20_cycle(table):
    return O.cycle(table("nation").select("n_nationkey"), 90, "n_nationkey")


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) BETWEEN 101 AND 150")
def set21_take_skip(table):
    return O.take(table("orders").select("o_orderkey"), 50, "o_orderkey", 100)


@query("SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def set23_keep_first(table):
    return O.keep_first(table("documents").select("text", "doc_id", "lang"), ["text"], "doc_id")


# ---------------------------------------------------------------- windows

_SPEECH = "(SELECT conv_id * 100 + turn AS ord, conv_id, turn, role, text FROM conversations)"


@query("""WITH a AS (SELECT conv_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
o AS (SELECT *, (row_number() OVER (ORDER BY md5(concat(conv_id, '-42')), conv_id) - 1) // 8 AS batch, row_number() OVER (ORDER BY md5(concat(conv_id, '-42')), conv_id) AS rn FROM a)
SELECT conv_id, batch, coalesce(lag(answer) OVER w, last_value(answer) OVER (PARTITION BY batch ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS rejected_response
FROM o WINDOW w AS (PARTITION BY batch ORDER BY rn)""")
def win01_kto_shift(table):
    answers = table("conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))
    ranked = O.hash_rank(answers, "conv_id").withColumn("batch", F.floor((F.col("rn") - 1) / 8))
    return W.previous_in_batch(ranked, "answer", "batch", "rn").select("conv_id", "batch", "rejected_response")


@query("""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT a.user_id, a.i - 1 AS step, round(sum(b.value * pow(0.9, a.i - b.i)) / sum(pow(0.9, a.i - b.i)), 4) AS ema
FROM s a JOIN s b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.user_id, a.i""")
def win02_ema(table):
    series = table("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return series.select("user_id", F.posexplode(W.ema(F.transform("s", lambda x: x["value"]))).alias("step", "ema")).select("user_id", F.col("step").cast("bigint").alias("step"), r(F.col("ema")).alias("ema"))


@query("SELECT conv_id, coalesce(max(CASE WHEN role = 'user' THEN i END), -1) AS last_user FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id")
def win03_last_user_round(table):
    return messages_of(table).select("conv_id", W.last_user_round(F.col("messages")).alias("last_user"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def win04_last_per_key(table):
    return W.last_per_key(table("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT doc_id, (dense_rank() OVER (ORDER BY f) - 1) AS prompt_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)")
def win05_dense_ids(table):
    return W.dense_ids(table("documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "prompt_id")


@query("""SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (
SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM events) GROUP BY user_id, session""")
def win07_sessions(table):
    s = W.sessions(table("events"), F.col("event_type") == "signup", ["user_id"], "event_id", ["event_type"])
    return s.select("user_id", "session", F.size("items").cast("bigint").alias("n"), F.col("items")[0]["event_id"].alias("first_event"))


@query("SELECT conv_id, turn, e - length(text) AS start, e AS end FROM (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM conversations)")
def win10_boundaries(table):
    return W.running_boundaries(table("conversations").withColumn("n", F.length("text")), "n", ["conv_id"], "turn").select("conv_id", "turn", "start", "end")


@query("""SELECT user_id, event_id, stale, stale >= 3 AS stop FROM (
SELECT *, i - max(CASE WHEN b IS NULL OR value > b THEN i END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stale FROM (
SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events))""")
def met19_early_stop(table):
    return W.early_stop(table("events"), "value", "event_id", ["user_id"]).select("user_id", "event_id", "stale", "stop")


def messages_of(table) -> DataFrame:
    """conv_id and messages, an array of (role, content) in turn order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table("conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


# ---------------------------------------------------------------- group statistics

_G = "avg({x}) OVER (PARTITION BY l_orderkey) AS m, coalesce(stddev_samp({x}) OVER (PARTITION BY l_orderkey), 0) AS s, count({x}) OVER (PARTITION BY l_orderkey) AS k"


def rewards(table) -> DataFrame:
    return table("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", (F.col("l_discount") * 10).alias("reward"))


_REWARDS = "(SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_discount * 10 AS reward FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, 0 + round((reward - m) / (s + 1e-4), 4) AS advantage FROM (SELECT *, {_G.format(x='reward')} FROM {_REWARDS})")
def adv02_grpo(table):
    return G.advantages(rewards(table), "reward", "l_orderkey").select("l_orderkey", "l_linenumber", r(F.col("advantage")).alias("advantage"))


@query(f"SELECT l_orderkey, l_linenumber, 0 + round(CASE WHEN k > 1 THEN (reward - m) * k / (k - 1) ELSE reward - m END, 4) AS advantage FROM (SELECT *, {_G.format(x='reward')} FROM {_REWARDS})")
def adv03_rloo(table):
    return G.advantages(rewards(table), "reward", "l_orderkey", "rloo").select("l_orderkey", "l_linenumber", r(F.col("advantage")).alias("advantage"))


@query(f"SELECT l_orderkey, l_linenumber, 0 + round(raw / (stddev_samp(raw) OVER () + 1e-4), 4) AS advantage FROM (SELECT *, reward - m AS raw FROM (SELECT *, {_G.format(x='reward')} FROM {_REWARDS}))")
def adv04_reinforce_plus_plus(table):
    return G.advantages(rewards(table), "reward", "l_orderkey", "reinforce_plus_plus").select("l_orderkey", "l_linenumber", r(F.col("advantage")).alias("advantage"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber,
  coalesce((l_discount - avg(l_discount) OVER w) / (coalesce(stddev_samp(l_discount) OVER w, 0) + 1e-8), 0)
  + 0.5 * coalesce((l_tax - avg(l_tax) OVER w) / (coalesce(stddev_samp(l_tax) OVER w, 0) + 1e-8), 0) AS t
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, 0 + round((t - avg(t) OVER ()) / (stddev_samp(t) OVER () + 1e-8), 3) AS advantage FROM z""")
def adv05_gdpo(table):
    d = G.gdpo_advantages(table("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"], [1.0, 0.5], "l_orderkey")
    return d.select("l_orderkey", "l_linenumber", r(F.col("advantage"), 3).alias("advantage"))


@query("""WITH last AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL)
SELECT user_id, event_type, round((v - avg(v) OVER w) / (coalesce(stddev_samp(v) OVER w, 0) + 1e-4), 4) AS advantage FROM last WINDOW w AS (PARTITION BY user_id)""")
def adv06_last_of_request(table):
    e = table("events").withColumn("request", F.concat_ws("-", "user_id", "event_type"))
    last = W.last_per_key(e.select("request", "user_id", "event_type", "event_id", "value"), "request", "event_id")
    return G.advantages(last, "value", "user_id").select("user_id", "event_type", r(F.col("advantage")).alias("advantage"))


@query(f"""SELECT round(avg(m), 4) AS reward, round(avg(s), 4) AS reward_std, round(avg(CASE WHEN s = 0 THEN 1.0 ELSE 0 END), 4) AS frac_zero_std, count(*) AS groups
FROM (SELECT avg(reward) AS m, coalesce(stddev_samp(reward), 0) AS s FROM {_REWARDS} GROUP BY l_orderkey)""")
def adv07_reward_metrics(table):
    d = G.reward_metrics(rewards(table), "reward", "l_orderkey")
    return d.select(*[r(F.col(c)).alias(c) for c in ("reward", "reward_std", "frac_zero_std")], "groups")


@query(f"SELECT l_orderkey, l_linenumber FROM {_REWARDS} WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING stddev_samp(l_discount * 10) > 0)")
def flt14_varied_groups(table):
    return G.varied_groups(rewards(table), "reward", "l_orderkey").select("l_orderkey", "l_linenumber")


_TOKENS = "(SELECT l_orderkey, l_linenumber, l_discount - l_tax AS lr, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS mask, -l_discount AS n, -l_tax AS o FROM lineitem)"


def tokens_of(table) -> DataFrame:
    return table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") - F.col("l_tax")).alias("lr"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("mask"), (-F.col("l_discount")).alias("n"), (-F.col("l_tax")).alias("o"))


@query(f"""SELECT l_orderkey, l_linenumber, round(least(exp(coalesce(avg(CASE WHEN mask = 1 THEN lr END) OVER (PARTITION BY l_orderkey), 0)), 1.02), 4) AS weight FROM {_TOKENS}""")
def adv09_sequence_weights(table):
    d = G.sequence_ratios(tokens_of(table), "lr", "mask", "l_orderkey", "sequence", "truncate", 1.02)
    return d.select("l_orderkey", "l_linenumber", r(F.col("weight")).alias("weight"))


@query(f"""WITH t AS (SELECT *, n - o AS d FROM {_TOKENS} WHERE mask = 1), s AS (SELECT avg(n) AS n, avg(o) AS o, sum(n - o) AS r FROM t GROUP BY l_orderkey)
SELECT round(kl, 4) AS kl, round(k3_kl, 4) AS k3_kl, round(chi2_token, 4) AS chi2_token, round(training_ppl, 4) AS training_ppl, round(rollout_ppl, 4) AS rollout_ppl, round(log_ppl_diff, 4) AS log_ppl_diff, round(ppl_ratio, 4) AS ppl_ratio, round(chi2_seq, 4) AS chi2_seq
FROM (SELECT avg(-d) AS kl, avg(exp(d) - d - 1) AS k3_kl, avg(exp(2 * d)) - 1 AS chi2_token FROM t),
(SELECT avg(exp(-n)) AS training_ppl, avg(exp(-o)) AS rollout_ppl, avg(o - n) AS log_ppl_diff, avg(exp(o - n)) AS ppl_ratio, avg(exp(2 * greatest(least(r, 20), -20))) - 1 AS chi2_seq FROM s)""")
def adv11_off_policy(table):
    d = G.off_policy_metrics(tokens_of(table), "n", "o", "mask", "l_orderkey")
    return d.select(*[r(F.col(c)).alias(c) for c in ("kl", "k3_kl", "chi2_token", "training_ppl", "rollout_ppl", "log_ppl_diff", "ppl_ratio", "chi2_seq")])


@query(f"""SELECT round(avg(x), 4) AS loss FROM (SELECT l_orderkey, avg(-least(exp(lr) * a, greatest(least(exp(lr), 1.2), 0.8) * a)) AS x
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE -0.5 END AS a FROM {_TOKENS}) WHERE mask = 1 GROUP BY l_orderkey)""")
def adv13_policy_loss(table):
    t = tokens_of(table).withColumn("ratio", F.exp("lr")).withColumn("a", F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-0.5))
    return G.policy_loss(t, "ratio", "a", "mask", "l_orderkey").select(r(F.col("loss")).alias("loss"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.8) FROM lineitem)")
def flt16_top_share(table):
    return G.top_entropy_tokens(table("lineitem"), "l_extendedprice", 0.2).select("l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- metrics


@query("SELECT lang, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS std, min(n_chars) AS min, max(n_chars) AS max, count(*) AS size FROM documents GROUP BY lang")
def agg01_length_stats(table):
    return M.length_stats(table("documents"), "n_chars", ["lang"]).select("lang", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "min", "max", "size")


@query("SELECT 'loss_' || coalesce(event_type, 'None') AS name, round(avg(value), 4) AS loss, count(*) AS tokens FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def met08_channel_loss(table):
    e = table("events").withColumn("mask", (F.col("user_id") % 3 != 0).cast("int"))
    return M.channel_loss(e, "value", "mask", "event_type").select("name", r(F.col("loss")).alias("loss"), "tokens")


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END), 6) AS acc FROM labels")
def met03_exact_match(table):
    return M.exact_match(table("labels"), "quality", "toxic").select(F.round("acc", 6).alias("acc"))


@query("""WITH g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY value DESC, event_id) AS rk, row_number() OVER (PARTITION BY user_id, grp ORDER BY label DESC, event_id) AS ik FROM g WHERE grp > 0),
p AS (SELECT user_id, grp, count(*) AS n, coalesce(1.0 / min(CASE WHEN label = 1 THEN rk END), 0) AS mrr, sum((pow(2, label) - 1) / log2(rk + 1)) AS dcg, sum((pow(2, label) - 1) / log2(ik + 1)) AS ideal FROM k GROUP BY ALL)
SELECT round(avg(mrr), 4) AS mrr, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 4) AS ndcg, count(*) AS groups FROM p WHERE n > 1""")
def met07_mrr_ndcg(table):
    e = table("events").withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return M.mrr_ndcg(e, "value", "label", "event_id", ["user_id"]).select(r(F.col("mrr")).alias("mrr"), r(F.col("ndcg")).alias("ndcg"), "groups")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (
SELECT CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS y, list_dot_product(a.e, b.e) AS d, list_cosine_similarity(a.e, b.e) AS c, -list_distance(a.e, b.e) AS u FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
k AS (SELECT y, d, c, u, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY d) AS rd FROM p)
SELECT round(corr(y, c), 4) AS pearson_cosine, round(corr(y, d), 4) AS pearson_dot, round(corr(y, u), 4) AS pearson_euclidean, round(corr(ry, rd), 3) AS spearman_dot FROM k""")
def met05_paired_similarity(table):
    a = table("embeddings").where("vec_id % 2 = 0")
    b = table("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("label_b"))
    d = M.paired_metrics(a.join(b, "vec_id").withColumn("same", (F.col("label") == F.col("label_b")).cast("int")), "embedding", "other", "same")
    return d.select(*[r(F.col(c)).alias(c) for c in ("pearson_cosine", "pearson_dot", "pearson_euclidean")], r(F.col("spearman_dot"), 3).alias("spearman_dot"))


@query("""WITH v AS (SELECT vec_id, vec_id // 32 AS b, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.b, q.vec_id, max(CASE WHEN d.vec_id = q.vec_id THEN list_cosine_similarity(q.e, d.e) END) AS pos, max(CASE WHEN d.vec_id <> q.vec_id THEN list_cosine_similarity(q.e, d.e) END) AS top,
  sum(CASE WHEN d.vec_id <> q.vec_id THEN list_cosine_similarity(q.e, d.e) END) AS s, count(*) - 1 AS n FROM v q JOIN v d ON q.b = d.b GROUP BY ALL)
SELECT round(avg(pos - top), 4) AS margin, round(sum(s) / sum(n), 4) AS mean_neg, round(avg(pos), 4) AS mean_pos FROM p""")
def met06_infonce_margins(table):
    e = table("embeddings").withColumn("b", F.floor(F.col("vec_id") / 32))
    d = M.infonce_margins(e, e, "embedding", "embedding", "vec_id", "vec_id", "b")
    return d.select(*[r(F.col(c)).alias(c) for c in ("margin", "mean_neg", "mean_pos")])


@query("""SELECT round(avg(l_extendedprice), 2) AS mean_chosen, round(avg(c), 2) AS mean_rejected, round(avg(CASE WHEN l_extendedprice > c THEN 1.0 ELSE 0 END), 4) AS accuracy, round(avg(l_extendedprice - c), 2) AS mean_margin
FROM (SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS c FROM lineitem)""")
def met14_pairwise_reward(table):
    d = M.pairwise_reward_metrics(table("lineitem").withColumn("c", F.col("l_extendedprice") * (1 - F.col("l_discount"))), "l_extendedprice", "c")
    return d.select(r(F.col("mean_chosen"), 2).alias("mean_chosen"), r(F.col("mean_rejected"), 2).alias("mean_rejected"), r(F.col("accuracy")).alias("accuracy"), r(F.col("mean_margin"), 2).alias("mean_margin"))


@query("SELECT d AS desirable, u AS undesirable, round(u / d, 2) AS des_low, round(u / d * 1.33, 2) AS des_high, round(d / u / 1.33, 2) AS und_low, round(d / u, 2) AS und_high FROM (SELECT sum(toxic)::BIGINT AS d, sum(1 - toxic)::BIGINT AS u FROM labels)")
def met12_kto_weights(table):
    return M.kto_weights(table("labels"), "toxic")


@query("""WITH g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events)
SELECT round(avg(loss), 4) AS loss FROM (SELECT ln(sum(exp(value / 100))) - arg_min(value, event_id) / 100 AS loss FROM g WHERE grp > 0 GROUP BY user_id, grp HAVING count(*) >= 2)""")
def met09_listwise_loss(table):
    e = table("events").withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return M.listwise_loss(e, "value", "label", "event_id", ["user_id"], temperature=100.0).select(r(F.col("loss")).alias("loss"))


@query()
def met04_generation_scores(table):
    c = table("conversations").groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("pred"), F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("label"))
    return M.generation_scores(c, "pred", "label")


# ---------------------------------------------------------------- layouts, validity, rendering, packing, rewards


_MESSAGES = "(SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"


def conversations(table) -> DataFrame:
    """conv_id and canonical messages."""
    return messages_of(table).withColumn("messages", F.transform("messages", lambda m: N.message(m["role"], m["content"])))


#: Turns in SQL: the leading system turn apart, j the place of a turn where a leading assistant turn follows an empty query.
_CHAT = """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t WHERE NOT (n = 1 AND role = 'system')),
l AS (SELECT *, i + (arg_min(role, turn) OVER (PARTITION BY conv_id) = 'assistant')::INTEGER AS j, (arg_min(role, turn) OVER (PARTITION BY conv_id) = 'assistant')::INTEGER AS lead, coalesce(max(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY conv_id), -1) AS last FROM b)"""
_RENDERED = """string_agg(CASE WHEN j % 2 = 0 OR i = 0 THEN '<|im_start|>user' || chr(10) || CASE WHEN j % 2 = 0 THEN text ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE '' END
 || CASE WHEN j % 2 = 1 THEN text || '<|im_end|>' || chr(10) ELSE '' END, '' ORDER BY i)"""
_SYSTEMS = "(SELECT conv_id, max(text) FILTER (n = 1 AND role = 'system') AS system FROM t GROUP BY conv_id)"


@query(f"""{_CHAT} SELECT conv_id, md5('<|im_start|>system' || chr(10) || coalesce(system, 'You are a helpful assistant.') || '<|im_end|>' || chr(10) || coalesce(body, '')) AS text
FROM {_SYSTEMS} LEFT JOIN (SELECT conv_id, {_RENDERED} AS body FROM l GROUP BY conv_id) USING (conv_id)""")
def q01_render_conversations(table):
    """Every conversation as the text that a model is trained on."""
    d = conversations(table).select("conv_id", N.split_system(F.col("messages")).alias("p"))
    return d.select("conv_id", F.md5(R.text_of(R.segments(R.TEMPLATES["chatml_default"], F.col("p.system"), F.col("p.messages")))).alias("text"))


@query("SELECT conv_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS messages FROM conversations GROUP BY conv_id")
def nrm04_messages_layout(table):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("from"), F.col("text").alias("value"))))
    d = N.messages_layout(table("conversations").groupBy("conv_id").agg(turns.alias("conversations")))
    return d.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("messages"))


@query("SELECT conv_id, CASE WHEN bool_or(i % 5 = 4) THEN 'illegal role' WHEN conv_id % 7 = 3 THEN 'null content' END AS reason FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id")
def flt01_reject_reasons(table):
    def spoiled(m, i):
        hidden = F.when((F.col("conv_id") % 7 == 3) & (i == 0), F.lit(None)).otherwise(m["content"])
        return m.withField("role", F.when(i % 5 == 4, "narrator").otherwise(m["role"])).withField("content", hidden)

    d = messages_of(table).withColumn("messages", F.transform("messages", spoiled))
    good, bad = V.split_valid(d, V.message_fault(F.col("messages")))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("conv_id", "reason")


@query("SELECT doc_id, 'user,assistant' AS roles, lang AS query, md5(text) AS response FROM documents")
def nrm02_query_response(table):
    d = N.query_response(table("documents").select("doc_id", F.col("lang").alias("question"), F.col("text").alias("answer")))
    roles = F.array_join(F.transform("messages", lambda m: m["role"]), ",")
    return d.select("doc_id", roles.alias("roles"), F.col("messages")[0]["content"].alias("query"), F.md5(F.col("messages")[1]["content"]).alias("response"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE lang || chr(10) || source END AS query FROM documents")
def nrm03_alpaca(table):
    docs = table("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("lang")).alias("instruction"), F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source")).alias("input"), F.col("text").alias("output"))
    return N.alpaca(docs).select("doc_id", F.get("messages", 0)["content"].alias("query"))


@query("SELECT doc_id, CASE toxic WHEN 0 THEN 'clean' ELSE 'toxic' END AS response FROM labels WHERE quality IS NOT NULL")
def nrm08_classification_prompt(table):
    return _toxicity_prompts(table).select("doc_id", "response")


def _toxicity_prompts(table) -> DataFrame:
    """doc_id, prompt and response of every label's own messages; the id is read from the prompt."""
    d = N.classification_as_generation(table("labels").select("doc_id", F.concat(F.lit("item "), "doc_id").alias("sentence"), F.col("toxic").alias("label")), ["clean", "toxic"], "Toxicity")
    prompt = F.element_at("messages", -2)["content"]
    return d.select(F.regexp_extract(prompt, "item (-?[0-9]+)", 1).cast("bigint").alias("doc_id"), prompt.alias("prompt"), F.element_at("messages", -1)["content"].alias("response"))


@query("""SELECT doc_id, concat('Task: Toxicity', chr(10), 'Sentence: item ', doc_id, chr(10), 'Category: clean, toxic', chr(10), 'Output:') AS prompt,
CASE toxic WHEN 0 THEN 'clean' ELSE 'toxic' END AS response FROM labels WHERE toxic IS NOT NULL""")
def nrm08_prompts(table):
    return _toxicity_prompts(table)


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t WHERE NOT (n = 1 AND role = 'system'))
SELECT conv_id, (i // 2)::INTEGER AS i, max(CASE WHEN i % 2 = 0 THEN text END) AS q, max(CASE WHEN i % 2 = 1 THEN text END) AS a FROM b GROUP BY conv_id, i // 2""")
def nrm10_history_pairs(table):
    d = conversations(table).select("conv_id", N.messages_to_history(F.col("messages")).alias("h"))
    pairs = F.concat("h.history", F.array(F.array("h.query", "h.response")))
    return d.select("conv_id", F.posexplode(pairs).alias("i", "p")).select("conv_id", "i", F.col("p")[0].alias("q"), F.col("p")[1].alias("a"))


@query(f"""{_CHAT} SELECT conv_id, md5(coalesce('<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10), '') || coalesce(body, '')) AS text
FROM {_SYSTEMS} LEFT JOIN (SELECT conv_id, {_RENDERED} AS body FROM l GROUP BY conv_id) USING (conv_id)""")
def rnd05_chatml_render(table):
    d = conversations(table).select("conv_id", N.split_system(F.col("messages")).alias("p"))
    return d.select("conv_id", F.md5(R.text_of(R.segments(R.TEMPLATES["chatml"], F.col("p.system"), F.col("p.messages")))).alias("text"))


@query(f"""{_CHAT} SELECT conv_id, coalesce(sum(CASE WHEN j % 2 = 1 AND j - 1 >= last + lead THEN length(text) END), 0)::DOUBLE AS chars FROM t LEFT JOIN (SELECT conv_id, turn, j, last, lead FROM l) USING (conv_id, turn) GROUP BY conv_id""")
def lsc01_supervised_chars(table):
    d = conversations(table).select("conv_id", N.split_system(F.col("messages")).alias("p"))
    pieces = R.segments(R.TEMPLATES["chatml"], F.col("p.system"), F.col("p.messages"), "last_round")
    answers = F.filter(pieces, lambda x: x["kind"] == "response")
    return d.select("conv_id", F.aggregate(answers, F.lit(0.0), lambda s, x: s + x["weight"] * F.length(x["text"])).alias("chars"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS role, text FROM conversations),
g AS (SELECT *, sum(CASE WHEN role IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t))
SELECT conv_id, (run - 1)::BIGINT AS run, role, string_agg(text, '' ORDER BY turn) AS content FROM g GROUP BY conv_id, run, role""")
def rnd07_merge_same_role(table):
    t = table("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "user").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    return R.merge_same_role(t, ["conv_id"], "turn")


@query("""WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE WHEN role = 'assistant' THEN '<think>x</think>  ' || text ELSE text END AS c, text FROM conversations),
l AS (SELECT *, coalesce(max(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY conv_id), -1) AS last FROM t)
SELECT conv_id, i, CASE WHEN role = 'assistant' AND i < last THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE c END AS content FROM l""")
def rnd11_history_thinking(table):
    d = conversations(table).withColumn("messages", F.transform("messages", lambda m: F.when(m["role"] == "assistant", m.withField("content", F.concat(F.lit("<think>x</think>  "), m["content"]))).otherwise(m)))
    return d.select("conv_id", F.posexplode(R.remove_history_thinking(F.col("messages"))).alias("i", "m")).select("conv_id", "i", F.col("m.content").alias("content"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, len(ws) AS n, array_to_string(ws[1:64], ' ') AS right_side, array_to_string(CASE WHEN len(ws) > 64 THEN ws[len(ws) - 63:len(ws)] ELSE ws END, ' ') AS left_side, (len(ws) + 63) // 64 AS windows FROM w""")
def rnd19_truncate(table):
    from parley.functions.text import words

    d = table("documents").select("doc_id", words(F.col("text")).alias("ws"))
    return d.select("doc_id", F.size("ws").cast("bigint").alias("n"), F.array_join(R.truncate(F.col("ws"), 64), " ").alias("right_side"), F.array_join(R.truncate(F.col("ws"), 64, "left"), " ").alias("left_side"), F.size(R.split_windows(F.col("ws"), 64)).cast("bigint").alias("windows"))


@query("SELECT count(*) AS rows, sum(n_chars)::BIGINT AS total, count(*) FILTER (n_chars > 8192) AS over FROM documents")
def pck02_pack_best_fit(table):
    """All documents in chunks of 1000 with carry: no pack is over the limit but those of one over-long document."""
    packed = P.pack_table(table("documents"), "doc_id", "n_chars", 8192, shards=4)
    bins = packed.groupBy("shard", "pack").agg(F.sum("n_chars").alias("s"), F.count(F.lit(1)).alias("n"))
    return bins.agg(F.sum("n").alias("rows"), F.sum("s").alias("total"), F.sum((F.col("s") > 8192).cast("bigint")).alias("over"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) ELSE [] END AS gs FROM w)
SELECT doc_id, CASE WHEN len(gs) > 0 THEN round((1 - len(list_distinct(gs)) / len(gs)) * -1.0, 6) + 0 ELSE 0 END AS reward FROM g""")
def rwd03_repetition(table):
    return table("documents").select("doc_id", (F.round(RW.repetition(F.col("text")), 6) + 0).alias("reward"))


@query(r"""SELECT doc_id, regexp_full_match(c, '<think>.*?</think>\s*<answer>.*?</answer>', 's')::INTEGER::DOUBLE AS reward FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>' || text || '</think>' || chr(10) || '<answer>x</answer>'
WHEN 1 THEN 'x' || chr(10) || '<think>' || text || '</think><answer>x</answer>' ELSE text END AS c FROM documents)""")
def rwd01_format(table):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>\n<answer>x</answer>"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x\n<think>"), "text", F.lit("</think><answer>x</answer>"))).otherwise(F.col("text"))
    return table("documents").select("doc_id", RW.think_answer_format(text).alias("reward"))


@query("SELECT doc_id, round(CASE WHEN toxic = 0 THEN 1.0 - 0.5 * (1 - cos(n_chars * pi() / 20000)) / 2 ELSE -0.5 + 0.5 * (1 - cos(n_chars * pi() / 20000)) / 2 END, 6) AS reward, round(least(-(n_chars - 3000) / 1000.0, 0), 6) + 0 AS overlong FROM documents JOIN labels USING (doc_id)")
def rwd04_cosine_overlong(table):
    d = table("documents").join(table("labels"), "doc_id")
    return d.select("doc_id", F.round(RW.cosine_length(F.col("n_chars"), F.col("toxic") == 0, 20000), 6).alias("reward"), (F.round(RW.soft_overlong(F.col("n_chars"), 4000, 1000), 6) + 0).alias("overlong"))


@query("SELECT doc_id, ((doc_id * 4 + doc_id % 3) / 2.0 = doc_id * 2 + (n_chars % 2) / 2.0)::INTEGER::DOUBLE AS reward FROM documents")
def rwd06_math_accuracy(table):
    """Decimals against fractions."""
    halves = F.when(F.col("n_chars") % 2 == 0, F.lit("")).otherwise(F.lit(".5"))
    answer = F.concat(F.lit("so \\boxed{"), (F.col("doc_id") * 2).cast("string"), halves, F.lit("}"))
    wanted = F.concat(F.lit("\\boxed{\\frac{"), (F.col("doc_id") * 4 + F.col("doc_id") % 3).cast("string"), F.lit("}{2}}"))
    return table("documents").select("doc_id", RW.math_accuracy(answer, wanted).alias("reward"))


@query("""WITH s AS (SELECT *, CASE WHEN ph > pl THEN (value - pl) / (ph - pl + 1e-5) ELSE least(1, value) END + 10 * CASE WHEN oh > ol THEN (orm - ol) / (oh - ol + 1e-5) ELSE least(1, orm) END AS score FROM (
SELECT *, min(value) OVER w AS pl, max(value) OVER w AS ph, min(orm) OVER w AS ol, max(orm) OVER w AS oh FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'click') THEN 1.0 ELSE 0 END AS orm FROM events) WINDOW w AS (PARTITION BY user_id))),
m AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id ORDER BY score, event_id) AS rejected FROM s)
SELECT user_id, event_id, rejected, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM m WHERE value > 0 AND orm > 0 AND event_id <> rejected) WHERE rank <= 4""")
def sel01_rejection_sampling(table):
    e = table("events").withColumn("orm", F.when(F.col("event_type").isin("purchase", "click"), 1.0).otherwise(0.0))
    return S.rejection_sample(e, "user_id", "value", "orm", "event_id", 4).select("user_id", "event_id", "rejected", "rank")


@query("SELECT doc_id, 7 AS n, 0 AS own FROM documents")
def mm07_negatives(table):
    docs = table("documents").select("doc_id", "text")
    # digests in place of texts, before rows are dealt by document
    made = S.negatives(docs, "doc_id", "text").select("doc_id", F.sha2("negative", 256).alias("negative"))
    d = made.join(docs.select(F.col("doc_id").alias("_d"), F.sha2("text", 256).alias("text")), F.col("doc_id") == F.col("_d"))
    return d.groupBy("doc_id").agg(F.count_distinct("negative").cast("int").alias("n"), F.sum((F.col("negative") == F.col("text")).cast("int")).cast("int").alias("own"))


@query("SELECT event_id, 'lookup' AS name, (regexp_extract(props, '\\d+'))::VARCHAR AS k FROM events")
def agt04_hermes_calls(table):
    text = F.concat(F.lit("Sure.\n<tool_call>\n{\"name\": \"lookup\", \"arguments\": "), "props", F.lit("}\n</tool_call>"))
    d = table("events").select("event_id", A.extract_hermes(text).alias("c"))
    return d.select("event_id", F.col("c")[0]["name"].alias("name"), F.get_json_object(F.col("c")[0]["arguments"], "$.k").alias("k"))


@query("SELECT event_id, 'lookup' AS name, props AS arguments FROM events")
def agt01_react_calls(table):
    text = F.concat(F.lit("Thought: x\nAction: lookup\nAction Input: "), "props", F.lit("\nObservation: y"))
    d = table("events").select("event_id", A.extract_react(text).alias("c"))
    return d.select("event_id", F.col("c")[0]["name"].alias("name"), F.col("c")[0]["arguments"].alias("arguments"))


@query("SELECT event_id, 'lookup' AS name FROM events")
def agt07_all_formats(table):
    """Every format extracts the call that it renders, for every event."""
    e = table("events").select("event_id", A.round_trips("lookup", F.col("props")).alias("calls"))
    names = F.array_join(F.array_distinct(F.transform("calls", lambda c: c["name"])), ",")
    return e.select("event_id", F.when(F.size("calls") == len(A.FORMATS), names).alias("name"))


_TEXT_VALUES = "('glm4_5', 'glm4_7', 'qwen3_coder', 'qwen3_5', 'seed_oss')"
_LITERALS = "('react_en', 'react_zh', 'react_grpo', 'toolbench', 'qwen_en', 'qwen_zh', 'qwen_en_parallel', 'qwen_zh_parallel', 'chatglm4', 'glm4')"


@query(f"""SELECT event_id, format, 'lookup' AS name,
  CASE WHEN format IN {_TEXT_VALUES} THEN regexp_replace(props, ': (-?[0-9.]+)', ': "\\1"', 'g') WHEN format IN {_LITERALS} THEN replace(props, '"', '''') ELSE props END AS arguments
FROM events, (SELECT unnest([{", ".join(f"'{f}'" for f in A.FORMATS)}]) AS format)""")
def agt07_all_events(table):
    """The call of every event, rendered and extracted in every format; some formats have all values as texts, some write literals."""
    calls = table("events").select("event_id", F.explode(A.round_trips("lookup", F.col("props"))).alias("c"))
    return calls.select("event_id", "c.format", "c.name", "c.arguments")


_SHOWN = {
    "react_en": "n || ': Call this tool to interact with the ' || n || ' API. What is the ' || n || ' API useful for? ' || d || ' Parameters: ' || props || ' Format the arguments as a JSON object.'",
    "hermes": "'{\"type\": \"function\", \"function\": ' || t || '}'",
    "mistral": "'{\"type\": \"function\", \"function\": ' || t || '}'",
    "toolbench": "t",
    "glm4_5": "t",
    "deepseek_v3_1": "'### ' || n || chr(10) || 'Description: ' || d || chr(10) || chr(10) || 'Parameters: ' || props",
    "minimax_m2": "'<tool>' || t || '</tool>'",
    "llama3": "'{' || chr(10) || '    \"name\": \"' || n || '\",' || chr(10) || '    \"description\": \"' || d || '\",' || chr(10) || '    \"parameters\": {' || chr(10) || '        ' || substr(props, 2, length(props) - 2) || chr(10) || '    }' || chr(10) || '}'",
}  # the tool in each format
_FILLED = "replace(replace(replace({p}, '{{{{NAMES}}}}', n), '{{{{TOOLS}}}}', {t}), '{{{{{s}}}}}', {v})"


def _tool_prompts_sql() -> str:
    branch = {f: _FILLED.format(p="'" + TL.PROMPTS[f].prompt.replace("'", "''") + "'", t=t, s="QUERY" if f == "llama3" else "SYSTEM", v="event_type" if f == "llama3" else "'<|system|>' || chr(10) || 'S' || user_id" if f == "glm4_5" else "'S' || user_id") for f, t in _SHOWN.items()}
    return f"""WITH e AS (SELECT event_id, user_id, event_type, props, 'f' || user_id AS n, 'About ' || event_type AS d FROM events),
x AS (SELECT *, '{{"name": "' || n || '", "description": "' || d || '", "parameters": ' || props || '}}' AS t FROM e)
{" UNION ALL ".join(f"SELECT event_id, '{f}' AS format, md5({'chr(83) || user_id' if f == 'llama3' else s}) AS system, md5({s if f == 'llama3' else 'event_type'}) AS query FROM x" for f, s in branch.items())}"""


@query(_tool_prompts_sql())
def agt13_tool_prompts(table):
    """A tool of every event's own name, description and parameters, shown in the system prompt or query of formats."""
    tools = F.concat(F.lit('[{"name": "f'), F.col("user_id").cast("string"), F.lit('", "description": "About '), "event_type", F.lit('", "parameters": '), "props", F.lit("}]"))
    system = F.concat(F.lit("S"), F.col("user_id").cast("string"))
    made = table("events").select("event_id", F.explode(TL.tool_prompts(tools, system, F.col("event_type"), list(_SHOWN))).alias("c"))
    return made.select("event_id", "c.format", F.md5("c.system").alias("system"), F.md5("c.query").alias("query"))


@query("SELECT doc_id, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def jon03_semi_join(table):
    return table("labels").join(table("documents").where("lang = 'en'"), "doc_id", "left_semi").select("doc_id", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon04_cache_rest(table):
    cache = table("labels").select("doc_id", F.array(F.lit("a"), F.lit("b")).alias("choices"))
    return S.cached_choices(table("documents").select("doc_id"), cache, "doc_id", 2)[1]


from parley.plans import format_queries, operator_queries  # noqa: E402, F401  (they register their queries)
