"""Queries of token-level math: advantages, returns, masks, losses, batch metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as X
from .registry import query
from .views import ROLLOUTS, rollouts, table, tokens

R = lambda c, n=6: F.round(c, n)


def _uid():
    return W.partitionBy("uid")



@query("a3_group_mean", f"WITH {ROLLOUTS} SELECT uid, round(avg(h), 6) AS h FROM rollouts GROUP BY uid")
def group_mean(spark, d):
    return rollouts(spark, d).groupBy("uid").agg(R(F.avg("h")).alias("h"))


@query("a4_response_mean", f"WITH {ROLLOUTS} SELECT uid, round(sum(h * mask) / greatest(sum(mask), 1), 6) AS mean FROM rollouts GROUP BY uid")
def response_mean(spark, d):
    return tokens(spark, d).select("uid", R(X.masked_mean(F.col("h"), F.col("mask"))).alias("mean"))


@query(
    "a5_entropy_summary",
    f"WITH {ROLLOUTS} SELECT uid, count(*) FILTER (mask = 1) AS n, round(coalesce(avg(h) FILTER (mask = 1), 0), 6) AS mean, coalesce(min(h) FILTER (mask = 1), 0) AS low, coalesce(max(h) FILTER (mask = 1), 0) AS high, round(coalesce(stddev_pop(h) FILTER (mask = 1), 0), 6) AS std FROM rollouts GROUP BY uid",
)
def entropy_summary(spark, d):
    h = F.when(F.col("mask") == 1, F.col("h"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return rollouts(spark, d).groupBy("uid").agg(F.count(h).alias("n"), R(z(F.avg(h))).alias("mean"), z(F.min(h)).alias("low"), z(F.max(h)).alias("high"), R(z(F.stddev_pop(h))).alias("std"))


@query(
    "a6_group_entropy_summary",
    f"""WITH {ROLLOUTS}, g AS (SELECT uid // 8 AS item, uid, avg(h) AS m, count(*) AS n, min(h) AS lo, max(h) AS hi FROM rollouts GROUP BY ALL)
SELECT item, round(avg(m), 9) AS mean, round(min(m), 9) AS low, round(max(m), 9) AS high, round(stddev_pop(m), 6) AS std, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS tokens_mean, min(lo) AS token_low, max(hi) AS token_high FROM g GROUP BY item""",
)
def group_entropy(spark, d):
    g = rollouts(spark, d).groupBy(F.floor(F.col("uid") / 8).alias("item"), "uid").agg(F.avg("h").alias("m"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    return g.groupBy("item").agg(
        R(F.avg("m"), 9).alias("mean"), R(F.min("m"), 9).alias("low"), R(F.max("m"), 9).alias("high"), R(F.stddev_pop("m")).alias("std"), F.sum("n").alias("tokens"), R(F.avg("n")).alias("tokens_mean"), F.min("lo").alias("token_low"), F.max("hi").alias("token_high")
    )


@query(
    "w3_group_normalize",
    f"""WITH {ROLLOUTS}, g AS (SELECT *, avg(score) OVER p AS m, stddev_samp(score) OVER p AS s, count(*) OVER p AS n FROM rollouts WINDOW p AS (PARTITION BY uid))
SELECT uid, idx, round((score - m) / (s + 1e-6::DOUBLE), 4) * mask AS adv FROM g WHERE n > 1""",
)
def group_normalize(spark, d):
    g = rollouts(spark, d).withColumns({"m": F.avg("score").over(_uid()), "s": F.stddev_samp("score").over(_uid()), "n": F.count(F.lit(1)).over(_uid())}).where("n > 1")
    return g.select("uid", "idx", (R((F.col("score") - F.col("m")) / (F.col("s") + 1e-6), 4) * F.col("mask")).alias("adv"))


@query(
    "w4_leave_one_out",
    f"WITH {ROLLOUTS}, g AS (SELECT *, sum(score) OVER (PARTITION BY uid) AS t, count(*) OVER (PARTITION BY uid) AS n FROM rollouts) SELECT uid, idx, round(score - (t - score) / (n - 1), 6) AS adv FROM g WHERE n > 1",
)
def leave_one_out(spark, d):
    g = rollouts(spark, d).withColumns({"t": F.sum("score").over(_uid()), "n": F.count(F.lit(1)).over(_uid())}).where("n > 1")
    return g.select("uid", "idx", R(F.col("score") - (F.col("t") - F.col("score")) / (F.col("n") - 1), 6).alias("adv"))


@query("w5_baseline", f"WITH {ROLLOUTS} SELECT uid, idx, round(score - first(score) OVER (PARTITION BY uid ORDER BY idx), 4) AS adv FROM rollouts")
def baseline(spark, d):
    return rollouts(spark, d).select("uid", "idx", R(F.col("score") - F.first("score").over(_uid().orderBy("idx")), 4).alias("adv"))


@query("j14_group_lookup", f"WITH {ROLLOUTS} SELECT uid, idx, max(score) OVER (PARTITION BY uid) AS best FROM rollouts")
def group_lookup(spark, d):
    return rollouts(spark, d).select("uid", "idx", F.max("score").over(_uid()).alias("best"))


# Closed forms of the scans: a return is cut where a mask between is 0.
@query(
    "w7_discounted_return",
    f"""WITH {ROLLOUTS}, z AS (SELECT *, sum(1 - mask) OVER (PARTITION BY uid ORDER BY idx) AS zeros FROM rollouts)
SELECT a.uid, a.idx, round(sum(b.score * pow(1.0::DOUBLE / 3, b.idx - a.idx)), 3) AS ret FROM z a JOIN z b ON a.uid = b.uid AND b.idx >= a.idx AND b.zeros = a.zeros GROUP BY a.uid, a.idx""",
)
def discounted(spark, d):
    t = tokens(spark, d).select("uid", F.posexplode(X.discounted_returns(F.col("score"), F.col("mask"), 1.0 / 3)).alias("i", "ret"))
    return t.select("uid", (F.col("i") + 1).alias("idx"), R("ret", 3).alias("ret"))


@query(
    "w6_gae",
    f"""WITH {ROLLOUTS}, e AS (SELECT *, score + coalesce(lead(h) OVER (PARTITION BY uid ORDER BY idx), 0) / 1.1::DOUBLE - h AS delta FROM rollouts)
SELECT a.uid, a.idx, round(sum(b.delta * pow(0.8::DOUBLE / 1.1::DOUBLE, b.idx - a.idx)), 3) AS adv FROM e a JOIN e b ON a.uid = b.uid AND b.idx >= a.idx GROUP BY a.uid, a.idx""",
)
def gae(spark, d):
    t = tokens(spark, d).select("uid", F.posexplode(X.gae(F.col("score"), F.col("h"), 1 / 1.1, 0.8)).alias("i", "adv"))
    return t.select("uid", (F.col("i") + 1).alias("idx"), R("adv", 3).alias("adv"))


@query(
    "w8_response_mask",
    f"WITH {ROLLOUTS}, f AS (SELECT *, min(CASE WHEN mask = 0 THEN idx END) OVER (PARTITION BY uid) AS e FROM rollouts) SELECT uid, idx, CAST(e IS NULL OR idx <= e AS INT) AS keep FROM f",
)
def response_mask(spark, d):
    t = tokens(spark, d).select("uid", F.posexplode(X.response_mask(F.col("mask"), 0)).alias("i", "keep"))
    return t.select("uid", (F.col("i") + 1).alias("idx"), "keep")


@query("w9_position_ids", f"WITH {ROLLOUTS} SELECT uid, idx, CAST(greatest(sum(mask) OVER (PARTITION BY uid ORDER BY idx) - 1, 0) AS INT) AS pos FROM rollouts")
def position_ids(spark, d):
    t = tokens(spark, d).select("uid", F.posexplode(X.position_ids(F.col("mask"))).alias("i", "pos"))
    return t.select("uid", (F.col("i") + 1).alias("idx"), "pos")


@query(
    "a35_masked_whiten",
    f"""WITH {ROLLOUTS}, m AS (SELECT sum(h * mask) / (sum(mask) + 1e-8::DOUBLE) AS mean, sum(mask) AS n FROM rollouts),
v AS (SELECT mean, n, (SELECT sum((h - mean) * (h - mean) * mask) FROM rollouts) / (n + 1e-8::DOUBLE) * n / (n - 1) AS var FROM m)
SELECT uid, idx, round((h - mean) / sqrt(var + 1e-8::DOUBLE), 5) AS white FROM rollouts, v""",
)
def whiten(spark, d):
    """Batch-wide mean and variance are one row, which every row meets."""
    r = rollouts(spark, d)
    m = r.agg((F.sum(F.col("h") * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("mean"), F.sum("mask").alias("n"))
    v = r.join(F.broadcast(m)).agg(F.first("mean").alias("mean"), F.first("n").alias("n"), (F.sum((F.col("h") - F.col("mean")) * (F.col("h") - F.col("mean")) * F.col("mask"))).alias("ss"))
    v = v.select("mean", (F.col("ss") / (F.col("n") + 1e-8) * F.col("n") / (F.col("n") - 1)).alias("var"))
    return r.join(F.broadcast(v)).select("uid", "idx", R((F.col("h") - F.col("mean")) / F.sqrt(F.col("var") + 1e-8), 5).alias("white"))


@query("a36_kl_penalty", f"WITH {ROLLOUTS}, g AS (SELECT uid, sum((h - 0.05::DOUBLE) * mask) / greatest(sum(mask), 1) AS k FROM rollouts GROUP BY uid) SELECT round(avg(k), 6) AS kl FROM g")
def kl_penalty(spark, d):
    t = tokens(spark, d)
    k = X.kl(F.col("h"), F.transform("h", lambda x: F.lit(0.05)), "kl")
    return t.select(X.masked_mean(k, F.col("mask")).alias("k")).agg(R(F.avg("k")).alias("kl"))


@query(
    "m4_kl_estimators",
    f"WITH {ROLLOUTS} SELECT uid, round(sum(h - 0.05::DOUBLE), 6) AS kl, round(sum(abs(h - 0.05::DOUBLE)), 6) AS abs, round(sum(0.5::DOUBLE * (h - 0.05::DOUBLE) * (h - 0.05::DOUBLE)), 6) AS mse, round(sum(greatest(-10, least(10, exp(0.05::DOUBLE - h) - (0.05::DOUBLE - h) - 1))), 6) AS low_var FROM rollouts GROUP BY uid",
)
def kl_estimators(spark, d):
    ref = F.transform("h", lambda x: F.lit(0.05))
    named = {"kl": "kl", "abs": "abs", "mse": "mse", "low_var_kl": "low_var"}
    return tokens(spark, d).select("uid", *[R(X.total(X.kl(F.col("h"), ref, k))).alias(n) for k, n in named.items()])


@query(
    "m5_policy_loss",
    f"""WITH {ROLLOUTS}, x AS (SELECT *, exp(h - 0.05::DOUBLE) AS ratio, CASE WHEN correct THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS adv FROM rollouts),
l AS (SELECT *, greatest(-adv * ratio, -adv * greatest(0.98::DOUBLE, least(1.02::DOUBLE, ratio))) AS worst FROM x)
SELECT round(sum(CASE WHEN adv < 0 THEN least(worst, -adv * 3) ELSE worst END * mask) / sum(mask), 6) AS loss, round(avg(CAST(ratio > 1.02::DOUBLE AS INT)), 6) AS clipped FROM l""",
)
def policy_loss(spark, d):
    x = rollouts(spark, d).withColumns({"ratio": F.exp(F.col("h") - 0.05), "adv": F.when(F.col("correct"), 1.0).otherwise(-1.0)})
    loss = X.clipped_policy_loss(F.col("ratio"), F.col("adv"), 0.02, 0.02, 3.0)
    return x.agg(R(F.sum(loss * F.col("mask")) / F.sum("mask")).alias("loss"), R(F.avg((F.col("ratio") > 1.02).cast("int"))).alias("clipped"))


@query(
    "m6_value_loss",
    f"WITH {ROLLOUTS} SELECT round(avg(0.5::DOUBLE * greatest((h - 0.06::DOUBLE) * (h - 0.06::DOUBLE), (greatest(0.05::DOUBLE - 0.02::DOUBLE, least(0.05::DOUBLE + 0.02::DOUBLE, h)) - 0.06::DOUBLE) * (greatest(0.05::DOUBLE - 0.02::DOUBLE, least(0.05::DOUBLE + 0.02::DOUBLE, h)) - 0.06::DOUBLE))), 8) AS loss FROM rollouts",
)
def value_loss(spark, d):
    return rollouts(spark, d).agg(R(F.avg(X.clipped_value_loss(F.col("h"), F.lit(0.05), F.lit(0.06), 0.02)), 8).alias("loss"))


@query("m8_shaped_reward", f"WITH {ROLLOUTS} SELECT uid, idx, round(score - 0.1::DOUBLE * (h - 0.05::DOUBLE), 4) AS reward FROM rollouts")
def shaped(spark, d):
    return rollouts(spark, d).select("uid", "idx", R(F.col("score") - F.lit(0.1) * (F.col("h") - 0.05), 4).alias("reward"))


@query(
    "m9_reward_at_last",
    f"WITH {ROLLOUTS}, g AS (SELECT uid, sum(mask) AS n, sum(score) AS t FROM rollouts GROUP BY uid) SELECT uid, idx, CASE WHEN idx = n THEN round(t, 2) ELSE 0 END AS reward FROM rollouts JOIN g USING (uid)",
)
def reward_at_last(spark, d):
    t = tokens(spark, d).select("uid", F.posexplode(X.at_last_valid(R(X.total(F.col("score")), 2), F.col("mask"))).alias("i", "reward"))
    return t.select("uid", (F.col("i") + 1).alias("idx"), "reward")


@query(
    "m10_pad_or_cut",
    f"WITH {ROLLOUTS}, p AS (SELECT DISTINCT uid FROM rollouts), q AS (SELECT uid, unnest(range(1, 5)) AS idx FROM p) SELECT uid, CAST(q.idx AS INT) AS idx, coalesce(h, -1) AS h FROM q LEFT JOIN rollouts USING (uid, idx)",
)
def pad(spark, d):
    t = tokens(spark, d).select("uid", F.posexplode(X.pad_or_cut(F.col("h"), 4, F.lit(-1.0))).alias("i", "h"))
    return t.select("uid", (F.col("i") + 1).alias("idx"), "h")


@query(
    "a32_data_metrics",
    f"""WITH {ROLLOUTS}, s AS (SELECT uid, sum(score) AS t, count(*) AS n FROM rollouts GROUP BY uid)
SELECT round(avg(t), 3) AS score_mean, round(max(t), 3) AS score_max, round(min(t), 3) AS score_min, round(avg(n), 6) AS length_mean, round(avg(CAST(n = (SELECT max(n) FROM s) AS INT)), 6) AS clip_ratio,
(SELECT round(1 - var_samp(score - h) / (var_samp(score) + 1e-5::DOUBLE), 6) FROM rollouts) AS explained FROM s""",
)
def data_metrics(spark, d):
    r = rollouts(spark, d)
    s = r.groupBy("uid").agg(F.sum("score").alias("t"), F.count(F.lit(1)).alias("n"))
    top = F.broadcast(s.agg(F.max("n").alias("top")))
    a = s.join(top).agg(R(F.avg("t"), 3).alias("score_mean"), R(F.max("t"), 3).alias("score_max"), R(F.min("t"), 3).alias("score_min"), R(F.avg("n")).alias("length_mean"), R(F.avg((F.col("n") == F.col("top")).cast("int"))).alias("clip_ratio"))
    e = r.agg(R(1 - F.var_samp(F.col("score") - F.col("h")) / (F.var_samp("score") + 1e-5)).alias("explained"))
    return a.join(F.broadcast(e))


@query("a33_timing", f"WITH {ROLLOUTS} SELECT round(sum(score) * 1000 / count(*), 3) AS ms_per_token, round(count(*) / (sum(score) * 4), 9) AS tokens_per_gpu_sec FROM rollouts")
def timing(spark, d):
    t, n = F.sum("score"), F.count(F.lit(1))
    return rollouts(spark, d).agg(R(t * 1000 / n, 3).alias("ms_per_token"), R(n / (t * 4), 9).alias("tokens_per_gpu_sec"))


@query("a34_reduce_metrics", "SELECT event_type AS key, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def reduce_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(R(F.avg("value")).alias("value"))


@query("a39_flops", f"WITH {ROLLOUTS}, s AS (SELECT uid, count(*) AS n FROM rollouts GROUP BY uid) SELECT 6 * 7000 * sum(n)::DOUBLE + 12 * sum(n * n)::DOUBLE AS flops FROM s")
def flops(spark, d):
    s = rollouts(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return s.agg((F.lit(6 * 7000) * F.sum("n").cast("double") + F.lit(12) * F.sum(F.col("n") * F.col("n")).cast("double")).alias("flops"))


_LOGITS = "l AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z, label FROM embeddings)"


@query("a9_logit_entropy", f"WITH {_LOGITS}, m AS (SELECT vec_id, list_sum(list_transform(z, lambda x: exp(x))) AS s, list_sum(list_transform(z, lambda x: exp(x) * x)) AS t FROM l) SELECT vec_id, round(ln(s) - t / s, 6) AS entropy FROM m")
def logit_entropy(spark, d):
    z = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", R(X.entropy_of_logits(z)).alias("entropy"))


@query("m13_label_logp", f"WITH {_LOGITS} SELECT vec_id, round(z[label + 1] - ln(list_sum(list_transform(z, lambda x: exp(x)))), 6) AS logp FROM l")
def label_logp(spark, d):
    z = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", R(X.logp_of_label(z, F.col("label"))).alias("logp"))


@query(
    "a8_topk_entropy",
    f"""WITH {_LOGITS}, p AS (SELECT vec_id, list_transform(z[1:8], lambda x: -3 - abs(x)) AS lp FROM l), s AS (SELECT vec_id, -list_sum(list_transform(lp, lambda x: exp(x) * x)) AS o, 1 - list_sum(list_transform(lp, lambda x: exp(x))) AS t FROM p)
SELECT vec_id, round(o - t * ln(t / 992), 6) AS entropy FROM s""",
)
def topk_entropy(spark, d):
    lp = F.transform(F.slice("embedding", 1, 8), lambda x: F.lit(-3.0) - F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", R(X.entropy_of_top_logprobs(lp, 1000)).alias("entropy"))


@query("m3_projection_bin", f"WITH {_LOGITS} SELECT vec_id, CAST(greatest(0, least(9, floor((list_sum(z[1:8]) + 1) / 0.2::DOUBLE))) AS INT) AS bin FROM l")
def projection_bin(spark, d):
    """Clamped bin of the projection on a given direction (here the sum of eight components)."""
    x = X.total(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 8))
    return table(spark, d, "embeddings").select("vec_id", F.greatest(F.lit(0), F.least(F.lit(9), F.floor((x + 1) / 0.2))).cast("int").alias("bin"))
