"""Queries over graded samples: accuracy tables, averages, re-checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from .registry import query
from .views import DETAILS, ROLLOUTS, details, rollouts, table

R = lambda c, n=6: F.round(c, n)

_ITEMS = f"""{DETAILS}, items AS (SELECT benchmark, item, max(CAST(correct AND sample = 1 AS INT)) AS first_ok, max(CAST(correct AS INT)) AS any_ok,
  max(CAST(extracted AND sample = 1 AS INT)) AS extracted, max(CAST(boxed AND sample = 1 AS INT)) AS boxed, sum(chars) AS chars, count(*) AS samples FROM details GROUP BY benchmark, item),
bench AS (SELECT benchmark, count(*) AS items, sum(first_ok) / count(*) AS pass_1, sum(any_ok) / count(*) AS pass_n, avg(extracted) AS ext, avg(boxed) AS box, sum(chars) / sum(samples) AS avg_chars FROM items GROUP BY benchmark)"""


def _bench(spark, d):
    one = lambda c: F.max(F.when(F.col("sample") == 1, F.col(c).cast("int")).otherwise(0))
    items = details(spark, d).groupBy("benchmark", "item").agg(
        one("correct").alias("first_ok"), F.max(F.col("correct").cast("int")).alias("any_ok"), one("extracted").alias("ext"), one("boxed").alias("box"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("samples")
    )
    return items.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("items"), F.avg("first_ok").alias("pass_1"), F.avg("any_ok").alias("pass_n"), F.avg("ext").alias("ext"), F.avg("box").alias("box"), (F.sum("chars") / F.sum("samples")).alias("avg_chars")
    )


@query("a16_benchmark_summary", f"WITH {_ITEMS} SELECT benchmark, items, round(pass_1, 6) AS pass_1, round(pass_n, 6) AS pass_n, round(ext, 6) AS ext, round(box, 6) AS box, round(avg_chars, 3) AS avg_chars FROM bench")
def summary(spark, d):
    return _bench(spark, d).select("benchmark", "items", *[R(c).alias(c) for c in ("pass_1", "pass_n", "ext", "box")], R("avg_chars", 3).alias("avg_chars"))


@query(
    "a17_macro_averages",
    f"WITH {_ITEMS} SELECT round(avg(pass_1), 6) AS avg_all, round(avg(CASE WHEN benchmark IN ('1-URGENT', '2-HIGH') THEN pass_1 END), 6) AS avg_competition FROM bench",
)
def macro(spark, d):
    some = F.col("benchmark").isin("1-URGENT", "2-HIGH")
    return _bench(spark, d).agg(R(F.avg("pass_1")).alias("avg_all"), R(F.avg(F.when(some, F.col("pass_1")))).alias("avg_competition"))


@query(
    "a18_micro_macro",
    f"""WITH {DETAILS}, c AS (SELECT benchmark, count(*) AS n, count(*) FILTER (correct) AS ok FROM details GROUP BY benchmark)
SELECT benchmark, n, ok, round(ok / n, 6) AS accuracy FROM c UNION ALL SELECT 'micro', sum(n)::BIGINT, sum(ok)::BIGINT, round(sum(ok) / sum(n), 6) FROM c
UNION ALL SELECT 'macro', count(*), NULL, round(avg(ok / n), 6) FROM c WHERE n > 0""",
)
def micro_macro(spark, d):
    c = details(spark, d).groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("ok"))
    ratio = F.col("ok") / F.col("n")
    micro = c.agg(F.lit("micro").alias("benchmark"), F.sum("n").alias("n"), F.sum("ok").alias("ok")).withColumn("accuracy", R(ratio))
    macro_ = c.agg(F.lit("macro").alias("benchmark"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("ok"), R(F.avg(ratio)).alias("accuracy"))
    return c.withColumn("accuracy", R(ratio)).unionByName(micro).unionByName(macro_)


@query("a19_strict_average", f"WITH {_ITEMS} SELECT CASE WHEN count(DISTINCT benchmark) = 5 THEN round(avg(pass_1) * 100, 4) END AS avg_strict FROM bench")
def strict(spark, d):
    return _bench(spark, d).agg(F.when(F.count_distinct("benchmark") == 5, R(F.avg("pass_1") * 100, 4)).alias("avg_strict"))


@query("a20_lenient_average", f"WITH {_ITEMS} SELECT round(avg(pass_1) * 100, 4) AS avg_lenient FROM bench")
def lenient(spark, d):
    return _bench(spark, d).agg(R(F.avg("pass_1") * 100, 4).alias("avg_lenient"))


@query(
    "a21_column_means",
    f"""WITH {DETAILS}, s AS (SELECT item % 4 AS step, benchmark, avg(CAST(correct AS INT)) AS acc FROM details GROUP BY 1, 2)
SELECT step, benchmark, round(avg(acc), 6) AS acc FROM s GROUP BY GROUPING SETS ((step, benchmark), (benchmark))""",
)
def column_means(spark, d):
    s = details(spark, d).groupBy((F.col("item") % 4).alias("step"), "benchmark").agg(F.avg(F.col("correct").cast("int")).alias("acc"))
    return s.groupingSets([[F.col("step"), F.col("benchmark")], [F.col("benchmark")]], "step", "benchmark").agg(R(F.avg("acc")).alias("acc")).select("step", "benchmark", "acc")


_RECHECK = f"""{DETAILS}, r AS (SELECT benchmark, item, correct, boxed, chars / 10.0::DOUBLE AS pred, round(chars / 10.0::DOUBLE) AS ref FROM details)"""


@query(
    "a22_rounding_recheck",
    f"WITH {_RECHECK} SELECT benchmark, count(*) AS total, count(*) FILTER (correct) AS before, count(*) FILTER (NOT correct AND boxed AND abs(pred - ref) <= 0.3::DOUBLE) AS recovered FROM r GROUP BY benchmark",
)
def rounding(spark, d):
    r = details(spark, d).withColumn("pred", F.col("chars") / 10.0).withColumn("ref", F.round("pred"))
    ok = ~F.col("correct") & F.col("boxed") & (F.abs(F.col("pred") - F.col("ref")) <= 0.3)
    return r.groupBy("benchmark").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("before"), F.count_if(ok).alias("recovered"))


_JUDGE = f"""{DETAILS}, wrong AS (SELECT benchmark, item, chars FROM details WHERE NOT correct AND boxed), calls AS (SELECT DISTINCT item, chars FROM wrong), verdicts AS (SELECT item, chars, (item + chars) % 3 = 0 AS yes FROM calls)"""


@query(
    "a23_judge_rollup",
    f"""WITH {_JUDGE}, p AS (SELECT benchmark, count(*) AS judged, count(*) FILTER (yes) AS promoted FROM wrong JOIN verdicts USING (item, chars) GROUP BY benchmark),
c AS (SELECT benchmark, count(*) AS total, count(*) FILTER (correct) AS correct FROM details GROUP BY benchmark)
SELECT benchmark, total, correct, coalesce(judged, 0) AS judged, coalesce(promoted, 0) AS promoted, round((correct + coalesce(promoted, 0)) / total, 6) AS final FROM c LEFT JOIN p USING (benchmark)""",
)
def judge(spark, d):
    x = details(spark, d)
    wrong = x.where(~F.col("correct") & F.col("boxed")).select("benchmark", "item", "chars")
    verdicts = wrong.select("item", "chars").distinct().withColumn("yes", (F.col("item") + F.col("chars")) % 3 == 0)
    p = wrong.join(verdicts, ["item", "chars"]).groupBy("benchmark").agg(F.count(F.lit(1)).alias("judged"), F.count_if("yes").alias("promoted"))
    c = x.groupBy("benchmark").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct")).join(p, "benchmark", "left").fillna(0, ["judged", "promoted"])
    return c.withColumn("final", R((F.col("correct") + F.col("promoted")) / F.col("total")))


@query("a24_judge_calls", f"WITH {_JUDGE} SELECT (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM wrong JOIN verdicts USING (item, chars) WHERE yes) AS promotions")
def judge_calls(spark, d):
    wrong = details(spark, d).where(~F.col("correct") & F.col("boxed"))
    yes = (F.col("item") + F.col("chars")) % 3 == 0
    return wrong.agg(F.count_distinct("item", "chars").alias("calls"), F.count_if(yes).alias("promotions"))


@query(
    "j8_verdicts_to_duplicates",
    f"WITH {_JUDGE} SELECT item, chars, count(*) AS copies, bool_or(yes) AS yes FROM wrong LEFT JOIN verdicts USING (item, chars) GROUP BY item, chars",
)
def verdict_join(spark, d):
    wrong = details(spark, d).where(~F.col("correct") & F.col("boxed")).select("item", "chars")
    verdicts = wrong.distinct().withColumn("yes", (F.col("item") + F.col("chars")) % 3 == 0)
    return wrong.join(verdicts, ["item", "chars"], "left").groupBy("item", "chars").agg(F.count(F.lit(1)).alias("copies"), F.bool_or("yes").alias("yes"))


@query(
    "j13_stacked_recheck",
    f"""WITH {_RECHECK}, v AS (SELECT DISTINCT benchmark, item, item % 3 = 0 AS yes FROM details), f AS (SELECT r.*, coalesce(v.yes, false) AS yes FROM r LEFT JOIN v USING (benchmark, item))
SELECT benchmark, count(*) FILTER (correct OR yes) AS judged_ok, count(*) FILTER (correct OR yes OR (boxed AND abs(pred - ref) <= 0.3::DOUBLE)) AS final_ok FROM f GROUP BY benchmark""",
)
def stacked(spark, d):
    r = details(spark, d).withColumn("pred", F.col("chars") / 10.0).withColumn("ref", F.round("pred"))
    v = r.select("benchmark", "item").distinct().withColumn("yes", F.col("item") % 3 == 0)
    f = r.join(v, ["benchmark", "item"], "left").withColumn("ok", F.col("correct") | F.coalesce("yes", F.lit(False)))
    near = F.col("boxed") & (F.abs(F.col("pred") - F.col("ref")) <= 0.3)
    return f.groupBy("benchmark").agg(F.count_if("ok").alias("judged_ok"), F.count_if(F.col("ok") | near).alias("final_ok"))


@query("a40_dataset_scores", f"WITH {DETAILS} SELECT benchmark, sum(CAST(correct AS INT))::BIGINT AS ok, round(avg(CAST(correct AS INT)), 6) AS score FROM details GROUP BY benchmark")
def dataset_scores(spark, d):
    ok = F.col("correct").cast("int")
    return details(spark, d).groupBy("benchmark").agg(F.sum(ok).alias("ok"), R(F.avg(ok)).alias("score"))


@query(
    "t13_replication",
    "SELECT rep * (SELECT count(*) FROM benchmark) + pos AS position, item_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark), (SELECT unnest(range(32)) AS rep)",
)
def replication(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    w = W.partitionBy(F.lit(0))  # a benchmark is a short list
    b = b.withColumns({"pos": F.row_number().over(w.orderBy("item_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    return b.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(31)))).select((F.col("rep") * F.col("n") + F.col("pos")).alias("position"), "item_id")


@query(
    "s10_source_priority",
    f"""WITH {DETAILS}, s AS (SELECT benchmark, 'judged' AS source, 0 AS p, avg(CAST(correct AS INT)) AS acc FROM details WHERE benchmark < '3' GROUP BY 1
UNION ALL SELECT benchmark, 'plain', 1, avg(CAST(correct AS INT)) FROM details GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY p) AS k FROM s)
SELECT benchmark, source, round(acc, 6) AS acc FROM r WHERE k = 1""",
)
def source_priority(spark, d):
    from ..sources.files import first_available

    t = details(spark, d).groupBy("benchmark").agg(R(F.avg(F.col("correct").cast("int"))).alias("acc"))
    return first_available([("judged", t.where("benchmark < '3'")), ("plain", t)], ["benchmark"]).select("benchmark", "source", "acc")


@query(
    "a1_pass_rate",
    f"WITH {ROLLOUTS} SELECT uid, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(avg(CAST(correct AS INT)), 6) AS p_hat FROM rollouts GROUP BY uid",
)
def pass_rate(spark, d):
    return rollouts(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), R(F.avg(F.col("correct").cast("int"))).alias("p_hat"))


@query(
    "a2_full_score",
    f"WITH {ROLLOUTS}, g AS (SELECT uid, avg(CAST(correct AS INT)) AS p, avg(h) AS u, count(*) AS n, count(*) FILTER (correct) AS k FROM rollouts GROUP BY uid) SELECT uid, round(p, 6) AS p_hat, round(p * (1 - p), 6) AS learnability, round(p * (1 - p) * u, 6) AS rq, n, k AS n_correct FROM g",
)
def full_score(spark, d):
    g = rollouts(spark, d).groupBy("uid").agg(F.avg(F.col("correct").cast("int")).alias("p"), F.avg("h").alias("u"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))
    a, _ = scoring.rq_terms(F.col("p"), F.col("u"))
    return g.select("uid", R("p").alias("p_hat"), R(a).alias("learnability"), R(scoring.rq_value(F.col("p"), F.col("u"))).alias("rq"), "n", "n_correct")
