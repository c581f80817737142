"""Queries over the archive: champions, statistics, ranks, comparisons, selection, timelines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import archive as A
from .registry import query
from .views import CAND, CHAMPIONS, DIV_BINS, H_BINS, SCORED, STEPS, candidates, cells_by_step, scored

R = lambda c, n=6: F.round(c, n)


@query("t1_cell_champions", f"WITH {CHAMPIONS} SELECT h_bin, div_bin, program_id, seq, round(rq, 6) AS rq FROM champ")
def champions(spark, d):
    return A.champion_aggregate(scored(spark, d)).withColumn("rq", R("rq"))


@query(
    "t2_cell_reservoir",
    f"WITH {CHAMPIONS} SELECT h_bin, div_bin, CAST(rn AS INT) AS rn, program_id, seq, round(rq, 6) AS rq FROM ranked WHERE rn <= 4",
)
def reservoir(spark, d):
    return A.top_per_cell(scored(spark, d), 4).select("h_bin", "div_bin", "rn", "program_id", "seq", R("rq").alias("rq"))


@query("t3_top_champions", f"WITH {CHAMPIONS} SELECT h_bin, div_bin, program_id, round(rq, 6) AS rq FROM champ ORDER BY champ.rq DESC, h_bin, div_bin LIMIT 10")
def top_champions(spark, d):
    return A.champion_aggregate(scored(spark, d)).orderBy(F.desc("rq"), "h_bin", "div_bin").limit(10).select("h_bin", "div_bin", "program_id", R("rq").alias("rq"))


@query(
    "t4_last_events_per_cell",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY h_bin, div_bin ORDER BY seq DESC) AS k FROM scored)
SELECT h_bin, div_bin, CAST(k AS INT) AS k, seq, op FROM r WHERE k <= 6""",
)
def last_events(spark, d):
    w = W.partitionBy("h_bin", "div_bin").orderBy(F.desc("seq"))
    return scored(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 6").select("h_bin", "div_bin", "k", "seq", "op")


@query(
    "a11_grid_stats",
    f"""WITH {CHAMPIONS} SELECT count(*) AS occupied, count(*) / 60.0::DOUBLE AS coverage, round(coalesce(avg(rq), 0), 6) AS mean_rq, round(coalesce(max(rq), 0), 6) AS max_rq,
round(coalesce(min(rq), 0), 6) AS min_rq, count(*) FILTER (h_bin >= 2) AS hard FROM champ""",
)
def grid_stats(spark, d):
    s = A.grid_stats(A.champion_aggregate(scored(spark, d)), H_BINS, DIV_BINS)
    return s.withColumns({c: R(c) for c in ("mean_rq", "max_rq", "min_rq")})


@query(
    "a12_champion_distribution",
    f"""WITH {CHAMPIONS} SELECT round(avg(CASE WHEN rq <> 0 THEN rq END), 6) AS mean_rq, round(stddev_pop(CASE WHEN rq <> 0 THEN rq END), 6) AS std_rq,
count(*) FILTER (rq = 0) AS zero_rq FROM champ""",
)
def champion_distribution(spark, d):
    rq = F.when(F.col("rq") != 0, F.col("rq"))
    return A.champion_aggregate(scored(spark, d)).agg(R(F.avg(rq)).alias("mean_rq"), R(F.stddev_pop(rq)).alias("std_rq"), F.count_if(F.col("rq") == 0).alias("zero_rq"))


@query(
    "a13_value_distribution",
    f"WITH {CAND} SELECT op, count(*) AS n, round(avg(u), 6) AS mean, round(stddev_pop(u), 6) AS std, min(u) AS low, max(u) AS high FROM cand GROUP BY op",
)
def value_distribution(spark, d):
    return candidates(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("n"), R(F.avg("u")).alias("mean"), R(F.stddev_pop("u")).alias("std"), F.min("u").alias("low"), F.max("u").alias("high"))


_RUN = f"""WITH {SCORED}, f AS (SELECT *, max(rq) OVER w AS prev_rq, arg_max(program_id, struct_pack(a := rq, b := -seq)) OVER w AS prev_program FROM scored
  WINDOW w AS (PARTITION BY h_bin, div_bin ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, prev_rq IS NULL OR rq > prev_rq AS accepted FROM f)"""


@query("w11_running_champion", f"{_RUN} SELECT h_bin, div_bin, seq, program_id, accepted FROM g")
def running(spark, d):
    return A.running_champion(scored(spark, d)).select("h_bin", "div_bin", "seq", "program_id", "accepted")


@query("w12_previous_champion", f"{_RUN} SELECT seq, prev_program, round(prev_rq, 6) AS prev_rq FROM g")
def previous(spark, d):
    return A.running_champion(scored(spark, d)).select("seq", F.col("prev_program"), R("prev_rq").alias("prev_rq"))


@query(
    "a14_accept_rate",
    f"{_RUN} SELECT op, count(*) AS attempted, count(*) FILTER (accepted) AS inserted, round(count(*) FILTER (accepted) / greatest(count(*), 1), 6) AS accept_rate FROM g GROUP BY op",
)
def accept_rate(spark, d):
    r = A.running_champion(scored(spark, d)).groupBy("op").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("accepted").alias("inserted"))
    return r.withColumn("accept_rate", R(scoring.safe_ratio(F.col("inserted"), F.greatest("attempted", F.lit(1)))))


@query(
    "w1_rank_ucb",
    f"""WITH {CHAMPIONS}, v AS (SELECT h_bin, div_bin, count(*) AS visits FROM scored GROUP BY ALL),
r AS (SELECT h_bin, div_bin, rq, visits, row_number() OVER (ORDER BY rq, h_bin, div_bin) - 1 AS k, count(*) OVER () AS n, (sum(visits) OVER () + 1)::DOUBLE AS total FROM champ JOIN v USING (h_bin, div_bin))
SELECT h_bin, div_bin, round(CASE WHEN n = 1 THEN 1 ELSE k / (n - 1) END, 6) AS norm_rank,
  round(CASE WHEN n = 1 THEN 1 ELSE k / (n - 1) END + 0.5::DOUBLE * sqrt(ln(total) / visits), 6) AS ucb FROM r""",
)
def rank_ucb(spark, d):
    s = scored(spark, d)
    v = s.groupBy("h_bin", "div_bin").agg(F.count(F.lit(1)).alias("visits"))
    c = A.champion_aggregate(s).join(v, ["h_bin", "div_bin"])
    total = (F.sum("visits").over(W.partitionBy(F.lit(0))) + 1).cast("double")
    return A.rank_ucb(c.withColumn("total", total), F.col("visits"), F.col("total"), 0.5).select("h_bin", "div_bin", R("norm_rank").alias("norm_rank"), R("ucb").alias("ucb"))


@query(
    "p6_frontier_status",
    f"WITH {CAND} SELECT CASE WHEN p_hat <= 0.02 THEN 'too_hard' WHEN p_hat >= 0.98 THEN 'too_easy' ELSE 'frontier' END AS status, count(*) AS n FROM cand GROUP BY 1",
)
def frontier_status(spark, d):
    return candidates(spark, d).groupBy(scoring.frontier_status(F.col("p_hat"), 0.02, 0.98).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("p5_frontier", f"WITH {CHAMPIONS.replace('seq, rq FROM ranked', 'seq, rq, p_hat FROM ranked')} SELECT h_bin, div_bin, program_id FROM champ WHERE p_hat > 0.3 AND p_hat < 0.7")
def frontier(spark, d):
    return A.top_per_cell(scored(spark, d)).where(scoring.is_frontier(F.col("p_hat"), 0.3, 0.7)).select("h_bin", "div_bin", "program_id")


@query("p7_zero_gate", f"WITH {CAND} SELECT op, count(*) AS n, count(*) FILTER (p_hat = 0) AS gated FROM cand GROUP BY op")
def zero_gate(spark, d):
    return candidates(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_hat") == 0).alias("gated"))


@query("p8_usable_rates", f"WITH {CAND} SELECT seq, p_hat FROM cand WHERE p_hat > 0 AND p_hat < 1")
def usable_rates(spark, d):
    return candidates(spark, d).where((F.col("p_hat") > 0) & (F.col("p_hat") < 1)).select("seq", "p_hat")


@query(
    "m1_score_ablations",
    f"WITH {CAND} SELECT seq, round(p_hat * (1 - p_hat) * u, 6) AS rq, round(u, 6) AS rq_no_learnability, round(p_hat * (1 - p_hat), 6) AS rq_no_uncertainty FROM cand",
)
def ablations(spark, d):
    p, u = F.col("p_hat"), F.col("u")
    return candidates(spark, d).select(
        "seq", R(scoring.rq_value(p, u)).alias("rq"), R(scoring.rq_value(p, u, ablate_learnability=True)).alias("rq_no_learnability"), R(scoring.rq_value(p, u, ablate_uncertainty=True)).alias("rq_no_uncertainty")
    )


@query("m2_value_bins", f"WITH {SCORED} SELECT h_bin, count(*) AS n, min(u) AS low, max(u) AS high FROM scored GROUP BY h_bin")
def value_bins(spark, d):
    return scored(spark, d).groupBy("h_bin").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("low"), F.max("u").alias("high"))


@query("a31_histogram", f"WITH {CAND} SELECT CAST(least(floor(p_hat * 20), 19) AS INT) AS bin, count(*) AS n FROM cand GROUP BY 1")
def histogram(spark, d):
    return candidates(spark, d).groupBy(scoring.histogram_bin(F.col("p_hat")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a25_event_counters",
    "WITH e AS (SELECT event_type AS op, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) SELECT op, day, count(*) AS n FROM e GROUP BY GROUPING SETS ((op), (day))",
)
def counters(spark, d):
    e = candidates(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    return e.groupingSets([[F.col("op")], [F.col("day")]], "op", "day").agg(F.count(F.lit(1)).alias("n")).select("op", "day", "n")


@query(
    "a26_cell_event_rollup",
    f"{_RUN} SELECT h_bin, div_bin, count(*) AS n, count(*) FILTER (accepted) AS inserted, count(*) FILTER (NOT accepted) AS rejected, count(DISTINCT op) AS ops, max(seq) AS last_seq FROM g GROUP BY h_bin, div_bin",
)
def cell_rollup(spark, d):
    return A.running_champion(scored(spark, d)).groupBy("h_bin", "div_bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("inserted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_distinct("op").alias("ops"), F.max("seq").alias("last_seq")
    )


@query(
    "a27_program_rollup",
    f"WITH {SCORED} SELECT program_id, count(*) AS n, count(DISTINCT h_bin) AS cells, min(seq) AS first_seq, max(seq) AS last_seq FROM scored GROUP BY program_id",
)
def program_rollup(spark, d):
    return scored(spark, d).groupBy("program_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h_bin").alias("cells"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("a28_top_reasons", "SELECT split_part(event_type || ' | x', ' | ', 1) AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def top_reasons(spark, d):
    reason = F.split_part(F.concat("op", F.lit(" | x")), F.lit(" | "), F.lit(1))
    return candidates(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(5)


@query(
    "a29_metric_comparison",
    f"""WITH {CAND}, m AS (SELECT 'h' AS metric, u AS s, p_hat FROM cand UNION ALL SELECT 'h_span_max', u * 1.5::DOUBLE, p_hat FROM cand)
SELECT metric, round(avg(p_hat * (1 - p_hat) * s), 6) AS mean_rq, round(max(p_hat * (1 - p_hat) * s), 6) AS max_rq, count(*) FILTER (p_hat * (1 - p_hat) * s > 0) AS positive FROM m GROUP BY metric""",
)
def metric_comparison(spark, d):
    scores = F.create_map(F.lit("h"), F.col("u"), F.lit("h_span_max"), F.col("u") * 1.5)
    m = candidates(spark, d).select("p_hat", F.explode(scores).alias("metric", "s"))
    rq = scoring.rq_value(F.col("p_hat"), F.col("s"))
    return m.groupBy("metric").agg(R(F.avg(rq)).alias("mean_rq"), R(F.max(rq)).alias("max_rq"), F.count_if(rq > 0).alias("positive"))


@query("w10_event_order", f"WITH {CAND} SELECT seq, row_number() OVER (PARTITION BY program_id ORDER BY ts, seq)::INT AS position FROM cand")
def event_order(spark, d):
    return candidates(spark, d).select("seq", F.row_number().over(W.partitionBy("program_id").orderBy("ts", "seq")).alias("position"))


@query(
    "w15_snapshot_diff",
    f"""WITH {STEPS}, l AS (SELECT *, lag(rq) OVER (PARTITION BY h_bin, div_bin ORDER BY step) AS before FROM steps)
SELECT step, count(*) FILTER (before IS NULL) AS new_cells, count(*) FILTER (rq > before) AS improved FROM l GROUP BY step""",
)
def snapshot_diff(spark, d):
    s = cells_by_step(spark, d).withColumn("before", F.lag("rq").over(W.partitionBy("h_bin", "div_bin").orderBy("step")))
    return s.groupBy("step").agg(F.count_if(F.col("before").isNull()).alias("new_cells"), F.count_if(F.col("rq") > F.col("before")).alias("improved"))


@query(
    "w13_cell_trajectory",
    f"""WITH {STEPS} SELECT h_bin, div_bin, count(*) AS points, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS steps, round(sum(p_hat), 6) AS p_sum FROM steps GROUP BY h_bin, div_bin HAVING count(*) >= 2""",
)
def trajectory(spark, d):
    t = cells_by_step(spark, d).groupBy("h_bin", "div_bin").agg(F.array_sort(F.collect_list("step")).alias("a"), F.count(F.lit(1)).alias("points"), R(F.sum("p_hat")).alias("p_sum"))
    return t.where("points >= 2").select("h_bin", "div_bin", "points", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("steps"), "p_sum")


@query(
    "w14_first_last_delta",
    f"""WITH {STEPS}, m AS (SELECT step, avg(rq) AS mean_rq FROM steps GROUP BY step) SELECT round((arg_max(mean_rq, step) - arg_min(mean_rq, step)) * 100, 4) AS delta FROM m""",
)
def first_last(spark, d):
    m = cells_by_step(spark, d).groupBy("step").agg(F.avg("rq").alias("mean_rq"))
    return m.agg(R((F.max_by("mean_rq", "step") - F.min_by("mean_rq", "step")) * 100, 4).alias("delta"))


@query(
    "a30_run_series",
    f"""WITH {STEPS} SELECT step, count(*) AS champions, round(coalesce(count(*) FILTER (p_hat > 0.3 AND p_hat < 0.7) / nullif(count(*), 0), 0), 6) AS frontier_share, round(avg(rq), 6) AS mean_rq FROM steps GROUP BY step""",
)
def run_series(spark, d):
    near = F.count_if(scoring.is_frontier(F.col("p_hat"), 0.3, 0.7))
    n = F.count(F.lit(1))
    return cells_by_step(spark, d).groupBy("step").agg(n.alias("champions"), R(scoring.safe_ratio(near, n)).alias("frontier_share"), R(F.avg("rq")).alias("mean_rq"))


_TWO = f"""{STEPS}, a AS (SELECT * FROM steps WHERE step = (SELECT min(step) FROM steps)), b AS (SELECT * FROM steps WHERE step = (SELECT max(step) FROM steps))"""


def _two(spark, d):
    s = cells_by_step(spark, d)
    ends = F.broadcast(s.agg(F.min("step").alias("lo"), F.max("step").alias("hi")))
    s = s.join(ends)
    return s.where("step = lo").drop("lo", "hi"), s.where("step = hi").drop("lo", "hi")


@query("j1_shared_cells", f"WITH {_TWO} SELECT a.h_bin, a.div_bin, round(a.rq, 6) AS rq_a, round(b.rq, 6) AS rq_b, round(b.rq - a.rq, 6) AS delta FROM a JOIN b USING (h_bin, div_bin)")
def shared_cells(spark, d):
    a, b = _two(spark, d)
    j = a.select("h_bin", "div_bin", F.col("rq").alias("x")).join(b.select("h_bin", "div_bin", F.col("rq").alias("y")), ["h_bin", "div_bin"])
    return j.select("h_bin", "div_bin", R("x").alias("rq_a"), R("y").alias("rq_b"), R(F.col("y") - F.col("x")).alias("delta"))


@query("j2_cells_only_in_one", f"WITH {_TWO} SELECT 'a' AS side, h_bin, div_bin FROM a ANTI JOIN b USING (h_bin, div_bin) UNION ALL SELECT 'b', h_bin, div_bin FROM b ANTI JOIN a USING (h_bin, div_bin)")
def only_in_one(spark, d):
    a, b = _two(spark, d)
    k = ["h_bin", "div_bin"]
    return a.join(b, k, "left_anti").select(F.lit("a").alias("side"), *k).unionAll(b.join(a, k, "left_anti").select(F.lit("b"), *k))


@query(
    "d6_cell_set_counts",
    f"WITH {_TWO} SELECT count(*) FILTER (x AND y) AS both_n, count(*) FILTER (x AND y IS NULL) AS only_a, count(*) FILTER (x IS NULL AND y) AS only_b FROM (SELECT h_bin, div_bin, true AS x FROM a) FULL JOIN (SELECT h_bin, div_bin, true AS y FROM b) USING (h_bin, div_bin)",
)
def cell_sets(spark, d):
    a, b = _two(spark, d)
    k = ["h_bin", "div_bin"]
    j = a.select(*k, F.lit(True).alias("x")).join(b.select(*k, F.lit(True).alias("y")), k, "full")
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    return j.agg(F.count_if(x & y).alias("both_n"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"))


@query(
    "j3_steps_and_events",
    f"""WITH {STEPS}, e AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS step, count(*) AS events FROM cand GROUP BY 1), s AS (SELECT step, count(*) AS cells FROM steps GROUP BY step)
SELECT step, events, cells, cells IS NULL AS in_flight FROM e FULL JOIN s USING (step)""",
)
def steps_and_events(spark, d):
    """All steps of either side; a step with events and no cells yet is in flight."""
    e = candidates(spark, d).groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("step")).agg(F.count(F.lit(1)).alias("events"))
    s = cells_by_step(spark, d).groupBy("step").agg(F.count(F.lit(1)).alias("cells"))
    return e.join(s, "step", "full").select("step", "events", "cells", F.col("cells").isNull().alias("in_flight"))


_SWEEP = f"""{SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY seq) AS sweep FROM scored),
o AS (SELECT *, row_number() OVER (ORDER BY sweep, h_bin DESC, program_id) AS place FROM k WHERE sweep <= 3)"""


@query("w17_interleaved_sweep", f"WITH {_SWEEP} SELECT seq, program_id, CAST(sweep AS INT) AS sweep, CAST(place AS INT) AS place FROM o WHERE place <= 256")
def sweep(spark, d):
    """Training budget: rounds over programs, at most three of each, harder cells first within a round; 256 in all."""
    k = scored(spark, d).withColumn("sweep", F.row_number().over(W.partitionBy("program_id").orderBy("seq"))).where("sweep <= 3")
    picked = k.orderBy("sweep", F.desc("h_bin"), "program_id").limit(256)
    return picked.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("sweep", F.desc("h_bin"), "program_id"))).select("seq", "program_id", "sweep", "place")


@query(
    "t10_budget",
    f"WITH {_SWEEP} SELECT program_id, count(*) AS n FROM o WHERE place <= 256 GROUP BY program_id",
)
def budget(spark, d):
    return sweep(spark, d).groupBy("program_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j9_unused_seeds",
    f"WITH {CAND}, used AS (SELECT DISTINCT program_id, seq FROM cand WHERE op = 'click') SELECT c.program_id, count(*) AS unused FROM cand c ANTI JOIN used USING (program_id, seq) GROUP BY c.program_id",
)
def unused(spark, d):
    c = candidates(spark, d)
    used = c.where("op = 'click'").select("program_id", "seq").distinct()
    return c.join(used, ["program_id", "seq"], "left_anti").groupBy("program_id").agg(F.count(F.lit(1)).alias("unused"))


@query(
    "j9_smallest_missing",
    f"""WITH {CAND}, s AS (SELECT DISTINCT program_id, CAST(round(p_hat * 100) AS BIGINT) AS seed FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY seed) - 1 AS k FROM s)
SELECT program_id, count(*) FILTER (seed = k) AS next_seed FROM r GROUP BY program_id""",
)
def smallest_missing(spark, d):
    """The smallest seed from 0 that a program has not used: seeds equal to their rank come before the first gap."""
    s = candidates(spark, d).select("program_id", F.round(F.col("p_hat") * 100).cast("long").alias("seed")).distinct()
    r = s.withColumn("k", F.row_number().over(W.partitionBy("program_id").orderBy("seed")) - 1)
    return r.groupBy("program_id").agg(F.count_if(F.col("seed") == F.col("k")).alias("next_seed"))


@query(
    "d10_signature_owner",
    f"WITH {CAND} SELECT CAST(round(u) AS BIGINT) AS signature, arg_min(program_id, seq) AS owner, count(*) AS n FROM cand GROUP BY 1",
)
def signature_owner(spark, d):
    return candidates(spark, d).groupBy(F.round("u").cast("long").alias("signature")).agg(F.min_by("program_id", "seq").alias("owner"), F.count(F.lit(1)).alias("n"))


@query(
    "d11_latest_placement",
    f"WITH {CHAMPIONS}, p AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY seq DESC) AS k FROM champ) SELECT program_id, h_bin, div_bin, seq, round(rq, 6) AS rq FROM p WHERE k = 1",
)
def latest_placement(spark, d):
    return A.purge_other_cells(A.champion_aggregate(scored(spark, d))).withColumn("rq", R("rq"))


@query(
    "p17_material_pool",
    f"WITH {CHAMPIONS} SELECT 'champion' AS pool, program_id, seq FROM champ UNION ALL SELECT 'reservoir', r.program_id, r.seq FROM ranked r ANTI JOIN champ USING (program_id) WHERE rn BETWEEN 2 AND 4",
)
def material(spark, d):
    s = scored(spark, d)
    rest = A.top_per_cell(s, 4).where("rn > 1").select("program_id", "seq")
    return A.material_pool(A.champion_aggregate(s).select("program_id", "seq"), rest).select("pool", "program_id", "seq")


@query("p16_cadence", f"WITH {STEPS} SELECT DISTINCT step FROM steps WHERE (step + 1) % 3 = 0")
def cadence(spark, d):
    return cells_by_step(spark, d).select("step").distinct().where(scoring.cadence(F.col("step"), 3))


@query("m14_warmup", f"WITH {STEPS} SELECT DISTINCT step, round(least(1, step / 10.0::DOUBLE), 6) AS factor FROM steps")
def warmup(spark, d):
    return cells_by_step(spark, d).select("step").distinct().withColumn("factor", R(scoring.warmup(F.col("step"), 10)))


@query(
    "s18_grid_csv",
    f"WITH {CHAMPIONS} SELECT div_bin, " + ", ".join(f"round(max(rq) FILTER (h_bin = {h}), 4) AS h{h}" for h in range(10)) + " FROM champ GROUP BY div_bin",
)
def grid_csv(spark, d):
    from ..sources.files import grid_csv as pivot

    return pivot(A.champion_aggregate(scored(spark, d)), H_BINS)


@query("a15_reeval_deltas", f"WITH {_TWO}, x AS (SELECT b.rq - a.rq AS e FROM a JOIN b USING (h_bin, div_bin)) SELECT round(coalesce(avg(e), 0), 6) AS mean, round(coalesce(min(e), 0), 6) AS low, round(coalesce(max(e), 0), 6) AS high FROM x")
def reeval_deltas(spark, d):
    z = lambda c: R(F.coalesce(c, F.lit(0.0)))
    a, b = _two(spark, d)
    x = a.select("h_bin", "div_bin", F.col("rq").alias("x")).join(b.select("h_bin", "div_bin", F.col("rq").alias("y")), ["h_bin", "div_bin"]).select((F.col("y") - F.col("x")).alias("e"))
    return x.agg(z(F.avg("e")).alias("mean"), z(F.min("e")).alias("low"), z(F.max("e")).alias("high"))


@query("w16_reeval_targets", f"WITH {CHAMPIONS}, r AS (SELECT *, row_number() OVER (ORDER BY seq, h_bin, div_bin) AS k, count(*) OVER () AS n FROM champ) SELECT h_bin, div_bin, seq FROM r WHERE k <= floor(n * 0.5::DOUBLE)")
def reeval_targets(spark, d):
    """The oldest half of the champions."""
    w = W.partitionBy(F.lit(0))
    c = A.champion_aggregate(scored(spark, d)).withColumns({"k": F.row_number().over(w.orderBy("seq", "h_bin", "div_bin")), "n": F.count(F.lit(1)).over(w)})
    return c.where(F.col("k") <= F.floor(F.col("n") * 0.5)).select("h_bin", "div_bin", "seq")


@query("r4_archive_replay")
def archive_replay(spark, d):
    """Exact insertion with gates, one archive per operator type."""
    c = scored(spark, d).select(
        F.col("op").alias("archive_id"), "seq", F.col("program_id").cast("string").alias("program_id"), "rq", "h_bin", "div_bin",
        (F.col("seq") % 17 != 0).alias("valid"), F.round("u", 1).cast("string").alias("behaviour"), F.lit(None).cast("string").alias("template"),
    )
    return A.replay(c)
