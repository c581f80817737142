"""Queries over archives as they live: picks that remember, re-evaluations, the board of steps, axes, balanced ranks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import bandit, live_archive, partition, projection
from ..streaming.live import step_board
from .registry import query
from .views import CAND, DIV_BINS, H_BINS, H_RANGE, STEPS, candidates, cells_by_step, table

PICKS, EPSILON = 5, 0.3
#: Rows that a task sorts at once where a query deals a whole table by a key.
TASK_ROWS = 1_000_000


def _material(spark, d):
    c = cells_by_step(spark, d)
    return c.select(F.col("step").cast("string").alias("archive_id"), "h_bin", "div_bin", F.col("program_id").cast("string").alias("program_id"), "rq", F.lit("champion").alias("pool"))


def _draw(tag: str, which: str) -> str:
    return f"(('0x' || substr(md5('day|' || step || '|' || {tag} || '|{which}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick(source: str, tag: str, out: str, without: str | None = None) -> str:
    """One pick more: entries are numbered 1 to n by cell, ``ord`` is their place by score."""
    rest = f"list_filter(range(1, n + 1), lambda i: p[i] <> p[{without}])" if without else "range(1, n + 1)"
    rank = "CASE WHEN len(rest) = 1 THEN 1::DOUBLE ELSE len(list_filter(rest, lambda j: ord[j] < ord[i])) / (len(rest) - 1)::DOUBLE END"
    bonus = "CASE WHEN visits[i] > 0 THEN sqrt(ln(total + 1) / visits[i]) ELSE 'Infinity'::DOUBLE END"
    return f"""(SELECT * EXCLUDE (rest, s, visits, total), list_transform(range(1, n + 1), lambda i: visits[i] + CASE WHEN i = {out} THEN 1 ELSE 0 END) AS visits, total + 1 AS total FROM
  (SELECT *, rest[CASE WHEN {_draw(tag, 'u')} < {EPSILON}::DOUBLE THEN (floor({_draw(tag, 'v')} * len(rest)) + 1)::BIGINT ELSE list_position(s, list_max(s)) END] AS {out},
     CASE WHEN {_draw(tag, 'u')} < {EPSILON}::DOUBLE THEN 'uniform' ELSE 'ucb' END AS {out}_how FROM
   (SELECT *, list_transform(rest, lambda i: {rank} + {bonus}) AS s FROM (SELECT *, {rest} AS rest FROM {source}))))"""


def _picks_sql(pairs: bool) -> str:
    first = _pick("(SELECT step, p, ord, n, visits, total, k + 1 AS k FROM t WHERE k + 1 < %d%s)" % (PICKS, " AND len(list_distinct(p)) > 1" if pairs else ""), "k || 'a'" if pairs else "k", "a")
    more = _pick(first, "k || 'b'", "b", "a") if pairs else first
    second = "p[b] AS second_id, b_how AS second_how" if pairs else "NULL::VARCHAR AS second_id, NULL::VARCHAR AS second_how"
    return f"""WITH RECURSIVE {STEPS},
o AS (SELECT step, program_id::VARCHAR AS program_id, row_number() OVER (PARTITION BY step ORDER BY h_bin, div_bin) AS i, row_number() OVER (PARTITION BY step ORDER BY rq, h_bin, div_bin) AS ord FROM steps),
e AS (SELECT step, list(program_id ORDER BY i) AS p, list(ord ORDER BY i) AS ord, count(*) AS n FROM o GROUP BY step),
t AS (SELECT step, -1 AS k, p, ord, n, list_transform(range(1, n + 1), lambda i: 0) AS visits, 0::BIGINT AS total, NULL::VARCHAR AS first_id, NULL::VARCHAR AS first_how, NULL::VARCHAR AS second_id, NULL::VARCHAR AS second_how FROM e
  UNION ALL SELECT step, k, p, ord, n, visits, total, p[a], a_how, {second} FROM {more})
SELECT step::VARCHAR AS archive_id, k::INT AS pick, first_id, first_how, second_id, second_how FROM t WHERE k >= 0"""


@query("t7_ucb_parents", _picks_sql(False))
def ucb_parents(spark, d):
    """A few parents of each day's champions, one after another."""
    return bandit.pick_parents(_material(spark, d), PICKS, "day", EPSILON)


@query("t8_ucb_pairs", _picks_sql(True))
def ucb_pairs(spark, d):
    return bandit.pick_parents(_material(spark, d), PICKS, "day", EPSILON, pairs=True)


def live_steps(spark, d):
    """Each day's events as steps of its archive: errors re-evaluate a program, the others insert one."""
    c = candidates(spark, d)
    day = F.to_date("ts").cast("string")
    return c.select(
        day.alias("archive_id"),
        (F.row_number().over(W.partitionBy(day).orderBy("seq")) - 1).cast("long").alias("seq"),
        F.when(F.col("op") == "error", "reeval").otherwise("insert").alias("kind"),
        F.col("program_id").cast("string").alias("program_id"),
        "p_hat",
        "u",
        scoring.value_bin(F.col("u"), *H_RANGE, H_BINS).alias("h_bin"),
        "div_bin",
        F.col("seq").alias("generation"),
        (F.col("u") > 1).alias("valid"),
        F.round("u", 1).cast("string").alias("behaviour"),
        F.lit(None).cast("string").alias("template"),
    )


@query("r6_live_replay")
def live_replay(spark, d):
    """Insertions and re-evaluations of each day's archive, step by step."""
    return live_archive.live_replay(live_steps(spark, d))


@query("r6_live_promotion")
def live_promotion(spark, d):
    """The same, the best of a reservoir moving up where a seat empties."""
    return live_archive.live_replay(live_steps(spark, d), reservoir=2, promote=True)


def records(spark, d):
    """Events by day, and snapshots of the days on which nothing failed last."""
    c = candidates(spark, d).withColumn("step", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long"))
    failed = F.col("op") == "error"
    events = c.select(
        F.lit("event").alias("record"), "step", F.when(failed, "candidate_failed").otherwise("candidate_scored").alias("event"), F.when(F.col("op") == "purchase", "inserted").alias("status"),
        F.lit(None).cast("int").alias("h_bin"), F.lit(None).cast("int").alias("div_bin"), F.col("program_id").cast("string").alias("program_id"), F.lit(None).cast("double").alias("rq"),
    )
    ended = c.groupBy("step").agg(F.max_by("op", "seq").alias("op")).where("op <> 'error'").select("step")
    cells = cells_by_step(spark, d).withColumn("step", F.col("step").cast("long")).join(ended, "step")
    return events.unionByName(cells.select(
        F.lit("snapshot").alias("record"), "step", F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("status"), "h_bin", "div_bin", F.col("program_id").cast("string").alias("program_id"), "rq"
    ))


@query(
    "r2_step_board",
    f"""WITH {STEPS}, c AS (SELECT seq, op, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step FROM cand),
e AS (SELECT step, count(*) AS events, count(*) FILTER (op = 'purchase') AS inserted, count(*) FILTER (op = 'error') AS failed, arg_max(op, seq) AS last FROM c GROUP BY step),
s AS (SELECT step, count(*) AS cells, round(sum(rq::DECIMAL(28, 12)), 6)::DOUBLE AS total_rq, first(program_id::VARCHAR ORDER BY rq DESC, h_bin, div_bin) AS best_program FROM steps GROUP BY step)
SELECT e.step::BIGINT AS step, events, inserted, failed, CASE WHEN last <> 'error' THEN coalesce(cells, 0) ELSE 0 END AS cells, CASE WHEN last <> 'error' THEN total_rq END AS total_rq,
  CASE WHEN last <> 'error' THEN best_program END AS best_program, last = 'error' OR cells IS NULL AS in_flight FROM e LEFT JOIN s USING (step)""",
)
def board_of_steps(spark, d):
    """Steps with their events and snapshots; those still in flight have no cells."""
    return step_board(records(spark, d))


_SQUARINGS = 16


@query(
    "m3_axis_bins",
    f"""WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
l AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM x), mean AS (SELECT i, avg(v) AS m FROM l GROUP BY i), c AS (SELECT vec_id, i, v - m AS v FROM l JOIN mean USING (i)),
cov AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS s FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i), rows AS (SELECT i, list(s ORDER BY j) AS r FROM cov GROUP BY i),
t AS (SELECT 0 AS k, list(r ORDER BY i) AS m FROM rows
  UNION ALL SELECT k + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / s / s)) FROM
    (SELECT k, m, list_max(list_transform(m, lambda r: list_max(list_transform(r, lambda y: abs(y))))) AS s FROM t WHERE k < {_SQUARINGS})),
v AS (SELECT list_transform(m, lambda r: list_sum(r)) AS v FROM t WHERE k = {_SQUARINGS}), w AS (SELECT list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS w FROM v),
d AS (SELECT list_transform(w, lambda y: y * sign(w[list_position(list_transform(w, lambda z: abs(z)), list_max(list_transform(w, lambda z: abs(z))))])) AS w FROM w),
y AS (SELECT vec_id, sum(v * w[i]) AS y FROM c, d GROUP BY vec_id), b AS (SELECT min(y) - (max(y) - min(y)) * 0.1::DOUBLE AS lo, max(y) + (max(y) - min(y)) * 0.1::DOUBLE AS hi FROM y)
SELECT vec_id, least(floor((y - lo) / ((hi - lo) / 6)), 5)::INT AS bin, round(y, 6) AS projection FROM y, b""",
)
def axis_bins(spark, d):
    """Bins along the axis of largest variance."""
    e = table(spark, d, "embeddings")
    axis = projection.fit_axis(e, "embedding")
    return e.select("vec_id", axis.bin(F.col("embedding"), DIV_BINS, F.col("vec_id")).alias("bin"), F.round(axis.projection(F.col("embedding")), 6).alias("projection"))


@query("d15_rank_balance")
def rank_balance(spark, d):
    """Each supplier's line items, filled up to whole rows of four by its own shortest ones again, dealt to four ranks."""
    own = W.partitionBy("l_suppkey")
    lines = table(spark, d, "lineitem")
    # Counted from the files' footers; a task's rows stay as many when the table grows.
    t = lines.repartition(max(lines.count() // TASK_ROWS, 8), "l_suppkey").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_quantity").cast("long").alias("seqlen"))
    t = t.withColumns({"k": F.row_number().over(own.orderBy("seqlen", "item_id")), "n": F.count(F.lit(1)).over(own)})
    twice = F.when(F.col("k") <= F.pmod(-F.col("n"), F.lit(4)), F.array(F.col("item_id"), -F.col("item_id"))).otherwise(F.array("item_id"))
    whole = t.where("n >= 4").select(F.col("l_suppkey").alias("batch_id"), F.explode(twice).alias("item_id"), "seqlen")
    return partition.balance_ranks(whole, 4)
