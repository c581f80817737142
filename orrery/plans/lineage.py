"""Queries over parents and children, picks of parents, batches in order, and roll-ups of candidates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import md5_unit
from ..operators.spans import span_max_entropy
from .registry import query
from .views import CAND, ROLLOUTS, SCORED, STEPS, candidates, cells_by_step, rollouts, scored, table

_OP = "CASE seq % 3 WHEN 0 THEN 'crossover' WHEN 1 THEN 'in_depth' ELSE 'in_breadth' END"


def _programs(spark, d):
    """Candidates with the text that names their parents: one id in hex digits, or two with an x between."""
    op = F.when(F.col("seq") % 3 == 0, "crossover").when(F.col("seq") % 3 == 1, "in_depth").otherwise("in_breadth")
    a, b = (F.lower(F.hex(F.floor(F.col("seq") / k))) for k in (2, 3))
    return candidates(spark, d).select(
        "seq", op.alias("op"), F.when(op == "crossover", F.concat_ws("x", a, b)).otherwise(a).alias("parent_id"),
        F.concat(F.lit("t"), (F.col("seq") % 5).cast("string")).alias("kind"), F.concat(F.lit("g"), F.col("div_bin").cast("string")).alias("grp"), F.col("div_bin").alias("generation"),
    )


def with_parents(children, programs, sides=("a", "b")):
    """Each child with the row of its parents; a parent that is not there is null.

    Children without a parent on a side are dealt by their own number, not all to the task of the null key.
    """
    ids = F.split("parent_id", "x")
    number = lambda c: F.conv(c, 16, 10).cast("long")
    left = children.withColumns({"a_id": number(F.get(ids, F.lit(0))), "b_id": number(F.get(ids, F.lit(1)))})
    for side in sides:
        side_rows = programs.select(F.col("seq").alias(f"{side}_id"), F.hash(F.col("seq").cast("long")).alias("deal"), *[F.col(c).alias(f"{side}_{c}") for c in ("kind", "grp", "generation")])
        left = left.withColumn("deal", F.hash(F.coalesce(F.col(f"{side}_id"), F.col("seq").cast("long"))))
        left = left.join(side_rows, [f"{side}_id", "deal"], "left").drop("deal")
    return left


@query(
    "j4_child_parents",
    f"""WITH {CAND}, p AS (SELECT seq, {_OP} AS op, div_bin FROM cand)
SELECT c.seq, a.seq AS a_id, b.seq AS b_id, CAST(greatest(coalesce(a.div_bin, 0), coalesce(b.div_bin, 0)) + 1 AS INT) AS generation
FROM p c LEFT JOIN p a ON a.seq = c.seq // 2 LEFT JOIN p b ON c.op = 'crossover' AND b.seq = c.seq // 3""",
)
def child_parents(spark, d):
    p = _programs(spark, d)
    j = with_parents(p, p)
    known = lambda s: F.when(F.col(f"{s}_kind").isNotNull(), F.col(f"{s}_id")).alias(f"{s}_id")
    age = F.greatest(F.coalesce("a_generation", F.lit(0)), F.coalesce("b_generation", F.lit(0))) + 1
    return j.select("seq", known("a"), known("b"), age.cast("int").alias("generation"))


@query(
    "p9_operator_consistency",
    f"""WITH {CAND}, p AS (SELECT seq, {_OP} AS op, seq % 5 AS kind, div_bin AS grp FROM cand)
SELECT c.seq, CASE WHEN c.op = 'in_depth' AND a.kind <> c.kind THEN 'kind changed' WHEN c.op = 'in_breadth' AND a.grp = c.grp THEN 'group kept' END AS reason
FROM p c LEFT JOIN p a ON a.seq = c.seq // 2""",
)
def operator_consistency(spark, d):
    """A deeper child keeps its parent's kind, a broader one leaves its group; without a parent nothing is asked."""
    p = _programs(spark, d)
    j = with_parents(p, p, ["a"])
    reason = F.when((F.col("op") == "in_depth") & (F.col("a_kind") != F.col("kind")), "kind changed").when(
        (F.col("op") == "in_breadth") & (F.col("a_grp") == F.col("grp")), "group kept"
    )
    return j.select("seq", reason.alias("reason"))


_UNIT = lambda key: f"('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_PICK = """{name} AS (SELECT step, arg_min(program_id, CASE WHEN {u} < 0.2::DOUBLE THEN abs(k - 1 - floor({v} * n)) ELSE best END) AS program_id FROM {source} GROUP BY step)"""
_ENTRIES = "SELECT step, program_id, rq, row_number() OVER (PARTITION BY step ORDER BY h_bin, div_bin) AS k, count(*) OVER (PARTITION BY step) AS n, row_number() OVER (PARTITION BY step ORDER BY rq DESC, h_bin, div_bin) AS best"


def pick(entries, seed: str, epsilon: float = 0.2):
    """One program of each step's entries: uniform in a share ``epsilon`` of the steps, else the first of the best score.

    The draws are hashes of seed and step, so that reruns agree.  A step has an entry per cell at most.
    """
    step = F.col("step").cast("string")
    u, v = (md5_unit(F.concat(F.lit(f"{seed}{tag}|"), step)) for tag in "uv")
    own = W.partitionBy("step")
    e = entries.withColumns({
        "k": F.row_number().over(own.orderBy("h_bin", "div_bin")),
        "n": F.count(F.lit(1)).over(own),
        "best": F.row_number().over(own.orderBy(F.desc("rq"), "h_bin", "div_bin")),
    })
    chosen = F.when(u < epsilon, F.col("k") - 1 == F.floor(v * F.col("n"))).otherwise(F.col("best") == 1)
    return e.where(chosen).select("step", "program_id", F.when(u < epsilon, "uniform").otherwise("best").alias("how"))


def _pick_sql(source, seed):
    u, v = _UNIT(f"'{seed}u|' || step"), _UNIT(f"'{seed}v|' || step")
    return f"""SELECT step, program_id, CASE WHEN {u} < 0.2::DOUBLE THEN 'uniform' ELSE 'best' END AS how FROM ({_ENTRIES} FROM {source})
WHERE CASE WHEN {u} < 0.2::DOUBLE THEN k - 1 = floor({v} * n) ELSE best = 1 END"""


@query("t7_parent_pick", f"WITH {STEPS} {_pick_sql('steps', 'a')}")
def parent_pick(spark, d):
    """A parent of each day's champions."""
    return pick(cells_by_step(spark, d), "a")


@query(
    "t8_two_parents",
    f"""WITH {STEPS}, p1 AS ({_pick_sql('steps', 'a')}), rest AS (SELECT s.* FROM steps s JOIN p1 USING (step) WHERE s.program_id <> p1.program_id), p2 AS ({_pick_sql('rest', 'b')})
SELECT p1.step, p1.program_id AS first_id, p2.program_id AS second_id FROM p1 JOIN p2 USING (step)""",
)
def two_parents(spark, d):
    """Two different parents a day; days with one program have none."""
    entries = cells_by_step(spark, d)
    first = pick(entries, "a").select("step", F.col("program_id").alias("first_id"))
    rest = entries.join(first, "step").where("program_id <> first_id").drop("first_id")
    second = pick(rest, "b").select("step", F.col("program_id").alias("second_id"))
    return first.join(second, "step")


_TEXT = "intro\nStep 1: a b c\nStep 2: d e\nFinal: f"
_PIECES = ["intro", "Step", " 1", ":", " a", " b", " c", "Step", " 2", ":", " d", " e", "Final", ":", " f"]


def _mean_sql(a, b):
    return "(" + " + ".join(f"(n * {i + 1} % 7)" for i in range(a, b)) + f") / {b - a}.0::DOUBLE"


@query("a7_span_max_entropy", f"WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, turn, round(greatest({_mean_sql(1, 7)}, {_mean_sql(7, 12)}, {_mean_sql(12, 15)}), 6) AS h_span_max FROM t")
def span_max(spark, d):
    pieces = F.array(*[F.lit(p) for p in _PIECES])
    h = F.transform(pieces, lambda p, i: (F.length("text") * (i + 1) % 7).cast("double"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(span_max_entropy(F.lit(_TEXT), pieces, h), 6).alias("h_span_max"))


@query("a10_uncertainty", f"WITH {CAND} SELECT seq, coalesce(CASE WHEN seq % 2 = 0 THEN u * 2 END, u) AS h FROM cand")
def uncertainty(spark, d):
    """The span maximum, and the mean where a response has none."""
    span = F.when(F.col("seq") % 2 == 0, F.col("u") * 2)
    return candidates(spark, d).select("seq", scoring.uncertainty("h_span_max", F.col("u"), span).alias("h"))


@query(
    "a29_best_metric",
    f"""WITH {CAND}, s AS (SELECT op, unnest([{{'m': 'h', 'v': p_hat * (1 - p_hat) * u}}, {{'m': 'h_span_max', 'v': CASE WHEN seq % 3 = 0 THEN p_hat * (1 - p_hat) * (u + 10) END}}]) AS x FROM cand),
g AS (SELECT op, x.m AS metric, avg(x.v) AS a, max(x.v) AS b, count(*) FILTER (x.v > 0) AS positive FROM s WHERE x.v IS NOT NULL GROUP BY ALL)
SELECT op, arg_max(metric, (b, a)) AS best, round(max(b), 6) AS max_rq, CAST(sum(positive) AS BIGINT) AS positive FROM g GROUP BY op""",
)
def best_metric(spark, d):
    """Of the metrics that a candidate has, the one of the largest score, then of the largest mean."""
    p = F.col("p_hat")
    scores = F.create_map(F.lit("h"), F.col("u"), F.lit("h_span_max"), F.when(F.col("seq") % 3 == 0, F.col("u") + 10))
    c = candidates(spark, d).select("op", p.alias("p"), F.explode(scores).alias("metric", "score")).where("score is not null")
    v = F.col("p") * (1 - F.col("p")) * F.col("score")
    g = c.groupBy("op", "metric").agg(F.avg(v).alias("a"), F.max(v).alias("b"), F.count_if(v > 0).alias("positive"))
    return g.groupBy("op").agg(F.max_by("metric", F.struct("b", "a")).alias("best"), F.round(F.max("b"), 6).alias("max_rq"), F.sum("positive").alias("positive"))


@query("a38_cumulative", f"WITH {STEPS} SELECT DISTINCT step, step * 64::DOUBLE AS prompts, step * 512::DOUBLE AS trajectories FROM steps")
def cumulative(spark, d):
    prompts = F.col("step").cast("double") * 64
    return cells_by_step(spark, d).select("step").distinct().select("step", prompts.alias("prompts"), (prompts * 8).alias("trajectories"))


@query(
    "m7_adaptive_kl",
    f"""WITH {STEPS}, k AS (SELECT step, avg(p_hat) AS kl FROM steps GROUP BY step)
SELECT step, round(0.2 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 0.5 - 1)) * 64 / 1000.0::DOUBLE)) OVER (ORDER BY step)), 6) AS coef FROM k""",
)
def adaptive_kl(spark, d):
    """The coefficient after each step: a running product, one row a step."""
    k = cells_by_step(spark, d).groupBy("step").agg(F.avg("p_hat").alias("kl"))
    error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("kl") / 0.5 - 1))
    growth = F.ln(1 + error * 64 / F.lit(1000.0))
    return k.select("step", F.round(0.2 * F.exp(F.sum(growth).over(W.orderBy("step"))), 6).alias("coef"))


@query("d5_pad_to_divisor", "WITH r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) SELECT n_nationkey, CAST(i + n * c AS BIGINT) AS at, i + n * c >= n AS padding FROM r, range(2) t(c) WHERE i + n * c < ceil(n / 8.0) * 8")
def pad_to_divisor(spark, d):
    """A batch of a multiple of eight rows: rows from its head follow its end; what is padding can be dropped again."""
    n = table(spark, d, "nation").count()
    turns = -(-(-(-n // 8) * 8) // max(n, 1))
    r = table(spark, d, "nation").select("n_nationkey", (F.row_number().over(W.orderBy("n_nationkey")) - 1).alias("i"))
    at = (F.col("i") + n * F.col("c")).cast("long")
    return r.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).where(at < -(-n // 8) * 8).select("n_nationkey", at.alias("at"), (at >= n).alias("padding"))


@query(
    "d18_mini_batches",
    "WITH o AS (SELECT e AS epoch, n_nationkey, row_number() OVER (PARTITION BY e ORDER BY md5(e || '|' || n_nationkey)) - 1 AS i FROM nation, range(3) t(e)) SELECT CAST(epoch AS INT) AS epoch, CAST(i // 5 AS INT) AS batch, CAST(i % 5 AS INT) AS at, n_nationkey FROM o",
)
def mini_batches(spark, d):
    """Three epochs of batches of five, each in an order of its own."""
    r = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch"))
    key = F.md5(F.concat(F.col("epoch").cast("string"), F.lit("|"), F.col("n_nationkey").cast("string")))
    i = F.row_number().over(W.partitionBy("epoch").orderBy(key)) - 1
    return r.withColumn("i", i).select("epoch", F.floor(F.col("i") / 5).cast("int").alias("batch"), (F.col("i") % 5).cast("int").alias("at"), "n_nationkey")


@query("t11_shuffled_head", "SELECT item_id FROM benchmark ORDER BY md5('42|' || text), item_id LIMIT 20")
def shuffled_head(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(F.concat(F.lit("42|"), "text")).alias("o")).orderBy("o", "item_id").limit(20).select("item_id")


@query("t6_shuffle_cap", "SELECT item_id FROM benchmark ORDER BY md5('7|' || item_id) LIMIT 1000")
def shuffle_cap(spark, d):
    """At most a thousand items in shuffled order."""
    return table(spark, d, "benchmark").select("item_id").orderBy(F.md5(F.concat(F.lit("7|"), F.col("item_id").cast("string")))).limit(1000)


@query("p4_row_slice", "SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i >= 5 AND i < 11")
def row_slice(spark, d):
    r = table(spark, d, "nation").select("n_nationkey", (F.row_number().over(W.orderBy("n_nationkey")) - 1).alias("i"))
    return r.where("i >= 5 and i < 11").select("n_nationkey")


@query("p2_pop_columns", "SELECT n_nationkey, n_name FROM nation")
def pop_columns(spark, d):
    """What is left of a batch after columns were taken out of it."""
    batch = table(spark, d, "nation")
    popped = [c for c in batch.columns if c not in ("n_nationkey", "n_name")]
    return batch.drop(*popped)


@query("p13_without_headers", f"WITH {CAND} SELECT seq FROM cand WHERE op <> 'click'")
def without_headers(spark, d):
    return candidates(spark, d).where(~F.col("op").isin("click")).select("seq")


@query("p14_key_default", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.no.such'), 'none') AS missing FROM events")
def key_default(spark, d):
    """Dotted paths into settings, with a default where a part of the path is missing."""
    at = lambda path, default: F.coalesce(F.get_json_object("props", f"$.{path}"), F.lit(default))
    return table(spark, d, "events").select("event_id", at("k", "-1").cast("long").alias("k"), at("no.such", "none").alias("missing"))


@query("p19_optional_columns", f"WITH {ROLLOUTS} SELECT uid, idx, score FROM rollouts")
def optional_columns(spark, d):
    """The columns that a loss reads; the optional ones only where the batch has them."""
    r = rollouts(spark, d)
    return r.select("uid", "idx", "score", *[c for c in ("ref_log_probs", "images") if c in r.columns])


@query("m15_shifted_mask", f"WITH {ROLLOUTS}, a AS (SELECT uid, list(mask ORDER BY idx) AS m FROM rollouts GROUP BY uid) SELECT uid, array_to_string(m[greatest(len(m) - 2, 1):len(m) - 1], ',') AS shifted FROM a WHERE len(m) > 2")
def shifted_mask(spark, d):
    """The mask of the last two tokens' values: the window that ends one position earlier."""
    a = F.array_sort(F.collect_list(F.struct("idx", "mask")))
    m = rollouts(spark, d).groupBy("uid").agg(F.transform(a, lambda x: x["mask"]).alias("m")).where(F.size("m") > 2)
    return m.select("uid", F.array_join(F.slice("m", F.size("m") - 2, F.lit(2)), ",").alias("shifted"))


@query("a6_token_entropy", f"WITH {ROLLOUTS} SELECT uid, round(min(h), 6) AS token_min, round(max(h), 6) AS token_max, round(stddev_pop(h), 6) AS token_std, count(*) AS tokens FROM rollouts WHERE mask = 1 GROUP BY uid")
def token_entropy(spark, d):
    """Over all tokens of a group; groups without tokens are left out."""
    r = rollouts(spark, d).where("mask = 1").groupBy("uid")
    return r.agg(F.round(F.min("h"), 6).alias("token_min"), F.round(F.max("h"), 6).alias("token_max"), F.round(F.stddev_pop("h"), 6).alias("token_std"), F.count(F.lit(1)).alias("tokens"))


@query(
    "a26_cell_history",
    f"""WITH {SCORED}, o AS (SELECT h_bin, div_bin, op, count(*) AS c FROM scored GROUP BY ALL),
ops AS (SELECT h_bin, div_bin, string_agg(op || ':' || c, ',' ORDER BY op) AS ops, CAST(sum(c) AS BIGINT) AS n FROM o GROUP BY ALL),
l AS (SELECT h_bin, div_bin, seq, row_number() OVER (PARTITION BY h_bin, div_bin ORDER BY seq DESC) AS k FROM scored)
SELECT h_bin, div_bin, ops, n, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS last_six FROM ops JOIN l USING (h_bin, div_bin) WHERE k <= 6 GROUP BY ALL""",
)
def cell_history(spark, d):
    """Operators of each cell with their counts, and its last six events."""
    s = scored(spark, d)
    per = s.groupBy("h_bin", "div_bin", "op").agg(F.count(F.lit(1)).alias("c"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("op", "c"))), lambda x: F.concat(x["op"], F.lit(":"), x["c"].cast("string")))
    ops = per.groupBy("h_bin", "div_bin").agg(F.array_join(said, ",").alias("ops"), F.sum("c").alias("n"))
    last = s.withColumn("k", F.row_number().over(W.partitionBy("h_bin", "div_bin").orderBy(F.desc("seq")))).where("k <= 6")
    last = last.groupBy("h_bin", "div_bin").agg(F.array_join(F.array_sort(F.collect_list("seq")).cast("array<string>"), ",").alias("last_six"))
    return ops.join(last, ["h_bin", "div_bin"])


@query(
    "a27_cell_programs",
    f"""WITH {SCORED}, p AS (SELECT h_bin, div_bin, program_id, count(*) AS c, min(seq) AS s FROM scored GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY h_bin, div_bin ORDER BY c DESC, program_id) AS k, count(*) OVER (PARTITION BY h_bin, div_bin) AS programs, min(s) OVER (PARTITION BY h_bin, div_bin) AS first_seq FROM p)
SELECT h_bin, div_bin, programs, first_seq, string_agg(program_id::VARCHAR, ',' ORDER BY k) AS top_three FROM r WHERE k <= 3 GROUP BY ALL""",
)
def cell_programs(spark, d):
    """Programs of each cell, how many, and the three with most rows."""
    p = scored(spark, d).groupBy("h_bin", "div_bin", "program_id").agg(F.count(F.lit(1)).alias("c"), F.min("seq").alias("s"))
    cell = ["h_bin", "div_bin"]
    all_ = p.groupBy(*cell).agg(F.count(F.lit(1)).alias("programs"), F.min("s").alias("first_seq"))
    top = p.withColumn("k", F.row_number().over(W.partitionBy(*cell).orderBy(F.desc("c"), "program_id"))).where("k <= 3")
    names = F.transform(F.array_sort(F.collect_list(F.struct("k", "program_id"))), lambda x: x["program_id"].cast("string"))
    return all_.join(top.groupBy(*cell).agg(F.array_join(names, ",").alias("top_three")), cell)


@query("t4_first_per_group", f"WITH {SCORED}, l AS (SELECT h_bin, div_bin, seq, row_number() OVER (PARTITION BY h_bin, div_bin ORDER BY seq) AS k FROM scored) SELECT h_bin, div_bin, seq FROM l WHERE k <= 3")
def first_per_group(spark, d):
    s = scored(spark, d).select("h_bin", "div_bin", "seq")
    return s.withColumn("k", F.row_number().over(W.partitionBy("h_bin", "div_bin").orderBy("seq"))).where("k <= 3").drop("k")


@query("s15_used_seeds", f"WITH {CAND} SELECT div_bin, array_to_string(list_sort(list(DISTINCT seq % 50)), ',') AS seeds FROM cand GROUP BY div_bin")
def used_seeds(spark, d):
    """The sorted seeds that each key has used, however often."""
    c = candidates(spark, d).groupBy("div_bin").agg(F.array_sort(F.collect_set(F.col("seq") % 50)).alias("s"))
    return c.select("div_bin", F.array_join(F.col("s").cast("array<string>"), ",").alias("seeds"))


@query("d4_reorder", "WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, row_number() OVER (ORDER BY n_name DESC) - 1 AS j FROM nation) SELECT CAST(a.i AS INT) AS at, b.n_nationkey FROM r a JOIN r b ON a.j = b.i")
def reorder(spark, d):
    """Rows of a batch by a permutation: the new row i is the old row p(i)."""
    r = table(spark, d, "nation").select("n_nationkey", (F.row_number().over(W.orderBy("n_nationkey")) - 1).alias("i"), (F.row_number().over(W.orderBy(F.desc("n_name"))) - 1).alias("j"))
    old = r.select(F.col("i").alias("j"), "n_nationkey")
    return r.select(F.col("i").cast("int").alias("at"), "j").join(old, "j").select("at", "n_nationkey")


@query("d17_rank_chunks", "WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) SELECT n_nationkey, CAST(floor(i / ceil(n / 4.0)) AS INT) AS rank FROM r")
def rank_chunks(spark, d):
    """The rank that keeps each row of a gathered batch."""
    n = table(spark, d, "nation").count()
    i = F.row_number().over(W.orderBy("n_nationkey")) - 1
    return table(spark, d, "nation").select("n_nationkey", F.floor(i / F.lit(max(-(-n // 4), 1))).cast("int").alias("rank"))


@query("j6_entropy_to_rollout", f"WITH {ROLLOUTS} SELECT uid, idx, correct, h FROM rollouts")
def entropy_to_rollout(spark, d):
    """Entropies in an array beside rollouts in rows, joined by position."""
    r = rollouts(spark, d)
    a = F.array_sort(F.collect_list(F.struct("idx", "h")))
    flat = r.groupBy("uid").agg(F.transform(a, lambda x: x["h"]).alias("hs")).select("uid", F.posexplode("hs").alias("p", "h"))
    return r.select("uid", "idx", "correct").join(flat.select("uid", (F.col("p") + 1).alias("idx"), "h"), ["uid", "idx"])


@query(
    "j16_concept_candidates",
    f"""WITH {CAND}, g AS (SELECT DISTINCT div_bin AS other FROM cand), j AS (SELECT seq, other, row_number() OVER (PARTITION BY seq ORDER BY md5(seq || '|' || other)) AS k FROM cand JOIN g ON other <> div_bin WHERE seq % 3 = 2)
SELECT seq, other FROM j WHERE k = 1""",
)
def concept_candidates(spark, d):
    """For a broader child a group other than its parent's, drawn by hash; the groups are a handful."""
    c = candidates(spark, d)
    groups = c.select(F.col("div_bin").alias("other")).distinct()
    key = F.md5(F.concat(F.col("seq").cast("string"), F.lit("|"), F.col("other").cast("string")))
    j = c.where(F.col("seq") % 3 == 2).join(F.broadcast(groups), F.col("other") != F.col("div_bin"))
    return j.groupBy("seq").agg(F.min_by("other", key).alias("other"))


@query(
    "r6_eviction",
    f"""WITH {SCORED}, e AS (SELECT h_bin, div_bin, max(seq) FILTER (seq % 97 = 0) AS gone FROM scored GROUP BY ALL),
l AS (SELECT s.*, row_number() OVER (PARTITION BY h_bin, div_bin ORDER BY rq DESC, seq) AS k FROM scored s JOIN e USING (h_bin, div_bin) WHERE e.gone IS NULL OR s.seq > e.gone)
SELECT h_bin, div_bin, seq FROM l WHERE k = 1""",
)
def eviction(spark, d):
    """Champions where every so often a re-evaluation empties the cell: the best since the last one."""
    s = scored(spark, d)
    gone = s.groupBy("h_bin", "div_bin").agg(F.max(F.when(F.col("seq") % 97 == 0, F.col("seq"))).alias("gone"))
    live = s.join(gone, ["h_bin", "div_bin"]).where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return live.groupBy("h_bin", "div_bin").agg(F.max_by("seq", F.struct(F.col("rq"), -F.col("seq"))).alias("seq"))
