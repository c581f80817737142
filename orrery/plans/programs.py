"""Queries over replies, labels and answers put back, and the tables that runs leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import programs as P
from .parsing import _N, _case, _shapes
from .registry import query
from .views import DETAILS, STEPS, cells_by_step, details, table

_REPLIES = [
    "Sure:\n```python\nimport math\ndef generate(seed):\n    return <n>, seed\n```\nDone.",
    "def generate(seed):\n    return random.random() + <n>\nThat is all there is.",
    "```python\ndef generate(seed):\n    pass\n```\nbetter:\n```\ndef generate(s):\n    return <n>\n```",
    "# def generate(seed):\nno code <n>",
    "def generate(:\n    return <n>",
]


@query(
    "g25_program_in_reply",
    f"{_N} SELECT conv_id, turn, "
    + _case([
        "'import math' || chr(10) || 'def generate(seed):' || chr(10) || '    return ' || n || ', seed'",
        "'import random' || chr(10) || 'def generate(seed):' || chr(10) || '    return random.random() + ' || n",
        "'def generate(s):' || chr(10) || '    return ' || n",
        "NULL",
        "NULL",
    ])
    + " AS code FROM n",
)
def program_in_reply(spark, d):
    return _shapes(spark, d, _REPLIES).select("conv_id", "turn", P.program_in(F.col("s")).alias("code"))


@query("g26_nearest_label", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'geo.angle' WHEN 1 THEN 'event.' || event_type WHEN 4 THEN 'event.' || event_type END AS label FROM events")
def nearest_label(spark, d):
    """Labels written almost right, right, of no group, unlike any, and with a letter too many."""
    e = table(spark, d, "events").select("event_id", "event_type")
    known = ["geo.angle", "geo.area", *sorted("event." + r.event_type for r in e.select("event_type").distinct().collect())]  # a handful of types
    own, k = F.concat(F.lit("event."), "event_type"), F.col("event_id") % 5
    said = F.when(k == 0, "geo.angel").when(k == 1, own).when(k == 2, F.col("event_type")).when(k == 3, "geo.zzzzzz").otherwise(F.concat(own, F.lit("s")))
    return e.select("event_id", P.nearest_label(said, known).alias("label"))


_PUT_BACK = [
    ("Find x such that 3x ≡ <n> (mod 7).", "<n>", "n % 7 = 0"),
    ("Solve the equation: x^2 - <n>x = 0.", "{0, <n>}", "true"),
    ("Solve 2(x - 5) = 0", "<n>", "n = 5"),
    ("Solve x - 5 = 0", "none", "false"),
    ("How many are there?", "<n>", "true"),
    ("How many are there?", "many", "false"),
]


@query("g17_put_back", f"{_N} SELECT conv_id, turn, " + _case([x[2] for x in _PUT_BACK]) + " AS verified FROM n")
def put_back(spark, d):
    t = _shapes(spark, d, [f"{p}\t{a}" for p, a, _ in _PUT_BACK])
    problem, answer = (F.split_part("s", F.lit("\t"), F.lit(k)) for k in (1, 2))
    return t.select("conv_id", "turn", P.verified(problem, answer).alias("verified"))


def _length_reward(response, truth, most=400):
    right = float(response == truth)
    return {"overall": right - 0.5 * (len(response) > most), "accuracy": right}


@query("u1_reward_function", "SELECT conv_id, turn, CAST(role = 'user' AS INT) - CASE WHEN length(role) > 5 THEN 0.5 ELSE 0 END::DOUBLE AS overall, CAST(role = 'user' AS INT)::DOUBLE AS accuracy, CAST(NULL AS DOUBLE) AS format FROM conversations")
def reward_function(spark, d):
    """A reward of the user's over rows, one by one."""
    from functools import partial

    rows = table(spark, d, "conversations").select("conv_id", "turn", "role").withColumn("truth", F.lit("user"))
    return P.rewarded(rows, partial(_length_reward, most=5), "role", "truth").select("conv_id", "turn", "reward.*")


@query("s17_failures", f"WITH {DETAILS} SELECT benchmark, item, count(*) AS samples, left(string_agg(CASE WHEN correct THEN 'right' ELSE 'wrong' END, ',' ORDER BY sample), 17) AS responses FROM details GROUP BY ALL HAVING NOT bool_or(correct AND sample = 1)")
def failures(spark, d):
    """Items whose first sample is wrong, their responses up to a limit."""
    said = F.when(F.col("correct"), "right").otherwise("wrong")
    g = details(spark, d).groupBy("benchmark", "item").agg(
        F.count(F.lit(1)).alias("samples"), F.array_sort(F.collect_list(F.struct("sample", said.alias("r")))).alias("a"), F.bool_or(F.col("correct") & (F.col("sample") == 1)).alias("first")
    )
    text = F.left(F.array_join(F.transform("a", lambda x: x["r"]), ","), F.lit(17))
    return g.where(~F.col("first")).select("benchmark", "item", "samples", text.alias("responses"))


@query("s19_metric_rows", f"WITH {STEPS}, m AS (SELECT step, round(avg(rq), 6) AS rq_mean, round(max(rq), 6) AS rq_max, count(*)::DOUBLE AS champions FROM steps GROUP BY step) UNPIVOT m ON rq_mean, rq_max, champions INTO NAME key VALUE value")
def metric_rows(spark, d):
    """A row per step and metric, as a sink of metrics takes them."""
    names = ["rq_mean", "rq_max", "champions"]
    m = cells_by_step(spark, d).groupBy("step").agg(F.round(F.avg("rq"), 6).alias("rq_mean"), F.round(F.max("rq"), 6).alias("rq_max"), F.count(F.lit(1)).cast("double").alias("champions"))
    return m.unpivot("step", names, "key", "value")
