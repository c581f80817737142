"""Queries that run programs and store batches as values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generator
from ..sources import arrow_batches
from .registry import query
from .views import table

_PROGRAMS = [
    "import random\ndef generate(seed):\n    return f'What is <n> + {seed}?', <n> + seed",
    "def generate(seed):\n    return 'odd', 1 // (seed - 2)",
    "def generate(seed):\n    return 'only one'",
    "def generate(seed):\n    print('noise')\n    return [math.gcd(<n>, seed + 2), ' ' * (1 - seed % 2)]",
    "def other(seed):\n    return 1, 2",
    "def generate(seed:\n",
]


@query(
    "u2_generated_instances",
    """WITH p AS (SELECT item_id, item_id % 6 AS k, length(text) AS n, unnest(range(3))::INT AS seed FROM benchmark)
SELECT item_id, seed, CASE k WHEN 0 THEN 'What is ' || n || ' + ' || seed || '?' WHEN 1 THEN CASE WHEN seed <> 2 THEN 'odd' END END AS problem,
  CASE k WHEN 0 THEN (n + seed)::VARCHAR WHEN 1 THEN CASE seed WHEN 0 THEN '-1' WHEN 1 THEN '-1' END END AS answer,
  CASE k WHEN 1 THEN CASE WHEN seed = 2 THEN 'ZeroDivisionError' END WHEN 2 THEN 'not a pair' WHEN 3 THEN 'empty text' WHEN 4 THEN 'no generate' WHEN 5 THEN 'SyntaxError' END AS error FROM p""",
)
def generated_instances(spark, d):
    """Three seeds of a program for each benchmark item: good ones, and one of each failure."""
    b = table(spark, d, "benchmark").select("item_id", F.length("text").cast("string").alias("n"))
    source = F.element_at(F.array(*[F.lit(p) for p in _PROGRAMS]), (F.col("item_id") % len(_PROGRAMS) + 1).cast("int"))
    programs = b.select("item_id", F.replace(source, F.lit("<n>"), F.col("n")).alias("source_code"))
    return generator.instances(programs, 3).select("item_id", "seed", "problem", "answer", "error")


@query(
    "s23_batches_as_values",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_returnflag, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem",
)
def batches_as_values(spark, d):
    """Each supplier's line items as one value, and back."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    packed = arrow_batches.to_batches(rows, "l_suppkey", ["l_orderkey", "l_linenumber"])
    return arrow_batches.from_batches(packed, rows.schema).join(packed.select("l_suppkey", "n"), "l_suppkey")
