"""The library's inputs as views over the star schema: candidates, rollouts, token arrays, evaluation details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring

H_RANGE, H_BINS, DIV_BINS = (0.0, 500.0), 10, 6


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").alias("program_id"),
        F.col("event_type").alias("op"),
        F.col("value").alias("u"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("p_hat"),
        (F.col("user_id") % DIV_BINS).cast("int").alias("div_bin"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with score and cell, without those that nothing solved."""
    c = candidates(spark, d).where(F.col("p_hat") != 0)
    return c.withColumns({"rq": scoring.rq_value(F.col("p_hat"), F.col("u")), "h_bin": scoring.value_bin(F.col("u"), *H_RANGE, H_BINS)})


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("uid"),
        F.row_number().over(w).alias("idx"),
        (F.col("l_returnflag") == "N").alias("correct"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_discount").alias("h"),
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
    )


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """One row per group: arrays in order of idx.  A group is one order's lines."""
    a = F.array_sort(F.collect_list(F.struct("idx", "score", "h", "mask")))
    g = rollouts(spark, d).groupBy("uid").agg(a.alias("a"))
    part = lambda c: F.transform("a", lambda x: x[c])
    return g.select("uid", part("score").alias("score"), part("h").alias("h"), part("mask").alias("mask"))


def details(spark: SparkSession, d: str) -> DataFrame:
    """Graded samples: benchmark, item, sample position, whether it is correct, extracted, boxed, and its length."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("benchmark"))
    r = rollouts(spark, d)
    return r.join(o, F.col("uid") == F.col("o_orderkey")).select(
        "benchmark", F.col("uid").alias("item"), F.col("idx").alias("sample"), "correct", (F.col("mask") == 1).alias("extracted"), (F.col("h") > 0.05).alias("boxed"), F.floor("score").cast("long").alias("chars")
    )


def cells_by_step(spark: SparkSession, d: str) -> DataFrame:
    """Champion per cell and day."""
    s = scored(spark, d).withColumn("step", F.datediff(F.to_date("ts"), F.lit("2024-01-01")))
    best = F.max_by(F.struct("program_id", "rq", "p_hat"), F.struct(F.col("rq"), -F.col("seq")))
    return s.groupBy("step", "h_bin", "div_bin").agg(best.alias("b")).select("step", "h_bin", "div_bin", "b.*")


CAND = """cand AS (SELECT event_id AS seq, ts, user_id AS program_id, event_type AS op, value AS u,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(100 AS DOUBLE) AS p_hat, CAST(user_id % 6 AS INT) AS div_bin FROM events)"""
SCORED = f"""{CAND},
scored AS (SELECT *, p_hat * (1 - p_hat) * u AS rq,
  CAST(LEAST(FLOOR(GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(500 AS DOUBLE), u)) / CAST(50 AS DOUBLE)), 9) AS INT) AS h_bin FROM cand WHERE p_hat <> 0)"""
CHAMPIONS = f"""{SCORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY h_bin, div_bin ORDER BY rq DESC, seq) AS rn FROM scored),
champ AS (SELECT h_bin, div_bin, program_id, seq, rq FROM ranked WHERE rn = 1)"""
ROLLOUTS = """rollouts AS (SELECT l_orderkey AS uid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS idx,
  l_returnflag = 'N' AS correct, l_extendedprice AS score, l_discount AS h, CAST(l_linestatus = 'O' AS INT) AS mask FROM lineitem)"""
DETAILS = f"""{ROLLOUTS},
details AS (SELECT o_orderpriority AS benchmark, uid AS item, idx AS sample, correct, mask = 1 AS extracted, h > 0.05::DOUBLE AS boxed, CAST(floor(score) AS BIGINT) AS chars
  FROM rollouts JOIN orders ON uid = o_orderkey)"""
STEPS = f"""{SCORED},
sr AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step FROM scored),
sk AS (SELECT *, row_number() OVER (PARTITION BY step, h_bin, div_bin ORDER BY rq DESC, seq) AS rn FROM sr),
steps AS (SELECT CAST(step AS INT) AS step, h_bin, div_bin, program_id, rq, p_hat FROM sk WHERE rn = 1)"""
