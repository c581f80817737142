"""Mixing sources to target weights by systematic sampling.

Targets come from water-filling over the sources; inside a source every document expects
target / source size copies.  The expected copies are prefix-summed along the source, one random
offset is added, and a document is emitted once per integer boundary that its interval crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, comparable, stage

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (1, 2, 3)
#: Most copies that a source may expect of itself.
MAX_REPEAT = 3
#: Parts that a run of similar sizes in a source is dealt to, so that no source is one task.
SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) to (source, source_size, target), over all sources; null sorts last.

    Shares follow the weights; a target above ``max_repeat`` times its source's size stops there
    and the excess goes to the others by weight, until none is above.  Sources fill up in order
    of size / weight, so the fixed point is a prefix of that order: one ordered scan finds it.
    The table has a row per source.
    """
    total = W.partitionBy()
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    at = (F.row_number().over(order) - 1) % n
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (at + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("double")).withColumn("cap", max_repeat * F.col("source_size").cast("double"))
    fill = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.withColumn("all", F.sum(F.col("source_size")).over(total).cast("double"))
        .withColumn("left_w", F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        # Full if its cap is at most its share of what the fuller sources before it leave.
        .withColumn("full", F.col("cap") * F.col("left_w") <= F.col("left") * F.col("w"))
    )
    rows = rows.withColumn(
        "rate", F.max(F.when(~F.col("full"), F.struct(F.col("left_w").alias("k"), (F.col("left") / F.col("left_w")).alias("r")))).over(total)
    )
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(F.col("rate.r") * F.col("w")).alias("target"),
    )


def mix(docs: DataFrame, size: Column, seed: int = 7, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``size, source_size, target, copies`` to every row of ``docs`` (columns of these names are replaced).

    ``docs`` needs doc_id and source; rows of a null source form a source of their own.  Rows of
    size 0 get copies like others, which take no words.  A source without words has target 0 and
    no copies.  Copies differ by at most one between documents of a source and are at most
    ``max_repeat``; documents are passed in order of size, so words taken follow the target.
    The offset is a hash of seed and source, and rows of one doc_id and size are ordered by a hash
    of all their columns: reruns on the same rows agree.  Rows that are equal in all columns share
    their places.  Other columns pass through whatever their names; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    # The row travels whole, so that no name of its columns meets one of the plan's.
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    rows = docs.select("doc_id", "source", size.cast("long").alias("size"), row)
    # Runs of similar sizes (quarters of a power of two), each dealt to SALTS parts.
    bits = "length(bin(size))"
    bucket = F.expr(f"CASE WHEN size > 0 THEN CAST(4 * {bits} + shiftright(shiftleft(size, 3), {bits}) AS INT) ELSE 0 END")
    part = _hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % SALTS
    rows = rows.withColumns({"_bucket": bucket, "_salt": part.cast("int"), "_tie": F.xxhash64(comparable(rows, "row"))})
    parts = stage(
        rows.groupBy("source", "_bucket", "_salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-parts"
    )
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat)
    # Where each part starts: first the buckets of a source, then the parts of a bucket.
    buckets = parts.groupBy("source", "_bucket").agg(F.sum("n").alias("n"))
    starts = buckets.withColumn(
        "start", F.sum("n").over(W.partitionBy("source").orderBy("_bucket")) - F.col("n")
    ).drop("n")
    within = W.partitionBy("source", "_bucket").orderBy("_salt")
    parts_at = parts.select("source", "_bucket", "_salt", (F.sum("n").over(within) - F.col("n")).alias("inner"))
    offset = _hash32(F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("(null)"))))
    # Sources are compared null-safe, each side under a name of its own.
    starts = starts.toDF("s_source", "s_bucket", "start")
    targets = targets.toDF("t_source", "source_size", "target")
    plan = (
        parts_at.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("_bucket") == F.col("s_bucket")))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select(
            F.col("source").alias("p_source"),
            F.col("_bucket").alias("p_bucket"),
            F.col("_salt").alias("p_salt"),
            (F.col("start") + F.col("inner")).alias("start"),
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
            (offset.cast("double") / F.lit(4294967296.0)).alias("u"),
        )
    )
    plan = stage(plan, "mix-plan")
    ranked = rows.withColumn(
        "_rank", F.row_number().over(W.partitionBy("source", "_bucket", "_salt").orderBy("size", "doc_id", "_tie"))
    )
    edge = lambda r: F.floor(r * F.col("rate") + F.col("u"))
    last = F.col("start") + F.col("_rank")
    return (
        ranked.join(
            plan,
            F.col("source").eqNullSafe(F.col("p_source"))
            & (F.col("_bucket") == F.col("p_bucket"))
            & (F.col("_salt") == F.col("p_salt")),
            "left",
        )
        .withColumn("copies", (edge(last) - edge(last - 1)).cast("int"))
        .select("row.*", "size", "source_size", "target", "copies")
    )


def _hash32(text: Column) -> Column:
    """The first four bytes of MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the text is read once."""
    return stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(sizes_of(docs), F.col("size")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS size FROM documents),
g AS (SELECT source, sum(size)::DOUBLE AS source_size, 3 * sum(size)::DOUBLE AS cap FROM s GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, sum(source_size) OVER () AS total FROM g),
f AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_w, total - coalesce(sum(cap) OVER o, 0) AS rest FROM w
      WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, cap * left_w <= rest * w AS filled FROM f),
t AS (SELECT *, CASE WHEN filled THEN cap
        ELSE (SELECT arg_max(rest / left_w, left_w) FROM l WHERE NOT filled) * w END AS target FROM l),
b AS (SELECT *, CASE WHEN size > 0 THEN 4 * length(bin(size)) + ((size << 3) >> length(bin(size))) ELSE 0 END AS bucket,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 16 AS salt FROM s),
r AS (SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('7|' || coalesce(b.source, '(null)')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
        row_number() OVER (PARTITION BY b.source ORDER BY bucket, salt, size, doc_id) AS k
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) * size AS taken FROM r
"""


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it; all its columns and no others."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = mix(docs.select("doc_id", "source", row), word_count(F.col("row.text")), seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
