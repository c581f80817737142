"""Queries of the batch algebra and of balanced partitions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import partition as P
from .registry import query
from .views import rollouts, table

_L = "l AS (SELECT l_orderkey AS batch_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity AS q FROM lineitem)"


def _batch(spark, d):
    return rollouts(spark, d).select(F.col("uid").alias("batch_id"), F.col("idx").alias("item_id"), F.floor(F.col("score") / 100).cast("long").alias("seqlen"))


@query("d3_chunk", f"WITH {_L} SELECT batch_id, pos, CASE WHEN n % 2 = 0 THEN CAST(floor(pos * 2 / n) AS INT) END AS chunk FROM l")
def chunk(spark, d):
    """Halves of each batch; batches that have no equal halves have no chunks."""
    n = F.count(F.lit(1)).over(W.partitionBy("batch_id"))
    out = P.chunk(_batch(spark, d), 2, ["item_id"], ["batch_id"])
    return out.select("batch_id", "pos", F.when(n % 2 == 0, F.col("chunk")).alias("chunk"))


@query("d3_split", f"WITH {_L} SELECT batch_id, pos, CASE WHEN n >= 2 THEN CAST(floor(pos * (n // 2) / n) AS INT) END AS chunk FROM l")
def split(spark, d):
    """Chunks of about two rows; a batch of fewer has none."""
    n = F.count(F.lit(1)).over(W.partitionBy("batch_id"))
    out = P.split(_batch(spark, d), 2, ["item_id"], ["batch_id"])
    return out.select("batch_id", "pos", F.when(n >= 2, F.col("chunk")).alias("chunk"))


def _pos(spark, d):
    return P.positions(_batch(spark, d), ["item_id"], ["batch_id"]).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("batch_id")))


@query("d2_repeat_interleave", f"WITH {_L} SELECT batch_id, pos, CAST(pos * 3 + c AS INT) AS new_pos FROM l, (SELECT unnest(range(3)) AS c)")
def repeat_interleave(spark, d):
    return P.repeat(_pos(spark, d), 3).select("batch_id", "pos", F.col("new_pos").cast("int").alias("new_pos"))


@query("d2_repeat_tile", f"WITH {_L} SELECT batch_id, pos, CAST(c * n + pos AS INT) AS new_pos FROM l, (SELECT unnest(range(3)) AS c)")
def repeat_tile(spark, d):
    return P.repeat(_pos(spark, d), 3, interleave=False).select("batch_id", "pos", F.col("new_pos").cast("int").alias("new_pos"))


@query("t12_drop_last", f"WITH {_L} SELECT batch_id, pos, CAST(floor(pos / 3) AS INT) AS batch FROM l WHERE floor(pos / 3) < n // 3")
def drop_last(spark, d):
    return P.drop_last(_batch(spark, d), 3, ["item_id"], ["batch_id"]).select("batch_id", "pos", "batch")


@query("d16_inverse_permutation", f"WITH {_L} SELECT batch_id, pos, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY q, pos) - 1 AS INT) AS rank FROM l")
def inverse(spark, d):
    q = table(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey")
    a = q.select(F.col("l_orderkey").alias("batch_id"), (F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("pos"), F.col("l_quantity").alias("q"))
    return a.select("batch_id", "pos", (F.row_number().over(W.partitionBy("batch_id").orderBy("q", "pos")) - 1).alias("rank"))


@query("d4_fold_dim", f"WITH {_L} SELECT batch_id, CAST(pos // 2 AS INT) AS row, count(*) AS width, sum(q) AS total FROM l GROUP BY batch_id, pos // 2")
def fold_dim(spark, d):
    lines = table(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    a = lines.select(F.col("l_orderkey").alias("batch_id"), (F.row_number().over(w) - 1).alias("pos"), "l_quantity")
    return a.groupBy("batch_id", F.floor(F.col("pos") / 2).cast("int").alias("row")).agg(F.count(F.lit(1)).alias("width"), F.sum("l_quantity").alias("total"))


@query("d19_unpad", f"WITH {_L} SELECT batch_id, pos, q FROM l WHERE q > 25")
def unpad(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_quantity").alias("q"))
    return a.where("q > 25")


@query("j5_zip_union", "SELECT o_orderkey AS row_id, o_totalprice AS price, o_custkey AS cust FROM orders")
def zip_union(spark, d):
    o = table(spark, d, "orders")
    return P.zip_union(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price")), o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust")), ["row_id"])


@query("j15_collate", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def collate(spark, d):
    a = F.array_sort(F.collect_list(F.struct("turn", "role")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), a.alias("a"))
    return g.select("conv_id", "n", F.array_join(F.transform("a", lambda x: x["role"]), ",").alias("roles"))


@query("p1_select_pop_rename", "SELECT o_orderkey AS id, o_custkey AS owner FROM orders")
def select_rename(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").withColumnsRenamed({"o_orderkey": "id", "o_custkey": "owner"})


@query("d1_concat", "SELECT c_custkey AS id, 'c' AS side FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def concat(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("side"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("side")))


@query("d12_balanced_partition")
def balanced(spark, d):
    return P.balanced(_batch(spark, d), 2)


@query("d13_least_loaded")
def least_loaded(spark, d):
    return P.balanced(_batch(spark, d), 2, method="least_loaded")


@query("d14_micro_batches")
def micro_batches(spark, d):
    return P.micro_batches(_batch(spark, d), 1000)


@query("a37_balance_stats", f"WITH {_L}, c AS (SELECT batch_id, pos % 2 AS part, sum(q) AS s FROM l GROUP BY ALL) SELECT batch_id, min(s) AS low, max(s) AS high, round(sum(s) / 2, 4) AS mean FROM c GROUP BY batch_id")
def balance_stats(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), ((F.row_number().over(w) - 1) % 2).alias("part"), "l_quantity")
    c = a.groupBy("batch_id", "part").agg(F.sum("l_quantity").alias("s"))
    return c.groupBy("batch_id").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.round(F.sum("s") / 2, 4).alias("mean"))
