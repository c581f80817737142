"""Exact top-k inner-product search by pivot-table elimination.

Distances to a few dozen pivots are computed once per vector.  For a query and a candidate the
largest difference of their distances to one pivot is a lower bound of their own distance, hence an
upper bound of their inner product: <q, c> = (|q|^2 + |c|^2 - d^2) / 2.  Candidates are evaluated in
order of that bound until no bound left reaches the k-th best score, so results are exact.

Queries and candidates are dealt to blocks; each pair of blocks keeps k rows per query, and a
last ranking merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stage
from .vectors import as_binary, matrix, usable

PIVOTS, SAMPLE_ROWS = 24, 1024
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 1024
#: Candidates evaluated between two looks at the bound.
STRIDE = 128


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of a sample that lie far from each other."""
    if not len(sample):
        return sample
    at = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    near = ((sample - sample[at[0]]) ** 2).sum(axis=1)
    while len(at) < min(n, len(sample)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def search_block(q: np.ndarray, q_to: np.ndarray, c: np.ndarray, c_to: np.ndarray, floor: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the candidates that can be among its k best, best bound first; exact scores decide.

    ``c`` is in order of vec_id, so that a stable sort breaks ties as asked.  ``floor`` is a score
    that k candidates of the whole table are known to reach.  Returns rows (index, score).
    """
    low = np.zeros((len(q), len(c)))
    for p in range(q_to.shape[1]):
        np.maximum(low, np.abs(q_to[:, p, None] - c_to[None, :, p]), out=low)
    # A margin for the rounding of the square roots.
    slack = 1e-6 * (1.0 + q_to.max(initial=0.0) + c_to.max(initial=0.0))
    low = np.maximum(low - slack, 0.0)
    bound = ((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - low * low) / 2
    out = []
    for i in range(len(q)):
        live = np.flatnonzero(bound[i] >= floor[i])
        live = live[np.argsort(-bound[i, live], kind="stable")]
        at, score = np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(live), STRIDE):
            if len(score) >= k and bound[i, live[start]] < score[k - 1]:
                break
            part = live[start : start + STRIDE]
            at = np.concatenate([at, part])
            score = np.concatenate([score, c[part] @ q[i]])
            best = np.lexsort((at, -score))[:k]
            at, score = at[best], score[best]
        out.append(np.stack([at, score], axis=1))
    return out


def search_large(q: np.ndarray, q_to: np.ndarray, c: np.ndarray, c_to: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """As :func:`search_block`, where products are too large for doubles: what their rounding leaves in doubt is multiplied as integers."""
    out = []
    c_size, c_square = np.abs(c), (c * c).sum(axis=1)
    for i in range(len(q)):
        low = np.abs(q_to[i] - c_to).max(axis=1, initial=0.0)
        slack = 1e-6 * (1.0 + q_to[i].max(initial=0.0) + c_to.max(initial=0.0))
        low = np.maximum(low - slack, 0.0)
        square = c_square + q[i] @ q[i]
        bound = (square - low * low) / 2 + 1e-9 * square
        about = c @ q[i]
        doubt = 1e-12 * (c_size @ np.abs(q[i]))
        reached = np.partition(about - doubt, len(c) - k)[len(c) - k] if len(c) > k else -np.inf
        live = np.flatnonzero((bound >= reached) & (about + doubt >= reached))
        ints = [int(x) for x in q[i]]
        exact = [(sum(x * int(y) for x, y in zip(ints, c[at], strict=True)), int(at)) for at in live]
        out.append([(at, s) for s, at in sorted(exact, key=lambda e: (-e[0], e[1]))[:k]])
    return out


#: Scores are ranked as decimals of this many digits.
DIGITS = 38


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of integer vectors (vec_id long, v array of integers, as long or double).

    Score is the inner product; ties go to the smaller vec_id; a query's own vec_id is left out.
    Rows without vec_id take no part; vectors of different lengths are not compared; rows of one
    vec_id with equal vectors count once.  Fewer candidates than k: all of them.  Scores are exact
    and ranked to 38 digits; one that no long holds is given as the nearest long.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull())
    # Of equal vectors the k + 1 smallest ids are all that a result can show.  Spark limits each group before the shuffle.
    seen = W.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("_r", F.dense_rank().over(seen)).where(F.col("_r") <= k + 1)
    groups = kept.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    groups = stage(as_binary(groups.select("ids", F.col("v").alias("vec"), F.size("v").alias("d")), "vec"), "topk-groups")
    queries = stage(as_binary(rows.where(is_query).select("vec_id", F.col("v").alias("vec"), F.size("v").alias("d")).distinct(), "vec"), "topk-queries")
    n_groups, n_queries = groups.count(), queries.count()
    if not n_groups or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # A bounded sample gives the pivots of each length and scores that are surely reached.
    sample = groups.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE_ROWS).select("d", "vec", F.element_at("ids", 1).alias("id")).collect()
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for d in {r.d for r in sample}:
        part = [r for r in sample if r.d == d]
        m = np.array([np.frombuffer(r.vec, "<f8") for r in part])
        by_length[d] = (choose_pivots(m), m, np.array([r.id for r in part]))
    shared = spark.sparkContext.broadcast(by_length)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distances to the pivots, as doubles in a binary column."""
        for batch in batches:
            made = []
            for d, raw in zip(batch.column(batch.schema.get_field_index("d")), batch.column(batch.schema.get_field_index("vec")), strict=True):
                v = np.frombuffer(raw.as_buffer(), "<f8")
                pivots = shared.value.get(d.as_py(), (np.zeros((0, len(v))),))[0]
                made.append(np.sqrt(((pivots - v) ** 2).sum(axis=1)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "to"])

    c_blocks, q_blocks = -(-n_groups // CANDIDATE_BLOCK), -(-n_queries // QUERY_BLOCK)
    cands = groups.mapInArrow(table, "ids array<long>, vec binary, d int, to binary").select(
        "d", F.pmod(F.xxhash64("vec"), F.lit(c_blocks)).alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"), "ids", "vec", "to"
    )
    asks = queries.mapInArrow(table, "vec_id long, vec binary, d int, to binary").select(
        "d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("qb"), "vec_id", "vec", "to"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        most = 10**DIGITS - 1
        if left.num_rows and right.num_rows:
            ids = left.column("ids").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: ids[i][0])
            ids = [ids[i] for i in order]
            c, c_to = matrix(left.column("vec"))[order], matrix(left.column("to"))[order]
            q, q_to = matrix(right.column("vec")), matrix(right.column("to"))
            small = (np.abs(c).max(initial=0) * np.abs(q).max(initial=0)) * c.shape[1] < 2**53
            names = right.column("vec_id").to_pylist()
            _, m, m_ids = shared.value.get(c.shape[1], (None, np.zeros((0, c.shape[1])), np.zeros(0)))
            floor = np.full(len(q), -np.inf)
            if len(m) > k + 1:
                s = q @ m.T
                s[np.array(names)[:, None] == m_ids[None, :]] = -np.inf
                floor = np.partition(s, len(m) - k, axis=1)[:, len(m) - k]
            blocks = search_block(q, q_to, c, c_to, floor, k + 1) if small else search_large(q, q_to, c, c_to, k + 1)
            for name, found in zip(names, blocks, strict=True):
                best = sorted((-s, i) for at, s in found for i in ids[int(at)] if i != name)[:k]
                out[0].extend([name] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(Decimal(max(min(int(-s), most), -most)) for s, _ in best)
        kinds = (pa.int64(), pa.int64(), pa.decimal128(DIGITS, 0))
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    keys = ["d", "cb", "qb"]
    found = cands.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score decimal({DIGITS},0)")
    found = stage(found, "topk-found")
    discard(groups, queries)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    held = F.greatest(F.lit(-(2**63)).cast("decimal(38,0)"), F.least(F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("score")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.cast("long").alias("score"))


def quantized(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * component), as doubles, of the vectors whose components are all finite."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale  # from 2^53 on doubles are whole
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    v = F.transform("embedding", whole)
    return rows.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(quantized(rows), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
