"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors of a label by random hyperplanes, round after round, until a leaf is
small; vectors near a split go to both sides.  Leaves of all trees are compared exactly.  A pair
that meets in several leaves counts in the first only, so links are counted without being listed:
a leaf gives its vectors' link counts and a spanning forest of its links.

A leaf whose vectors all point nearly the same way is not split, as its pairs may all be links;
if it is large, it is dealt to blocks and every pair of blocks is compared.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, stage
from .vectors import as_binary, matrix, usable

TREES, LEAF, SPILL = 8, 384, 0.06
#: Vectors that a node's splits are fitted on, and most levels of splits in one round.
SAMPLE, LEVELS = 512, 6
#: A node is tight if the mean of its unit vectors is at least this long: mean cosine of 0.9 and more.
TIGHT = 0.95
THRESHOLD = 0.98


def fit_splits(unit: np.ndarray, count: int, rng: np.random.Generator) -> tuple | None:
    """Nested (direction, low, high, left, right); None: a leaf.  Rows between low and high go to both sides."""

    def grow(x: np.ndarray, size: float, level: int) -> tuple | None:
        if size <= LEAF or level == LEVELS or len(x) < 8 or np.linalg.norm(x.mean(axis=0)) >= TIGHT:
            return None
        direction = rng.normal(size=x.shape[1])
        at = x @ direction
        low, high = np.quantile(at, [0.5 - SPILL, 0.5 + SPILL])
        if low == at.max() or high == at.min():
            return None
        half = size * (0.5 + SPILL)
        return direction, low, high, grow(x[at <= high], half, level + 1), grow(x[at > low], half, level + 1)

    return grow(unit, float(count), 0)


def route(tree: tuple | None, unit: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """(leaf name, rows) of every leaf."""
    out = []

    def walk(node: tuple | None, rows: np.ndarray, name: str) -> None:
        if node is None:
            out.append((name, rows))
            return
        direction, low, high, left, right = node
        at = unit[rows] @ direction
        walk(left, rows[at <= high], name + "l")
        walk(right, rows[at > low], name + "r")

    walk(tree, np.arange(len(unit)), "")
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _leaves(points: DataFrame, seed: int) -> DataFrame:
    """(tree, node, id) of all leaves; ``points`` are (id, label, d, vec)."""
    spark = points.sparkSession
    start = F.concat_ws("/", F.col("label").cast("string"), F.col("d").cast("string"))
    rows = points.select("id", start.alias("node"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    done, level = [], 0
    rows = stage(rows, "rpt-rows")
    while True:
        sizes = stage(rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")), "rpt-sizes")
        big = sizes.where(F.col("n") > LEAF)
        if big.isEmpty():
            done.append(rows.select("tree", "node", "id"))
            break
        picked = F.pmod(F.xxhash64("id", "tree", F.lit(level)), F.lit(1 << 20)) * F.col("n") < F.lit(SAMPLE << 20)
        sample = rows.join(big, ["tree", "node"]).where(picked).join(points.select("id", "vec"), "id").select("tree", "node", "n", "vec")

        def fit(group: pa.Table) -> pa.Table:
            tree, node, n = (group.column(c)[0].as_py() for c in ("tree", "node", "n"))
            x = _unit(matrix(group.column("vec")))
            import zlib

            rng = np.random.default_rng([seed, level, tree, zlib.crc32(node.encode())])
            plan = fit_splits(x[np.lexsort(x.T)], n, rng)
            return pa.table([pa.array([tree], pa.int32()), pa.array([node]), pa.array([pickle.dumps(plan) if plan else None], pa.binary())], names=["tree", "node", "plan"])

        plans = stage(sample.groupBy("tree", "node").applyInArrow(fit, "tree int, node string, plan binary").where("plan is not null"), "rpt-plans")
        rest = rows.join(plans, ["tree", "node"], "left_anti")
        done.append(stage(rest.select("tree", "node", "id"), "rpt-leaves"))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plans_, nodes, trees = (batch.column(batch.schema.get_field_index(c)) for c in ("plan", "node", "tree"))
                ids = np.asarray(batch.column(batch.schema.get_field_index("id")))
                vec = batch.column(batch.schema.get_field_index("vec"))
                where: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(trees.to_pylist(), nodes.to_pylist(), strict=True)):
                    where.setdefault(key, []).append(i)
                for (tree, node), at in where.items():
                    plan = pickle.loads(plans_[at[0]].as_py())
                    unit = _unit(np.array([np.frombuffer(vec[i].as_buffer(), "<f8") for i in at]))
                    for name, got in route(plan, unit):
                        if len(got):
                            picked_ids = ids[np.array(at)[got]]
                            n = len(picked_ids)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(picked_ids, pa.int64()), pa.array([f"{node}:{name}"] * n), pa.array([tree] * n, pa.int32())],
                                names=["id", "node", "tree"],
                            )

        moved = rows.join(points.select("id", "vec"), "id").join(plans, ["tree", "node"]).select("id", "node", "tree", "vec", "plan")
        if plans.isEmpty():
            break
        fresh = stage(moved.mapInArrow(send, "id long, node string, tree int"), "rpt-rows")
        discard(rows, sizes)
        rows, level = fresh, level + 1
    out = done[0]
    for t in done[1:]:
        out = out.unionAll(t)
    return stage(out, "rpt-leaves")


def _compare(group: pa.Table, threshold: float) -> pa.Table:
    """Links of one leaf, or of two blocks of one: (id, links, root) of the rows that have any."""
    tree, bi, bj = (group.column(c)[0].as_py() for c in ("tree", "bi", "bj"))
    ids, mult, block = (np.asarray(group.column(c)) for c in ("id", "mult", "block"))
    unit = _unit(matrix(group.column("vec")))
    marks = group.column("marks").to_pylist()
    # The paddings of the two sides differ.  Leaves in earlier trees and, as spilled rows meet more than once in a tree, smaller marks of this tree.
    own = group.column("mark")[0].as_py()
    early = [[m for m in x if (m & 63, m) < (tree, own)] for x in marks]
    width = max(map(len, early), default=0)
    sides = [np.full((len(ids), width), -1 - s, np.int64) for s in (0, 1)]
    for i, x in enumerate(early):
        for side in sides:
            side[i, : len(x)] = x
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        a, b = np.nonzero(unit[part] @ unit[right].T >= threshold)
        a, b = part[a], right[b]
        if bi == bj:
            a, b = a[a < b], b[a < b]
        if width:
            new = np.ones(len(a), bool)
            for k in range(0, len(a), 20_000):
                cut = slice(k, k + 20_000)
                new[cut] = ~(sides[0][a[cut]][:, :, None] == sides[1][b[cut]][:, None, :]).any(axis=(1, 2))
            a, b = a[new], b[new]
        np.add.at(links, a, mult[b])
        np.add.at(links, b, mult[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if parent[i] != parent[j]:
                x, y = root(i), root(j)
                if x != y:
                    parent[x] = y
    at = np.flatnonzero(links)
    roots = np.array([root(i) for i in at], np.int64)
    return pa.table([pa.array(ids[at], pa.int64()), pa.array(links[at]), pa.array(ids[roots], pa.int64())], names=["id", "links", "root"])


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine in double precision is
    at least ``threshold``.  Vectors that are null, zero or hold a null or non-finite component
    link with nothing; vectors of different lengths neither.  Equal vectors of a label are found
    without the forest.  Rows without vec_id link with nothing and have no component.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    ok = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    norm = F.exists("embedding", lambda x: x != 0)
    live = rows.where(ok).where(norm)
    groups = stage(
        live.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult")), "vec-groups"
    )
    # A vec_id that repeats with other vectors stands for several groups: they get numbers of their own.
    points = stage(
        as_binary(groups.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("first"), "mult", "label", F.size("embedding").alias("d"), F.col("embedding").alias("vec")), "vec", unsigned_zero=True),
        "vec-points",
    )
    leaves = _leaves(points.select("id", "label", "d", "vec"), seed)
    mark = F.shiftleft(F.xxhash64("node", "tree"), 6).bitwiseOR(F.col("tree").cast("long"))
    marks = leaves.groupBy("id").agg(F.collect_list(mark).alias("marks"))
    sizes = leaves.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / (2 * LEAF)).cast("int")
    body = stage(points.join(marks, "id").select("id", "mult", "vec", "marks"), "vec-body")
    dealt = (
        leaves.join(sizes, ["tree", "node"])
        .withColumn("nb", blocks)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("tree", "node", "id", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), mark.alias("mark"))
    )
    found = (
        dealt.join(body, "id")
        .groupBy("tree", "node", "bi", "bj")
        .applyInArrow(lambda t: _compare(t, threshold), "id long, links long, root long")
    )
    found = stage(found, "vec-found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    name = points.select("id", "first")
    edges = found.where("id <> root").join(name, "id").select("root", F.col("first").alias("a")).join(name, F.col("root") == F.col("id")).select("a", F.col("first").alias("b"))
    members = live.join(groups, ["label", "embedding"]).select("vec_id", F.col("id").alias("first"))
    stars = members.where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    component = connected_components(edges.unionAll(stars))
    # Link counts by group: all of a group's rows have the same.
    counted = stage(
        points.join(links, "id", "left").select("first", "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "vec-counted"
    )
    keyed = as_binary(live.select("vec_id", "label", F.col("embedding").alias("vec")), "vec", unsigned_zero=True)
    per_row = keyed.join(counted.select("label", "vec", "n_links"), ["label", "vec"], "left").select("vec_id", "n_links")
    dead = rows.where(~F.coalesce(ok, F.lit(False)) | ~F.coalesce(norm, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = per_row.unionAll(dead).join(component.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    out = out.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
