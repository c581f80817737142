"""The archive: champions, reservoirs, ranks, coverage, and exact replay of insertions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["h_bin", "div_bin"]


def top_per_cell(scored: DataFrame, k: int = 1, cell=CELL) -> DataFrame:
    """The best ``k`` of each cell, the earliest of equals first; Spark limits each cell before the shuffle."""
    w = W.partitionBy(*cell).orderBy(F.desc("rq"), "seq")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def champion_aggregate(scored: DataFrame, cell=CELL) -> DataFrame:
    """Champions by one partially aggregated maximum, for cells of any size."""
    best = F.max_by(F.struct("program_id", "seq", "rq"), F.struct(F.col("rq"), -F.col("seq")))
    return scored.groupBy(*cell).agg(best.alias("b")).select(*cell, "b.program_id", "b.seq", "b.rq")


def scaffold(spark: SparkSession, h_bins: int, div_bins: int) -> DataFrame:
    """All cells of the grid: h_bins x div_bins rows, fixed by the grid and not by data."""
    return spark.range(h_bins * div_bins).select(
        F.floor(F.col("id") / div_bins).cast("int").alias("h_bin"), (F.col("id") % div_bins).cast("int").alias("div_bin")
    )


def grid_stats(champions: DataFrame, h_bins: int, div_bins: int, hard_from: int = 2) -> DataFrame:
    """Occupied cells, coverage and the distribution of scores; zeros for an empty grid."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return champions.agg(
        F.count(F.lit(1)).alias("occupied"),
        (F.count(F.lit(1)) / F.lit(float(h_bins * div_bins))).alias("coverage"),
        z(F.avg("rq")).alias("mean_rq"),
        z(F.max("rq")).alias("max_rq"),
        z(F.min("rq")).alias("min_rq"),
        F.count_if(F.col("h_bin") >= hard_from).alias("hard"),
    )


def rank_ucb(champions: DataFrame, visits: Column, total: Column, c: float) -> DataFrame:
    """Distinct ranks of the scores in [0, 1] plus an exploration bonus.  Runs over champions, at most one a cell."""
    w = W.partitionBy(F.lit(0)).orderBy("rq", *CELL)
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    norm = F.when(n == 1, 1.0).otherwise((F.row_number().over(w) - 1) / (n - 1))
    bonus = F.when(visits > 0, F.lit(c) * F.sqrt(F.ln(total) / visits)).otherwise(F.lit(float("inf")))
    return champions.withColumns({"norm_rank": norm, "ucb": norm + bonus})


def running_champion(scored: DataFrame, cell=CELL) -> DataFrame:
    """Whether each candidate, in order of arrival, replaces the champion so far; and that champion.

    Exact while no gate removes or blocks a champion; ``replay`` covers the rest.
    """
    before = W.partitionBy(*cell).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    best = F.max("rq").over(before)
    prev = F.max_by("program_id", F.struct(F.col("rq"), -F.col("seq"))).over(before)
    return scored.withColumns({"prev_rq": best, "prev_program": prev, "accepted": best.isNull() | (F.col("rq") > best)})


REPLAY = "archive_id string, seq long, program_id string, status string, h_bin int, div_bin int, duplicate_of string, replaced string"


class Fold:
    """Insertion of candidates into one archive, one by one: gates first, then strict improvement."""

    def __init__(self, state: dict | None = None):
        self.champions: dict[tuple[int, int], dict] = state or {}

    def insert(self, c: dict) -> dict:
        cell = (int(c["h_bin"]), int(c["div_bin"]))
        out = {"status": "", "duplicate_of": None, "replaced": None}
        if not c["valid"]:
            return out | {"status": "seed_variation_rejected"}
        for sig, status in (("behaviour", "duplicate_rejected"), ("template", "template_duplicate_rejected")):
            # Cells are tried in grid order; a program is no duplicate of itself.
            twin = c[sig] and next((v["program_id"] for _, v in sorted(self.champions.items()) if v[sig] == c[sig] and v["program_id"] != c["program_id"]), None)
            if twin:
                return out | {"status": status, "duplicate_of": twin}
        held = self.champions.get(cell)
        if held is None or c["rq"] > held["rq"]:
            # One program holds one cell: its other cells become empty, no runner-up moves up.
            for other in [k for k, v in self.champions.items() if v["program_id"] == c["program_id"]]:
                del self.champions[other]
            self.champions[cell] = {k: c[k] for k in ("program_id", "rq", "behaviour", "template")}
            return out | {"status": "inserted", "replaced": held["program_id"] if held else None}
        return out | {"status": "rejected"}

    def evict(self, program_id: str) -> bool:
        gone = [k for k, v in self.champions.items() if v["program_id"] == program_id]
        for k in gone:
            del self.champions[k]
        return bool(gone)


def replay(candidates: DataFrame) -> DataFrame:
    """Every candidate's fate, in order of seq within its archive.

    One archive is one task, as each insertion depends on all before it; work spreads over archives.
    The task holds the champions and one Arrow batch of candidates.
    """

    def start(_: str | None) -> Callable[[dict], tuple]:
        fold = Fold()

        def insert(c: dict) -> tuple:
            got = fold.insert(c | {"rq": float("nan") if c["rq"] is None else c["rq"]})
            return c["archive_id"], c["seq"], c["program_id"], got["status"], c["h_bin"], c["div_bin"], got["duplicate_of"], got["replaced"]

        return insert

    return in_order(candidates, start, REPLAY)


def in_order(rows: DataFrame, start: Callable[[str | None], Callable[[dict], tuple]], schema: str) -> DataFrame:
    """Each archive's rows by seq through the function that ``start`` makes for the archive; a row gives a row of ``schema``."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, archive = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if step is None or r["archive_id"] != archive:
                    archive = r["archive_id"]
                    step = start(archive)
                out.append(step(r))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t, from_pandas=True) for i, t in enumerate(kinds)], names=names)

    rows = rows.withColumn("archive_id", F.col("archive_id").cast("string"))
    return rows.repartition("archive_id").sortWithinPartitions("archive_id", F.col("seq").asc_nulls_last()).mapInArrow(run, schema)


def material_pool(champions: DataFrame, reservoir: DataFrame | None) -> DataFrame:
    """Champions, and reservoir rows of programs that are no champions."""
    out = champions.withColumn("pool", F.lit("champion"))
    if reservoir is None:
        return out
    rest = reservoir.join(champions.select("program_id"), "program_id", "left_anti").withColumn("pool", F.lit("reservoir"))
    return out.unionByName(rest, allowMissingColumns=True)


def purge_other_cells(placements: DataFrame) -> DataFrame:
    """Each program's latest placement; cells it leaves stay empty."""
    return placements.groupBy("program_id").agg(F.max_by(F.struct(*CELL, "seq", "rq"), "seq").alias("p")).select("program_id", "p.*")

