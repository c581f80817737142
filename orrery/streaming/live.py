"""The living archive over a stream, and the board of a run's steps while it runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.live_archive import FATE, LiveArchive, fates
from .training_set import committed_versions

STATE = "next long, waiting string, archive string"


def live_stream(steps: DataFrame, reservoir: int = 4, promote: bool = False) -> DataFrame:
    """:func:`live_replay` over micro-batches: per archive, rows wait until all smaller seqs (from 0) have come.

    Rows that come again are ignored.  State is the archive and the rows that wait.
    """
    names = [x.split(" ")[0] for x in FATE.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, waiting, held = state.get if state.exists else (0, "{}", None)
        late = {int(k): r for k, r in json.loads(waiting).items()}
        for pdf in batches:
            for r in json.loads(pdf.to_json(orient="records", double_precision=15)):
                if r["seq"] >= at:
                    late.setdefault(r["seq"], r)
        ready = []
        while at in late:
            ready.append(late.pop(at))
            at += 1
        archive = LiveArchive(reservoir, promote, held)
        out = fates(archive, key[0], ready)
        state.update((at, json.dumps(late), archive.state()))
        yield pd.DataFrame(out, columns=names)

    return steps.groupBy("archive_id").applyInPandasWithState(run, FATE, STATE, "append", "NoTimeout")


#: A record of a run: an event of a candidate, or a cell of a step's snapshot.
RECORD = "record string, step long, event string, status string, h_bin int, div_bin int, program_id string, rq double"


def step_board(records: DataFrame) -> DataFrame:
    """One row a step: its events by outcome, its snapshot's cells, and whether it is in flight, that is without a snapshot so far.

    The same over a table and, in update mode, over a stream: all are partial aggregates.  Records
    that come twice count twice.
    """
    snapshot, event = F.col("record") == "snapshot", F.col("record") == "event"
    best = F.max(F.when(snapshot, F.struct("rq", (-F.col("h_bin")).alias("h"), (-F.col("div_bin")).alias("d"), "program_id")))
    out = records.groupBy("step").agg(
        F.count_if(event).alias("events"),
        F.count_if(event & (F.col("status") == "inserted")).alias("inserted"),
        F.count_if(event & (F.col("event") == "candidate_failed")).alias("failed"),
        F.count_if(snapshot).alias("cells"),
        F.round(F.sum(F.when(snapshot, F.col("rq").cast("decimal(28,12)"))), 6).cast("double").alias("total_rq"),
        best.alias("best"),
    )
    return out.select("step", "events", "inserted", "failed", "cells", "total_rq", F.col("best.program_id").alias("best_program"), (F.col("cells") == 0).alias("in_flight"))


def board_into(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on the board in update mode: each batch's changed rows replace those of the same batch, if it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def board(spark: SparkSession, path: str) -> DataFrame | None:
    """The board as of the last committed batch: the newest row of each step; null before the first."""
    versions = committed_versions(spark, path)
    if not versions:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in versions])
    columns = [c for c in rows.columns if c != "version"]
    return rows.groupBy("step").agg(F.max_by(F.struct(*columns), "version").alias("row")).select("row.*")
