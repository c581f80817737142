"""The archive over an append-only event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import REPLAY, Fold

STATE = "next long, pending string, champions string"


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """JSON lines as they arrive; malformed lines, which come as nulls, are left out."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return raw.where(F.coalesce(*[F.col(c).cast("string") for c in raw.columns if "map" not in dict(raw.dtypes)[c]]).isNotNull())


def running_cells(scored: DataFrame) -> DataFrame:
    """Champion per cell so far, for complete or update mode; no gates."""
    best = F.max_by(F.struct("program_id", "seq", "rq"), F.struct(F.col("rq"), -F.col("seq")))
    return scored.groupBy("h_bin", "div_bin").agg(best.alias("b")).select("h_bin", "div_bin", "b.program_id", "b.seq", "b.rq")


def replay_stream(candidates: DataFrame) -> DataFrame:
    """Exact insertion order over micro-batches: per archive, rows wait until all smaller seqs (from 0) have come.

    Rows that come again are ignored.  State is the champions and the rows that wait.
    """
    import json

    names = [x.split(" ")[0] for x in REPLAY.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, waiting, held = (0, {}, {}) if not state.exists else (
            state.get[0], {int(k): v for k, v in json.loads(state.get[1]).items()}, {tuple(map(int, k.split(","))): v for k, v in json.loads(state.get[2]).items()}
        )
        for pdf in batches:
            for c in json.loads(pdf.to_json(orient="records")):
                if c["seq"] >= at:
                    waiting.setdefault(c["seq"], c)
        fold, rows = Fold(held), []
        while at in waiting:
            c = waiting.pop(at)
            got = fold.insert(c)
            rows.append((key[0], c["seq"], c["program_id"], got["status"], c["h_bin"], c["div_bin"], got["duplicate_of"], got["replaced"]))
            at += 1
        state.update((at, json.dumps(waiting), json.dumps({f"{h},{d}": v for (h, d), v in fold.champions.items()})))
        yield pd.DataFrame(rows, columns=names)

    return candidates.groupBy("archive_id").applyInPandasWithState(run, REPLAY, STATE, "append", "NoTimeout")


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; an extension for late data."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"))
