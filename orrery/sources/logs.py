"""Event logs whose numbers go on after a restart, and snapshots with a latest that is replaced in one commit.

Both are written by numbered commits.  A commit is a folder of its own; it counts once its marker is
there, and is replaced if it runs again.  Nothing that a stopped writer leaves behind is ever read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file of our own, null if it is not there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _replace(spark: SparkSession, path: str, value: dict) -> None:
    """Write the file beside its place and move it there in one step: a reader finds the old one or the new one."""
    fs, p = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(p)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(p), fs.makeQualified(target), overwrite)


#: Bits below the number of a task in ``monotonically_increasing_id``.
ROW_BITS = 33


class EventLog:
    """Events in folders ``commit=N``, numbered through all commits by ``event_seq``.

    A commit is sorted by range across the cluster, and every row keeps its task and its place there.
    How many rows each task wrote is part of the commit; with these counts a reader turns places
    into numbers without moving a row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commits(self) -> dict[int, dict]:
        """First number and counts by task of each commit that ended."""
        fs, p = _fs(self.spark, f"{self.path}/_commits/*.json")
        names = sorted(int(f.getPath().getName().split(".")[0]) for f in (fs.globStatus(p) or []) if f.getPath().getName().count(".") == 1)
        return {n: _read(self.spark, f"{self.path}/_commits/{n}.json") for n in names}

    def append(self, rows: DataFrame, commit: int, order: list[str], time: float | None = None) -> None:
        """Commit ``rows`` in an order that should be total; one that has ended already stays as it is.

        Numbers follow those of the commits before it; commits come in ascending order.  ``time`` is
        put into each row, the clock's where it is null.
        """
        ended = self.commits()
        if commit in ended:
            return
        if any(k > commit for k in ended):
            raise ValueError(f"commit {commit} comes before one that has ended")
        stamp = F.lit(time) if time is not None else F.unix_micros(F.current_timestamp()) / 1e6
        out = f"{self.path}/commit={commit}"
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
        placed.withColumn("time", stamp.cast("double")).write.mode("overwrite").parquet(out)
        task = F.shiftright("_place", ROW_BITS).alias("task")
        counts = self.spark.read.parquet(out).groupBy(task).count().orderBy("task").collect()  # a row per task
        first = max((c["first"] + sum(n for _, n in c["tasks"]) for c in ended.values()), default=0)
        _replace(self.spark, f"{self.path}/_commits/{commit}.json", {"first": first, "tasks": [[r["task"], r["count"]] for r in counts]})

    def into(self, order: list[str]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each micro-batch is a commit."""
        return lambda batch, number: self.append(batch, number, order)

    def read(self) -> DataFrame | None:
        """All events of commits that ended, with their numbers; null before the first event."""
        starts, folders = [], []
        for n, c in self.commits().items():
            at = c["first"]
            for task, count in c["tasks"]:
                starts.append((n, task, at))
                at += count
            folders += [f"{self.path}/commit={n}"] if c["tasks"] else []
        if not folders:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(*folders)
        rows = rows.withColumns({"_task": F.shiftright("_place", ROW_BITS), "_row": F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
        base = self.spark.createDataFrame(starts, "commit int, _task long, _start long")
        return rows.join(base, ["commit", "_task"]).withColumn("event_seq", F.col("_start") + F.col("_row")).drop("commit", "_task", "_row", "_start", "_place")


def save_snapshot(rows: DataFrame, path: str, step: int) -> None:
    """A step's snapshot, and the pointer to the latest.  The pointer never moves back to a smaller step."""
    spark = rows.sparkSession
    folder = f"step={step}/{uuid.uuid4().hex}"  # of its own, so that readers of an earlier write are not disturbed
    rows.write.parquet(f"{path}/{folder}")
    _replace(spark, f"{path}/_steps/{step}.json", {"folder": folder})
    latest = _read(spark, f"{path}/_latest.json")
    if latest is None or latest["step"] <= step:
        _replace(spark, f"{path}/_latest.json", {"step": step, "folder": folder})


def snapshot(spark: SparkSession, path: str, step: int | None = None) -> DataFrame | None:
    """The snapshot of a step, or the latest; null if there is none."""
    found = _read(spark, f"{path}/_latest.json" if step is None else f"{path}/_steps/{step}.json")
    return spark.read.parquet(f"{path}/{found['folder']}") if found else None
