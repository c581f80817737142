"""Training sets that a stream swaps in, and the keys that were used across restarts.

Every micro-batch writes a folder of its own number and replaces it if it runs again, so a restart
neither loses nor repeats a batch.  A version is current once its write has been committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import save_partitioned


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders ``version=N`` whose write ended."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.Path(f"{path}/version=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def swap_into(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is the next version of the training set."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, null before the first."""
    versions = committed_versions(spark, path)
    return spark.read.parquet(f"{path}/version={versions[-1]}") if versions else None


def unused_into(path: str, registry: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows whose key no earlier batch used go to ``path``, one of each key, and their keys to ``registry``.

    Keys compare null-safe.  Of rows of one key the smallest by all columns is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*batch.columns)
        fresh = batch.groupBy(*key).agg(F.min(row).alias("row"))
        jvm = spark._jvm.org.apache.hadoop.fs
        if jvm.Path(registry).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(registry)):
            used = spark.read.parquet(registry).where(F.col("batch") < number).alias("u")
            same = [F.col(f"f.{k}").eqNullSafe(F.col(f"u.{k}")) for k in key]
            fresh = fresh.alias("f").join(used, same, "left_anti")
        out = f"{path}/version={number}"
        fresh.select("row.*").write.mode("overwrite").parquet(out)
        keys = spark.read.schema(batch.schema).parquet(out).select(*key).withColumn("batch", F.lit(number).cast("long"))
        save_partitioned(keys, registry, ["batch"])

    return write
