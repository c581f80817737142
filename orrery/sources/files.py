"""Readers and writers of event logs, snapshots, tables and step folders, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT = (
    "event string, event_seq long, time double, global_step long, outer_iteration_index long, evolution_index long, "
    "candidate_index int, inner_iteration long, op string, parent_id string, parent_b_id string, child_id string, status string, reason string, "
    "p_hat double, rq_score double, h_bar double, h_bin int, d_bin int, frontier_status string, archive_status string, "
    "duplicate_of string, num_rollouts int, num_correct int, uncertainty_scores map<string,double>"
)


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def split_name(spec: str, default: str = "train") -> tuple[str, str]:
    """``path@split``."""
    path, _, split = spec.partition("@")
    return path, split or default


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped, malformed ones fail the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str = EVENT) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines); step and index of the file name stand in where a row has none."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.col("_metadata.file_name"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    named = lines.select("file", "value", F.from_json("value", f"{schema}, _bad string", options).alias("e")).select("file", "value", "e.*")
    number = lambda p: F.nullif(F.regexp_extract("file", p, 1), F.lit("")).try_cast("long")
    good = named.where("_bad is null").drop("_bad", "value")
    good = good.withColumns(
        {"global_step": F.coalesce("global_step", number(r"step_(\d+)")), "evolution_index": F.coalesce("evolution_index", number(r"evo_(\d+)"))}
    )
    # The latest file repeats lines of a numbered one.
    return good.where(~F.col("file").startswith("latest")), named.where("_bad is not null").select("file", F.col("value").alias("line"))


def json_documents(spark: SparkSession, path: str, schema: str, unknown: int = 10**12) -> DataFrame:
    """One document per file, with the step of its name; names without a number sort last."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    step = F.nullif(F.regexp_extract("file", r"(\d+)\.json$", 1), F.lit("")).try_cast("long")
    return docs.withColumn("step", F.coalesce(step, F.lit(unknown)))


def latest(docs: DataFrame) -> DataFrame:
    """The document of the largest step, compared as a number."""
    top = docs.agg(F.max("step").alias("step"))
    return docs.join(F.broadcast(top), "step", "left_semi")


def sources_of(spark: SparkSession, path: str) -> DataFrame:
    """Whole source files with their ids."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("source_code"), F.substring(F.md5("value"), 1, 12).alias("program_id"))


def step_range(df: DataFrame, start: int | None, end: int | None, column: str = "step") -> DataFrame:
    """Steps within a closed range; on a table partitioned by step this prunes partitions."""
    low = F.col(column) >= start if start is not None else F.lit(True)
    return df.where(low & (F.col(column) <= end if end is not None else F.lit(True)))


def first_available(tables: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """Rows of the first source that has the key; which one is kept."""
    rows = [t.withColumns({"source": F.lit(n), "priority": F.lit(i)}) for i, (n, t) in enumerate(tables)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    best = F.min("priority").over(W.partitionBy(*key))
    return out.withColumn("_best", best).where("priority = _best").drop("_best", "priority")


def obsolete(checkpoints: DataFrame, limit: int, current: int) -> DataFrame:
    """Checkpoints to delete: all but the newest ``limit - 1`` before the current one."""
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("step"))
    return checkpoints.where(F.col("step") < current).withColumn("_r", F.row_number().over(w)).where(F.col("_r") > limit - 1).drop("_r")


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def restore_champions(snapshots: DataFrame) -> DataFrame:
    """Champions of snapshot documents, placed as they are: no gate is applied again."""
    cells = snapshots.select("step", F.explode("grid").alias("c"))
    return cells.where("c.has_champion").select("step", "c.*")


def grid_csv(champions: DataFrame, h_bins: int, value: str = "rq") -> DataFrame:
    """A row per diversity bin, a column per h bin."""
    return (
        champions.groupBy("div_bin").pivot("h_bin", list(range(h_bins))).agg(F.round(F.max(value), 4)).withColumnsRenamed({str(h): f"h{h}" for h in range(h_bins)})
    )


#: The fields of a program's document.
PROGRAM = (
    "source_code string, program_id string, parent_id string, generation int, fitness double, h_score double, p_hat double, rq_score double, "
    "niche_h int, niche_div int, root_seed_id string, last_reeval_step long, metadata map<string,string>"
)


def save_archive(champions: DataFrame, reservoir: DataFrame, path: str) -> None:
    """Champions and the cells' further candidates, each a table in folders by cell."""
    for name, rows in (("champions", champions), ("reservoir", reservoir)):
        rows.write.mode("overwrite").partitionBy("h_bin", "div_bin").parquet(f"{path}/{name}")


def load_archive(spark: SparkSession, path: str, reservoir_size: int) -> tuple[DataFrame, DataFrame]:
    """(champions, reservoir) of a saved archive; of each cell's reservoir the best by ``rq``, then ``seq``, are kept."""
    best = W.partitionBy("h_bin", "div_bin").orderBy(F.desc("rq"), "seq")
    kept = spark.read.parquet(f"{path}/reservoir").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= reservoir_size)
    return spark.read.parquet(f"{path}/champions"), kept.drop("_k")


def save_programs(programs: DataFrame, path: str) -> None:
    """A JSON object per program, nulls written."""
    programs.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_programs(spark: SparkSession, path: str, one_a_file: bool = False) -> DataFrame:
    """Programs of JSON lines, or of files that hold one document on many lines; malformed ones fail the query."""
    return spark.read.schema(PROGRAM).option("mode", "FAILFAST").option("multiLine", one_a_file).json(path)
