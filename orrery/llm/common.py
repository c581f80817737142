"""Shared pieces of the training-data operators: scratch tables, word rules, components.

Scratch tables cut lineage.  They are written to the shared folder named by
``spark.checkpoint.dir``; only where that is unset and Spark runs in one process (tests,
notebooks) a folder of our own is made, one for each application.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; everything else is part of a word.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders made for applications that name none.
_OWN_FOLDERS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = f"file://{tempfile.mkdtemp(prefix='orrery-')}"
        found = _OWN_FOLDERS[app]
    return found.rstrip("/")


def stage(df: DataFrame, tag: str, hashes: bool = False) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: lineage ends here, results stay if executors are lost.

    ``hashes``: its values seldom repeat, so no dictionary of them is tried.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.enable.dictionary": "false"} if hashes else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def fold_held_out(key: Column, modulus: int, held: int) -> Column:
    """Whether crc32 of the key as text leaves remainder ``held``; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == held, F.lit(True))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id for every id named in ``links`` (two long columns).

    Every round hooks each node to its smallest neighbour, halves the resulting chains by one
    pointer jump and contracts the links, so the links left shrink geometrically; hubs cost one
    partially aggregated minimum.  Returns (node, component).  No links: an empty table.
    """
    spark = links.sparkSession
    edges = stage(
        links.select(F.least(F.col(a), F.col(b)).alias("u"), F.greatest(F.col(a), F.col(b)).alias("v"))
        .where("u < v")
        .distinct(),
        "edges",
    )
    labels, hops = None, []
    while not edges.isEmpty():
        near = stage(
            edges.select(F.col("v").alias("n"), F.col("u").alias("m"))
            .unionAll(edges.select("u", "u"))
            .groupBy("n")
            .agg(F.min("m").alias("m")),
            "near",
        )
        # One jump along the chain; roots point to themselves.
        up = stage(
            near.join(near.select(F.col("n").alias("m"), F.col("m").alias("top")), "m", "left").select(
                "n", F.coalesce("top", "m").alias("m")
            ),
            "up",
        )
        fresh = stage(
            edges.join(up.select(F.col("n").alias("u"), F.col("m").alias("x")), "u")
            .join(up.select(F.col("n").alias("v"), F.col("m").alias("y")), "v")
            .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
            .where("u < v")
            .distinct(),
            "edges",
        )
        hops.append(up)
        discard(edges, near)
        edges = fresh
    discard(edges)
    if not hops:
        return spark.createDataFrame([], "node long, component long")
    # Compose from the last round to the first, so that each table joins one smaller one.
    for k in range(len(hops) - 1, -1, -1):
        if labels is None:
            labels = hops[k].select(F.col("n").alias("node"), F.col("m").alias("component"))
        else:
            nxt = labels.select(F.col("node").alias("m"), F.col("component").alias("top"))
            labels = stage(
                hops[k].join(nxt, "m", "left").select(
                    F.col("n").alias("node"), F.coalesce("top", "m").alias("component")
                ),
                "labels",
            )
    return labels


def added(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` and more columns, by type name."""
    more = [T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items()]
    return T.StructType([*df.schema.fields, *more])


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def comparable(df: DataFrame, column: str) -> Column:
    """A form of the column that can be hashed and ordered: itself, or its JSON text if it holds a map."""

    def holds_map(t: T.DataType) -> bool:
        inner = [f.dataType for f in t.fields] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else []
        return isinstance(t, T.MapType) or any(map(holds_map, inner))

    return F.to_json(F.struct(column)) if holds_map(df.schema[column].dataType) else F.col(column)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


#: Bytes of rows that go to Python at once.  A batch is held as Arrow and as a message in the JVM and
#: once or more in the worker, outside the heap, for every task of an executor.
BATCH_BYTES = 2 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Python steps that run from now on in this session get batches of about ``BATCH_BYTES``."""
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


#: Keys that a semi- or anti-join may broadcast; more meet in a shuffled join.
BROADCAST_KEYS = 1_000_000


def by_keys(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi- or anti-join of wide rows with one-column keys, without shuffling the rows while the keys are few."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, how)
