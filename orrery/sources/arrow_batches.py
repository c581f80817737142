"""Whole batches as values: rows of a batch as one Arrow stream in a binary column, schema included."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def to_batches(rows: DataFrame, by: str, order: list[str] | None = None) -> DataFrame:
    """(by, n, data): each batch's rows, all columns, as one Arrow stream; in the given order, else as they come.

    A batch is held in one task and must stay under 2 GB.  A null key is a batch of its own.  An empty table has no batches: :func:`empty_batch` is one without rows.
    """
    kind = rows.schema[by].dataType.simpleString()
    columns = rows.columns

    def pack(table: pa.Table) -> pa.Table:
        keys = table.column(0).slice(0, 1).combine_chunks()
        inner = table.select(columns)
        if order:
            inner = inner.sort_by([(c, "ascending") for c in order])
        return pa.table({by: keys, "n": pa.array([len(inner)], pa.int64()), "data": pa.array([_stream(inner)], pa.binary())})

    return rows.groupBy(by).applyInArrow(pack, f"`{by}` {kind}, n long, data binary")


def empty_batch(schema: T.StructType) -> bytes:
    """The stream of a batch without rows."""
    return _stream(to_arrow_schema(schema).empty_table())


def from_batches(batches: DataFrame, schema: T.StructType | None = None, data: str = "data") -> DataFrame:
    """The rows of all batches; the schema is that of any batch, unless given.  Null batches have no rows."""
    if schema is None:
        first = batches.where(F.col(data).isNotNull()).select(data).first()
        if first is None:
            raise ValueError("without a batch the schema must be given")
        with pa.ipc.open_stream(bytes(first[0])) as stream:
            schema = from_arrow_schema(stream.schema)

    def unpack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for value in batch.column(0):
                if value.is_valid:
                    with pa.ipc.open_stream(value.as_buffer()) as stream:
                        yield from stream

    return batches.select(data).mapInArrow(unpack, schema)


def save_batch(spark: SparkSession, value: bytes, path: str) -> None:
    """One batch as a file of the store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(value))
    out.close()


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a batch's file."""
    return from_batches(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")))
