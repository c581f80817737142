"""Reading of embedding columns, shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def as_binary(rows: DataFrame, vector: str = "embedding", unsigned_zero: bool = False) -> DataFrame:
    """``rows`` with ``vector`` as little-endian doubles in a binary column; with ``unsigned_zero``, -0.0 becomes 0.0 as in Spark's grouping."""
    at = rows.columns.index(vector)
    kinds = [f"`{f.name}` {'binary' if f.name == vector else f.dataType.simpleString()}" for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            flat = np.asarray(col.flatten().cast(pa.float64()), dtype="<f8") + (0.0 if unsigned_zero else -0.0)
            ends = np.cumsum([len(x) if x.is_valid else 0 for x in col])
            made = [flat[b - (len(x) if x.is_valid else 0) : b].tobytes() for x, b in zip(col, ends, strict=True)]
            cols = list(batch.columns)
            cols[at] = pa.array(made, pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return rows.mapInArrow(run, ", ".join(kinds))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as a matrix."""
    return np.array([np.frombuffer(x.as_buffer(), "<f8") for x in column])
