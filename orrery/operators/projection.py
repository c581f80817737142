"""The first principal axis of a table of vectors, and bins along it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components a vector may have: the driver holds the square of this many moments, whatever the number of rows.
MOST_COMPONENTS = 4096


@dataclass
class Axis:
    """Mean and direction of unit length, and the range of the fitted projections with a margin."""

    mean: list[float]
    direction: list[float]
    low: float
    high: float

    def projection(self, vector: Column) -> Column:
        """Of vectors with a null component, or null: null."""
        at = float(np.dot(self.mean, self.direction))
        terms = F.zip_with(vector, F.array(*[F.lit(x) for x in self.direction]), lambda x, d: x.cast("double") * d)
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) - at

    def bin(self, vector: Column, bins: int, key: Column) -> Column:
        """0 to ``bins - 1``, clamped; a vector without a projection is dealt by the checksum of its key."""
        x = F.greatest(F.lit(self.low), F.least(F.lit(self.high), self.projection(vector)))
        width = (self.high - self.low) / bins
        at = F.least(F.floor((x - self.low) / width), F.lit(bins - 1)) if width else F.when(x.isNotNull(), F.lit(0))
        return F.coalesce(at, F.crc32(key.cast("string").cast("binary")) % bins).cast("int")


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def fit_axis(rows: DataFrame, vector: str, margin: float = 0.1) -> Axis | None:
    """The axis of largest variance over all vectors of ``rows``; null without any.

    Every task adds up first and second moments of its vectors, Spark adds the tasks' rows, and the
    driver finds the leading eigenvector of the one matrix.  The direction's largest component is
    positive (the first of equals).  Null vectors and such with null or non-finite components are
    left out; all others must have the same length, at most ``MOST_COMPONENTS``.
    """
    used = rows.where(_usable(vector)).select(F.col(vector).cast("array<double>").alias("x"))
    first = used.first()
    if first is None:
        return None
    origin = np.array(first["x"])  # moments about a vector near the mean lose no digits to it
    size = len(origin)
    if size > MOST_COMPONENTS:
        raise ValueError(f"more than {MOST_COMPONENTS} components")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((size + 1, size))
        for batch in batches:
            col = batch.column(0)
            if len(col) and set(np.diff(np.asarray(col.offsets)).tolist()) != {size}:
                raise ValueError("vectors of different lengths")
            x = np.asarray(col.flatten()).reshape(len(col), size) - origin
            n += len(x)
            total[0] += x.sum(axis=0)
            total[1:] += x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, size), pa.int32()), pa.array([n] * (size + 1), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "n", "sums"]
            )

    parts = used.mapInArrow(add_up, "i int, n long, sums array<double>")
    summed = parts.select("i", "n", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
    n = int(summed.n.iloc[0])
    table = np.zeros((size + 1, size))
    table[summed.i + 1, summed.j] = summed.s / n
    mean = table[0]
    _, vectors = np.linalg.eigh(table[1:] - np.outer(mean, mean))
    direction = vectors[:, -1]
    direction = direction * np.sign(direction[np.argmax(np.abs(direction))])
    axis = Axis((origin + mean).tolist(), direction.tolist(), 0.0, 0.0)
    x = axis.projection(F.col("x"))
    low, high = used.agg(F.min(x), F.max(x)).first()
    room = (high - low) * margin
    axis.low, axis.high = low - room, high + room
    return axis
