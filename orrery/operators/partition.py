"""Balanced partitions and the batch algebra: chunk, repeat, reorder, pad."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def largest_differencing(sizes: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Indices in ``k`` parts of nearly equal sums: the two most uneven partial partitions merge, largest with smallest."""
    if equal_size and len(sizes) % k:
        raise ValueError("equal parts need a number of items that k divides")
    if len(sizes) < k:
        raise ValueError("fewer items than parts")
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    heap: list = []
    if equal_size:
        groups = [order[i : i + k] for i in range(0, len(order), k)]
    else:
        groups = [[i] for i in order]
    for n, g in enumerate(groups):
        parts = sorted(((sizes[i], [i]) for i in g), reverse=True) + [(0, [])] * (k - len(g))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
    n = len(groups)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda t: (-t[0], t[1]))
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, merged))
        n += 1
    parts = [sorted(p) for _, p in heap[0][2]]
    if not all(parts):  # with very uneven sizes a part can stay empty: give it the last item of the fullest
        for p in parts:
            if not p:
                p.append(max(parts, key=len).pop())
    return parts


def least_loaded(sizes: list[int], k: int) -> list[list[int]]:
    """Items in their order, each to the part with the smallest sum so far."""
    parts, heap = [[] for _ in range(k)], [(0, p) for p in range(k)]
    for i, s in enumerate(sizes):
        load, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (load + s, p))
    return parts


def _dealt(items: DataFrame, group: str, pick: Callable[[list[int]], list[list[int]]], places: bool = False) -> DataFrame:
    """(group, item_id, seqlen, part), with ``places`` also pos and new_pos: ``pick`` deals each batch's lengths, in order of item_id.

    Rows arrive batch by batch; a task holds one batch and one Arrow batch of rows, and small batches
    share a call.  A null length counts as 0.
    """
    w = W.partitionBy(group).orderBy(F.col("item_id").asc_nulls_last(), "seqlen")
    rows = items.select(group, F.col("item_id").cast("long").alias("item_id"), F.col("seqlen").cast("long").alias("seqlen")).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    names = [group, "item_id", "seqlen", "part"] + (["pos", "new_pos"] if places else [])

    def deal(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pa.Table.from_batches(held).combine_chunks().to_batches():
            sizes = rows.column(2).fill_null(0).to_pylist()
            starts = np.flatnonzero(rows.column(3).to_numpy() == 0).tolist()
            part, new = [0] * len(sizes), [0] * len(sizes)
            for start, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
                at = start
                for p, own in enumerate(pick(sizes[start:end])):
                    for i in own:
                        part[start + i], new[start + i] = p, at - start
                        at += 1
            columns = [rows.column(0), rows.column(1), rows.column(2), pa.array(part, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + ([rows.column(3), pa.array(new, pa.int64())] if places else []), names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(3).to_numpy() == 0)
            if len(starts):  # the last batch in it may go on in the next rows
                held.append(batch.slice(0, starts[-1]))
                if any(len(b) for b in held):
                    yield from deal(held)
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from deal(held)

    kind = items.schema[group].dataType.simpleString()
    return rows.mapInArrow(run, f"{group} {kind}, item_id long, seqlen long, part int" + (", pos long, new_pos long" if places else ""))


def balanced(items: DataFrame, k: int, group: str = "batch_id", method: str = "largest_differencing") -> DataFrame:
    """(group, item_id, seqlen, part) of (group, item_id, seqlen); a group is one batch, which one task holds."""
    pick = {"largest_differencing": largest_differencing, "least_loaded": least_loaded}[method]
    return _dealt(items, group, lambda sizes: pick(sizes, min(k, len(sizes))))


def micro_batches(items: DataFrame, budget: int, group: str = "batch_id") -> DataFrame:
    """As many balanced parts as the token budget needs."""
    return _dealt(items, group, lambda sizes: largest_differencing(sizes, min(max(-(-sum(sizes) // budget), 1), len(sizes))))


def positions(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """0-based positions within ``by``; without it the whole table is one sequence, for bounded batches only."""
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w) - 1)


def chunk(df: DataFrame, chunks: int, order: list[str], by: list[str]) -> DataFrame:
    """Equal consecutive chunks of each batch."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return positions(df, order, by).withColumn("chunk", F.floor(F.col("pos") * chunks / n).cast("int"))


def split(df: DataFrame, size: int, order: list[str], by: list[str]) -> DataFrame:
    """``n // size`` chunks (not chunks of that size)."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return positions(df, order, by).withColumn("chunk", F.floor(F.col("pos") * F.floor(n / size) / n).cast("int"))


def repeat(df: DataFrame, times: int, interleave: bool = True, position: str = "pos", size: str = "n") -> DataFrame:
    """aabb (interleaved) or abab: copies with their new position."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    at = F.col(position) * times + F.col("copy") if interleave else F.col("copy") * F.col(size) + F.col(position)
    return out.withColumn("new_pos", at)


def zip_union(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Columns of two batches side by side; a column of both must be equal, else the query fails."""
    both = [c for c in a.columns if c in b.columns and c not in on]
    side = b.select(*on, *[F.col(c).alias(f"_{c}") for c in both], *[c for c in b.columns if c not in both and c not in on])
    out = a.join(side, on)
    for c in both:
        same = F.assert_true(F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"column {c} differs"))
        out = out.where(same.isNull())
    return out.drop(*[f"_{c}" for c in both])


def drop_last(df: DataFrame, size: int, order: list[str], by: list[str]) -> DataFrame:
    """Whole batches of ``size`` only."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    out = positions(df, order, by).withColumns({"batch": F.floor(F.col("pos") / size).cast("int"), "_whole": F.floor(n / size)})
    return out.where(F.col("batch") < F.col("_whole")).drop("_whole")


def balance_ranks(items: DataFrame, ranks: int, group: str = "batch_id") -> DataFrame:
    """(group, item_id, seqlen, part, pos, new_pos): each batch dealt to ``ranks`` parts of equal count and nearly equal length.

    ``pos`` is the place by item_id, ``new_pos`` the place once each part's items lie together: the
    permutation and, read the other way, its inverse.  A batch is one task; one whose count ``ranks``
    does not divide ends the query with an error.
    """
    return _dealt(items, group, lambda sizes: largest_differencing(sizes, ranks, equal_size=True), places=True)


def restored(balanced_rows: DataFrame, results: DataFrame, group: str = "batch_id") -> DataFrame:
    """``results`` of rows in their new places, (group, new_pos, ...), with ``item_id`` and ``pos`` of the places they came from."""
    return results.join(balanced_rows.select(group, "new_pos", "item_id", "pos"), [group, "new_pos"])
