"""Uncertainty of the most uncertain reasoning span of a response."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Marks of explicit steps, and what ends a sentence or paragraph.
STEP_MARK = re.compile(r"(?im)^\s*(?:step\s*\d+|final)\s*:")
BREAK = re.compile(r"[.!?]\s+|\n+")


def _spans(text: str) -> list[tuple[int, int]]:
    """Steps from mark to mark; without marks, sentences and lines.  What stands before the first mark is in no step."""
    marks = [m.start() for m in STEP_MARK.finditer(text)]
    edges = marks or [0, *(m.end() for m in BREAK.finditer(text))]
    return [(a, b) for a, b in zip(edges, [*edges[1:], len(text)], strict=True) if a < b]


def span_max(text: str | None, pieces: list[str], entropies: list[float | None]) -> float | None:
    """The largest mean entropy of a span's tokens.

    ``pieces`` are the texts of the tokens in order, ``entropies`` their values, null where masked.
    A token belongs to every span that it overlaps.  Without a span that holds a token: the mean
    of all; without any value: null.
    """
    text, at, tokens = text or "", 0, []
    for piece, h in zip(pieces, entropies, strict=True):
        if h is None or h != h:
            continue
        if not piece:
            tokens.append((at, at, h))
            continue
        start = max(text.find(piece, at), at)
        at = start + len(piece)
        tokens.append((start, at, h))
    if not tokens:
        return None
    means = []
    for a, b in _spans(text):
        inside = [h for s, e, h in tokens if e > a and s < b]
        if inside:
            means.append(sum(inside) / len(inside))
    return float(max(means)) if means else float(sum(h for *_, h in tokens) / len(tokens))


@F.pandas_udf(DoubleType())
def _span_max(text: pd.Series, pieces: pd.Series, entropies: pd.Series) -> pd.Series:
    return pd.Series([span_max(t, list(p), list(h)) if p is not None and h is not None else None for t, p, h in zip(text, pieces, entropies, strict=True)], dtype="float64")


def span_max_entropy(text: Column, pieces: Column, entropies: Column) -> Column:
    """``span_max`` in Arrow batches: offsets of tokens follow from all before them, which column functions cannot search."""
    return _span_max(text, pieces, entropies)
