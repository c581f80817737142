"""Scores, bins and gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rq_terms(p: Column, u: Column, ablate_learnability: bool = False, ablate_uncertainty: bool = False) -> tuple[Column, Column]:
    """Learnability p(1-p) and uncertainty; an ablated term is 1."""
    one = F.lit(1.0)
    return (one if ablate_learnability else p * (1 - p)), (one if ablate_uncertainty else u)


def rq_value(p: Column, u: Column, **ablate: bool) -> Column:
    a, b = rq_terms(p, u, **ablate)
    return a * b


def value_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Clamped equal-width bin; the top bin is closed and takes NaN."""
    width = (high - low) / bins
    at = F.floor((F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)) - F.lit(float(low))) / F.lit(width))
    return F.least(at, F.lit(bins - 1)).cast("int")


def is_frontier(p: Column, low: float, high: float) -> Column:
    """Open interval; an unknown rate passes."""
    return p.isNull() | ((p > low) & (p < high))


def frontier_status(p: Column, low: float, high: float) -> Column:
    return F.when(p <= low, "too_hard").when(p >= high, "too_easy").otherwise("frontier")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for an empty group."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def uncertainty(metric: str, h: Column, span_max: Column) -> Column:
    """The named score; the span maximum falls back to the mean."""
    if metric == "h":
        return h
    if metric == "h_span_max":
        return F.coalesce(span_max, h)
    raise ValueError(f"unknown uncertainty metric: {metric}")


def histogram_bin(x: Column, bins: int = 20) -> Column:
    """Equal bins on [0, 1], the last closed."""
    return F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")


def operator_choice(u: Column, crossover: float, in_depth: float) -> Column:
    """Operator by cumulative ratios of one uniform number."""
    return F.when(u < crossover, "crossover").when(u < crossover + in_depth, "in_depth").otherwise("in_breadth")


def cadence(step: Column, every: int) -> Column:
    """Whether a hook that runs every so many iterations runs; 0 counts as 1, negative never."""
    every = every or 1
    return F.pmod(step + 1, F.lit(every)) == 0 if every > 0 else F.lit(False)


def warmup(step: Column, steps: int) -> Column:
    return F.least(F.lit(1.0), step / F.lit(float(max(1, steps))))


def unit_hash(*keys: Column, seed: int = 0) -> Column:
    """A reproducible uniform number in [0, 1) of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def md5_unit(key: Column) -> Column:
    """A reproducible uniform number in [0, 1) of a text: its MD5's first 32 bits."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
