"""Token-level math on array columns, one row per sequence, without exploding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def _zero() -> Column:
    return F.lit(0.0)


def total(a: Column) -> Column:
    return F.aggregate(a, _zero(), lambda s, x: s + x)


def masked_sum(a: Column, mask: Column) -> Column:
    return total(F.zip_with(a, mask, lambda x, m: x * m.cast("double")))


def masked_mean(a: Column, mask: Column) -> Column:
    """Mean of the masked elements; an empty mask counts as one element of 0."""
    return masked_sum(a, mask) / F.greatest(total(F.transform(mask, lambda m: m.cast("double"))), F.lit(1.0))


def response_mask(ids: Column, eos: int) -> Column:
    """Ones up to and with the first end token."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Running count of the mask, less one, at least 0."""
    start = F.struct(F.expr("CAST(array() AS array<int>)").alias("out"), F.lit(0).alias("n"))
    step = lambda s, m: F.struct(
        F.concat(s["out"], F.array(F.greatest(s["n"] + m - 1, F.lit(0)))).alias("out"), (s["n"] + m).alias("n")
    )
    return F.aggregate(mask, start, step, lambda s: s["out"])


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """R = r + gamma * R from the right; stored, then reset where the mask is 0."""
    start = F.struct(F.expr("CAST(array() AS array<double>)").alias("out"), _zero().alias("carry"))

    def step(s: Column, e: Column) -> Column:
        r = e["r"] + F.lit(gamma) * s["carry"]
        return F.struct(F.concat(F.array(r), s["out"]).alias("out"), (r * e["m"].cast("double")).alias("carry"))

    zipped = F.reverse(F.zip_with(rewards, mask, lambda r, m: F.struct(r.alias("r"), m.alias("m"))))
    return F.aggregate(zipped, start, step, lambda s: s["out"])


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalized advantages by a scan from the right; the value after the last is 0."""
    start = F.struct(F.expr("CAST(array() AS array<double>)").alias("out"), _zero().alias("adv"), _zero().alias("next"))

    def step(s: Column, e: Column) -> Column:
        adv = e["r"] + F.lit(gamma) * s["next"] - e["v"] + F.lit(gamma * lam) * s["adv"]
        return F.struct(F.concat(F.array(adv), s["out"]).alias("out"), adv.alias("adv"), e["v"].alias("next"))

    zipped = F.reverse(F.zip_with(rewards, values, lambda r, v: F.struct(r.alias("r"), v.alias("v"))))
    return F.aggregate(zipped, start, step, lambda s: s["out"])


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token KL estimate of two log-probability arrays."""
    diff = lambda a, b: a - b
    kinds = {
        "kl": diff,
        "abs": lambda a, b: F.abs(a - b),
        "mse": lambda a, b: F.lit(0.5) * (a - b) * (a - b),
        "low_var_kl": lambda a, b: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(b - a) - (b - a) - 1)),
    }
    if kind not in kinds:
        raise ValueError(f"unknown KL estimator: {kind}")
    return F.zip_with(logp, ref, kinds[kind])


def entropy_of_logits(z: Column) -> Column:
    """logsumexp(z) - sum softmax(z) * z, shifted by the maximum."""
    top = F.array_max(z)
    e = total(F.transform(z, lambda x: F.exp(x - top)))
    return F.ln(e) + top - total(F.transform(z, lambda x: F.exp(x - top) * x)) / e


def logp_of_label(z: Column, label: Column) -> Column:
    top = F.array_max(z)
    return F.element_at(z, (label + 1).cast("int")) - top - F.ln(total(F.transform(z, lambda x: F.exp(x - top))))


def entropy_of_top_logprobs(lp: Column, vocabulary: int) -> Column:
    """Entropy of the observed probabilities plus a uniform tail over the rest of the vocabulary."""
    observed = -total(F.transform(lp, lambda x: F.exp(x) * x))
    tail = F.lit(1.0) - total(F.transform(lp, F.exp))
    rest = F.lit(float(vocabulary)) - F.size(lp)
    return observed + F.when((tail > 1e-8) & (rest > 0), -tail * F.ln(tail / rest)).otherwise(0.0)


def at_last_valid(score: Column, mask: Column) -> Column:
    """The score at the last masked position, 0 elsewhere."""
    last = F.aggregate(mask, F.lit(0), lambda s, m: s + m) - 1
    return F.transform(mask, lambda m, i: F.when(i == last, score).otherwise(F.lit(0.0)))


def pad_or_cut(a: Column, length: int, pad: Column, left: bool = False) -> Column:
    """Exactly ``length`` elements: cut, or padded on one side."""
    fill = F.array_repeat(pad, F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    cut = F.slice(a, F.greatest(F.size(a) - length + 1, F.lit(1)), F.lit(length)) if left else F.slice(a, 1, length)
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def clipped_policy_loss(ratio: Column, adv: Column, low: float, high: float, dual: float) -> Column:
    """Dual-clip policy loss of one token."""
    clipped = F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    worst = F.greatest(-adv * ratio, -adv * clipped)
    return F.when(adv < 0, F.least(worst, -adv * dual)).otherwise(worst)


def clipped_value_loss(v: Column, old: Column, ret: Column, clip: float) -> Column:
    bound = F.greatest(old - clip, F.least(old + clip, v))
    return F.lit(0.5) * F.greatest((v - ret) * (v - ret), (bound - ret) * (bound - ret))
