"""Heuristics against broken problems: one boolean column per rule, so that their counts can be reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers, phrases and patterns that the rules look for.
TRIVIAL = ["0", "1", "-0", "-1", "0.0", "1.0", "-0.0", "-1.0"]
GREATER = r"\b(\d+)\s*>\s*(\d+)\b"
GCD_CLAIMS = [
    r"gcd\s*\([^)]*\)\s*(?:=|is|equals)\s*(\d+)",
    r"gcd\s+(?:of\s+)?[^.]{0,80}?\bis\s+(\d+)",
    r"greatest\s+common\s+divisor[^.]{0,80}?\bis\s+(\d+)",
]
ENOUGH_FOR_AREA = r"\b(angle|included|right\s+triangle|equilateral|isosceles|heron|altitude|height|perimeter|hypotenuse|third\s+side|vertices|coordinates|base)\b"
SIDES = r"sides?\s+(?:of\s+(?:length|lengths?)\s+)?(\d+)\s*(?:,|and)\s*(\d+)(?:\s*(?:,|and)\s*(\d+))?"
RUN_ON_FRACTION = r"\\frac\d{4,}"
FIRST_TERMS = r"sum\s+of\s+(?:the\s+)?first\s+(\d+)\s+terms?"
GCD_VALUE = r"(?:gcd|greatest common divisor)[^.]{0,80}?\b(?:is|equals|=)\s*(\d+)"
LCM_VALUE = r"(?:lcm|least common multiple)[^.]{0,80}?\b(?:is|equals|=)\s*(\d+)"
HINTS = ["coprime", "are reciprocals", "roots are reciprocal", "is a perfect square", "are a pythagorean", "form a pythagorean"]
MEANS = ["arithmetic mean", "geometric mean", "harmonic mean", "average of", "am-gm", "am gm"]
ASSIGNED = r"\b([a-z])\s*=\s*(-?\d+(?:\.\d+)?)\b"
FLAT_ANGLE = r"(?<!\d)(?:0|180)\s*(?:°|degrees?)"
CORNERS = r"\b(\d+)[\-\s]+(?:vertex|vertices|sided|sides)\b"
COMMITTEE = r"committees?\s+of\s+size[s]?\s+(\d+)(?:\s+and\s+(\d+))?"
PEOPLE = [r"group\s+of\s+(\d+)\s+people", r"(\d+)\s+people"]
GIVEN = ["given that", "such that the", "given the value"]
# End of fixed values.

RULES = [
    "trivial_count", "false_inequality", "gcd_claim", "open_triangle", "run_on_fraction", "short_sum",
    "gcd_and_lcm", "hint", "equal_variables", "flat_figure", "whole_committee", "answer_given",
]


def _has(text: Column, *words: str) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _int(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match as a number, null if it takes no part."""
    return F.regexp_extract(text, pattern, group).try_cast("bigint")


def broken_rules(problem: Column, answer: Column) -> dict[str, Column]:
    """Whether each rule of ``RULES`` speaks against a problem; nulls count as empty texts."""
    p = F.lower(F.trim(F.coalesce(problem, F.lit(""))))
    a = F.trim(F.coalesce(answer, F.lit("")))
    trivial = a.isin(TRIVIAL)
    out: dict[str, Column] = {}
    counting = _has(p, "exactly") & _has(p, "fixed point", "their original")
    out["trivial_count"] = trivial & (counting | p.rlike(r"first\s+1\s+term") | (_has(p, "single element") & _has(p, "product")))
    left, right = (F.regexp_extract_all(p, F.lit(GREATER), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(left.alias("l"), right.alias("r"))
    out["false_inequality"] = F.exists(pairs, lambda x: x["l"].try_cast("bigint") <= x["r"].try_cast("bigint"))

    # The first claim that is found counts; the two numbers before it must be multiples.
    claim = F.lit(None).cast("struct<g:bigint,v:array<string>>")
    for pattern in reversed(GCD_CLAIMS):
        before = F.regexp_extract(p, rf"(?s)^(.*?){pattern}", 1)
        found = F.struct(_int(p, pattern).alias("g"), F.regexp_extract_all(before, F.lit(r"\b(\d+)\b"), F.lit(1)).alias("v"))
        claim = F.when(p.rlike(pattern), found).otherwise(claim)
    x, y = (F.try_element_at(claim["v"], F.lit(-k)).try_cast("bigint") for k in (2, 1))
    odd = (F.try_mod(x, claim["g"]) != 0) | (F.try_mod(y, claim["g"]) != 0)
    out["gcd_claim"] = _has(p, "gcd", "greatest common divisor") & (claim["g"] > 0) & (x > 0) & (y > 0) & odd

    two_sides = p.rlike(SIDES) & (F.regexp_extract(p, SIDES, 3) == "")
    out["open_triangle"] = _has(p, "triangle") & _has(p, "area") & ~p.rlike(ENOUGH_FOR_AREA) & two_sides
    out["run_on_fraction"] = p.rlike(RUN_ON_FRACTION)
    out["short_sum"] = _int(p, FIRST_TERMS) <= 2
    both = _has(p, "gcd", "greatest common divisor") & _has(p, "lcm", "least common multiple")
    out["gcd_and_lcm"] = both & p.rlike(GCD_VALUE) & p.rlike(LCM_VALUE)
    out["hint"] = _has(p, *HINTS)
    # The first value of each letter; a value that two letters share.
    named = F.arrays_zip(*[F.regexp_extract_all(p, F.lit(ASSIGNED), F.lit(k)).alias(n) for k, n in ((1, "k"), (2, "v"))])
    firsts = F.transform(F.array_distinct(F.transform(named, lambda e: e["k"])), lambda k: F.try_element_at(F.filter(named, lambda e: e["k"] == k), F.lit(1))["v"])
    out["equal_variables"] = _has(p, *MEANS) & (F.size(F.array_distinct(firsts)) < F.size(firsts))
    corners = p.rlike(r"\b(?:polygon|n-gon)\b") & (_int(p, CORNERS) <= 2)
    out["flat_figure"] = (_has(p, "triangle") & p.rlike(FLAT_ANGLE)) | F.coalesce(corners, F.lit(False))
    k, k2 = _int(p, COMMITTEE, 1), _int(p, COMMITTEE, 2)
    n = F.coalesce(*[_int(p, x) for x in PEOPLE])
    split = (k + k2 == n) & ((k == 1) | (k2 == 1))
    out["whole_committee"] = _has(p, "committee") & _has(p, "people") & ((k == n) | ((k == 0) & n.isNotNull()) | F.coalesce(split, F.lit(False)))
    digits = F.translate(a, ".-", "").rlike(r"^\d+$")
    whole = F.when(trivial | digits, F.floor(a.try_cast("double")).cast("bigint") + F.when((a.try_cast("double") < 0) & (a.try_cast("double") != F.floor(a.try_cast("double"))), 1).otherwise(0))
    bare = F.regexp_replace(F.lower(F.coalesce(problem, F.lit(""))), r"\b[a-z]\s*=\s*\d+", "")
    word = F.concat(F.lit(r"\b\Q"), whole.cast("string"), F.lit(r"\E\b"))
    out["answer_given"] = (F.abs(whole) >= 2) & F.regexp_like(F.coalesce(problem, F.lit("")), word) & F.regexp_like(bare, word) & _has(p, *GIVEN)
    return {r: F.coalesce(out[r], F.lit(False)) for r in RULES}


def looks_broken(problem: Column, answer: Column) -> Column:
    rules = broken_rules(problem, answer)
    return F.exists(F.array(*rules.values()), lambda x: x)
