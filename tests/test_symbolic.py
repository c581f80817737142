"""Equality of answers: listed pairs, and random expressions against exact arithmetic of their own."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from orrery.functions import symbolic
from orrery.functions.symbolic import equal

SAME = [
    ("1/2", "0.5"), (r"\frac{1}{2}", r"\dfrac12"), (r"3\frac{1}{2}", "7/2"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}"), (r"\sqrt[3]{54}", r"3\sqrt[3]{2}"),
    (r"2\pi r", r"r\cdot 2\pi"), ("(x+1)^2", "x^2+2x+1"), (r"\frac{x^2-1}{x-1}", "x+1"), ("x=5", "5"), ("$5$", "5"), ("1,000", "1000"), (r"\{1,2,3\}", r"\{3,2,1\}"), ("1, 2", "2,1"), ("(1,2)", "(1, 2)"),
    (r"(-\infty, 3]", r"(-\infty,\frac{6}{2}]"), (r"[0,1)\cup(2,3)", r"(2,3)\cup[0,1)"), (r"\pm 2", "2,-2"), (r"1\pm\sqrt{2}", r"1+\sqrt2, 1-\sqrt2"), (r"\sin^2(x)+\cos^2(x)", "1"), (r"e^{i\pi}", "-1"),
    ("2^10", "1024"), ("2**10", "1024"), ("sqrt(2)/2", "1/sqrt(2)"), (r"90^\circ", "90"), (r"50\%", "50"), (r"\ln(e)", "1"), ("exp(2)", "e^2"), ("ab", "ba"), ("3!", "6"), ("i^2", "-1"), (r"\sqrt{-4}", "2i"),
    ("-3^2", "-9"), ("2^{-1}", "1/2"), ("x^{1/2}", r"\sqrt{x}"), (r"5\text{ cm}", "5"), ("1.", "1"), (r"\left(\frac{1}{2},3\right)", "(0.5,3)"), (r"\frac{\pi}{4}", r"\arctan(1)"), ("|-3|", "3"), (r"\log 8", r"3\log 2"),
    ("sqrt(2)*sqrt(3)", "sqrt(6)"), ("2(3+4)", "14"), (r"\{-1,350\}", r"\{350, -1\}"), ("1,234,567/2", "617283.5"),
]
OTHER = [
    ("1", "2"), ("(1,2)", "(2,1)"), ("[0,1)", "[0,1]"), ("x+1", "x-1"), (r"\{1,2\}", r"\{1,3\}"), ("", ""), (None, "1"), ("1", "foo("), ("sqrt(2)", "1.41421"), ("x", "y"), ("1/0", "1/0"), ("pi", "3.14159"),
    ("9^9^9^9", "1"), ("(1,2)", r"\{1,2\}"), (r"\infty", r"-\infty"), ("(((", "((("), ("0.333", "1/3"), ("x^2", "x^3"), ("abc", "abd"), ("2,3", "2"), ("(" * 5000, "1"), ("x" * 100_000, "x" * 100_000), ("1" * 3000, "1" * 3000),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert equal(a, b) and equal(b, a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert not equal(a, b) and not equal(b, a)


def test_tolerance():
    assert equal("pi", "3.14159", 1e-4) and not equal("pi", "3.14", 1e-4) and equal("1/3", "0.33333", 1e-4)


def expression(rng, depth):
    """(text, value at x=3, y=5/7), exact; None as a value for a division by zero."""
    if depth == 0 or rng.random() < 0.2:
        n = rng.randint(0, 9)
        return rng.choice([(str(n), Fraction(n)), ("x", Fraction(3)), ("y", Fraction(5, 7)), (f"0.{n}5", Fraction(10 * n + 5, 100))])
    (a, u), (b, v) = expression(rng, depth - 1), expression(rng, depth - 1)
    if u is None or v is None:
        return a, None
    match rng.randrange(6):
        case 0:
            return rng.choice([f"({a}+{b})", f"[{b} + {a}]"]), u + v
        case 1:
            return f"({a}-({b}))", u - v
        case 2:
            return rng.choice([f"({a})({b})", f"({a})*({b})", rf"({b}) \cdot ({a})"]), u * v
        case 3:
            return rng.choice([rf"\frac{{{a}}}{{{b}}}", f"(({a})/({b}))"]), u / v if v else None
        case 4:
            k = rng.randint(0, 3)
            return f"({a})^{{{k}}}", u**k
    return f"(-({a}))", -u


def test_random_expressions():
    """Both read to the value that exact arithmetic gives; equal expressions agree there, and a changed one is told apart."""
    rng, read, apart = random.Random(7), 0, 0
    point = {"x": 3.0, "y": 5 / 7}
    for _ in range(1500):
        text, value = expression(rng, 3)
        if value is None:
            continue
        try:
            kind, q = symbolic.read(text)
        except (symbolic.Unread, ZeroDivisionError):
            continue
        read += 1
        assert kind == "value" and abs(q.at(point) - complex(value)) <= 1e-6 * max(1, abs(value)), text
        assert equal(text, f"({text}+1)-1") and equal(text, rf"\frac{{2*({text})}}{{2}}")
        apart += not equal(text, f"{text}+x/7")
    assert read > 1000 and apart == read


def test_columns(spark):
    d = spark.createDataFrame([("1/2", "0.5"), (None, "1"), ("x", None), ("[1,2]", "(1,2)"), ("", "")], "a string, b string")
    assert [r[0] for r in d.select(symbolic.same(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]
