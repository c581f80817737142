"""Whether two answers are the same mathematical object: numbers, expressions, intervals, tuples, sets and equations.

An answer, plain or LaTeX, becomes a quotient of polynomials with rational coefficients in variables
and in what stays symbolic: roots of integers, pi, e, i, and functions of such quotients.
Two answers are equal if cross-multiplying leaves nothing.  Where it leaves something that
may still be nothing (functions, roots of expressions), both are evaluated at fixed points.  What cannot be
read is equal to nothing.  Parsing needs Python: a Pandas UDF on Arrow batches.
"""

from __future__ import annotations

import cmath
import math
import re
from fractions import Fraction
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of what is written out: an exponent, the terms of a polynomial, digits of a number, the length of an answer.
MOST_POWER, MOST_TERMS, MOST_DIGITS, MOST_CHARS, MOST_ROOT = 64, 400, 400, 2_000, 10**12
#: Fixed points of evaluation, and how far values may differ there relative to their size.
POINTS, NEAR = (0.7390851, 1.3247179, 2.2955871), 1e-9
FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "asin": cmath.asin, "acos": cmath.acos, "atan": cmath.atan, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "abs": abs}
NAMES = {"arcsin": "asin", "arccos": "acos", "arctan": "atan"}
CONSTANTS = {"pi": math.pi, "e": math.e}
TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|\\?([A-Za-z]+)|([-+*/^()\[\]{},=|!]))")
#: LaTeX that only sets, and words for signs.
GONE = re.compile(r"\\(?:left|right|displaystyle|limits|,|;|!|:|quad|qquad|mathrm|mathbf|operatorname)(?![A-Za-z])|\\?\$|\\ |~|\\?%|\^\{?\\circ\}?|\\text\{[^{}]*\}|\.$")
SIGNS = [(r"\\[dt]frac", r"\\frac"), (r"\\(?:cdot|times|ast)(?![A-Za-z])|·|×", "*"), (r"\\div(?![A-Za-z])|÷", "/"), (r"−|–", "-"), ("π", r"\\pi "), ("∞|\\boo\\b", r"\\infty "), (r"\*\*", "^"), (r"∪", r"\\cup "), ("√", r"\\sqrt "), (r"\\[lr]brace|\\([{}])", lambda m: "⦃" if m[0][1:] in ("lbrace", "{") else "⦄")]
#: A comma between thousands, where no brackets make it part of a list.
THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")

Monomial = tuple[tuple[object, int], ...]
Polynomial = dict[Monomial, Fraction]


class Unread(ValueError):
    """Not an expression that is read here."""


def _plus(p: Polynomial, q: Polynomial, times: int = 1) -> Polynomial:
    out = dict(p)
    for m, c in q.items():
        c = out.get(m, 0) + times * c
        if c:
            out[m] = c
        else:
            out.pop(m, None)
    return out


def _times(p: Polynomial, q: Polynomial) -> Polynomial:
    out: Polynomial = {}
    for (m, c), (n, d) in product(p.items(), q.items()):
        powers, factor = dict(m), c * d
        for atom, k in n:
            powers[atom] = powers.get(atom, 0) + k
        for atom in [a for a in powers if isinstance(a, tuple) and a[0] == "root"]:
            _, base, k = atom  # a k-th root: k of them are its base
            factor *= Fraction(base) ** (powers[atom] // k)
            powers[atom] %= k
        if "i" in powers:
            factor *= (-1) ** (powers["i"] // 2)
            powers["i"] %= 2
        key = tuple(sorted(((a, k) for a, k in powers.items() if k), key=repr))
        out = _plus(out, {key: factor})
        if len(out) > MOST_TERMS:
            raise Unread
    return out


def number(x: Fraction | int) -> Quotient:
    return Quotient({(): Fraction(x)} if x else {}, {(): Fraction(1)})


def atom(a: object) -> Quotient:
    return Quotient({((a, 1),): Fraction(1)}, {(): Fraction(1)})


class Quotient:
    """A quotient of two polynomials; not reduced, so compare by cross-multiplying."""

    def __init__(self, top: Polynomial, low: Polynomial):
        if not low:
            raise Unread
        if len(low) == 1 and () in low:
            top, low = {m: c / low[()] for m, c in top.items()}, {(): Fraction(1)}
        self.top, self.low = top, low

    def __add__(self, o: Quotient) -> Quotient:
        return Quotient(_plus(_times(self.top, o.low), _times(o.top, self.low)), _times(self.low, o.low))

    def __mul__(self, o: Quotient) -> Quotient:
        return Quotient(_times(self.top, o.top), _times(self.low, o.low))

    def __truediv__(self, o: Quotient) -> Quotient:
        return Quotient(_times(self.top, o.low), _times(self.low, o.top))

    def rational(self) -> Fraction | None:
        """Its value if nothing is symbolic."""
        if set(self.top) <= {()} and set(self.low) == {()}:
            return self.top.get((), Fraction(0))
        return None

    def __pow__(self, o: Quotient) -> Quotient:
        k = o.rational()
        if k is None or abs(k.numerator) > MOST_POWER:
            if self.top == {(("e", 1),): 1} and self.low == {(): 1}:
                return function("exp", o)
            return atom(("power", self.key(), o.key(), self, o))
        if k.denominator != 1:
            return root(self, k.denominator) ** number(k.numerator)
        out = number(1)
        for _ in range(abs(k.numerator)):
            out = out * self
        r = out.rational()
        if r is not None and max(abs(r.numerator), r.denominator) > 10**MOST_DIGITS:
            raise Unread
        return number(1) / out if k < 0 else out

    def key(self) -> str:
        return repr(sorted(((repr(m), c) for m, c in self.top.items()))) + repr(sorted(((repr(m), c) for m, c in self.low.items())))

    def exact(self) -> bool:
        """Whether cross-multiplying decides: no functions, and roots at most of distinct primes' products of one degree."""
        kinds = {a for p in (self.top, self.low) for m in p for a, _ in m}
        return all(isinstance(a, str) and a not in ("pi", "e") for a in kinds)

    def names(self) -> set[str]:
        out = set()
        for a in {a for p in (self.top, self.low) for m in p for a, _ in m}:
            if isinstance(a, str):
                out |= {a} - {"i", *CONSTANTS}
            elif a[0] != "root":
                out |= {n for x in a if isinstance(x, Quotient) for n in x.names()}
        return out

    def at(self, point: dict[str, float]) -> complex:
        def of(a: object) -> complex:
            match a:
                case "i":
                    return 1j
                case str():
                    return CONSTANTS[a] if a in CONSTANTS else point[a]
                case ("root", base, k):
                    return complex(base) ** (1 / k)
                case ("power", _, _, base, k):
                    return base.at(point) ** k.at(point)
                case (name, _, x):
                    return FUNCTIONS[name](x.at(point))

        def value(p: Polynomial) -> complex:
            return sum((complex(float(c)) * math.prod((of(a) ** k for a, k in m), start=1) for m, c in p.items()), 0j)

        return value(self.top) / value(self.low)


def function(name: str, x: Quotient) -> Quotient:
    r = x.rational()
    if r == 0 and name in ("sin", "tan", "asin", "atan"):
        return number(0)
    if (r == 0 and name in ("cos", "exp")) or (name == "ln" and x.key() == atom("e").key()):
        return number(1)
    if r == 1 and name in ("ln", "log"):
        return number(0)
    if name == "abs" and r is not None:
        return number(abs(r))
    return atom((name, x.key(), x))


def root(x: Quotient, k: int) -> Quotient:
    """The k-th root: of rationals by their integers' prime powers, of the rest as it stands."""
    r = x.rational()
    if r is None or k > MOST_POWER or max(abs(r.numerator), r.denominator) > MOST_ROOT:
        return atom(("power", x.key(), number(Fraction(1, k)).key(), x, number(Fraction(1, k))))
    out = number(1)
    if r < 0:
        if k == 2:
            out = atom("i")
        elif k % 2:
            out = number(-1)
        else:
            raise Unread
    # a/b has the root of a * b^(k-1), over b.
    n, rest, p = abs(r.numerator), r.denominator, 2
    out = out * number(Fraction(1, rest))
    n *= rest ** (k - 1)
    while p * p <= n and p < 10**6:
        at = 0
        while n % p == 0:
            n, at = n // p, at + 1
        out = out * number(p ** (at // k)) * (atom(("root", p, k)) ** number(at % k))
        p += 1 + (p > 2)
    return out * atom(("root", n, k)) if n > 1 else out if n else number(0)


class _Reader:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise Unread(text)
            at = m.end()
            n, word, sign = m.groups()
            if n:
                self.tokens.append(("number", n))
            elif word:
                self.tokens += [("name", w) for w in self.words(word, text[m.start(2) - 1 : m.start(2)] == "\\")]
            else:
                self.tokens.append(("sign", sign))
        self.at = 0

    @staticmethod
    def words(word: str, command: bool) -> list[str]:
        """A LaTeX command and a known name are one word; other letters are variables of their own."""
        word = NAMES.get(word, word)
        if command or word in FUNCTIONS or word in CONSTANTS or word == "sqrt":
            return [word]
        if word in ("infty", "inf", "infinity"):
            return ["infty"]
        return list(word) if len(word) <= 3 else [word]

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *signs: str) -> bool:
        if self.peek() in signs and self.tokens[self.at][0] == "sign":
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise Unread

    def sum(self) -> Quotient:
        out = None
        while True:
            minus = 1
            while self.peek() in ("+", "-") and self.tokens[self.at][0] == "sign":
                minus = -minus if self.peek() == "-" else minus
                self.at += 1
            term = self.product() * number(minus)
            out = term if out is None else out + term
            if self.peek() not in ("+", "-"):
                return out

    def product(self) -> Quotient:
        out = self.power()
        while True:
            if self.take("*"):
                out = out * self.signed()
            elif self.take("/"):
                out = out / self.signed()
            elif self.peek() is not None and (self.tokens[self.at][0] != "sign" or self.peek() in "({"):
                out = out * self.power()
            else:
                return out

    def signed(self) -> Quotient:
        return number(-1) * self.signed() if self.take("-") else self.power()

    def power(self) -> Quotient:
        base = self.primary()
        while self.take("!"):
            r = base.rational()
            if r is None or r.denominator != 1 or not 0 <= r <= 100:
                raise Unread
            base = number(math.factorial(int(r)))
        return base ** self.exponent() if self.take("^") else base

    def exponent(self) -> Quotient:
        if self.take("-"):
            return number(-1) * self.exponent()
        return self.power()

    def group(self) -> Quotient:
        """What braces or brackets hold, or one digit or name."""
        for opening, closing in ("{}", "()"):
            if self.take(opening):
                out = self.sum()
                self.need(closing)
                return out
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "number" and len(word) > 1 and word.isdigit():  # \frac12
            self.tokens[self.at] = (kind, word[1:])
            return number(int(word[0]))
        return self.primary()

    def primary(self) -> Quotient:
        for opening, closing in ("{}", "()", "[]"):
            if self.take(opening):
                out = self.sum()
                self.need(closing)
                return out
        if self.take("|"):
            out = function("abs", self.sum())
            self.need("|")
            return out
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "sign":
            raise Unread
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            if len(word) > MOST_DIGITS:
                raise Unread
            return self.mixed(number(Fraction(word)), word)
        if word == "frac":
            top = self.group()
            return top / self.group()
        if word == "sqrt":
            k = Fraction(2)
            if self.take("["):
                k = self.sum().rational()
                self.need("]")
            if k is None or k.denominator != 1 or k < 1:
                raise Unread
            return root(self.group(), int(k))
        if word in FUNCTIONS:
            k = self.exponent() if self.take("^") else number(1)
            return function(word, self.group() if self.peek() in ("(", "{") else self.power()) ** k
        return atom(word)

    def mixed(self, whole: Quotient, word: str) -> Quotient:
        """3\\frac{1}{2} is a sum of numbers."""
        at = self.at
        if self.peek() == "frac" and word.isdigit():
            part = self.primary()
            r = part.rational()
            if r is not None and 0 < r < 1:
                return whole + part
            self.at = at
        return whole


def _cut(text: str, sign: str) -> list[str]:
    """Parts between signs outside of all brackets."""
    parts, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([{⦃") - (c in ")]}⦄")
        if c == sign and depth == 0:
            parts.append(text[at:k])
            at = k + 1
    return [*parts, text[at:]]


def read(text: str) -> tuple:
    """An answer: ("set", parts), ("list", opening, closing, parts), ("infinity", sign) or ("value", quotient)."""
    for pattern, by in [(GONE.pattern, ""), *SIGNS]:
        text = re.sub(pattern, by, text.strip())
    text = text.strip()
    if not text or len(text) > MOST_CHARS:
        raise Unread
    if not set(text) & set("([⦃"):
        text = THOUSANDS.sub("", text)
    union = re.split(r"\\cup(?![A-Za-z])|\bU\b", text)
    if len(union) > 1:
        return ("set", [read(u) for u in union])
    sides = _cut(text, "=")
    if len(sides) == 2 and re.fullmatch(r"\s*(?:\\?[A-Za-z]+|[A-Za-z]_?\{?\w*\}?\(?[a-z]?\)?)\s*", sides[0]):
        return read(sides[1])
    either = re.split(r"\\pm(?![A-Za-z])|±", text)
    if len(either) == 2:
        return ("set", [read(f"{either[0]}+({either[1]})") if either[0].strip() else read(either[1]), read(f"{either[0]}-({either[1]})")])
    if text[0] == "⦃" and text[-1] == "⦄":
        return ("set", [read(p) for p in _cut(text[1:-1], ",")] if text[1:-1].strip() else [])
    if text[0] in "([" and text[-1] in ")]" and len(_cut(text, ",")) == 1 and len(inner := _cut(text[1:-1], ",")) > 1:
        return ("list", text[0], text[-1], [read(p) for p in inner])
    if len(parts := _cut(text, ",")) > 1:
        return ("set", [read(p) for p in parts])
    if m := re.fullmatch(r"([+-]?)\s*(?:\\infty|infty|infinity|inf)", text):
        return ("infinity", m[1] or "+")
    reader = _Reader(text)
    out = reader.sum()
    if reader.at < len(reader.tokens):
        raise Unread
    return ("value", out)


def _same_value(a: Quotient, b: Quotient, tolerance: float) -> bool:
    if not _plus(_times(a.top, b.low), _times(b.top, a.low), -1):
        return True
    if a.exact() and b.exact() and not tolerance:
        return False
    names = sorted(a.names() | b.names())
    if a.names() != b.names() and not (a.exact() and b.exact()) and len(names) > 6:
        return False
    for shift in range(len(POINTS) if names else 1):
        point = {n: POINTS[(k + shift) % len(POINTS)] + k // len(POINTS) for k, n in enumerate(names)}
        x, y = a.at(point), b.at(point)
        if not abs(x - y) <= max(NEAR * max(abs(x), abs(y), 1), tolerance if not names else 0):
            return False
    return True


def _same(a: tuple, b: tuple, tolerance: float) -> bool:
    if a[0] != b[0]:
        return False
    match a[0]:
        case "value":
            return _same_value(a[1], b[1], tolerance)
        case "infinity":
            return a[1] == b[1]
        case "list":
            return a[1:3] == b[1:3] and len(a[3]) == len(b[3]) and all(_same(x, y, tolerance) for x, y in zip(a[3], b[3], strict=True))
    # Sets: each has its like in the other.
    return all(any(_same(x, y, tolerance) for y in q) for p, q in ((a[1], b[1]), (b[1], a[1])) for x in p)


def equal(a: str | None, b: str | None, tolerance: float = 0.0) -> bool:
    """Whether both can be read and are the same; numbers may differ by ``tolerance``."""
    try:
        return a is not None and b is not None and _same(read(a), read(b), tolerance)
    except (Unread, ArithmeticError, RecursionError, ValueError, KeyError, TypeError):
        return False


def same(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """:func:`equal` of two columns; never null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([equal(p, q, tolerance) for p, q in zip(x, y, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")(a, b)
