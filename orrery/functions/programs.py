"""Generated programs and their problems: code in replies, near labels, answers put back, rewards of one's own.

Texts are only parsed, never run.  What needs a parser is a Pandas UDF on Arrow batches; the rest
are column expressions.
"""

from __future__ import annotations

import ast
import difflib
import importlib.util
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import numbers_in, parse_number

# Marks in replies, weights of a piece of code, patterns of problems, similarity of labels.
ENTRY = "generate"
MARKERS = ["<|im_sep|>", "<|endoftext|>"]
FENCE = r"```(?:python)?\s*\n(.*?)```"
STARTS = ("import ", "from ", "def generate")
QUOTED_CONTEXT, CONTEXT_CHARS, QUOTED_WEIGHT = ("for inspection", "do not follow"), 240, -20
PASS_WEIGHT, IMPORT_WEIGHT, ENTRY_WEIGHT, PLACE_CHARS, PLACE_MOST = -10, 5, 3, 5000, 4
EQUATION = r"[Ss]olve\s+(?:the\s+equation:?\s*)?(.+?)\s*=\s*0"
MODULAR = r"(\d+)\s*[·*x]\s*[≡=]\s*(\d+)\s*\(?\s*mod\s+(\d+)"
ROOT_TOLERANCE, LABEL_CUTOFF = 1e-6, 0.6
# End of fixed values.


def _defines_entry(code: str) -> tuple[bool, int]:
    """Whether the code parses and defines the entry point; and the line that keeps it from parsing, 0 if none does."""
    try:
        nodes = ast.walk(ast.parse(code))
    except SyntaxError as e:
        return False, e.lineno or 1
    except (ValueError, RecursionError, MemoryError):
        return False, 1
    return any(isinstance(n, ast.FunctionDef) and n.name == ENTRY for n in nodes), 0


def longest_program(code: str) -> str | None:
    """The longest run of first lines that parses and defines the entry point."""
    lines = code.strip().splitlines()
    while lines:
        text = "\n".join(lines).strip()
        good, bad_line = _defines_entry(text)
        if good:
            return text
        if not bad_line:
            return None  # what the whole does not define, no part does
        # No run that holds the line at fault parses, as what follows a line cannot mend it.
        del lines[min(len(lines) - 1, max(bad_line - 1, 0)) :]
    return None


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(place, code) of fenced blocks, of what starts at a line of code, and of the whole text."""
    yield from ((m.start(), m.group(1)) for m in re.finditer(FENCE, text, re.DOTALL))
    at = 0
    for line in text.splitlines(keepends=True):
        if line.lstrip().startswith(STARTS):
            yield at, text[at:]
        at += len(line)
    yield len(text), text


def best_program(text: str | None) -> str | None:
    """The program of a reply: the piece of the largest weight, the last of those; null if none defines the entry point."""
    if not text or f"def {ENTRY}" not in text:
        return None
    for mark in MARKERS:
        text = text.replace(mark, "")
    best = None
    for place, piece in _pieces(text):
        code = longest_program(piece.split("```")[0]) if f"def {ENTRY}" in piece else None
        if code is None:
            continue
        before = text[max(place - CONTEXT_CHARS, 0) : place].lower()
        weight = min(place // PLACE_CHARS, PLACE_MOST)
        for holds, w in (
            (any(q in before for q in QUOTED_CONTEXT), QUOTED_WEIGHT),
            ("pass" in code, PASS_WEIGHT),
            (re.search(r"(?m)^\s*(import|from)\s", code), IMPORT_WEIGHT),
            (re.search(rf"(?m)^\s*def\s+{ENTRY}\b", code), ENTRY_WEIGHT),
        ):
            weight += w if holds else 0
        if best is None or (weight, place) >= best[:2]:
            best = (weight, place, code)
    if best is None:
        return None
    code = best[2]
    return f"import random\n{code}" if "random." in code and not re.search(r"(?m)^\s*import\s+random\b", code) else code


def program_in(reply: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(best_program)

    return F.pandas_udf(run, "string")(reply)


def nearest_label(label: Column, known: list[str], cutoff: float = LABEL_CUTOFF) -> Column:
    """The known ``group.name`` whose name is most like that of the label, within its group; known labels are themselves."""

    def run(labels: pd.Series) -> pd.Series:
        names: dict[str, list[str]] = {}
        for k in known:
            group, _, name = k.partition(".")
            names.setdefault(group, []).append(name)

        def near(x: str | None) -> str | None:
            group, dot, name = (x or "").strip().partition(".")
            found = difflib.get_close_matches(name, names.get(group, []), 1, cutoff) if dot else []
            return f"{group}.{found[0]}" if found else None

        return labels.map(near)

    return F.when(label.isin(*known), label).otherwise(F.pandas_udf(run, "string")(label))


def _polynomial(node: ast.AST, x: float) -> float:
    match node:
        case ast.Expression():
            return _polynomial(node.body, x)
        case ast.Constant(value=int() | float()):
            return float(node.value)
        case ast.Name(id="x"):
            return x
        case ast.UnaryOp(op=ast.UAdd() | ast.USub()):
            v = _polynomial(node.operand, x)
            return -v if isinstance(node.op, ast.USub) else v
        case ast.BinOp(op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() | ast.Pow()):
            a, b = _polynomial(node.left, x), _polynomial(node.right, x)
            match node.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return a / b
            return a**b
    raise ValueError("not an expression in x")


def all_roots(expression: Column, numbers: Column) -> Column:
    """Whether there are numbers and the expression in x vanishes at each; null if it cannot be read."""

    def run(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(text: str | None, xs) -> bool | None:
            if text is None:
                return None
            try:
                plain = re.sub(r"(?<=[\dx)])\s*(?=[x(])", "*", text.replace("^", "**"))
                tree = ast.parse(plain.strip(), mode="eval")
                return len(xs) > 0 and all(abs(_polynomial(tree, float(x))) <= ROOT_TOLERANCE for x in xs)
            except (SyntaxError, ValueError, ArithmeticError, RecursionError, TypeError):
                return None

        return pd.Series([one(t, x) for t, x in zip(texts, values, strict=True)], dtype=object)

    return F.pandas_udf(run, "boolean")(expression, numbers)


def verified(problem: Column, answer: Column) -> Column:
    """The answer put back into its problem: roots of an equation, else a congruence, else any number at all."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(problem, pattern, k), F.lit(""))
    a, b, p = (part(MODULAR, k).try_cast("double") for k in (1, 2, 3))
    numbers, value = numbers_in(answer), parse_number(answer)
    congruent = F.pmod(a * value, p) == F.pmod(b, p)
    return F.coalesce(all_roots(part(EQUATION, 1), numbers), F.when(p > 0, congruent), F.size(numbers) > 0, F.lit(False))


REWARD = "overall double, accuracy double, format double"


def load_function(path: str, name: str, **options) -> Callable:
    """The function ``name`` of a Python file that the user trusts, with ``options`` given to it."""
    from functools import partial

    spec = importlib.util.spec_from_file_location("reward_of_user", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    return partial(getattr(module, name), **options)


def rewarded(rows: DataFrame, function: Callable, response: str, truth: str, batch: bool = False) -> DataFrame:
    """``rows`` and a struct ``reward``: of (response, truth) one by one, or of two lists for each Arrow batch.

    The function gives a dict with ``overall`` and, if it has them, ``accuracy`` and ``format``.
    """

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = function(list(a), list(b)) if batch else [function(x, y) for x, y in zip(a, b, strict=True)]
        if len(got) != len(a):
            raise ValueError("the reward function must give a score for each response")
        return pd.DataFrame({k: [float(g[k]) if g.get(k) is not None else None for g in got] for k in ("overall", "accuracy", "format")}, dtype=float)

    return rows.withColumn("reward", F.pandas_udf(run, REWARD)(response, truth))
