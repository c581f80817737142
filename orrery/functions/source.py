"""Source of generated programs by its syntax tree: what is wrong with it, its constants, and the source without its labels.

Sources are parsed, never run.  Parsing needs Python, so these are Pandas UDFs on Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The entry point, modules that may be imported, texts that may not occur, random sources that ignore a seed, labels.
ENTRY = "generate"
MODULES = {"collections", "fractions", "functools", "itertools", "math", "random", "sympy"}
FORBIDDEN = ["print(", "input(", "open(", "__import__", "eval(", "exec(", "subprocess", "socket", "requests", "urllib", "os.", "sys."]
SEEDED = {"Random"}
DEVICES = {"urandom", "getrandom"}
LABELS, GROUP = {"CONCEPT_TYPE", "CONCEPT_REASON"}, "CONCEPT_GROUP"
# End of fixed values.

#: Calls that ignore a seed, by the name before the last dot.
UNSEEDED: dict[str, Callable[[str], bool]] = {
    "random": lambda f: f not in SEEDED,
    "sympy": lambda f: f.startswith("rand"),
    "secrets": lambda f: True,
    "os": lambda f: f in DEVICES,
    "numpy.random": lambda f: True,
    "np.random": lambda f: True,
}
FINDING = "array<struct<rule:string,detail:string,line:int>>"
#: The rules, in the order of their findings.
RULES = ["syntax", "forbidden_text", "no_entry", "import", "unseeded_import", "top_level_statement", "unseeded_call", "endless_loop"]


def _tree(source: str) -> ast.Module | SyntaxError:
    try:
        return ast.parse(source)
    except SyntaxError as e:
        return e
    except (ValueError, RecursionError, MemoryError) as e:
        return SyntaxError(str(e))


def _dotted(node: ast.expr) -> str | None:
    """``a.b.c`` of names and attributes alone."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None


class _Findings(ast.NodeVisitor):
    """Gathers (rule, detail, line) over one tree."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str, int]] = []
        self.entry = False

    def add(self, rule: str, detail: str, node: ast.AST) -> None:
        self.found.append((rule, detail, node.lineno))

    def top(self, node: ast.stmt) -> None:
        """Statements of the module itself: definitions, assignments, constants and imports of known modules."""
        match node:
            case ast.Import(names=names):
                self.modules([n.name for n in names], node)
            case ast.ImportFrom(module=module, names=names):
                self.modules([module] if module else [], node)
                for n in names:
                    if self.draws(module or "", n.name):
                        self.add("unseeded_import", f"{module}.{n.name}", node)
            case ast.FunctionDef() | ast.ClassDef() | ast.Assign() | ast.AnnAssign() | ast.Expr(value=ast.Constant()):
                pass
            case _:
                self.add("top_level_statement", type(node).__name__, node)

    @staticmethod
    def draws(module: str, name: str) -> bool:
        root = "sympy" if module.startswith("sympy") else module
        return root in ("random", "sympy") and UNSEEDED[root](name)

    def modules(self, names: list[str], node: ast.stmt) -> None:
        for name in names:
            if name.partition(".")[0] not in MODULES:
                self.add("import", name, node)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.entry |= node.name == ENTRY
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        module, _, function = (_dotted(node.func) or "").rpartition(".")
        if module in UNSEEDED and UNSEEDED[module](function):
            self.add("unseeded_call", f"{module}.{function}", node)
        self.generic_visit(node)

    def visit_While(self, node: ast.While) -> None:
        always = isinstance(node.test, ast.Constant) and bool(node.test.value)
        if always and not any(isinstance(n, ast.Break | ast.Return | ast.Raise) for n in ast.walk(node)):
            self.add("endless_loop", "while", node)
        self.generic_visit(node)


def findings(source: str) -> list[tuple[str, str, int]]:
    """(rule, detail, line) by rule and then line; a source that does not parse has that finding alone.  Line 0: the whole."""
    tree = _tree(source)
    if isinstance(tree, SyntaxError):
        return [("syntax", tree.msg or "", tree.lineno or 0)]
    visitor = _Findings()
    for node in tree.body:
        visitor.top(node)
    try:
        visitor.visit(tree)
    except RecursionError:
        return [("syntax", "too deep", 0)]
    lowered = source.lower()
    found = [("forbidden_text", t, 0) for t in FORBIDDEN if t in lowered]
    if not visitor.entry:
        found.append(("no_entry", ENTRY, 0))
    return sorted(found + visitor.found, key=lambda f: (RULES.index(f[0]), f[2]))


def _labels(node: ast.stmt) -> set[str]:
    """Names that a statement assigns to directly."""
    targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
    return {t.id for t in targets if isinstance(t, ast.Name)}


def _fate(node: ast.stmt) -> str:
    """``drop`` for labels and texts that stand alone, ``last`` for the group, else ``keep``."""
    match node:
        case ast.Expr(value=ast.Constant(value=str())):
            return "drop"
    names = _labels(node)
    return "drop" if names & LABELS else "last" if GROUP in names else "keep"


def _shared_lines(body: list[ast.stmt]) -> Iterator[list[ast.stmt]]:
    """Statements of the module, those together that share a line."""
    group: list[ast.stmt] = []
    for node in body:
        if group and node.lineno > group[-1].end_lineno:
            yield group
            group = []
        group.append(node)
    if group:
        yield group


def without_labels(source: str) -> str:
    """The source without top-level texts and labels, its group declared last; all other lines stay byte by byte.

    A source that does not parse, or has nothing of the kind, is returned as it is.  Doing it again changes nothing.
    """
    tree = _tree(source)
    if isinstance(tree, SyntaxError) or all(_fate(n) == "keep" for n in tree.body):
        return source
    lines = re.findall(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", source.encode())
    if lines and lines[0].startswith(b"\xef\xbb\xbf"):
        lines[0] = lines[0][3:]  # positions do not count a byte order mark

    def text(node: ast.stmt) -> bytes:
        part = lines[node.lineno - 1 : node.end_lineno]
        part[-1] = part[-1][: node.end_col_offset]  # the end first: both may be on one line
        part[0] = part[0][node.col_offset :]
        return b"".join(part)

    out, last, at = [], [], 0
    for group in _shared_lines(tree.body):
        first, end = min([group[0], *getattr(group[0], "decorator_list", [])], key=lambda n: n.lineno).lineno, group[-1].end_lineno
        fates = [_fate(n) for n in group]
        last += [text(n) for n, f in zip(group, fates, strict=True) if f == "last"]
        if all(f == "keep" for f in fates):
            continue
        out += lines[at : first - 1]
        kept = [text(n) for n, f in zip(group, fates, strict=True) if f == "keep"]
        if kept:
            out += [b"; ".join(kept), lines[end - 1][group[-1].end_col_offset :].lstrip(b"; ") or b"\n"]
        at = end
    out += lines[at:]
    body = b"".join(out)
    if last and body and not body.endswith((b"\n", b"\r")):
        body += b"\n"
    return (body + b"".join(t + b"\n" for t in last)).decode()


def string_constant(source: str, name: str) -> str | None:
    """The text, trimmed, that the module assigns to ``name`` directly, the first of them; null if none or the source does not parse."""
    tree = _tree(source)
    for node in [] if isinstance(tree, SyntaxError) else tree.body:
        value = getattr(node, "value", None)
        if name in _labels(node) and isinstance(value, ast.Constant) and isinstance(value.value, str):
            return value.value.strip()
    return None


def lint(source: Column) -> Column:
    """Findings of each source as an array of (rule, detail, line); none for a clean one, null for null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else [dict(zip(("rule", "detail", "line"), f, strict=True)) for f in findings(s)])

    return F.pandas_udf(run, FINDING)(source)


def stripped(source: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(without_labels, na_action="ignore")

    return F.pandas_udf(run, "string")(source)


def constant(source: Column, name: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else string_constant(s, name))

    return F.pandas_udf(run, "string")(source)
