"""Rules over syntax trees against a naive walker, and sources without labels against trees."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import source as S

GOOD = "import random\ndef generate(seed):\n    rng = random.Random(seed)\n    return str(rng.random()), '1'\n"


@pytest.mark.parametrize(
    ("text", "rules"),
    [
        (GOOD, []),
        ("def generate(:", ["syntax"]),
        ("a\x00b", ["syntax"]),
        ("(" * 2000, ["syntax"]),
        (GOOD + "x = eval('1')", ["forbidden_text"]),
        (GOOD + "x = EVAL('1')", ["forbidden_text"]),
        ("import math\n", ["no_entry"]),
        ("class A:\n    def generate(self): pass\n", []),
        ("async def generate(s): pass\n", ["no_entry", "top_level_statement"]),
        ("import numpy.linalg\n" + GOOD, ["import"]),
        ("import math, json, re\n" + GOOD, ["import", "import"]),
        ("from . import x\n" + GOOD, []),
        ("from collections.abc import Iterator\n" + GOOD, []),
        ("from random import choice, Random\n" + GOOD, ["unseeded_import"]),
        ("from sympy.ntheory import randprime, isprime\n" + GOOD, ["unseeded_import"]),
        ("from secrets import choice\n" + GOOD, ["import"]),
        ("for i in range(3): pass\n" + GOOD, ["top_level_statement"]),
        ("if 1:\n    import json\n" + GOOD, ["top_level_statement"]),
        ("'text'\n1\n" + GOOD, []),
        ("math.floor(1)\n" + GOOD, ["top_level_statement"]),
        (GOOD + "    random.choice([1])\n", ["unseeded_call"]),
        (GOOD + "    sympy.randprime(1, 9)\n    sympy.prime(3)\n", ["unseeded_call"]),
        (GOOD + "    np.random.rand(3)\n    numpy.random.seed(1)\n    a.np.random.rand()\n", ["unseeded_call", "unseeded_call"]),
        (GOOD + "    secrets.token_hex()\n", ["unseeded_call"]),
        (GOOD + "    os.urandom(3)\n    os.getcwd()\n", ["forbidden_text", "unseeded_call"]),
        (GOOD + "    '''random.choice(1)'''\n    rng.choice(1)\n    random.choice\n", []),
        (GOOD + "    while True:\n        pass\n", ["endless_loop"]),
        (GOOD + "    while 'x':\n        while 1: x = 2\n", ["endless_loop", "endless_loop"]),
        (GOOD + "    while 1:\n        if x: break\n    while 0: pass\n    while x: pass\n    while True:\n        raise E\n", []),
        ("", ["no_entry"]),
    ],
)
def test_rules(text, rules):
    assert [f[0] for f in S.findings(text)] == rules


STATEMENTS = [
    "import math", "import os, json", "from random import choice", "from sympy import randint", "x = 1", "y: int = 2", "'a text'", '"""more\ntext"""', "3", "CONCEPT_TYPE = 'geo'",
    "CONCEPT_REASON: str = 'é 日'", "CONCEPT_GROUP = 'algebra'", "CONCEPT_GROUP: str = 'a'", "CONCEPT_TYPE = CONCEPT_GROUP = 'b'", "a.CONCEPT_TYPE = 1", "def generate(s):\n    'doc'\n    return random.choice(s)",
    "def f():\n    while True: pass", "@g\ndef h():\n    while 1:\n        return 2", "print(1)", "for i in x:\n    CONCEPT_TYPE = 'in'", "class A:\n    def generate(s): np.random.rand()", "# a note", "", "CONCEPT_REASON = (\n  'x'\n  'y'\n)", "é = 'ö'",
]


def programs(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        parts, text = rng.choices(STATEMENTS, k=rng.randint(0, 7)), ""
        for p in parts:
            simple = "\n" not in p and not p.startswith(("def", "class", "for", "@", "#")) and p
            joined = text and simple and rng.random() < 0.3 and text.rstrip("\r\n").split("\n")[-1].split("\r")[-1][:1] not in " #\t'\")" and ":\n" not in text[-30:]
            if joined:
                text = text.rstrip("\r\n") + rng.choice(["; ", ";", " ; "])
            text += p + rng.choice(["\n", "\r\n", "  # end\n", "\n\n"])
        text = text if rng.random() < 0.7 else text.rstrip()
        try:
            ast.parse(text)
        except SyntaxError:
            continue
        yield text


def walked(text):
    """How often each rule holds, by walking over all nodes."""
    tree = ast.parse(text)
    nodes = list(ast.walk(tree))
    count = dict.fromkeys(S.RULES, 0)
    count["forbidden_text"] = sum(t in text.lower() for t in S.FORBIDDEN)
    count["no_entry"] = int("generate" not in [n.name for n in nodes if type(n) is ast.FunctionDef])
    for n in tree.body:
        if isinstance(n, ast.Import):
            count["import"] += sum(a.name.split(".")[0] not in S.MODULES for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            count["import"] += n.module.split(".")[0] not in S.MODULES
            count["unseeded_import"] += sum((n.module == "random" and a.name != "Random") or (n.module[:5] == "sympy" and a.name[:4] == "rand") for a in n.names)
        elif type(n) not in (ast.FunctionDef, ast.ClassDef, ast.Assign, ast.AnnAssign) and not (type(n) is ast.Expr and type(n.value) is ast.Constant):
            count["top_level_statement"] += 1
    for n in nodes:
        if isinstance(n, ast.Call):
            name = ast.unparse(n.func)
            count["unseeded_call"] += name.startswith(("random.", "np.random.", "sympy.rand")) and name != "random.Random"
        if isinstance(n, ast.While):
            count["endless_loop"] += isinstance(n.test, ast.Constant) and "return" not in ast.unparse(n)
    return {k: v for k, v in count.items() if v}


def test_rules_against_a_walk():
    seen = 0
    for text in programs(4000, 1):
        got = {}
        for rule, _, _ in S.findings(text):
            got[rule] = got.get(rule, 0) + 1
        assert got == walked(text), text
        seen += 1
    assert seen > 2000


def test_labels_go_and_lines_stay():
    changed = 0
    for text in programs(6000, 2):
        out = S.without_labels(text)
        tree = ast.parse(text)
        label = lambda n: {t.id for t in (n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []) if isinstance(t, ast.Name)}
        kept = [n for n in tree.body if not (isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)) and not label(n) & S.LABELS]
        want = [ast.dump(n) for n in kept if S.GROUP not in label(n)] + [ast.dump(n) for n in kept if S.GROUP in label(n)]
        assert [ast.dump(n) for n in ast.parse(out).body] == want, text
        assert S.without_labels(out) == out, text
        touched = {k for n in tree.body if n not in kept or S.GROUP in label(n) for k in range(n.lineno, n.end_lineno + 1)}
        rest = [line for k, line in enumerate(text.encode().splitlines(), 1) if k not in touched]
        at = iter(out.encode().splitlines())
        assert all(line in at for line in rest), text  # in order, byte by byte
        changed += out != text
    assert changed > 1000


def test_columns(spark):
    rows = [(GOOD + "CONCEPT_GROUP = 'g'  # note\n'tail'",), (None,), ("def (",), ("",), ("CONCEPT_GROUP = f'{x}'\nCONCEPT_GROUP = 'second'",)]
    d = spark.createDataFrame(rows, "s string")
    got = d.select(F.transform(S.lint("s"), lambda f: f["rule"]).alias("r"), S.stripped(F.col("s")).alias("t"), S.constant(F.col("s"), "CONCEPT_GROUP").alias("g")).collect()
    assert [x.r for x in got] == [[], None, ["syntax"], ["no_entry"], ["no_entry"]]
    assert [x.t for x in got][:4] == [GOOD + "CONCEPT_GROUP = 'g'\n", None, "def (", ""]
    assert [x.g for x in got] == ["g", None, None, None, "second"]
