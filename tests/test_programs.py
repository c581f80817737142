"""Programs in replies against brute force; archives and training sets by round trips and restarts."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import programs as P
from orrery.sources import files
from orrery.streaming import training_set

LINES = ["import math", "def generate(s):", "    return 1", "    x = (", "    )", "x = '''", "'''", "text here", "# note", "", "  y = 2", "generate = 3"]


def by_trying(code):
    lines = code.strip().splitlines()
    for end in range(len(lines), 0, -1):
        text = "\n".join(lines[:end]).strip()
        try:
            if any(isinstance(n, ast.FunctionDef) and n.name == "generate" for n in ast.walk(ast.parse(text))):
                return text
        except SyntaxError:
            pass
    return None


def test_longest_program_against_all_runs():
    rng, found = random.Random(5), 0
    for _ in range(6000):
        code = "\n".join(rng.choices(LINES, k=rng.randint(0, 9)))
        want = by_trying(code)
        found += want is not None
        assert P.longest_program(code) == want, code
    assert found > 100


def test_quoted_examples_lose():
    quoted = "For inspection only:\n```python\nimport a\ndef generate(s):\n    return 0\n```\n" + "-" * 300
    own = "\n```python\ndef generate(s):\n    return 1\n```\n"
    assert P.best_program(quoted + own).endswith("return 1")
    assert P.best_program(None) is None and P.best_program("") is None


@pytest.mark.parametrize(
    ("problem", "answer", "want"),
    [("Solve x^2 - 5x + 6 = 0", "2, 3", True), ("Solve x^2 - 5x + 6 = 0", "2, 4", False), ("Solve 1/x = 0", "0", True), ("Solve open(x) = 0", "1", True), (None, "1", True), ("Solve x = 0", None, False)],
)
def test_put_back(spark, problem, answer, want):
    """What cannot be read or divided falls back to whether the answer has numbers."""
    row = spark.createDataFrame([(problem, answer)], "p string, a string")
    assert row.select(P.verified(F.col("p"), F.col("a")).alias("v")).first().v is want


def test_rewards_one_by_one_and_in_lists(spark, tmp_path):
    (tmp_path / "r.py").write_text("def one(a, b, k=1):\n    return {'overall': k * (a == b)}\ndef many(a, b):\n    return [{'overall': float(x == y), 'format': 1} for x, y in zip(a, b)]\n")
    rows = spark.createDataFrame([("x", "x"), ("x", "y")], "a string, b string")
    one = P.rewarded(rows, P.load_function(str(tmp_path / "r.py"), "one", k=2), "a", "b")
    assert sorted(r.reward.overall for r in one.collect()) == [0.0, 2.0]
    many = P.rewarded(rows, P.load_function(str(tmp_path / "r.py"), "many"), "a", "b", batch=True)
    assert sorted((r.reward.overall, r.reward.accuracy, r.reward.format) for r in many.collect()) == [(0.0, None, 1.0), (1.0, None, 1.0)]
    with pytest.raises(AttributeError):
        P.load_function(str(tmp_path / "r.py"), "none")


def test_archive_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, s, float(s % 3)) for s in range(6)] + [(1, 2, 9, 5.0)], "h_bin int, div_bin int, seq long, rq double")
    champions = rows.where("seq in (2, 9)")
    files.save_archive(champions, rows, str(tmp_path / "a"))
    kept, reservoir = files.load_archive(spark, str(tmp_path / "a"), 3)
    columns = ["h_bin", "div_bin", "seq", "rq"]
    assert sorted(map(tuple, kept.select(columns).collect())) == sorted(map(tuple, champions.collect()))
    assert sorted(r.seq for r in reservoir.collect()) == [1, 2, 5, 9]


def test_programs_round_trip(spark, tmp_path):
    full = ("line\n\"q\"", "a", None, 1, 0.1, 1.0, 0.5, 0.25, 0, 1, "r", 7, {"k": "v"})
    rows = spark.createDataFrame([full, ("", "b", "a", 2, *[None] * 9)], files.PROGRAM)
    files.save_programs(rows, str(tmp_path / "p"))
    assert sorted(map(tuple, files.load_programs(spark, str(tmp_path / "p")).collect()), key=lambda r: r[1]) == sorted(map(tuple, rows.collect()), key=lambda r: r[1])
    (tmp_path / "one.json").write_text(json.dumps(dict(zip(rows.columns, full, strict=True)), indent=2))
    assert tuple(files.load_programs(spark, str(tmp_path / "one.json"), one_a_file=True).first()) == full


def test_training_set_swaps_and_keys_are_used_once(spark, tmp_path):
    swap, once = str(tmp_path / "set"), str(tmp_path / "once")
    assert training_set.current(spark, swap) is None
    schema = "k int, v string"
    batches = [[(1, "a"), (1, "b"), (None, "n")], [(1, "c"), (2, "d"), (None, "m")]]
    write = training_set.unused_into(once, str(tmp_path / "keys"), ["k"])
    for number in (0, 1, 1):  # the last batch runs again after a restart
        batch = spark.createDataFrame(batches[number], schema)
        training_set.swap_into(swap)(batch, number)
        write(batch, number)
    assert training_set.current(spark, swap).count() == 3
    got = [sorted(r.v for r in spark.read.parquet(f"{once}/version={n}").collect()) for n in (0, 1)]
    assert got == [["a", "n"], ["d"]]
