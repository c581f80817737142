"""Scalar functions by truth tables, folds against windows, partitions by invariants, sources and streams by round trips."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import arrays, scoring, text
from orrery.operators import archive, partition
from orrery.plans import registry
from orrery.sources import files
from orrery.streaming import archive as stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("h", "want"), [(-1.0, 0), (0.0, 0), (49.9, 0), (50.0, 1), (500.0, 9), (900.0, 9), (float("nan"), 9)])
def test_value_bin(spark, h, want):
    assert value(spark, scoring.value_bin(F.lit(h), 0, 500, 10)) == want


def test_frontier_passes_unknown_rates(spark):
    assert value(spark, scoring.is_frontier(F.lit(None).cast("double"), 0.3, 0.7))
    assert not value(spark, scoring.is_frontier(F.lit(0.3), 0.3, 0.7))


@pytest.mark.parametrize(
    ("f", "arg", "want"),
    [
        (text.boxed, r"\boxed{1} and \boxed{\frac{3}{4}}", r"\frac{3}{4}"),
        (text.boxed, "nothing", None),
        (text.boxed_greedy, r"\boxed{1} and \boxed{2}", r"1} and \boxed{2"),
        (text.parse_number, "$1,234.50$", 1234.5),
        (text.parse_number, "5d", None),
        (text.parse_number, "1_000", None),
        (text.decimals, "24.310", 3),
        (text.first_letter, "the answer is C", "C"),
    ],
)
def test_extraction(spark, f, arg, want):
    assert value(spark, f(F.lit(arg))) == want


def test_long_text_does_not_overflow(spark):
    assert value(spark, text.boxed(F.lit("x" * 40_000 + r"\boxed{7}"))) == "7"
    assert value(spark, F.length(text.final_answer(F.lit("Final Answer:" + "a" * 40_000 + "\n")))) == 40_000


@pytest.mark.parametrize(("pred", "ref", "want"), [("50.73", "50.7", True), ("50.4", "50", False), ("50.8", "50.7", False)])
def test_rounding(spark, pred, ref, want):
    assert value(spark, text.rounding_recovered(F.lit(pred), F.lit(ref))) is want


def test_token_arrays(spark):
    ids = F.array(*[F.lit(x) for x in (0, 0, 2, 4, 3, 5, 1, 0, 0)])
    assert value(spark, arrays.response_mask(ids, 1)) == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    r, m = F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)), F.array(F.lit(1), F.lit(1), F.lit(0))
    assert value(spark, arrays.discounted_returns(r, m, 0.5)) == [1.0, 0.0, 2.0]
    assert value(spark, arrays.position_ids(F.array(F.lit(0), F.lit(1), F.lit(1)))) == [0, 0, 1]


def test_partitions_cover_and_balance():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(4, 40))]
        parts = partition.largest_differencing(sizes, 4)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and all(parts)
    parts = partition.largest_differencing([5, 4, 3, 2, 1, 1], 2, equal_size=True)
    assert [len(p) for p in parts] == [3, 3]
    assert abs(sum(sizes[i] for i in parts[0]) - sum(sizes[i] for i in parts[1])) >= 0


def candidates(n=200, seed=5):
    rng = random.Random(seed)
    return [
        {"archive_id": "a", "seq": i, "program_id": str(i), "rq": round(rng.random(), 2), "h_bin": rng.randint(0, 2), "div_bin": rng.randint(0, 2), "valid": True, "behaviour": None, "template": None}
        for i in range(n)
    ]


SCHEMA = "archive_id string, seq long, program_id string, rq double, h_bin int, div_bin int, valid boolean, behaviour string, template string"


def test_replay_equals_window_without_gates(spark):
    df = spark.createDataFrame([tuple(c.values()) for c in candidates()], SCHEMA)
    fold = {r.seq: r.status == "inserted" for r in archive.replay(df).collect()}
    window = {r.seq: r.accepted for r in archive.running_champion(df).collect()}
    assert fold == window


def test_gates():
    fold = archive.Fold()
    c = {"program_id": "p", "rq": 1.0, "h_bin": 0, "div_bin": 0, "valid": True, "behaviour": "b", "template": "t"}
    assert fold.insert(c)["status"] == "inserted"
    assert fold.insert(c | {"program_id": "q", "rq": 2.0})["duplicate_of"] == "p"
    assert fold.insert(c | {"program_id": "q", "behaviour": "x"})["status"] == "template_duplicate_rejected"
    assert fold.insert(c | {"program_id": "q", "valid": False})["status"] == "seed_variation_rejected"
    assert fold.insert(c | {"rq": 3.0, "h_bin": 1})["status"] == "inserted" and list(fold.champions) == [(1, 0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = candidates(60)
    rng = random.Random(3)
    order = rows[:]
    rng.shuffle(order)
    for k in range(3):
        (tmp_path / f"in{k}.json").write_text("\n".join(json.dumps(r) for r in order[k * 20 : k * 20 + 20]) + "\n\nnot json\n")
    got = stream.replay_stream(stream.event_stream(spark, f"{tmp_path}/in*.json", SCHEMA))
    q = got.writeStream.format("memory").queryName("replayed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = archive.replay(spark.createDataFrame([tuple(c.values()) for c in rows], SCHEMA)).select("seq", "status").collect()
    assert sorted(map(tuple, spark.table("replayed").select("seq", "status").collect())) == sorted(map(tuple, want))


def test_event_logs(spark, tmp_path):
    (tmp_path / "events_evo_1_step_7.jsonl").write_text('{"event": "a", "event_seq": 1}\n\n{bad\n')
    (tmp_path / "latest_events.jsonl").write_text('{"event": "a", "event_seq": 1}\n')
    good, bad = files.jsonl_tolerant(spark, str(tmp_path))
    assert [(r.event, r.global_step) for r in good.collect()] == [("a", 7)]
    assert [r.line for r in bad.collect()] == ["{bad"]


def test_latest_is_numeric(spark, tmp_path):
    for n in (9, 10):
        (tmp_path / f"evo_step_{n}.json").write_text(json.dumps({"global_step": n}))
    docs = files.json_documents(spark, str(tmp_path), "global_step long")
    assert [r.global_step for r in files.latest(docs).collect()] == [10]


def test_retention_and_zip(spark):
    steps = spark.createDataFrame([(i,) for i in range(1, 7)], "step int")
    assert sorted(r.step for r in files.obsolete(steps, 3, 6).collect()) == [1, 2, 3]
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    assert partition.zip_union(a, a.withColumn("w", F.lit(3)), ["k"]).first().w == 3
    with pytest.raises(Exception, match="differs"):
        partition.zip_union(a, a.withColumn("v", F.lit(9)), ["k"]).collect()


def test_registry_is_consistent():
    q, s = registry.queries(), registry.oracle_sql()
    assert len(q) > 90 and set(s) <= set(q)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["h_bin", "div_bin", "program_id", "seq", "rq"]


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr[-2000:]


def test_lint_query_gives_the_reasons_of_its_sql(spark, tmp_path):
    """Empty and null texts and languages that read as bad answers bring no reason: the SQL has two."""
    texts = [(None, ""), ("", ""), ("  ", ""), ("x" * 4000, ""), ("\U0001f600" * 4000, ""), ("e\u0301" * 2001, "long_problem"), ("{", ""), ("}{", "unfilled_template"), ("{}" * 2001, "long_problem,unfilled_template")]
    langs = ["en", None, "", " ", "None", "NaN", "inf", "0.123456789"]
    rows = [(i, *r) for i, r in enumerate((t, g, want) for t, want in texts for g in langs)]
    spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.reasons for r in registry.queries()["g22_lint_reasons"](spark, str(tmp_path)).collect()}
    assert got == {i: want for i, _, _, want in rows}


def test_lint_has_all_reasons_in_order(spark):
    """The function itself names every reason unless some are asked for."""
    d = spark.createDataFrame([(None, None), (" ", "NaN"), ("{}" * 2001, "0.123456789"), ("x", "1.5")], "p string, a string")
    got = d.select(text.lint_reasons(F.col("p"), F.col("a")).alias("all"), text.lint_reasons(F.col("p"), F.col("a"), only=("bad_answer",)).alias("one")).collect()
    assert [r.all for r in got] == [["empty_problem", "empty_answer"], ["empty_problem", "bad_answer"], ["long_problem", "over_precise", "unfilled_template"], []]
    assert [r.one for r in got] == [[], ["bad_answer"], [], []]
