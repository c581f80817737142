"""All queries and the pipeline in a session with no settings of its own, over documents with odd columns and rows."""

import os
import subprocess
import sys

from orrery.llm import topk, url_filter

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.checkpoint.dir", None) is None
import corpus_pipeline
from orrery.llm import queries
from orrery.llm.common import stage
for name, q in queries.queries().items():
    if name not in {skip!r}:
        print(name, q(spark, "/root/testdata/sf0.001").count(), flush=True)
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
rows = [(None, "sans id le la", "x", "s"), (70001, None, None, None), (70002, "", "x", "s"), (70003, "mot " * 60_000, "x", "t"), (70004, "le texte", "x", None), (70004, "le texte", "x", None)]
docs = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source").schema))
extra = {{"score": F.lit(-7.0), "lang_pred": F.lit("mine"), "a.b": F.lit("dot"), "m": F.create_map(F.lit("k"), F.lit("v")), "row": F.lit("r"), "size": F.lit("s"), "key": F.lit(3)}}
docs = docs.withColumns(extra)
for empty in (False, True):
    d = docs.limit(0) if empty else docs
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, d, None), "x")
        if name != "packing":
            assert out.columns == docs.columns, (name, out.columns)
            odd = out.where("score <> -7.0 or lang_pred <> 'mine' or `a.b` <> 'dot' or m['k'] <> 'v' or `row` <> 'r' or size <> 's' or `key` <> 3")
            assert odd.count() == 0 and (out.count() > 0) != empty, name
        d = out
    print("stages", d.count(), flush=True)
"""


def test_plain_session(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = SCRIPT.format(repo=repo, skip=["op8_ngram_jaccard", "op9_line_dedup", "op4_best_fit_packing", "op11_sentencepiece", "op12_fill_middle", "op13_periodic_runs", "op7_mixing"])
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("stages") == 2 and "op1_url_filter" in done.stdout


def test_large_components(spark):
    """Scores beyond doubles and longs are ranked as integers."""
    rows = [(0, [1e10, 1.0]), (50, [1e10, 2.0]), (2, [1e10, 2.0]), (3, [-1e10, 0.5]), (4, [3e12, 1.0]), (5, [1.0, 1.0]), (6, [2.0**60, 1.0]), (7, [2.0**60, -1.0]), (8, [1.0, 2.0, 3.0]), (9, None), (10, [float("inf"), 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(topk.quantized(d), "vec_id % 50 = 0", 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ints = {i: [int(256 * x // 1) for x in v] for i, v in rows if v and len(v) == 2 and v[0] != float("inf")}
    for q in (0, 50):
        exact = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:4]
        assert got[q] == [(i, min(-s, 2**63 - 1)) for s, i in exact]


def test_hosts_of_many_labels(spark):
    long = "http://" + "a." * 40_000 + "example.org/es/x"
    pages = spark.createDataFrame([(1, long), (2, "http://" + "." * 50_000 + "/"), (3, "http://org/"), (4, "http://example.org./es/"), (5, "http://xexample.org/es/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_table(spark)).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: ("org/", "allow"), 4: (None, "allow"), 5: ("org/", "allow")}
