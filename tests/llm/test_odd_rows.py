"""Extra columns of clashing names, empty tables, repeated rows, and texts beside others."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import langid, line_dedup, mixing, ngram_join, packing, url_filter

CLASH = ["block", "rate", "start", "u", "gone", "h", "uid", "size", "rank", "part", "row", "key", "digest", "_bucket", "_salt", "copies", "component_id"]


def docs(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return out.withColumns({c: F.lit(f"own {c}") for c in CLASH})


ROWS = [(1, "one two three four five six", "x", "s"), (1, "one two three four five six", "x", "s"), (2, None, None, None), (3, "", "y", "s"), (None, "no id", "x", "t")]


@pytest.mark.parametrize(
    "stage",
    [line_dedup.without_emptied, lambda d: ngram_join.one_per_group(d, 5, 80), mixing.mixed_documents],
    ids=["lines", "near", "mixing"],
)
def test_stages_keep_columns(spark, stage):
    d = docs(spark, ROWS)
    out = stage(d)
    rows = out.collect()
    assert out.columns == d.columns and rows
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH)
    assert stage(d.limit(0)).count() == 0


def test_urls_keep_columns(spark):
    pages = spark.createDataFrame([(1, "http://example.org/es/", "mine", 1.0), (2, None, "mine", 2.0)], "page_id long, url string, block string, best double")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.rules_table(spark)).collect()}
    assert (got[1].block, got[1].verdict, got[2].block, got[2].verdict) == ("mine", "block", "mine", "allow")
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_ids_equal_library_as_it_comes():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_tokenizer())
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        own = packing.ByteTokenizer(f.read())
    texts = ["a <|endoftext|> b", "a\x00b \x00.", "x \x00.y", "<|endoftext|>", " ", "", "a  \n b", "x" + " " * 30_000 + "y" + "\n" * 12_000]
    assert [own(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert len(own(" " * 2_000_000 + "x")) > 0 and len(own("a" * 200_000)) > 0


def test_packing_is_best_fit_decreasing(spark):
    """As many sequences as one piece after another, largest first, each into the tightest gap."""
    rng = random.Random(9)
    for capacity, sizes in ((100, [rng.randint(1, 100) for _ in range(300)]), (64, [rng.choice([0, 7, 9, 20, 33]) for _ in range(300)]), (50, [10] * 120)):
        gaps = []
        for s in sorted((s for s in sizes if s), reverse=True):
            fit = [g for g in gaps if g >= s]
            g = min(fit) if fit else capacity
            if fit:
                gaps.remove(g)
            gaps.append(g - s)
        rows = [(i, s, "u", "p") for i, s in enumerate(sizes)]
        out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, uid string, part string"), capacity=capacity).toPandas()
        assert out[out.length > 0].sequence_id.nunique() == len(gaps) and sorted(out.doc_id) == list(range(len(sizes))) and set(out.uid) == {"u"}
        for _, g in out[out.length > 0].sort_values("offset").groupby("sequence_id"):
            assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all() and g.length.sum() <= capacity
    with pytest.raises(Exception, match="out of range"):
        packing.pack(spark.createDataFrame([(1, 101)], "doc_id long, length long"), capacity=100).collect()


def test_language_of_a_text_alone(spark):
    """A text's n-grams do not depend on its neighbours."""
    texts = ["zu", "où", "the end", "", "a", "ß"]
    grams = langid.Grams()
    found, starts, _ = grams(texts)
    ends = np.append(starts[1:], found.shape[1])
    for t, a, b in zip(texts, starts, ends, strict=True):
        alone, _, _ = grams([t])
        assert (found[:, a:b] == alone).all()


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m, common in ((10, 12, 8), (150, 150, 140), (1000, 700, 650), (5, 400, 3)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        x, y = pool[:n], pool[n - common : n - common + m]
        apart = len(np.setxor1d(x, y))
        assert ngram_join.least_apart(ngram_join.parities(x), ngram_join.parities(y)) <= apart


def test_lines_near_misses(spark):
    """Many lines with one or two words of the same line changed: removed if and only if an earlier one reaches the similarity."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(1 + i % 3):
            w[rng.randrange(60)] = f"x{i}{k}"
        rows.append((i, " ".join(w)))
    sets, want = [], {}
    for i, t in rows:
        w = t.split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        want[i] = "" if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in sets) else t
        sets.append(s)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_language_takes_only_texts_to_python(spark):
    """Columns that Arrow has no form for stay beside the texts, which are labelled once and in small pieces."""
    docs = spark.createDataFrame([(i, "be or not to be", "e") for i in range(9)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    out = langid.predict(docs.withColumn("gap", F.expr("make_interval(1)")), model).where(langid.accepted())
    assert out.where("gap is not null and lang_pred = 'e'").count() == 9
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert max(sum(map(len, c)) for c in langid._chunks(pa.array(["x" * 1000] * 1000))) < 1 << 17


def test_pipeline_batches_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Of the pipeline, Python gets texts in pieces of a few MB; the session's setting comes back."""
    import corpus_pipeline
    from orrery.llm.common import BATCH_BYTES, BATCH_CONF

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefg "), 300).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(packing, "pack_documents", lambda docs: docs.mapInArrow(sizes, "n long"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("packing", corpus_pipeline.pack_sequences)])
    before = spark.conf.get(BATCH_CONF)
    found = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(found) > 2 and max(found) < 2 * BATCH_BYTES
    assert spark.conf.get(BATCH_CONF) == before


def test_line_tables_of_hashes_have_no_dictionaries(spark, monkeypatch):
    """Every line is written with one word of parities, and its hashes without a dictionary."""
    import pyarrow.parquet as pq

    kept = {}

    def look(df, tag, *rest, **more):
        out = stage(df, tag, *rest, **more)
        kept[tag] = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in out.inputFiles()]
        return out

    stage = line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", look)
    line_dedup.line_decisions(spark.createDataFrame([(1, "a b c d e f\ng h"), (2, "a b c d e f\nx")], "doc_id long, text string"))
    groups = [m.row_group(0) for m in kept["line-rows"] if m.num_row_groups]
    assert groups and {"b0", "b1"}.isdisjoint(g.column(i).path_in_schema for g in groups for i in range(g.num_columns))
    assert not any("DICTIONARY" in e for g in groups for i in range(g.num_columns) for e in g.column(i).encodings)
