"""SentencePiece ids, fill-in-the-middle and periodic runs against the library, brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import fill_middle, periodic, pieces

CLASH = {"row": "own row", "key": "own key", "ids": "own ids", "n": "own n", "at": "own at", "a": "own a", "runs": "own runs", "h1": "own h1", "end": "own end"}
ODD = ["", None, " ", "\n", "\n\n\n", "a", "a\nb", "no end", "ends\n", "é\n日本\n🙂", "a\r\nb\x0bc\x0cd", "x <P> y", "<S>", "<M", "<\n<", "a\x00b\n", "la la la la la la la", "▁", "x" * 70_000, "a b " * 30_000, "word\n" * 20_000]


def table(spark, rows=None):
    if rows is None:
        rows = list(enumerate(ODD)) + [(0, ""), (6, "a\nb"), (6, "a\nb"), (6, "other\ntext\n"), (None, "no id\nx\n"), (None, "no id\nx\n"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASH.items()}).withColumn("a.b", F.lit(1))


def by_row(df, *cols):
    return sorted(((r.doc_id, r.text, *(r[c] for c in cols)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    with open(pieces.default_model(), "rb") as f:
        return pieces.PieceTokenizer(f.read())


def test_ids_and_texts_equal_library(own, library):
    rng = random.Random(3)
    letters = list("abcdefghijklmnoprstuvwxyz     \n\t.,é日🙂▁0123ing<>è\x00")
    texts = [t or "" for t in ODD] + ["<s>", "</s>", "<0x0A>", "<unk>", "⁇", " ⁇ ", "�", "▁▁ ▁a", " " * 5_000, "ab" * 3_000, "́"]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(4_000)]
    tokens = list(own.id)
    texts += ["".join(rng.choices(tokens, k=rng.randint(1, 8))) for _ in range(3_000)]
    for t in texts:
        ids = library.encode(t)
        assert list(own.encode(t)) == ids, t
        assert own.decode([*ids, 2]) == library.decode([*ids, 2]), t
    for _ in range(4_000):  # ids that no text gives: broken bytes, unknown and control ids
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_parts_that_come_often_stay_known(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PARTS", 16)
    with open(pieces.default_model(), "rb") as f:
        own = pieces.PieceTokenizer(f.read())
    asked, find = [], own._encode_known
    monkeypatch.setattr(own, "_encode_known", lambda text: asked.append(text) or find(text))
    text = " ".join(f"house w{k}" for k in range(200))
    assert list(own.encode(text)) == library.encode(text)
    assert asked.count("▁house") == 1


def test_tables_of_pieces(spark, library):
    d = table(spark)
    out = pieces.with_ids(d)
    assert set(out.columns) == {*d.columns, "decoded"}
    want = [(i, t, [*library.encode(t or ""), 2], library.decode([*library.encode(t or ""), 2])) for i, t in ((r.doc_id, r.text) for r in d.collect())]
    assert by_row(out, "ids", "decoded") == sorted(want, key=repr)
    assert all(r[c] == v for r in out.collect() for c, v in CLASH.items() if c != "ids")
    assert pieces.with_ids(d.limit(0)).count() == 0
    assert pieces.with_ids(d.where("doc_id = 1"), end=False).first().ids == []


def middle_by_hand(key, text, percent=100, spm=50):
    text = text or ""
    x = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= percent:
        return n, "plain", text, None, None
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_middle(spark, percent, spm):
    rng = random.Random(percent)
    rows = [(i, "".join(rng.choice(["a", "\n", "é🙂", "<P", ">", "\r"]) for _ in range(rng.randint(0, 60)))) for i in range(100, 160)]
    d = table(spark).union(table(spark, rows))
    out = fill_middle.transform(d, percent=percent, spm_percent=spm)
    assert set(out.columns) == {*d.columns, "form", "output", "prefix_chars", "middle_chars"}
    want = [(r.doc_id, r.text, *middle_by_hand(r.doc_id, r.text, percent, spm)) for r in d.collect()]
    assert by_row(out, "n", "form", "output", "prefix_chars", "middle_chars") == sorted(want, key=repr)
    back = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert back.where("back <> coalesce(text, '')").count() == 0
    assert fill_middle.transform(d.limit(0)).count() == 0


def test_fill_middle_units_and_marks(spark):
    """Words as units, marks with pattern characters in them."""
    d = spark.createDataFrame([(i, "one two  three. four ") for i in range(30)], "doc_id long, text string")
    marks = ("[.]", "(*", "|")
    out = fill_middle.transform(d, units=r"\S*\s+|\S+", marks=marks)
    rows = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == r.text and r.n == 4 for r in rows)
    assert {r.prefix_chars for r in rows} <= {0, 4, 9, 16, 21} and len({r.prefix_chars for r in rows}) > 2


def runs_by_trying(words, least, times):
    """All maximal stretches for every period, the least period of each."""
    n, out = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                out.setdefault((s, i + p), p)
    return sorted((s, e, p) for (s, e), p in out.items())


def periodic_words(rng):
    kind, n = rng.random(), rng.randint(0, 60)
    if kind < 0.5:
        return [rng.randint(0, 1 if kind < 0.3 else 3) for _ in range(n)]
    out = []
    while len(out) < n:
        out += [rng.randint(0, 2) for _ in range(rng.randint(1, 5))] * rng.randint(1, 6)
        if rng.random() < 0.4:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randint(1, 30)]
    return out


def test_runs_by_trying():
    rng = random.Random(1)
    for _ in range(700):
        words = periodic_words(rng)
        for least, times in ((6, 4), (2, 2), (3, 3)):
            got = periodic.find_runs(np.array([*words, -1]), least, times)
            assert [tuple(r) for r in got.tolist()] == runs_by_trying(words, least, times), (words, least, times)


def test_previous_factors_by_trying():
    rng = random.Random(4)
    for _ in range(150):
        s = [*periodic_words(rng), -1]
        length, source = periodic.previous_factors(periodic.Names(np.array(s)))
        for i in range(len(s)):
            best = max((next((k for k in range(len(s) - i + 1) if i + k == len(s) or s[i + k] != s[j + k]), 0) for j in range(i)), default=0)
            assert length[i] == best and (best == 0) == (source[i] < 0)
            assert s[i : i + best] == s[source[i] : source[i] + best] and source[i] < i


def collapsed_by_hand(words):
    runs = [(s, e - s, p) for s, e, p in runs_by_trying(words, 6, 4)]
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("block_words", [1, 50, 1 << 18])
def test_tables_of_runs(spark, block_words):
    rng = random.Random(block_words)
    d = table(spark).where("doc_id < 18 or doc_id is null").union(table(spark, [(100 + i, " ".join(map(str, periodic_words(rng)))) for i in range(80)]))
    out = periodic.with_runs(d, block_words=block_words)
    assert set(out.columns) == {*d.columns, "collapsed"}
    want = [(r.doc_id, r.text, *collapsed_by_hand(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in d.collect()]
    assert by_row(out.withColumn("runs", F.col("runs")), "runs", "collapsed") == sorted(want, key=repr)
    assert periodic.with_runs(d.limit(0)).count() == 0


def test_very_long_runs(spark):
    d = spark.createDataFrame([(1, "a b " * 60_000), (2, "x " * 50_000 + "y " + "x " * 50_000), (3, ("p q r " * 5 + "z ") * 4_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.with_runs(d).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 120_000, 2)] and got[1].collapsed == "a b"
    assert [tuple(x) for x in got[2].runs] == [(0, 50_000, 1), (50_001, 50_000, 1)] and got[2].collapsed == "x y x"
    assert len(got[3].runs) == 4_001 and tuple(got[3].runs[1]) == (0, 64_000, 16) and got[3].collapsed == "p q r z"


def test_query_of_runs(spark, tmp_path):
    """Planting and digests over a documents table."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(None, "a a a a a a a"), (500, None), (501, " \n ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in periodic.query(spark, str(tmp_path)).collect()}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, short = collapsed_by_hand(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        assert got[key] == (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(short.encode()).hexdigest()), key
