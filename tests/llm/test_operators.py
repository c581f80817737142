"""Each operator against brute force, an exact round trip or held-out labels, on small tables with odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import langid, line_dedup, mixing, near_vectors, ngram_join, packing, topk, toxicity, url_filter, warc
from orrery.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=0, n=40):
    rng, rows = random.Random(seed), []
    base = [words(rng, rng.randint(1, 80)) for _ in range(n)]
    for i, t in enumerate(base):
        rows.append((i, t, "xy"[i % 2], None if i % 7 == 0 else f"s{i % 3}"))
        if i % 4 == 0:  # near copies
            w = t.split()
            w[len(w) // 2] = "changed"
            rows.append((1000 + i, " ".join(w), "x", "s1"))
    rows += [(2000, base[3], "x", "s0"), (2000, base[3], "x", "s0"), (2001, None, None, None), (2002, "", "y", "s1"), (2003, " \n\t", "y", "s2"), (2004, "A b", "x", "s0"), (2005, "a  B", "x", "s0"), (None, "no id here", "x", "s0")]
    return rows


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(edges, {x for e in edges for x in e})
    assert got == {k: want[k] for k in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2?x", "example.org", "/en/2", "org/", "allow"),
        ("https://notexample.com/de/", "notexample.com", "/de/", "com/de/", "block"),
        ("https://x.net/de/", "x.net", "/de/", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://org#f", "org", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "old"), (1, url, "old")], "page_id long, url string, verdict string")
    rows = url_filter.judge_urls(df, url_filter.rules_table(spark)).collect()
    assert len(rows) == 2
    assert (rows[0].host, rows[0].path, rows[0].rule, rows[0].verdict) == (host, path, rule, verdict)


def test_toxicity_learns_pairs():
    rng = random.Random(1)
    terms = toxicity.Terms()
    rows = []
    for _ in range(3000):  # toxic only where both words meet
        a, b = rng.random() < 0.5, rng.random() < 0.5
        t = words(rng, 6) + (" insult" if a else "") + (" group" if b else "")
        rows.append((terms(t), int(a and b)))
    m = toxicity.fit_rows(rows)

    def score(t):
        ids = terms(t)
        v = m.latent[m.slot[ids]]
        s = v.sum(axis=0)
        return m.bias + m.linear[ids].sum() + 0.5 / max(len(ids), 1) * (s @ s - (v * v).sum())

    assert score("insult group") > max(score("insult"), score("group"), score("other"))


def test_toxicity_learns_pairs_of_long_texts(spark):
    """Toxic is one combination of insult and group and not the other: each word alone says nothing."""
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(1500)]
    rows = []
    for i in range(4000):
        a, b = rng.randint(0, 1), rng.randint(0, 1)
        text = rng.choices(pool, k=200) + [("vile", "dull")[a], ("group", "other")[b]]
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(a == b)))
    terms = toxicity.Terms()
    model = toxicity.fit_rows([(terms(t), y) for _, t, y in rows[:3200]])
    docs = spark.createDataFrame(rows[3200:], "doc_id long, text string, toxic int")
    got = toxicity.score(docs, model).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    # Without pairs nothing is found, so none is made up.
    shuffled = [(terms(t), rng.randint(0, 1)) for _, t, _ in rows[:1000]]
    assert not toxicity.fit_rows(shuffled).latent.any()


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_language(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["thing", "other", "with"] if i % 2 else ["être", "où", "garçon"]) for _ in range(20)), "ef"[i % 2 == 0]) for i in range(200)]
    rows += [(900, None, "e"), (901, "123 !!", "e"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(langid.training_rows(docs))).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i < 900)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))


def test_language_learns_every_lang(spark):
    """300 languages, the last ones the rarest."""
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(300)]
    rows = [(1000 * k + i, f"{s} {s} {s}", f"l{k:03}") for k, s in enumerate(stems) for i in range(4 if k < 250 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == sorted({r[2] for r in rows})
    got = langid.predict(docs, model).collect()
    rare = [r for r in got if r.lang >= "l250"]
    assert len(got) == len(rows) and sum(r.lang_pred == r.lang for r in rare) >= 0.9 * len(rare)


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * 0.02).tolist(), i % 2 if i % 11 else None) for i in range(150)]
    rows += [(200, [0.0] * 16, 0), (201, None, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 1), (204, base[0].tolist(), 0), (205, base[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    ok = [(i, np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for i, v, a in ok for j, w, b in ok if i < j and a == b and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
    want = components(links, {r[0] for r in rows})
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_links == sum(i in e for e in links) for i in got)


def test_near_vectors_negative_zero(spark):
    rows = [(1, [-0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, -0.0], 0), (4, [-0.0, -0.0], 0), (5, [-0.0, 1.0], None)]
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
        assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True)}


def test_near_vectors_forest(spark):
    """More vectors of one label than a leaf holds: many groups of ten, one tight group of more than two leaves."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(250, 24))
    x = np.concatenate([base[np.arange(2500) % 250] + rng.normal(size=(2500, 24)) * 0.1, rng.normal(size=24) + rng.normal(size=(900, 24)) * 0.08])
    assert len(x) > 8 * near_vectors.LEAF and 900 > 2 * near_vectors.LEAF
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_vectors(df).toPandas().set_index("vec_id").sort_index()
    true, found = near.sum(axis=1), got.n_links.to_numpy()
    assert len(got) == len(x) and (found <= true).all()  # a pair that meets in several leaves counts once
    assert found.sum() >= 0.95 * true.sum() and found[:2500].sum() >= 0.9 * true[:2500].sum()
    want = components(np.argwhere(near).tolist(), range(len(x)))
    wrong = sum(want[i] != c for i, c in got.component_id.items())
    assert wrong <= 0.01 * len(x)
    print("links found", found.sum() / true.sum(), "outside the tight group", found[:2500].sum() / true[:2500].sum(), "wrong components", wrong)


def test_tokenizer_equals_library():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = packing.ByteTokenizer(f.read())
    rng = random.Random(4)
    bits = ["a", "b", "'s", " ", "  ", "\n", "\t", ".", ",", "1", "é", "\xa0", "'", "<|endoftext|>", "漢", "\x1c", "!?", "½", " .", "\r\n", "hello", " World"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [own(t) for t in texts] == want


def test_packing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 5, 30, 64, 100, 100, 100]) if i % 2 else rng.randint(1, 100)) for i in range(400)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), capacity=100).toPandas()
    assert sorted(zip(out.doc_id, out.length, strict=True)) == rows
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 100 and (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all()
    assert out.sequence_id.nunique() <= -(-sum(n for _, n in rows) // 100) * 1.02 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0


def test_packing_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, "word " * 5000), (3, ""), (3, "")], "doc_id long, text string")
    pieces = packing.tokenize_pieces(docs, packing.default_tokenizer(), capacity=1024).toPandas()
    assert all(len(r.ids) == 4 * r.length for r in pieces.itertuples())
    long = pieces[pieces.doc_id == 2].sort_values("piece")
    assert (long.length.iloc[1:] == 1024).all() and (long.start.to_numpy() == np.r_[0, long.length.cumsum()[:-1]]).all()
    assert (pieces[pieces.doc_id != 2].length == 1).all() and len(pieces[pieces.doc_id == 3]) == 2


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-5, 5, 8).tolist()) for i in range(300)] + [(1000 + i, [1] * 8) for i in range(40)] + [(2000, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).toPandas()
    for q, v in rows:
        if q % 50 == 0:
            want = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            mine = got[got.query_id == q].sort_values("rank")
            assert list(zip(-mine.score, mine.vec_id, strict=True)) == want


def test_mixing(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    out = mixing.mix(mixing.sizes_of(df), F.col("size")).toPandas()
    assert len(out) == df.count() and out.copies.between(0, 3).all()
    for _, g in out.groupby("source", dropna=False):
        assert g.source_size.iloc[0] == g["size"].sum() and g.target.iloc[0] <= 3 * g["size"].sum() + 1e-9
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 3 * max(g["size"].max(), 1)
    assert abs(out.groupby("source", dropna=False).target.first().sum() - out["size"].sum()) < 1e-6
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == out.copies.sum()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, n, percent):
    rows = corpus()
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), n, percent).collect()
    sets = {}
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(links, ids)
    assert len(got) == len(rows)
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)


def test_one_per_group(spark):
    out = ngram_join.one_per_group(spark.createDataFrame(corpus(), DOCS), 3, 90)
    assert out.columns == ["doc_id", "text", "lang", "source"] and out.where("doc_id = 2000").count() == 0 and out.where("doc_id is null").count() == 1


def test_one_per_group_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    near = b + " more"
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "w"), (1, b, "w"), (2, near, "x"), (3, c, "x"), (3, d, "x"), (3, None, "x"), (0, c, "x"), (4, a + " z", "x"), (None, a, "x")]
    out = ngram_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3, 80).collect()
    want = [(1, a, "x"), (1, b, "w"), (3, d, "x"), (3, None, "x"), (0, c, "x"), (None, a, "x")]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_lines(spark):
    rng = random.Random(3)
    pool = [words(rng, rng.randint(1, 60)) for _ in range(30)]
    rows = []
    for i in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.6 else words(rng, 30) for _ in range(6)]
        lines = [ln.replace(ln.split()[-1], "x", 1).upper() if rng.random() < 0.3 else ln for ln in lines]
        rows.append((i, "\n".join([*lines, "", lines[0]])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (103, rows[0][1])]

    def tokens(line):
        w = re.split("[ \t\r\x0b\f]+", line.lower().strip(" \t\r\x0b\f"))
        w = [x for x in w if x]
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else None)

    seen, want = [], {}
    for i, t in rows:
        if t is None or i in want:
            want.setdefault(i, t)
            continue
        kept = []
        for line in t.split("\n"):
            k = tokens(line)
            if k is None or not any(9 * len(k & s) >= 4 * (len(k) + len(s)) for s in seen):
                kept.append(line)
            if k is not None:
                seen.append(k)
        want[i] = "\n".join(kept)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.text == want[r.doc_id] for r in got)


def test_warc(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\n", "same"), (3, None, None), (4, "u", ""), (5, "http://c/", "é" * 50_000), (None, "x", "same"), (7, "y", "other")]
    got = {r.record_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 7
    for i, _, html in rows:
        r = got[f"urn:page:{'null' if i is None else i}"]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.digest32(raw))
        last = max(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", f"urn:page:{last}"))


def test_warc_refuses_damage():
    raw = warc.encode_record("urn:page:1", "http://a/", b"body", None, "2024-01-01T00:00:00Z")
    assert warc.decode_record(raw)["payload"] == b"body"
    for bad in (raw.replace(b"body", b"b0dy"), raw[:-3], raw.replace(b"WARC/1.1", b"WARX/1.1")):
        with pytest.raises(ValueError):
            warc.decode_record(bad)


def test_dictionary_frame():
    import zstandard

    samples = [b"<html><head><title>%d</title></head>" % i * 20 for i in range(400)]
    d = zstandard.train_dictionary(4096, samples).as_bytes()
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    records = [warc.encode_record(f"urn:page:{i}", None, s, None, "d") for i, s in enumerate(samples[:5])]
    archive = warc.skippable_frame(d) + b"".join(map(c.compress, records))
    assert [r["payload"] for r in warc.read_archive(archive)] == samples[:5]
    with pytest.raises(ValueError):
        list(warc.read_archive(archive[:-4]))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(0)
    rows = [(i, "\n".join(words(rng, 30) for _ in range(4)), "xy"[i % 2], f"s{i % 3}", 1) for i in range(60)]
    rows += [(900 + i, rows[i][1], "x", "s0", 1) for i in range(10)] + [(950, "123", "x", "s0", 3), (951, None, "x", "s0", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) <= set(range(60)) and out.length.max() <= 2048
    assert out.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize(("rows", "length"), [(4000, 20), (12000, 20), (4000, 200), (12000, 200)])
def test_toxicity_pairs_by_sample_and_length(rows, length):
    """Toxic is one combination of insult and group and not the other, in short and long texts, few and many labels."""
    rng = random.Random(rows + length)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(1500)]
    terms, made = toxicity.Terms(), []
    for _ in range(rows + 500):
        a, b = rng.randint(0, 1), rng.randint(0, 1)
        text = rng.choices(pool, k=length) + [("vile", "dull")[a], ("group", "other")[b]]
        rng.shuffle(text)
        made.append((terms(" ".join(text)), int(a == b)))
    m = toxicity.fit_rows(made[:rows])
    right = sum((m.bias + m.linear[ids].sum() + toxicity.pair_terms(ids, m) >= 0) == bool(y) for ids, y in made[rows:])
    assert m.latent.any() and right >= 475


def test_toxicity_scores_and_slopes_by_explicit_sums():
    rng = np.random.default_rng(3)
    size, texts = 9, [np.sort(np.random.default_rng(i).choice(np.arange(1, 9), i % 6, replace=False)) for i in range(25)]
    pairs, v = toxicity.Pairs(texts, size), np.random.default_rng(4).normal(size=(size, toxicity.RANK))
    v[0] = 0
    held = np.zeros((len(texts), size))
    for i, x in enumerate(texts):
        held[i, x] = 1
    mean = held.mean(axis=0)

    def by_sums(w):  # all pairs of centred terms, and of a term with itself what centring leaves
        out = np.zeros((len(texts), w.shape[1]))
        for i in range(len(texts)):
            for s in range(size):
                for t in range(size):
                    c = (held[i, s] - mean[s]) * (held[i, t] - mean[t]) - (held[i, s] if s == t else 0)
                    out[i] += 0.5 * c * w[s] * w[t]
        return out

    assert np.allclose(pairs.values(v), by_sums(v))
    r, step, slope = rng.normal(size=len(texts)), 1e-5, pairs.slope(rng.normal(size=len(texts)) * 0, v)
    assert not slope.any()
    slope = pairs.slope(r, v)
    assert not slope[0].any()  # of no term
    for s in range(1, size):
        for k in range(toxicity.RANK):
            up, down = v.copy(), v.copy()
            up[s, k] += step
            down[s, k] -= step
            assert abs((r @ (by_sums(up) - by_sums(down))).sum() / (2 * step) - slope[s, k]) < 1e-5
    # What centring adds is linear, so the model has it in its linear weights and bias.
    linear = rng.normal(size=size)
    model = toxicity.centred(linear, 0.3, v, np.arange(size), pairs.mean)
    for i, x in enumerate(texts):
        plain = sum(v[s] @ v[t] for n, s in enumerate(x) for t in x[:n])
        assert np.isclose(toxicity.pair_terms(x, model), plain)
        want = 0.3 + linear[x].sum() + pairs.values(v)[i].sum()
        assert np.isclose(model.bias + model.linear[x].sum() + toxicity.pair_terms(x, model), want)


def test_lists_are_cut_before_they_travel(spark, monkeypatch):
    """Whole inverted lists went to every document that asked; entries of other sizes and smaller components now end before."""
    from orrery.llm import ngram_join

    seen, write = {}, ngram_join.stage

    def spy(df, tag):
        seen[tag] = str(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(ngram_join, "stage", spy)
    rows = [(1, 10, 1, b"\0" * 16, [5, 6, 7]), (2, 10, 2, b"\0" * 16, [5, 6, 7]), (3, 40, 3, b"\0" * 16, [5, 6, 7])]
    out = ngram_join._search(spark.createDataFrame(rows, "id long, n long, comp long, par binary, tokens array<long>"), 90)
    assert [tuple(r) for r in out.collect()] == [(1, 2)]
    assert "filter(e" in seen["jac-pairs"]
