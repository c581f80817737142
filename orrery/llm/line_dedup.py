"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct runs of five words (the whole line, if it has fewer).  Lines
with equal words are one class.  Two classes match when the Jaccard similarity of their tokens
is at least 0.8; a line is removed if an earlier line is of its class or matches it.

The join runs in two steps.  Over all lines, a semi-join on the prefixes in hash order finds the
classes that have a possible partner; all others match nothing.  For the classes left, tokens are
counted, ordered by rarity, and joined with prefix, length and positional filters.  Each class
first meets the earliest class of each of its lists; only those that this leaves undecided are
joined with all earlier classes.  Both steps also compare parities of the tokens, which bound the
tokens that differ: near misses, of which a group of edited copies has a square, end there.  The
first step has 64 of them, as every line pays for them; the second has 128.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, by_keys, discard, stage

SHINGLE = 5
#: Similarity as a fraction, TOP / BOTTOM.
TOP, BOTTOM = 4, 5
#: Cells of the table that counts tokens by hash: their order of rarity.
CELLS = 1 << 16


def _plain(text: Column) -> Column:
    """Lower-cased, with blanks for other ASCII white space inside lines; lines keep their places."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f"))
    return F.lower(F.when(odd, F.translate(text, "\t\r\x0b\f", "    ")).otherwise(text))


def _hashed(rows: DataFrame) -> DataFrame:
    """``line``, made plain, becomes ``hs``, the hashes of its words; lines without words go."""
    # The test reads the line: a test of the words would split every line twice.
    words = F.array_remove(F.split("line", " "), "")
    return rows.where(F.trim("line") != "").withColumn("hs", F.transform(words, lambda w: F.xxhash64(w))).drop("line")


def _tokens() -> Column:
    """Sorted distinct 64-bit hashes of the word runs of ``hs``."""
    n = SHINGLE
    parts = ", ".join(f"get(hs, i + {k})" for k in range(1, n))
    runs = f"transform(slice(hs, 1, size(hs) - {n - 1}), (w, i) -> xxhash64(w, {parts}))"
    return F.expr(f"sort_array(array_distinct(CASE WHEN size(hs) >= {n} THEN {runs} ELSE array(xxhash64(hs, size(hs))) END))")


def _prefix(size: str) -> Column:
    """Tokens that a partner must share at least one of."""
    return F.expr(f"CAST({size} - ceil({size} * {TOP} / {BOTTOM}) + 1 AS INT)")


def _enough(common: Column, m: str, n: str) -> Column:
    """Whether an overlap gives the similarity: common / (m + n - common) >= TOP / BOTTOM."""
    return common * (TOP + BOTTOM) >= TOP * (F.col(m) + F.col(n))


def _parity() -> Column:
    """64 bits of parities: bit ``t & 63`` of all tokens ``t``."""
    return F.expr("aggregate(tokens, 0L, (a, t) -> a ^ shiftleft(1L, CAST(t & 63 AS INT)))")


def _half_parity(word: int) -> Column:
    """64 of 128 bits of parities: bit ``t & 63`` of the tokens ``t`` whose bit 6 is ``word``."""
    return F.expr(f"aggregate(tokens, 0L, (a, t) -> CASE WHEN (t & 64) = {64 * word} THEN a ^ shiftleft(1L, CAST(t & 63 AS INT)) ELSE a END)")


def _near(x: str, y: str, parities: list[str]) -> Column:
    """What a pair must fulfil to reach the similarity; ``x`` and ``y`` are the prefixes of its columns.

    Sizes within the similarity; no more overlap than tokens left from the shared one on and before
    it; and no more than the parities allow, as every differing bit is a token of one side only.
    """
    c = lambda side, name: F.col(f"{side}{name}")
    total = c(x, "m") + c(y, "m")
    sizes = F.least(c(x, "m"), c(y, "m")) * BOTTOM >= F.greatest(c(x, "m"), c(y, "m")) * TOP
    room = F.least(c(x, "at"), c(y, "at")) + F.least(c(x, "m") - c(x, "at"), c(y, "m") - c(y, "at"))
    apart = reduce(add, [F.bit_count(c(x, b).bitwiseXOR(c(y, b))) for b in parities])
    return sizes & (room * (TOP + BOTTOM) >= total * TOP) & ((total - apart) * (TOP + BOTTOM) >= total * (2 * TOP))


def _with_partner(entries: DataFrame) -> DataFrame:
    """The classes (k1, k2) that could match another one of their lists.  Each entry looks for one partner, so pairs are not listed."""
    names = ["k1", "k2", "m", "b", "at"]
    x = entries.select("token", *[F.col(c).alias(f"x{c}") for c in names])
    y = entries.select(F.col("token").alias("ytoken"), *[F.col(c).alias(f"y{c}") for c in names])
    other = (F.col("xk1") != F.col("yk1")) | (F.col("xk2") != F.col("yk2"))
    found = x.join(y, (F.col("token") == F.col("ytoken")) & other & _near("x", "y", ["b"]), "left_semi")
    return found.select(F.col("xk1").alias("k1"), F.col("xk2").alias("k2")).distinct()


def line_decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, h, gone): for every text that loses lines, the positions (from 0) of those.

    ``h`` is ``xxhash64(text)``.  Lines are ordered by doc_id (null first), text hash and
    position.  Blank lines, null and empty texts lose nothing.  Rows of equal doc_id and text are
    one text.
    """
    # Hashed once a text, not once a line.
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), _plain(F.col("text")).alias("text"))
    rows = texts.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    made = _hashed(rows).withColumns({"k1": F.xxhash64("hs"), "k2": F.xxhash64(F.lit(1), "hs"), "tokens": _tokens()}).drop("hs")
    made = made.withColumns({"m": F.size("tokens"), "b": _parity()})
    lines = stage(made.select("doc_id", "h", "pos", "k1", "k2", "m", "b", F.slice("tokens", F.lit(1), _prefix("m")).alias("prefix")), "line-rows", hashes=True)
    first = F.struct("doc_id", "h", "pos")
    classes = stage(lines.groupBy("k1", "k2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "line-classes", hashes=True)
    live = (
        lines.select("k1", F.explode("prefix").alias("token"))
        .groupBy("token")
        .agg(F.min("k1").alias("a"), F.max("k1").alias("b"))
        .where("a < b")
    )
    live = stage(live.select("token"), "line-live", hashes=True)
    entries = lines.select("k1", "k2", "m", "b", F.posexplode("prefix").alias("at", "token"))
    entries = stage(by_keys(entries, live, "token").distinct(), "line-shared", hashes=True)
    linked = stage(_with_partner(entries), "line-partners")
    # Numbered in the order of their first lines: of two classes the earlier has the smaller number.
    linked = linked.join(classes, ["k1", "k2"]).select("k1", "k2", "first").orderBy("first")
    linked = stage(linked.withColumn("cid", F.monotonically_increasing_id()), "line-linked")
    found = _matched(docs, lines, linked)
    gone_classes = linked.join(found, "cid")
    repeated = classes.where("n > 1").select("k1", "k2", "first", F.lit(False).alias("also"))
    touched = (
        repeated.unionAll(gone_classes.select("k1", "k2", "first", F.lit(True)))
        .groupBy("k1", "k2")
        .agg(F.min("first").alias("first"), F.max("also").alias("also"))
    )
    touched = stage(touched, "line-touched")
    gone = (
        lines.select("doc_id", "h", "pos", "k1", "k2")
        .join(touched, ["k1", "k2"])
        .where(F.col("also") | ~F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    out = stage(gone, "line-gone")
    discard(lines, classes, live, entries, linked, touched)
    return out


def _matched(docs: DataFrame, lines: DataFrame, linked: DataFrame) -> DataFrame:
    """The classes (cid) of ``linked`` that match an earlier one."""
    spots = linked.select("first.doc_id", "first.h", F.struct("first.pos", "cid").alias("e")).groupBy("doc_id", "h")
    spots = spots.agg(F.collect_list("e").alias("at")).select(F.col("doc_id").alias("s_doc"), F.col("h").alias("s_h"), "at")
    spots = stage(spots, "line-spots")
    n = linked.limit(BROADCAST_KEYS + 1).count()
    side = F.broadcast(spots) if n <= BROADCAST_KEYS else spots
    texts = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = texts.join(side, (F.col("h") == F.col("s_h")) & F.col("doc_id").eqNullSafe(F.col("s_doc")))
    rows = rows.select(F.split(_plain(F.col("text")), "\n").alias("all"), "at")
    line = lambda e: e.withField("line", F.get(F.col("all"), e["pos"]))
    rows = _hashed(rows.select(F.explode(F.transform("at", line)).alias("e")).select("e.*")).select("cid", _tokens().alias("tokens"))
    # A row of documents that is there several times gives its lines several times.
    firsts = lines.join(linked.select("k1", "k2", "first", "cid"), ["k1", "k2"]).where(F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first")))
    if not firsts.groupBy("cid").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["cid"])
    sets = stage(rows.withColumns({"b0": _half_parity(0), "b1": _half_parity(1)}), "line-sets")
    cell = lambda t: F.pmod(t, F.lit(CELLS)).cast("int")
    # How often tokens of each cell occur in the classes left: a fixed number of cells, all tokens.
    counts = sets.select(F.explode("tokens").alias("t")).groupBy(cell(F.col("t")).alias("cell")).count()
    counts = stage(counts, "line-cells")
    filled = docs.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    table = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("count", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("cells"))
    table = stage(table, "line-rarity").scalar()
    rarest = F.sort_array(F.transform("tokens", lambda t: F.struct(F.get(F.col("cells"), cell(t)).alias("n"), t.alias("t"))))
    ranked = sets.withColumn("cells", table).withColumns({"by": rarest, "m": F.size("tokens")}).withColumn("p", _prefix("m"))
    entries = ranked.select("cid", "b0", "b1", "m", F.posexplode(F.slice("by", F.lit(1), F.col("p"))).alias("at", "e"))
    names = ["cid", "m", "at", "b0", "b1"]
    entries = stage(entries.select(F.col("e.t").alias("token"), *names), "line-entries")
    heads = entries.groupBy("token").agg(F.min(F.struct(*names)).alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = stage(heads.select("token", *[F.col(f"y.{c}").alias(f"y{c}") for c in names]), "line-heads")
    x = entries.select("token", *[F.col(c).alias(f"x{c}") for c in names])
    met = stage(x.join(heads, "token").where("ycid < xcid"), "line-met")
    done = stage(_verified(met.where(_near("x", "y", ["b0", "b1"])), sets), "line-done")
    left = stage(met.select(*x.columns).join(done, "xcid", "left_anti"), "line-open")
    y = entries.select(F.col("token").alias("ytoken"), *[F.col(c).alias(f"y{c}") for c in names])
    later = (F.col("token") == F.col("ytoken")) & (F.col("ycid") < F.col("xcid")) & _near("x", "y", ["b0", "b1"])
    rest = stage(_verified(left.join(y, later), sets), "line-rest")
    discard(spots, sets, counts, entries, heads, met, left)
    return done.unionAll(rest).distinct().select(F.col("xcid").alias("cid"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The xcid whose tokens reach the similarity with those of a ycid."""
    pairs = stage(pairs.select("xcid", "ycid", "xm", "ym").distinct(), "line-pairs")
    out = (
        pairs.join(sets.select(F.col("cid").alias("xcid"), F.col("tokens").alias("xt")), "xcid")
        .join(sets.select(F.col("cid").alias("ycid"), F.col("tokens").alias("yt")), "ycid")
        .where(_enough(F.size(F.array_intersect("xt", "yt")), "xm", "ym"))
    )
    return out.select("xcid").distinct()


def dedup_lines(docs: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """``docs`` with the later matches taken out of ``text``, and ``lines_removed`` (int, replaced if there).

    Other lines keep their order and their bytes.  A text may become empty; null stays null.  Other
    columns pass through whatever their names; rows that are there several times are one text and
    lose the same lines; an empty table stays empty.
    """
    gone = line_decisions(docs.select("doc_id", "text")) if decisions is None else decisions
    keep = [c for c in docs.columns if c != "lines_removed"]
    side = gone.select("doc_id", "h", "gone")
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("k")).first()
    if size.n <= BROADCAST_KEYS and size.k <= 4 * BROADCAST_KEYS:
        side = F.broadcast(side)
    own = lambda c: F.col(f"d.`{c}`")
    joined = docs.alias("d").join(side.alias("g"), (F.xxhash64(own("text")) == F.col("g.h")) & own("doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    left = F.array_join(F.filter(F.split(own("text"), "\n"), lambda x, i: ~F.array_contains(F.col("g.gone"), i)), "\n")
    text = F.when(F.col("g.gone").isNull(), own("text")).otherwise(left).alias("text")
    return joined.select(*[text if c == "text" else own(c) for c in keep], F.coalesce(F.size("g.gone"), F.lit(0)).alias("lines_removed"))


def without_emptied(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: texts without later lines; documents of which nothing but blanks is left are dropped.

    Returns the columns of ``docs`` and no others; ``n_chars``, if there, is the length of what is left.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("row")) if len(docs.columns) > 2 else docs
    out = dedup_lines(rows)
    left = F.coalesce(F.trim(F.translate("text", "\n\t\r\x0b\f", "     ")), F.lit("")) != ""
    kind = dict(docs.dtypes).get("n_chars")

    def column(c: str) -> Column:
        if c in ("doc_id", "text"):
            return F.col(c)
        old = F.col(f"row.`{c}`")
        return (F.when(F.col("lines_removed") > 0, F.length("text").cast(kind)).otherwise(old) if c == "n_chars" else old).alias(c)

    return out.where((F.col("lines_removed") == 0) | left).select(*[column(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
