"""Exact Jaccard self-join of documents on word n-grams by T-occurrence search.

Every set is ordered by the rarity of its shingles.  To reach the least overlap T that a partner
needs, a document must meet it at least ``SHORT_HITS`` times in its short lists: the inverted lists
of all but its T - ``SHORT_HITS`` most common shingles (DivideSkip).  Short lists are heap-merged;
documents with enough hits are candidates, whose remaining shingles are found by binary search
until the overlap is reached or out of reach.

Equal sets are one class.  Classes that share a minimum hash are compared with one leader of the
group by minimum hashes first, so that groups of near copies become one component in linear work;
the search then only looks for links between different components.  Entries of long lists carry the
parities of their set's shingles by hash, about a bit a shingle.  Every parity in which two sets
differ is a shingle of one side only, so near misses of the similarity, of which a group of edited
copies has a square, are told apart before they become candidates.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_keys, comparable, connected_components, discard, stage

#: Hits in short lists that a candidate needs.
SHORT_HITS = 2
#: Cells of the table that counts shingles by hash: their order of rarity, over all documents.
CELLS = 1 << 18
#: Minimum hashes per set, and rounds of comparing with leaders.
MINIMA, LEADER_ROUNDS = 3, 2
#: Entries of an inverted list that travel together.
LIST_ENTRIES = 1024
#: Entries of one component in a list from which on they have a list of their own, and of a list from which on they carry parities.
OWN_LIST, PARITY_LIST = 32, 32
CHUNK_CHARS = 1 << 20


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int):
        import xxhash

        self.n, self.hash = words, xxhash.xxh3_64_intdigest

    def __call__(self, text: bytes | None) -> np.ndarray:
        # Splitting and lower-casing bytes touches ASCII only, as the contract has it.
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([self.hash(b" ".join(words), seed=len(words))], np.uint64)
        h = np.fromiter(map(self.hash, words), np.uint64, len(words))
        size = len(h) - self.n + 1
        out = h[:size].copy()
        for k in range(1, self.n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out += h[k : k + size]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def _texts(batch: pa.RecordBatch, index: int) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column(index).cast(pa.binary()))


def least_overlap(n: np.ndarray | int, percent: int):
    """Overlap that a set of ``n`` needs with any partner."""
    return -(-n * percent // 100)


def summaries(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, sig, mins) per row; and per partition a row with a null ``sig`` that counts shingles by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        make, cells, any_row = Shingler(words), np.zeros(CELLS, np.int64), False
        salts = [np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % 2**64) for k in range(MINIMA)]
        names, kinds = ["doc_id", "n", "sig", "mins", "cells"], (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), _texts(batch, 1), strict=True):
                s = make(text)
                mins = []
                if len(s):
                    for salt in salts:
                        v = s * salt
                        v ^= v >> np.uint64(31)
                        mins.append(int((v * np.uint64(0x94D049BB133111EB)).min().view(np.int64)))
                    # A set's shingles seldom share a cell; add.at counts those that do.
                    np.add.at(cells, (s >> np.uint64(46)).astype(np.int64), 1)
                rows.append((key.as_py(), len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"", mins or None, None))
            any_row = any_row or bool(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        if any_row:
            import zlib

            packed = zlib.compress(cells.astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, packed), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary, mins array<long>, cells binary")


def _cell_counts(parts: DataFrame) -> np.ndarray:
    """The sum of the partitions' tables, added up in groups on the executors; at most 8 tables reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["cells"])

    import zlib

    rows = parts.repartition(8).mapInArrow(add, "cells binary").collect()
    total = np.zeros(CELLS, np.int64)
    for r in rows:
        total += np.frombuffer(zlib.decompress(bytes(r.cells)), "<i8")
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def parities(s: np.ndarray) -> bytes:
    """A bit for each remainder of the shingles' hashes by a power of two of at least their number: whether it is left an odd number of times."""
    bits = 1 << max(7, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Shingles that at least are in one of the two sets only, by their parities."""
    a, b, wide = int.from_bytes(x, "little"), int.from_bytes(y, "little"), max(len(x), len(y))
    if len(x) < len(y):
        a, b = b, a
    while wide > min(len(x), len(y)):  # half as many remainders: the two halves are added
        wide //= 2
        a = (a >> 8 * wide) ^ (a & ((1 << 8 * wide) - 1))
    return (a ^ b).bit_count()


def _prefixes(docs: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, sig, par, tokens): the shingles whose lists count as short, rarest first, and the parities of all."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        make, cells = Shingler(words), shared.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), _texts(batch, 1), strict=True):
                s = make(text)
                if not len(s) or key.as_py() is None:
                    continue
                need = int(least_overlap(len(s), percent))
                short = len(s) - need + min(SHORT_HITS, need)
                rank = cells[(s >> np.uint64(46)).astype(np.int64)]
                order = np.lexsort((s, rank))[:short]
                rows.append((key.as_py(), len(s), xxhash.xxh3_128_digest(s.tobytes()), parities(s), s[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([r[3] for r in rows], pa.binary()),
                    pa.array([r[4] for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "sig", "par", "tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary, par binary, tokens array<long>")


def overlap_reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x and y| >= percent |x or y|, by binary search of the smaller set's shingles in the larger one."""
    if len(x) > len(y):
        x, y = y, x
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if need > len(x) or not len(y):
        return False
    found = 0
    # In four strides: stop when the overlap is out of reach.
    step = max(-(-len(x) // 4), 64)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        i = np.minimum(np.searchsorted(y, part), len(y) - 1)
        found += int((y[i] == part).sum())
        if found + len(x) - min(at + step, len(x)) < need:
            return False
    return found >= need


def _verify(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; sets are made anew from the texts of the ids in question."""
    ids = stage(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "jac-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for batch in batches:
            found = [make(t).tobytes() for t in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "items"])

    made = stage(by_keys(docs.select("doc_id", "text"), ids, "doc_id").mapInArrow(sets, "id long, items binary"), "jac-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                overlap_reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(made.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(
        made.select(F.col("id").alias("b"), F.col("items").alias("y")), "b"
    )
    out = stage(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct(), "jac-links")
    discard(made, ids)
    return out


def _fits(n_a: str, n_b: str, percent: int):
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _with_component(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(components.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn(
        "comp", F.coalesce("comp", "id")
    )


def _leader_pairs(classes: DataFrame, components: DataFrame | None, round_: int, percent: int) -> DataFrame:
    """Members of a minimum-hash group against one leader of another component."""
    rows = stage(
        _with_component(classes, components).select("id", "n", "comp", F.posexplode("mins").alias("slot", "low")), "jac-minima"
    )
    order = F.xxhash64(F.lit(round_), F.col("slot"), F.col("id"))
    heads = (
        rows.groupBy("slot", "low")
        .agg(
            F.min(F.struct(order.alias("o"), F.col("id"), F.col("n"), F.col("comp"))).alias("head"),
            F.min("comp").alias("c0"),
            F.max("comp").alias("c1"),
        )
        .where("c0 < c1")
        .select("slot", "low", F.col("head.id").alias("h_id"), F.col("head.n").alias("h_n"), F.col("head.comp").alias("h_comp"))
    )
    heads = stage(heads, "jac-heads")
    pairs = (
        rows.join(heads, ["slot", "low"])
        .where((F.col("comp") != F.col("h_comp")) & _fits("n", "h_n", percent))
        .select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b"))
        .distinct()
    )
    pairs = stage(pairs, "jac-pairs")
    discard(rows, heads)
    return pairs


def _search(postings: DataFrame, percent: int) -> DataFrame:
    """Candidates of different components from (id, n, comp, par, tokens): heap-merged short lists."""
    flat = postings.select("id", "n", "comp", F.explode("tokens").alias("token"))
    # Lists that could link two components; all others, mostly of one document, end here.
    live = (
        flat.groupBy("token")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("df"))
        .where("c0 < c1")
        .select("token", "df")
    )
    live = stage(live, "jac-live")
    flat = stage(flat.join(live, "token"), "jac-postings")
    # Entries of one component with many in a list have lists of their own, which its members skip.
    per = flat.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= OWN_LIST).select("token", "comp", F.lit(True).alias("own"))
    long = F.col("df") >= PARITY_LIST
    # Parities: of the entries of long lists, and once a document that asks for such a list.
    par = postings.select("id", "par").join(flat.where(long).select("id").distinct(), "id")
    par = stage(par, "jac-parities")
    entries = flat.where(~long).withColumn("par", F.lit(None).cast("binary")).unionByName(flat.where(long).join(par, "id"))
    field = lambda c: F.transform("e", lambda e: e[c])
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / LIST_ENTRIES).cast("long"))
    columns = (("id", "ids"), ("n", "sizes"), ("comp", "comps"), ("par", "pars"))
    lists = (
        entries.join(per, ["token", "comp"], "left")
        .withColumns({"part": part, "l_comp": F.when(F.col("own"), F.col("comp"))})
        .groupBy("token", "l_comp", "part")
        .agg(F.sort_array(F.collect_list(F.struct("id", "n", "comp", "par"))).alias("e"), F.max("comp").alias("top"))
        .select("token", "l_comp", "top", "e")
    )
    lists = stage(lists, "jac-lists")
    # Each pair is met once: by the document of the smaller component.
    asked = flat.join(lists, "token").where(F.col("comp") < F.coalesce("l_comp", "top"))
    # Entries of other sizes and of smaller components end here, before lists are dealt by document.
    fits = F.filter("e", lambda e: (F.col("comp") < e["comp"]) & _fits(F.col("n"), e["n"], percent))
    asked = asked.withColumn("e", fits).where(F.size("e") > 0)
    asked = asked.select("id", F.lit(None).cast("binary").alias("par"), "n", "comp", *[field(c).alias(n) for c, n in columns])
    none = [F.lit(None).cast(asked.schema[n].dataType).alias(n) for n in asked.columns[2:]]
    asked = asked.unionAll(par.select("id", "par", *none))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by id, parities first: the lists of one query stand together."""

        def candidates(n: int, own: bytes | None, lists: list, pars: dict) -> list[int]:
            long_x = least_overlap(n, percent) - min(SHORT_HITS, least_overlap(n, percent))
            out, last, size, count = [], None, 0, 0

            def close() -> None:
                if last is None or 100 * min(n, size) < percent * max(n, size):
                    return
                # Of two short parts the one that ends first has met all its common shingles in the
                # other; the rest of the overlap lies in its long part.
                need = -(-percent * (n + size) // (100 + percent))
                long_y = least_overlap(size, percent) - min(SHORT_HITS, least_overlap(size, percent))
                if count < max(need - max(long_x, long_y), 1):
                    return
                theirs = pars.get(last)
                if own is None or theirs is None or n + size - least_apart(own, theirs) >= 2 * need:
                    out.append(last)

            for y, m in heapq.merge(*lists):
                if y != last:
                    close()
                    last, size, count = y, m, 0
                count += 1
            close()
            return out

        query, size, own, held, pars = None, 0, None, [], {}
        out: tuple[list, list] = ([], [])

        def close() -> None:
            if held:
                for y in candidates(size, own, held, pars):
                    out[0].append(query)
                    out[1].append(y)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["x", "y"])
            out[0].clear()
            out[1].clear()
            return batch

        for batch in batches:
            for x, p, n, comp, ids, sizes, comps, theirs in zip(*(batch.column(i) for i in range(8)), strict=True):
                x = x.as_py()
                if x != query:
                    close()
                    query, own, held, pars = x, None, [], {}
                if not ids.is_valid:
                    own = p.as_py()
                    continue
                size, mine = n.as_py(), comp.as_py()
                ids, comps = ids.as_py(), comps.as_py()
                held.append([(y, m) for y, m, c in zip(ids, sizes.as_py(), comps, strict=True) if mine < c])
                if theirs.values[0].is_valid:
                    pars.update((y, b) for y, b, c in zip(ids, theirs.as_py(), comps, strict=True) if mine < c)
            if len(out[0]) > 20_000:
                yield flush()
        close()
        yield flush()

    found = asked.repartition("id").sortWithinPartitions("id", F.col("ids").isNotNull()).mapInArrow(merge, "x long, y long")
    pairs = stage(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jac-pairs")
    discard(live, flat, lists, par)
    return pairs


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union`` of their shingle sets; the
    component is the smallest doc_id reachable by links.  Texts of fewer than ``words`` words are
    one shingle; null texts and texts without words have none, link with nothing and are their
    own component.  Rows of one doc_id are one document, linked by any of its texts; rows without
    doc_id get no component and link with nothing.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stage(summaries(docs, words), "jac-docs")
    rows = made.where("cells is null").select("doc_id", "n", "sig", "mins")
    counts = _cell_counts(made.where("cells is not null").select("cells"))
    live = rows.where("n > 0 and doc_id is not null")
    classes = stage(
        live.groupBy("sig").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("mins").alias("mins")), "jac-classes"
    )
    # Links inside a class, and between rows of one doc_id, are stars around its smallest id.
    own = live.select("doc_id", "sig").distinct()
    same = own.join(classes.select("sig", "id"), "sig").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    links = [stage(same, "jac-same")]
    components = None
    nodes = classes.select("id", "n", "mins")
    near: list[DataFrame] = []
    for k in range(LEADER_ROUNDS):
        pairs = _leader_pairs(nodes, components, k, percent)
        near.append(_verify(docs, pairs, words, percent))
        discard(pairs)
        components = connected_components(_union(near))
    tokens = _prefixes(docs, words, percent, counts).join(classes.select(F.col("id").alias("doc_id"), "sig"), ["doc_id", "sig"], "left_semi")
    short = stage(_with_component(tokens.select(F.col("doc_id").alias("id"), "n", "par", "tokens"), components), "jac-short")
    pairs = _search(short, percent)
    near.append(_verify(docs, pairs, words, percent))
    discard(short, pairs)
    final = connected_components(_union([*links, *near]))
    return (
        rows.select("doc_id", F.col("n").alias("n_shingles"))
        .join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def _own_keys(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, digest, rank, key) of the texts of ids that stand for several; the first keeps its id as key, others get unused numbers."""
    texts = by_keys(docs, repeated, "doc_id").select("doc_id", _digest().alias("digest")).distinct()
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("digest"))
    texts = texts.withColumn("rank", rank).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("doc_id"))).where("n > 1")
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    if low is None or high < 1 << 62:
        number = F.lit(high or 0) + 1 + F.monotonically_increasing_id()
    elif low > -(1 << 62):
        number = F.lit(low) - 1 - F.monotonically_increasing_id()
    else:
        raise ValueError("no numbers are left for texts whose doc_id repeats")
    return stage(texts.select("doc_id", "digest", "rank", F.when(F.col("rank") == 1, F.col("doc_id").cast("long")).otherwise(number).alias("key")), "jac-keys")


def _digest() -> Column:
    return F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each group of near copies; rows without doc_id stay.

    The row of the smallest doc_id is kept.  Texts that share a doc_id are a group only if they are
    near copies; the order of their digests decides between them, and that of all columns between
    rows of the same id and text.  Other columns pass through whatever their names.
    """
    # The row travels whole, so that no name of its columns meets one of the plan's.
    docs = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    repeated = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jac-repeated")
    keys = _own_keys(docs, repeated)
    several = stage(keys.select("doc_id").distinct(), "jac-several")
    rest = by_keys(docs, several, "doc_id", "left_anti").withColumn("key", F.col("doc_id").cast("long"))
    own = by_keys(docs, several, "doc_id").withColumn("digest", _digest()).join(keys.select("doc_id", "digest", "key"), ["doc_id", "digest"])
    rows = rest.unionByName(own.select(*rest.columns))
    found = jaccard_components(rows.select(F.col("key").alias("doc_id"), "text"), words, percent)
    found = stage(found.where("doc_id is not null").select(F.col("doc_id").alias("key"), "component_id").distinct(), "jac-found")
    # The first of a component by id and rank: its own number unless texts with new numbers are in it.
    place = F.struct(F.coalesce("doc_id", "key").alias("id"), F.coalesce("rank", F.lit(1)).alias("rank"))
    best = found.join(keys.select("key", "doc_id", "rank"), "key", "left").groupBy("component_id").agg(F.min_by("key", place).alias("best"))
    drop = stage(found.join(best, "component_id").where("key <> best").select("key"), "jac-drop")
    kept = by_keys(rows, drop, "key", "left_anti")
    again = repeated.join(several, "doc_id", "left_anti").select(F.col("doc_id").cast("long").alias("key")).unionAll(keys.select("key"))
    once = by_keys(kept, again, "key", "left_anti").select("row")
    more = by_keys(kept, again, "key").groupBy("key").agg(F.min_by("row", comparable(kept, "row")).alias("row")).select("row")
    return once.unionAll(more).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 90)
