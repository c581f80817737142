"""Runs of consecutive words that repeat with a period, found through longest previous factors.

Spark deals the texts out; inside a task, texts are laid end to end in blocks of bounded size, each
closed by a symbol of its own, so that nothing is found across texts.  For a block

* prefix doubling gives the suffix array and, level by level, names of all substrings of 2^h words;
  comparing names gives the longest common extension of two positions, forwards and backwards,
  and so the LCP array;
* the LCP array with the nearest smaller positions on both sides in suffix order gives the longest
  previous factor of each position, and these the Lempel-Ziv factors;
* every run that is not strictly inside a factor crosses or touches a factor's end: it is found there
  by extending the equality of positions one period apart both ways, for all periods that a run
  there can have;
* a run strictly inside a factor is a copy of a run inside the factor's earlier occurrence: known
  runs lie in buckets by start, and the buckets of the earlier occurrence are copied, left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as a Java pattern; everything else is part of a word.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Words laid end to end at once; a longer text is a block of its own.
BLOCK_WORDS = 1 << 18
#: Candidate pairs extended at once.
PAIRS = 1 << 21
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Names:
    """Names of all substrings of 2^h symbols, for h from 0 until every position has its own name.

    ``order`` is the suffix array.  The last symbol must occur nowhere else.
    """

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        _, first = np.unique(symbols, return_inverse=True)
        order = np.argsort(first, kind="stable")
        name = self._spread(first[order], order, n)
        self.levels, h = [name], 0
        # Positions whose name is not theirs alone, in suffix order; only these are sorted on.
        live = order[self._shared(name[order])]
        while len(live):
            after = live + (1 << h)
            # Ends are apart already, as the last symbol is unique, so that positions past the end never decide.
            right = name[np.minimum(after, n - 1)]
            by = np.argsort(name[live] * np.int64(n) + right, kind="stable")
            live, right = live[by], right[by]
            old = name[live]
            fresh = np.r_[True, old[1:] != old[:-1]]
            starts = np.flatnonzero(fresh)
            group = starts[np.cumsum(fresh) - 1]
            differs = fresh | np.r_[True, right[1:] != right[:-1]]
            first_of = np.maximum.accumulate(np.where(differs, np.arange(len(live)), 0))
            name = name.copy()
            name[live] = old + (first_of - group)
            self.levels.append(name)
            live = live[self._shared(name[live])]
            h += 1
        self.order = np.empty(n, np.int64)
        self.order[name] = np.arange(n)

    @staticmethod
    def _shared(names: np.ndarray) -> np.ndarray:
        """Which of ascending names occur more than once."""
        same = names[1:] == names[:-1]
        return np.r_[False, same] | np.r_[same, False]

    @staticmethod
    def _spread(ranked: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        """Names that leave room for the later distinctions: how many positions come before."""
        differs = np.r_[True, ranked[1:] != ranked[:-1]]
        out = np.empty(n, np.int64)
        out[order] = np.maximum.accumulate(np.where(differs, np.arange(n), 0))
        return out

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` and ``b`` on are equal, for different positions."""
        return self._equal(a, b, 0)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` and before ``b`` are equal, for different positions."""
        return self._equal(a, b, -1)

    def _equal(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)

        def same(live: np.ndarray, h: int) -> np.ndarray:
            """Those of ``live`` whose next 2^h symbols are equal."""
            x, y = a[live], b[live]
            ok = np.minimum(x, y) >= 1 << h if way else np.maximum(x, y) < self.n
            x, y, live = x[ok] + (way << h), y[ok] + (way << h), live[ok]
            return live[self.levels[h][x] == self.levels[h][y]]

        # Most pairs part early: powers of two are tried upwards, then added downwards for the pairs that reached them.
        reach = [np.arange(len(a))]
        while len(reach[-1]) and len(reach) <= len(self.levels):
            reach.append(same(reach[-1], len(reach) - 1))
        for h in range(len(reach) - 2, -1, -1):
            hit, step = same(reach[h + 1], h), 1 << h
            got[hit] += step
            a[hit] += -step if way else step
            b[hit] += -step if way else step
        return got


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, or -1.

    All between an index and the one it points to are larger, so pointers may be followed together.
    """
    at = np.arange(-1, len(values) - 1)
    live = np.arange(len(values))
    while len(live):
        live = live[at[live] >= 0]
        live = live[values[at[live]] > values[live]]
        at[live] = at[at[live]]
    return at


def previous_factors(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(length, position): the longest factor at each position that also starts earlier, and one such start (-1: none)."""
    order, n = names.order, names.n
    # Single symbols: the first position of each.
    single = names.levels[0]
    source = np.full(n, n)
    np.minimum.at(source, single, np.arange(n))
    source = source[single]
    length = (source < np.arange(n)).astype(np.int64)
    source[length == 0] = -1
    # Longer factors: only positions that share two symbols with another one.  Of neighbours in suffix
    # order the nearer ones share more, so the nearest smaller positions on both sides decide.
    pair = names.levels[min(1, len(names.levels) - 1)][order]
    order = order[Names._shared(pair)]
    m = len(order)
    backwards = m - 1 - smaller_before(order[::-1])[::-1]  # the nearest smaller one after; m: none
    for near in (smaller_before(order), backwards):
        has = np.flatnonzero((near >= 0) & (near < m))
        here, there = order[has], order[near[has]]
        shared = names.ahead(here, there)
        better = shared > length[here]
        length[here[better]], source[here[better]] = shared[better], there[better]
    return length, source


def factor_starts(length: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv factors: each as long as its previous factor, one symbol where there is none."""
    after = (np.arange(len(length)) + np.maximum(length, 1)).tolist()
    at, n, out = 0, len(length), np.zeros(len(length), bool)
    while at < n:
        out[at] = True
        at = after[at]
    return np.flatnonzero(out)


def find_runs(symbols: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least ``least`` symbols and ``times`` periods, by start and end.

    ``times`` is at least 2.  The last symbol must occur nowhere else.
    """
    names = Names(symbols)
    length, source = previous_factors(names)
    starts = factor_starts(length)
    sizes = np.diff(np.r_[starts, names.n])
    # A run that ends in a factor or at its end starts less than a period before the factor before it (otherwise
    # that one would have been longer), so times * period < period + the sizes of both.
    most = np.r_[0, (sizes[:-1] + sizes[1:] - 1) // (times - 1)]
    found = [np.empty((0, 3), np.int64)]
    bounds = np.cumsum(most)
    edge = 0
    while edge < len(starts):
        stop = max(edge + 1, int(np.searchsorted(bounds, (bounds[edge - 1] if edge else 0) + PAIRS, "right")))
        at = np.repeat(starts[edge:stop], most[edge:stop])
        period = np.arange(len(at)) - np.repeat(np.cumsum(most[edge:stop]) - most[edge:stop], most[edge:stop]) + 1
        for a, b in ((at, at + period), (at - period, at)):
            ok = np.flatnonzero((a >= 0) & (b < names.n))
            a, b, p = a[ok], b[ok], period[ok]
            right = names.ahead(a, b)
            left = names.behind(a, b)
            hit = np.flatnonzero((left + right >= (times - 1) * p) & (left + right + p >= least))
            found.append(np.c_[a[hit] - left[hit], b[hit] + right[hit], p[hit]])
        edge = stop
    runs = np.unique(np.concatenate(found), axis=0)
    if len(runs):
        # The same stretch may have been found at multiples of its period; the least comes first.
        runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]]
        runs = _copied(runs, starts, sizes, source, least)
    return runs


def _copied(runs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, source: np.ndarray, least: int) -> np.ndarray:
    """``runs`` and their copies strictly inside later factors."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in runs.tolist():
        buckets.setdefault(s, []).append((e, p))
    for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size < least + 2:
            continue
        first = int(source[at])
        shift = at - first
        # Buckets of the factor itself fill up while they are read where both occurrences overlap.
        for s in range(first + 1, first + size - least):
            for e, p in buckets.get(s, ()):
                if e < first + size:
                    copies = buckets.setdefault(s + shift, [])
                    if (e + shift, p) not in copies:
                        copies.append((e + shift, p))
    return np.array(sorted((s, e, p) for s, b in buckets.items() for e, p in b), np.int64)


def _blocks(texts: list[bytes], block_words: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(number of the first text, the words of each text), as many texts at once as a block takes."""
    block, first, held = [], 0, 0
    for k, t in enumerate(texts):
        words = t.split()  # bytes split at ASCII white space
        if block and held + len(words) > block_words:
            yield first, block
            block, first, held = [], k, 0
        block.append(words)
        held += len(words) + 1
    if block:
        yield first, block


def text_runs(texts: list[bytes], least: int, times: int, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs (start, length, period), and its words without those that runs repeat, joined by blanks."""
    for _, block in _blocks(texts, block_words):
        ids = pa.array([w for words in block for w in words], pa.large_binary()).dictionary_encode().indices
        sizes = np.array(list(map(len, block)))
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.empty(ends[-1] + 1, np.int64)
        closes = np.zeros(len(symbols), bool)
        closes[ends] = True
        symbols[closes] = -1 - np.arange(len(ends))  # unlike any other symbol
        symbols[~closes] = np.asarray(ids)
        runs = find_runs(symbols, least, times)
        owner = np.searchsorted(ends, runs[:, 0], "left")
        per = np.bincount(owner, minlength=len(block)).tolist()
        first, row = 0, 0
        for words, n, end in zip(block, per, ends.tolist(), strict=True):
            own = [(s - first, e - s, p) for s, e, p in runs[row : row + n].tolist()]
            row += n
            if own:
                gone = bytearray(len(words))
                for s, length, p in own:
                    gone[s + p : s + length] = b"\1" * (length - p)
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            yield sorted(own, key=lambda r: (r[0], r[2])), b" ".join(words)
            first = end + 1


def with_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``runs``, an array of (start, length, period) by start and then period, and ``collapsed``.

    A run is a stretch of consecutive words with smallest period q, words q apart being identical, of
    at least ``least`` words and ``times`` periods, that no neighbouring word extends.  ``collapsed``
    joins by one blank the words that no run contains after its first q.  Words are what ASCII white
    space parts, letters count as they are; a null text has no words and no runs and collapses to
    the empty text.  Repeated rows are kept.  Other columns pass through, whatever their names;
    columns with the names of the two added ones are replaced.  An empty table stays empty.  A text
    is taken whole; a very long one takes some 8 bytes a word for every doubling of its longest repeat.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    shape = T.StructType([base.schema["row"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = [], []
            for own, short in text_runs([t or b"" for t in batch.column(1).to_pylist()], least, times, block_words):
                runs.append([dict(zip(RUN.names, r, strict=True)) for r in own])
                collapsed.append(short.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(collapsed, pa.string())], names=["row", "runs", "collapsed"])

    return base.mapInArrow(find, shape).select("row.*", "runs", "collapsed")


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda w: w != "")


def planted(text: Column, key: Column) -> Column:
    """The text with a repeated stretch planted where crc32 of the key ends in 0; other texts, and those of null keys, as they are.

    With h the checksum, g = h // 10 and n words, the words from a = g % n on repeat the p = 1 + (n - a) // (3 + g % 8) words there.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = words_of(text)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # Single words are looked up in an array that is made once.
    repeated = F.transform(
        F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p"))),
        lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"]))), " "),
    )
    return F.when((h % 10 == 0) & (n > 0), repeated[0]).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    out = with_runs(docs)
    order = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    best = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), order.alias("best"), listed.alias("listed"), "collapsed")
    start, length, period = -F.col("best.s"), F.col("best.length"), -F.col("best.p")
    return best.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
