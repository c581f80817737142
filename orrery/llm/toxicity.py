"""Toxicity: a factorization machine over hashed terms.

Terms are a document's distinct words and their first four and five letters.  The score adds
linear weights and the inner products of the terms' latent vectors, so a pair of terms can count
although neither counts alone, and the same in texts of any length.  Linear weights follow the
regularised leader with an L1 penalty; latent vectors are fitted on all sampled texts at once, for
the terms whose pairs go most with the errors of the linear weights, under the penalty that rates
kept-aside texts best.  Pairs that do not help there, beyond what one coefficient more would
anyway, are left out, that is, the penalty is then without bound.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, fold_held_out

BITS = 18
#: Labelled rows that the model is fitted on, those of smallest hash.
TRAIN_ROWS = 12_000
#: Documents of the sample in which a term must occur to get weights, and to get a latent vector.
MIN_DOCS, MIN_LATENT_DOCS = 3, 20
RANK, EPOCHS = 6, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
#: Turns of the search for leading pairs, and gradient steps of the latent vectors.
TURNS, STEPS = 15, 15
#: Terms that get latent vectors at most.
LATENT_TERMS = 512
#: Penalties tried, as shares of the one that leaves no latent vectors.
SHARES = (0.9, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.06)
#: Parts of the sample that are kept aside in turn to choose among them.
FOLDS = 3
CACHE_WORDS = 400_000


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # (2 ** BITS,)
    latent: np.ndarray  # (latent terms + 1, RANK); row 0 is zero
    slot: np.ndarray  # (2 ** BITS,), row of each term in latent


class Linear:
    """Linear weights by the regularised leader."""

    def __init__(self, bias: float):
        self.bias, self.bias_n = bias, 1.0
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def fit(self, rows: list[tuple[np.ndarray, int]], beside: np.ndarray, epochs: int, rng: np.random.Generator) -> np.ndarray:
        """Fit beside the pairs' terms.  The linear scores of the texts, each before its last step."""
        raw = np.zeros(len(rows))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, y = rows[i]
                w = self.weights(ids)
                raw[i] = self.bias + w.sum()
                g = 1.0 / (1.0 + np.exp(-np.clip(raw[i] + beside[i], -30, 30))) - y
                n = self.n[ids]
                more = n + g * g
                self.z[ids] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
                self.n[ids] = more
                self.bias_n += g * g
                self.bias -= ALPHA * g / np.sqrt(self.bias_n)
        return raw

    def scores(self, rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
        w = self.weights()
        return np.array([self.bias + w[ids].sum() for ids, _ in rows])


class Terms:
    """Hashed term ids of a text."""

    def __init__(self):
        import re

        self.known: dict[str, tuple[int, ...]] = {}
        self.letters = re.compile(r"[^\W\d_]+")

    def _word(self, word: str) -> tuple[int, ...]:
        ids = set()
        for w in self.letters.findall(word):
            for term in (w, f"{w[:4]}*", f"{w[:5]}*"):
                ids.add(zlib.crc32(term.encode("utf-8", "surrogatepass")) >> (32 - BITS))
        return tuple(ids)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        known, ids = self.known, set()
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(text.lower().split()):
            found = known.get(word)
            if found is None:
                found = known[word] = self._word(word)
            ids.update(found)
        return np.fromiter(ids, np.int64, len(ids))


def pair_terms(ids: np.ndarray, model: Model) -> float:
    """Sum of the inner products of all pairs of terms.  A pair counts the same in texts of any length."""
    v = model.latent[model.slot[ids]]
    s = v.sum(axis=0)
    return 0.5 * float(s @ s - (v * v).sum())


class Pairs:
    """Latent vectors of all texts at once; single steps would move every term of a long text for one pair."""

    def __init__(self, slots: list[np.ndarray], size: int, mean: np.ndarray | None = None):
        """``mean``: each term's share of the texts, where it is that of others."""
        self.size = size
        self.ends = np.cumsum([0] + [len(x) + 1 for x in slots])
        # Every text starts with the zero row, so none is empty.
        self.at = np.zeros(self.ends[-1], np.int32)
        for i, x in enumerate(slots):
            self.at[self.ends[i] + 1 : self.ends[i + 1]] = x
        self.df = np.bincount(self.at, minlength=size).astype(float)
        # Rare terms move further; by the fourth root on each side neither they nor the commonest drown a pair.
        self.width = np.maximum(self.df, 1) ** -0.25
        self.width[0] = 0
        # Terms count from their means, or the commonest would drown all others; the rest of each product is linear.
        self.mean = self.df / max(len(slots), 1) if mean is None else mean.copy()
        self.mean[0] = 0

    def _parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        start = 0
        while start < len(self.ends) - 1:
            stop = max(start + 1, int(np.searchsorted(self.ends, self.ends[start] + (1 << 18), "right")) - 1)
            yield slice(start, stop), self.at[self.ends[start] : self.ends[stop]], self.ends[start : stop + 1] - self.ends[start]
            start = stop

    def values(self, v: np.ndarray) -> np.ndarray:
        """Every text's term of each column."""
        out, mean = np.zeros((len(self.ends) - 1, v.shape[1])), self.mean @ v
        for rows, at, ends in self._parts():
            x = v[at]
            out[rows] = 0.5 * ((np.add.reduceat(x, ends[:-1]) - mean) ** 2 - np.add.reduceat(x * x, ends[:-1]))
        return out

    def slope(self, r: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Gradient of the sum of r * values(v)."""
        out, mean, total = np.zeros_like(v), self.mean @ v, np.zeros(v.shape[1])
        own = np.zeros(self.size)
        for rows, at, ends in self._parts():
            s, n = np.add.reduceat(v[at], ends[:-1]) - mean, np.diff(ends)
            total += r[rows] @ s
            own += np.bincount(at, np.repeat(r[rows], n), self.size)
            for k in range(v.shape[1]):
                out[:, k] += np.bincount(at, np.repeat(r[rows] * s[:, k], n), self.size)
        out -= own[:, None] * v + self.mean[:, None] * total
        out[0] = 0  # the row that stands for no term stays zero
        return out

    def leading(self, r: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Largest values and their vectors of the pairs' covariance with ``r``."""
        w = self.width[:, None]
        u, shift = np.linalg.qr(rng.normal(size=(self.size, min(RANK, self.size))))[0], 0.0
        for _ in range(TURNS):
            m = w * self.slope(r, w * u)
            shift = max(shift, 0.5 * np.linalg.norm(m, axis=0).max())
            u = np.linalg.qr(m + shift * u)[0]
        value, turn = np.linalg.eigh(u.T @ (w * self.slope(r, w * u)))
        return value[::-1], w * (u @ turn)[:, ::-1]


def _chance(raw: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def leading_terms(pairs: Pairs, r: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Up to LATENT_TERMS slots of the terms that weigh most in the directions in which pairs go with the errors ``r``."""
    value, u = pairs.leading(r, rng)
    size = (np.abs(u[:, value > 0]) / np.maximum(pairs.width, 1e-9)[:, None]).max(axis=1, initial=0.0)
    size[0] = 0.0
    best = np.argsort(-size, kind="stable")[:LATENT_TERMS]
    return np.sort(best[size[best] > 0])


def fit_latent(few: Pairs, raw: np.ndarray, y: np.ndarray, shares: tuple[float, ...], rng: np.random.Generator) -> list[np.ndarray]:
    """Latent vectors beside the scores ``raw`` for each penalty, given as the share of the one that leaves no vectors."""
    value, u = few.leading(y - _chance(raw), rng)
    f, scale = few.values(u), np.where(few.width > 0, few.width, 1.0)[:, None] ** -2
    weight = (scale * u * u).sum(axis=0)

    def loss(now: np.ndarray) -> float:
        return float((np.logaddexp(0, now) - y * now).sum())

    out = []
    for penalty in [share * float(value[0]) for share in shares]:
        w = np.zeros((few.size, RANK))
        out.append(w)
        on = value > penalty
        if penalty <= 0 or not on.any():
            continue
        # How far along each direction: a column's term grows with the square of its vector.
        g, c, cost = f[:, on], np.zeros(int(on.sum())), 0.5 * penalty * weight[on]
        for _ in range(10):
            p = _chance(raw + g @ c)
            step = np.linalg.solve(g.T @ (g * (p * (1 - p))[:, None]) + 1e-6 * np.eye(len(c)) * (g * g).sum(axis=0).max(), g.T @ (y - p) - cost)
            c = min((np.clip(c + 0.25**k * step, 0, None) for k in range(6)), key=lambda x: loss(raw + g @ x) + float(cost @ x))
        w[:, : len(c)] = u[:, on] * np.sqrt(c)
        # Then all vectors by gradient steps.
        now, length, terms = loss(raw + g @ c) + float(cost @ c), 1.0 / penalty, g @ c
        for _ in range(STEPS if w.any() else 0):
            way = few.slope(y - _chance(raw + terms), w) / scale - penalty * w
            for _ in range(8):
                tried = w + length * way
                more = few.values(tried).sum(axis=1)
                got = loss(raw + more) + 0.5 * penalty * float((scale * tried * tried).sum())
                if got < now:
                    w[:], now, terms, length = tried, got, more, length * 2
                    break
                length /= 4
            else:
                break
    return out


def pairs_of(slots: list[np.ndarray], size: int, keep: np.ndarray, mean: np.ndarray | None = None) -> Pairs:
    """Pairs among the slots ``keep`` only, numbered from 1."""
    at = np.zeros(size, np.int64)
    at[keep] = np.arange(1, len(keep) + 1)
    return Pairs([at[x][at[x] > 0] for x in slots], len(keep) + 1, mean)


def fitted_loss(x: np.ndarray, y: np.ndarray) -> float:
    """Logarithmic loss of a logistic regression on the columns of ``x``, with no coefficient below zero."""
    x = np.column_stack([x / np.maximum(x.std(axis=0), 1e-9), np.ones(len(y))])
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = _chance(x @ c)
        c = c + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(len(c)), x.T @ (y - p) - 1e-3 * c)
        c[:-1] = np.clip(c[:-1], 0, None)
    raw = x @ c
    return float((np.logaddexp(0, raw) - y * raw).sum())


def choose_share(rows: list[tuple[np.ndarray, int]], slots: list[np.ndarray], y: np.ndarray, size: int, start: float, rng: np.random.Generator) -> float | None:
    """The penalty whose pairs add most to linear scores of kept-aside texts; None if none adds more than
    one coefficient chosen among as many penalties would by chance (Akaike's criterion and a union bound)."""
    fold, raw, found = rng.integers(0, FOLDS, len(rows)), np.zeros(len(rows)), np.zeros((len(rows), len(SHARES)))
    for k in range(FOLDS):
        here, aside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        mine, linear = [slots[i] for i in here], Linear(start)
        own = linear.fit([rows[i] for i in here], np.zeros(len(here)), 1, rng)
        raw[aside] = linear.scores([rows[i] for i in aside])
        keep = leading_terms(Pairs(mine, size), y[here] - _chance(own), rng)
        few = pairs_of(mine, size, keep)
        other = pairs_of([slots[i] for i in aside], size, keep, few.mean)
        for j, latent in enumerate(fit_latent(few, own, y[here], SHARES, rng)):
            found[aside, j] = other.values(latent).sum(axis=1)
    base = fitted_loss(raw[:, None], y)
    gain = [base - fitted_loss(np.column_stack([raw, found[:, j]]), y) for j in range(len(SHARES))]
    return SHARES[int(np.argmax(gain))] if max(gain) > 1 + np.log(len(SHARES)) else None


def centred(linear: np.ndarray, bias: float, latent: np.ndarray, slot: np.ndarray, mean: np.ndarray) -> Model:
    """The model whose plain pairs, with the linear weights and bias, give what ``Pairs.values`` gives about ``mean``."""
    m = mean @ latent
    return Model(bias + 0.5 * float(m @ m), linear - (latent @ m)[slot], latent, slot)


def fit_rows(rows: list[tuple[np.ndarray, int]], seed: int = 0) -> Model:
    """Fit on (ids, label) pairs: the latent vectors, then the linear weights beside them."""
    rng = np.random.default_rng(seed)
    df = np.zeros(1 << BITS, np.int64)
    for ids, _ in rows:
        df[ids] += 1
    wide = df >= MIN_LATENT_DOCS
    slot, size = np.where(wide, np.cumsum(wide), 0), int(wide.sum()) + 1
    y_mean = np.mean([y for _, y in rows]) if rows else 0.0
    start = float(np.log((y_mean + 1e-3) / (1 - y_mean + 1e-3)))
    latent, mean, linear = np.zeros((1, RANK)), np.zeros(1), Linear(start)
    at = np.zeros(1 << BITS, np.int64)
    if 0 < y_mean < 1:
        rows = [(ids[df[ids] >= MIN_DOCS], y) for ids, y in rows]
        y = np.array([y for _, y in rows], float)
        slots = [slot[ids][slot[ids] > 0] for ids, _ in rows]
        beside = np.zeros(len(rows))
        share = choose_share(rows, slots, y, size, start, rng) if size > 1 else None
        if share is not None:
            # After one epoch no score knows its own text's label: linear weights learn long texts by heart, and pairs would find no errors.
            raw = Linear(start).fit(rows, beside, 1, rng)
            keep = leading_terms(Pairs(slots, size), y - _chance(raw), rng)
            few = pairs_of(slots, size, keep)
            latent, mean = fit_latent(few, raw, y, (share,), rng)[0], few.mean
            beside = few.values(latent).sum(axis=1)
            number = np.zeros(size, np.int64)
            number[keep] = np.arange(1, len(keep) + 1)
            at = number[slot]
        linear.fit(rows, beside, EPOCHS, rng)
    return centred(linear.weights(), linear.bias, latent, at, mean)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold; of several labels of a document the largest."""
    sample = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~fold_held_out(F.col("doc_id"), 5, 0))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            ids = [array("I", sorted(terms(t.as_py()).tolist())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["toxic", "ids"])

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # at most train_rows rows
        .select("toxic", "text")
        .mapInArrow(features, "toxic int, ids binary")
        .toPandas()
        .sort_values(["ids", "toxic"])
    )
    return fit_rows([(np.frombuffer(r.ids, "<u4").astype(np.int64), int(r.toxic > 0)) for r in rows.itertuples()])


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (columns of these names are replaced) from whole texts.

    Null and empty texts get the model's base rate.  Repeated rows stay repeated.  ``carry``
    names the columns that the result keeps (all).
    """
    docs = docs.drop("score", "predicted")
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = Model(**shared.value), Terms()
        for batch in batches:
            out = []
            for t in batch.column(batch.schema.get_field_index(text)):
                ids = terms(t.as_py())
                out.append(m.bias + m.linear[ids].sum() + pair_terms(ids, m))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(carry).columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*carry, "score", "predicted"]
            )

    return docs.mapInArrow(rate, added(docs.select(carry), score="double", predicted="int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    rows = docs.select("doc_id", fold_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return score(rows, model, carry=["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")
