"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is a blank; n-grams of one to three characters are
hashed to ``BUCKETS`` columns.  Document frequencies cover all training documents.  Weights are
fitted with follow-the-regularised-leader under an elastic net on a bounded sample, and a
temperature fitted on a part of the sample kept aside makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold_held_out

BUCKETS = 1 << 16
#: Sample per language: PARTS hash parts of PART_ROWS rows at most, whole texts.
PARTS, PART_ROWS = 64, 24
#: Follow-the-regularised-leader: step, damping, and the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
EPOCHS = 3
#: Scale of the relative term frequencies.
SCALE = 100.0
#: Characters handled at once; each takes about 130 bytes and a double a language meanwhile.
CHUNK_CHARS = 1 << 16


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), inverse document frequency included
    bias: np.ndarray
    temperature: float


class Rows(Sequence):
    """(buckets, values, class) of sampled texts, held as buckets and term frequencies of 32 bits."""

    def __init__(self, held: list, scale: np.ndarray):
        self.held, self.scale = held, scale

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return Rows(self.held[i], self.scale)
        ids, tf, y = self.held[i]
        ids = ids.astype(np.int64)
        return ids, tf.astype(np.float64) * self.scale[ids], y


class Grams:
    """Hashed n-grams of many texts at once."""

    def __init__(self):
        self.letter = np.array([chr(i).isalpha() for i in range(0x10000)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(three buckets per position, start of each text, letters per text); two blanks follow a text, as far as an n-gram looks back."""
        low = [t.lower() + "  " for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letter[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
        c = np.where(is_letter, codes, np.uint32(32))
        prev = np.concatenate(([np.uint32(32)], c[:-1]))
        last = np.concatenate(([np.uint32(32)], prev[:-1]))
        h1 = c * np.uint32(2654435761)
        h2 = h1 ^ (prev * np.uint32(2246822519) + np.uint32(374761393))
        h3 = h2 ^ (last * np.uint32(3266489917) + np.uint32(668265263))
        grams = np.stack([h1, h2, h3])
        grams ^= grams >> np.uint32(15)
        grams *= np.uint32(0x85EBCA6B)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return (grams >> np.uint32(16)).astype(np.int64), starts, np.add.reduceat(is_letter.astype(np.int64), starts)


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in lists of about ``CHUNK_CHARS`` characters."""
    held, texts = 0, []
    for t in column:
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held > CHUNK_CHARS:
            yield texts
            held, texts = 0, []
    if texts:
        yield texts


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold each bucket, and how many there are; a row per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, seen, n = Grams(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.bool_), 0
        for batch in batches:
            for texts in _chunks(batch.column(0)):
                found, starts, _ = grams(texts)
                ends = np.append(starts[1:], found.shape[1])
                for a, b in zip(starts, ends, strict=True):
                    seen[found[:, a:b]] = True
                    total += seen
                    seen[:] = False
                n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["bucket", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    known = rows[rows.bucket >= 0]
    out[known.bucket] = known.n
    return out, int(rows.n[rows.bucket < 0].sum())


def _sample(docs: DataFrame, part_rows: int) -> DataFrame:
    key = F.xxhash64("doc_id", "text")
    within = W.partitionBy("lang", F.pmod(key, F.lit(PARTS))).orderBy(key, "doc_id")
    return docs.withColumn("_k", F.row_number().over(within)).where(F.col("_k") <= part_rows).drop("_k")


def fit(train: DataFrame, part_rows: int = PART_ROWS) -> Model:
    """Fit on (doc_id, text, lang) rows with a language; at most PARTS * ``part_rows`` texts per language."""
    train = train.where("lang is not null and text is not null")
    languages = sorted(r.lang for r in train.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    frequency, n_docs = document_frequencies(train)
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1.0
    keys = _sample(train.select("doc_id", "lang", F.xxhash64("text").alias("text")), part_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            rows, at = [], 0
            names = batch.column(1).to_pylist()
            for texts in _chunks(batch.column(0)):
                found, starts, _ = grams(texts)
                for a, b in zip(starts, np.append(starts[1:], found.shape[1]), strict=True):
                    ids, n = np.unique(found[:, a:b], return_counts=True)
                    rows.append((names[at], ids.astype("<u4").tobytes(), (n / (3 * (b - a))).astype("<f4").tobytes()))
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))],
                names=["lang", "ids", "tf"],
            )

    # The sampled keys are bounded by the parameters above; texts stay on the executors.
    sampled = (
        train.withColumn("_t", F.xxhash64("text"))
        .join(F.broadcast(keys.select("doc_id", F.col("text").alias("_t")).distinct()), ["doc_id", "_t"], "left_semi")
        .select("text", "lang")
        .mapInArrow(features, "lang string, ids binary, tf binary")
        .toPandas()
        .sort_values(["lang", "ids", "tf"])
    )
    rng = np.random.default_rng(0)
    number = {name: i for i, name in enumerate(languages)}
    # Views of the bytes that came; each text is widened when it is read.
    seen = [(np.frombuffer(ids, "<u4"), np.frombuffer(tf, "<f4"), number[lang]) for lang, ids, tf in zip(sampled.lang, sampled.ids, sampled.tf, strict=True)]
    rows = Rows([seen[i] for i in rng.permutation(len(seen))], SCALE * idf)
    held = max(len(rows) // 5, 1)
    fitted, kept = (rows[held:], rows[:held]) if len(rows) >= 10 else (rows, rows)
    weights, bias = _leader(fitted, len(languages), rng)
    temperature = _temperature(kept, weights, bias)
    return Model(languages, weights * (SCALE * idf)[:, None], bias, temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _leader(rows: Sequence, classes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, one document at a time."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def solve(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, x, y = rows[i]
            ids, x = np.append(ids, BUCKETS), np.append(x, 1.0)  # the last column is the bias
            zi, ni = z[ids], n[ids]
            w = solve(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            more = ni + g * g
            z[ids] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[ids] = more
    for k in range(0, len(z), 4096):  # in place, as all languages are learned
        z[k : k + 4096] = solve(z[k : k + 4096], n[k : k + 4096])
    return z[:BUCKETS], z[BUCKETS]


def _temperature(rows: Sequence, weights: np.ndarray, bias: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    z = np.array([x @ weights[ids] + bias for ids, x, _ in rows])
    y = np.array([r[2] for r in rows])

    def loss(t: float) -> float:
        return -np.log(_softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (columns of these names are replaced) from whole texts.

    Texts that are null or have no letter get ``und`` and 0; so do all, if nothing was learned.
    Ties go to the first language in code-point order.  Repeated rows stay repeated.  ``carry``
    names the columns that the result keeps (all).  Only texts go to Python, and no text comes back.
    """
    docs = docs.drop("lang_pred", "score")
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, grams = Model(**shared.value), Grams()
        names = np.array([*m.languages, "und"], object)
        for column in columns:
            preds, scores = [], []
            for texts in _chunks(column):
                found, starts, letters = grams(texts)
                if m.languages:
                    sums = sum(np.add.reduceat(m.weights[g], starts, axis=0) for g in found)
                    size = np.diff(np.append(starts, found.shape[1]))[:, None]
                    p = _softmax((sums / (3 * size) + m.bias) / m.temperature)
                    best = p.argmax(axis=1)
                    top = p[np.arange(len(best)), best]
                    best = np.where(letters > 0, best, -1)
                    preds.append(names[best])
                    scores.append(np.where(letters > 0, top, 0.0))
                else:
                    preds.append(np.full(len(texts), "und", object))
                    scores.append(np.zeros(len(texts)))
            cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
            yield pa.StructArray.from_arrays([cat(preds, pa.string()), cat(scores, pa.float64())], names=["lang_pred", "score"])

    # Not deterministic for the planner only, which else may label texts once for a filter and again for the result.
    found = F.arrow_udf(label, "lang_pred string, score double").asNondeterministic()
    kept = [F.col(f"`{c}`") for c in carry]
    return docs.select(*kept, found(F.col(f"`{text}`")).alias("_found")).select(*kept, "_found.lang_pred", "_found.score")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: the fold of the contract, with a language."""
    return docs.select("doc_id", "text", "lang").where(~fold_held_out(F.col("doc_id"), 3, 1))


def accepted(minimum: float = 0.5) -> Column:
    """Rows that the pipeline keeps: some language is likelier than all others together."""
    return (F.col("lang_pred") != "und") & (F.col("score") >= minimum)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs))
    rows = docs.select("doc_id", fold_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return predict(rows, model, carry=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
