"""The corpus pipeline: language ID, line dedup, near-duplicate documents, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents it
keeps, the last one the packed pieces.  Stages run one after the other, each on what its
predecessor wrote.  Stages with Python steps bound their batches by bytes, for the session; ``run``
takes that back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import langid, line_dedup, mixing, ngram_join, packing
from orrery.llm.common import BATCH_CONF, small_batches, stage, whole_row

#: Words per shingle and least similarity in percent of the near-duplicate stage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and undecided ones go."""
    small_batches(spark)
    model = langid.fit(langid.training_rows(docs))
    # Other columns travel as one; each text once.
    rows = docs.select(whole_row(docs.drop("text")).alias("row"), "text")
    kept = langid.predict(rows, model, carry=["row", "text"]).where(langid.accepted())
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches; documents left without any line go."""
    return line_dedup.without_emptied(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return ngram_join.one_per_group(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID, the join's components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_CONF)
    try:
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH_CONF, before)
    return docs
