"""Fill-in-the-middle texts from relational units.

A text's units (lines, unless another pattern is given) become rows, a window adds up their lengths,
and two cut requests a document meet them by ordinal: the smaller ordinal's offset ends the prefix,
the larger one's the middle.  Only ordinals and lengths are shuffled with the keys; texts meet the two
offsets once, in one join, and are cut by ``substring``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A line with its end, or what is left after the last end.
LINES = "[^\\n]*\\n|[^\\n]+"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Columns that the transformation adds.
ADDED = ("n", "form", "output", "prefix_chars", "middle_chars")


def draws(key: Column, seed: int = 7) -> list[Column]:
    """Four unsigned 32-bit numbers of a key: the first four 8-digit groups of the hex sha256 of ``seed:key``.  A null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _pattern(marks: tuple[str, str, str]) -> str:
    return "|".join(re.escape(m) for m in marks)


def unit_ends(texts: DataFrame, units: str = LINES) -> DataFrame:
    """(key, ordinal, end): characters up to and including the ``ordinal``-th unit (from 1) of each (key, text).

    Rows that repeat a key must repeat its text; they count once.  Texts without units give no rows.
    """
    rows = texts.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(units), F.lit(0))).alias("at", "unit"))
    rows = rows.select("key", "at", F.length("unit").alias("chars")).repartition("key")  # once, for both steps
    once = rows.groupBy("key", "at").agg(F.max("chars").alias("chars"))
    end = F.sum("chars").over(W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    return once.select("key", (F.col("at") + 1).alias("ordinal"), end.alias("end"))


def transform(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    units: str = LINES,
    percent: int = 100,
    spm_percent: int = 50,
    seed: int = 7,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Add ``n`` (units), ``form``, ``output``, ``prefix_chars`` and ``middle_chars`` to every row.

    The prefix ends after the smaller, the middle after the larger of two ordinals from 0 to n that
    the key's :func:`draws` give; equal ones leave the middle empty.  Of the documents, ``percent``
    in 100 are transformed, ``spm_percent`` in 100 of these with the suffix first; an empty or null
    text, or one that contains a mark, stays as it is: form ``plain``, null counts of characters,
    output the text (empty for null).  ``units`` must cover the text without gaps.  A null key is
    drawn for as an empty one; rows with the same key and text get the same result, rows with the
    same key and other texts their own.  Other columns pass through, whatever their names; columns
    with the names of the added ones are replaced.  An empty table stays empty.
    """
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    p, s, m = marks
    kept = [c for c in docs.columns if c not in ADDED]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    plain = (body == "") | body.rlike(_pattern(marks)) | (h3 % 100 >= percent)
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        body.alias("text"),
        # The text's digest keeps apart rows that share a key.
        F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))).alias("key"),
        F.regexp_count(body, F.lit(units)).cast("long").alias("n"),
        F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    cut = base.where("form <> 'plain'")
    ends = unit_ends(cut.select("key", "text"), units)
    pair = F.array(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))
    requests = cut.select("key", F.explode(pair).alias("ordinal")).distinct()
    # Offsets grow with the ordinals, so the least is the prefix's end and the greatest the middle's.
    found = requests.join(ends, ["key", "ordinal"], "left").select("key", F.coalesce("end", F.lit(0)).alias("end"))
    offsets = found.groupBy("key").agg(F.min("end").alias("a"), F.max("end").alias("b"))
    # Texts travel once, in their rows.
    whole = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    joined = base.drop("text").join(offsets, "key", "left").withColumn("text", whole)
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    before, rest = F.substring("text", F.lit(1), a), F.substring("text", b + 1, F.length("text") - b)
    middle = F.substring("text", a + 1, b - a)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(p), before, F.lit(s), rest, F.lit(m), middle))
        .otherwise(F.concat(F.lit(s), rest, F.lit(p), before, F.lit(m), middle))
    )
    return joined.select(
        "row.*", "n", "form", output.alias("output"), F.col("a").cast("long").alias("prefix_chars"), (b - a).cast("long").alias("middle_chars")
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that :func:`transform` rearranged; a plain output is the text itself."""
    parts = F.split(output, _pattern(marks), -1)
    ordered = F.when(form == "psm", F.array(parts[1], parts[3], parts[2])).otherwise(F.array(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(F.array_join(ordered, ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = transform(docs)
    back = restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[25:32])::BIGINT AS h4,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM h
), p AS (
  SELECT *, array_to_string(u[1:i], '') AS a, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:n], '') AS z FROM c
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE '<P>' || a || '<S>' || z || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
