"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into (host suffix, path prefix) expressions.  Expressions and rules meet
in an equi-join on the first four bytes of their SHA-256; the full digest then confirms a hit
and the longest rule decides.

The host suffixes of a URL are those with as many labels as some rule's host, the path prefixes
those as long as some rule's path, so a URL makes at most (distinct label counts) x (distinct path
lengths) expressions however long its host and its path are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stage

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Rules are broadcast up to this many; beyond it they meet the expressions in a shuffled join.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty where the host rule finds no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    # The length of the host keeps (a, b/c) and (a/b, /c) apart.
    return F.sha2(F.concat_ws("|", F.length(host).cast("string"), F.concat(host, path)), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``.

    A rule fits its host and all its subdomains if the path starts with the rule's path.  The
    longest rule (host plus path) wins; of one rule listed as allow and block, block.  No rule:
    ``rule`` is null and the verdict ``default``.  Null or unparsable URLs have an empty host,
    which no rule fits.  Columns of ``pages`` with the names of the four results are replaced, others
    pass through whatever their names; repeated rows stay repeated, an empty table stays empty, and
    a URL of any length makes as many expressions as the rules ask for.
    """
    spark = pages.sparkSession
    clash = [c for c in pages.columns if c in ("host", "path", "rule", "verdict") and c != url]
    base = pages.drop(*clash).withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    known = (
        rules.where("host is not null and path is not null and host <> ''")
        .select(
            ascii_lower(F.col("host")).alias("r_host"),
            F.col("path").alias("r_path"),
            (F.col("verdict") == "block").alias("r_block"),
        )
        .groupBy("r_host", "r_path")
        .agg(F.max("r_block").alias("r_block"))
        .withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("prefix", _prefix(F.col("digest")))
    )
    n_rules = known.limit(BROADCAST_RULES + 1).count()
    # At most as many lengths as a path can have; they bound the expressions of a URL.
    lengths = sorted(r[0] for r in known.select(F.length("r_path")).distinct().collect())
    if not lengths:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = base.select("host", "path").where("host <> ''").distinct()
    # At most as many counts as a host has labels, a few in practice.
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    counts = sorted(r[0] for r in known.select((dots(F.col("r_host")) + 1).alias("n")).distinct().collect())
    suffixes = F.array(*[F.when(dots(F.col("host")) + 1 >= m, F.substring_index("host", ".", -m)) for m in counts])
    exprs = (
        keys.withColumn("r_host", F.explode(F.array_compact(suffixes)))
        .withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths])))
        .where(F.length("path") >= F.col("n"))
        .withColumn("digest", _digest(F.col("r_host"), F.expr("substring(path, 1, n)")))
        .select("host", "path", "digest", _prefix(F.col("digest")).alias("prefix"))
    )
    side = known.select("prefix", F.col("digest").alias("full"), "r_host", "r_path", "r_block")
    hits = exprs.join(F.broadcast(side) if n_rules <= BROADCAST_RULES else side, "prefix").where("digest = full")
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length(F.concat("r_host", "r_path")).alias("n"),
                F.length("r_host").alias("h"),
                F.col("r_block").alias("block"),
                F.concat("r_host", "r_path").alias("rule"),
            )
        ).alias("best")
    )
    # Written out first, so that the join below can split a host that holds many rows.
    best = stage(best.select("host", "path", "best.rule", "best.block"), "url-rules").alias("b")
    same = (F.col("p.host") == F.col("b.host")) & (F.col("p.path") == F.col("b.path"))
    return base.alias("p").join(best, same, "left").select(
        *[F.col(f"p.`{c}`") for c in base.columns],
        F.col("b.rule").alias("rule"),
        F.when(F.col("b.block"), "block").when(~F.col("b.block"), "allow").otherwise(default).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
ORACLE = rf"""
WITH p AS (
  SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                       ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
keys AS (SELECT DISTINCT host, path FROM p),
best AS (
  SELECT host, path, arg_max(h || rp, length(h || rp)) AS rule, arg_max(v, length(h || rp)) AS verdict
  FROM keys JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
