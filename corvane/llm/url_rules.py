"""URL filter rules by expanded expressions (operator 8).

Every distinct URL is expanded into host-suffix x path-prefix expressions. Only suffixes with a label count and
prefixes with a length that some rule has are made, so a URL yields at most as many expressions as the rules have
different (labels, length) shapes, however long it is. Expressions meet rules in an equi-join on the first 32 bits of
a SHA-256, the full digests confirm, and the longest rule wins (ties: allow before block, then the smaller text).

Defined results: a null URL or one without `://` has an empty host and path and fits no rule; repeated pages each get
a row; an empty table gives an empty result; rules with a null part are ignored; further columns of pages are kept out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "verdict string, host string, path string")


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.expr(f"locate('://', `{url}`)")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict. rules(verdict, host, path)."""
    pages = split_url(pages.select("page_id", "url"))
    rules = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    rules = rules.select(
        "verdict", F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("prefix"), _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    )
    rules = rules.withColumn("short", F.substring("rule_digest", 1, 8))
    #: One row: the rules' shapes, at most (label counts) x (path lengths) of them.
    shapes = [(r.labels, r.prefix) for r in rules.select("labels", "prefix").distinct().toLocalIterator()]
    if not shapes:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    places = pages.select("host", "path").where("host != ''").distinct()
    expressions = F.array(*[
        F.when(
            (F.col("labels") >= n) & (F.length("path") >= k),
            F.struct(F.substring_index("host", ".", -n).alias("h"), F.substring("path", 1, k).alias("p")),
        )
        for n, k in shapes
    ])
    expanded = places.withColumn("labels", F.size(F.split("host", r"\."))).select("host", "path", F.explode(F.filter(expressions, lambda e: e.isNotNull())).alias("e"))
    expanded = expanded.select("host", "path", _digest(F.col("e.h"), F.col("e.p")).alias("digest"))
    found = expanded.withColumn("short", F.substring("digest", 1, 8)).join(rules, "short").where("digest = rule_digest")
    rank = F.struct(F.length("rule"), (F.col("verdict") == "allow").cast("int"), F.col("rule"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
