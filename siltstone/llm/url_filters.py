"""URL filters, in DataFrame functions only.

A rule is a host, a path prefix and a verdict. It fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's path. Each distinct (host, path) is expanded into host suffix + path prefix expressions:
the suffixes with as many labels as some rule's host has, and the path's prefix at each length that a rule of the table has. Expressions meet
the rules in an equi-join on the first four bytes of their SHA-256; the full digests are then compared, and the
longest rule wins (of equal length: block before allow, then the smaller text). A URL that no rule fits gets the
default verdict.

Null URLs and URLs without `://` have an empty host and path, and fit no rule. Repeated URLs are judged once; the
verdicts join back to all rows, so repeated rows stay. Empty tables give empty results. Columns of the pages other
than the identifier and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The rules of the query, as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"
PREFIX_BYTES = 4


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes with as many labels as some rule's host, each with path prefixes as long as some rule's path."""
    suffixes = F.array(*[F.substring_index(host, ".", -n) for n in labels])
    has = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    fitting_hosts = F.filter(F.arrays_zip(F.array(*[F.lit(n) for n in labels]).alias("n"), suffixes.alias("suffix")), lambda x: x["n"] <= has)
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(fitting_hosts, lambda s: F.transform(prefixes, lambda p: F.concat(s["suffix"], p))))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judged(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: id_column, host, path, rule (host and path of the rule that won, or null), verdict."""
    # as many lengths as the rules have different ones: never more than a URL has characters
    used = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
    lengths = sorted(r[0] for r in used.select(F.length("path")).distinct().collect())
    # and as many label counts: never more than a host has labels
    labels = sorted(r[0] for r in used.select(F.size(F.split("host", r"\.", -1))).distinct().collect())
    listed = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.concat("host", "path").alias("rule"), "verdict")
        .select("rule", F.col("verdict").alias("rule_verdict"), F.sha2(F.col("rule").cast("binary"), 256).alias("rule_digest"))
        .withColumn("prefix", F.substring("rule_digest", 1, 2 * PREFIX_BYTES))
    )
    placed = pages.select(F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    if not lengths:
        return placed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    each = placed.select("host", "path").distinct().filter(F.col("host") != "")
    spread = each.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), labels, lengths)).alias("expression"))
    hashed = spread.withColumn("digest", F.sha2(F.col("expression").cast("binary"), 256)).withColumn("prefix", F.substring("digest", 1, 2 * PREFIX_BYTES))
    met = hashed.join(listed, "prefix").filter(F.col("digest") == F.col("rule_digest"))
    order = F.struct(F.length("rule").alias("length"), (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict")
    won = met.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    out = placed.join(won, ["host", "path"], "left")
    return out.select(id_column, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), rules_table(spark, RULES))


SQL = f"""
WITH r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
s AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
),
d AS (SELECT DISTINCT host, path FROM u),
m AS (
  SELECT host, path, h || p AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC) AS rn
  FROM d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, u.host, u.path, m.rule, coalesce(m.v, '{DEFAULT}') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path AND m.rn = 1
"""
