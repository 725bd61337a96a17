"""URL rules by host-suffix and path-prefix expressions and hashed lookups.

Each URL becomes a short list of expressions ``host suffix + path prefix``
(as many labels and characters as some rule has, so the list is bounded by the
rules, not by the URL). Expressions meet the rules in an equi-join on the first
eight hex digits of their SHA-256; the full digests confirm a meeting. Of the
rules that fit, the longest wins, of equals the blocking one.

Scale. Only distinct URLs are expanded and only their url and expressions
shuffle; a URL that a third of the pages carry is expanded once and its verdict
joined back (AQE splits that side). The rules' side is broadcast by the planner
when its size allows.

A null URL, or one without ``://``, has an empty host and path and fits no rule.
Equal rows are judged each, further columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``path`` is matched as a prefix of the URL's path, ``host`` with its subdomains."""

    verdict: str
    host: str
    path: str


#: Fixed values of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All host suffixes of so many labels with all path prefixes of so many characters."""
    parts = F.split(host, r"\.")
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]
    prefixes = [F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes]))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", prefix: int = 8) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; ``default`` where no rule fits."""
    spark: SparkSession = pages.sparkSession
    known = spark.createDataFrame([(r.host.lower() + r.path, r.verdict) for r in rules], "rule string, verdict string")
    known = known.select("rule", "verdict", F.sha2("rule", 256).alias("rule_digest"), F.substring(F.sha2("rule", 256), 1, prefix).alias("short"))
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = own.where(F.col("url").isNotNull()).select("url").distinct()
    expanded = urls.select("url", F.explode(expressions(host_of(F.col("url")), path_of(F.col("url")), labels, lengths)).alias("expression"))
    hashed = expanded.select("url", F.sha2("expression", 256).alias("digest")).withColumn("short", F.substring("digest", 1, prefix))
    met = hashed.join(known, "short").where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.char_length("rule"), F.col("verdict") == "block", "rule", "verdict")
    best = met.groupBy("url").agg(F.max(rank).alias("best")).select("url", "best.rule", "best.verdict")
    out = own.join(best, "url", "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fitted AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM fitted
"""
