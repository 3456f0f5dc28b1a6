"""URL filters by host-suffix and path-prefix expressions (operator 4).

A rule is (host, path, action). It fits its host and all subdomains if the url's path starts with
the rule's path; of the fitting rules the longest wins. Each url is expanded into expressions: a
suffix of its host (cut at dots) and a prefix of its path (cut after slashes), no deeper than the rules go. A rule is filed
under its host and its path up to the last slash. Rules and expressions meet in an equi-join on
the first four bytes of the expression's SHA-256; the full digests are then compared, and what
is left of the rule's path is compared with the url's path.

Expressions are made for distinct (host, path) pairs, so an address that a third of the rows
share is expanded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values of the query: (host, path, action).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Verdict of the method where no rule fits.
DEFAULT = "allow"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def occurrences(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def host_suffixes(host: Column, most: Column) -> Column:
    """What follows a dot of the host, or all of it, as far as it has at most ``most`` labels; none of an empty host."""
    deepest = F.least(occurrences(host, ".") + 1, most)
    return F.when((host == "") | (most < 1), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), deepest), lambda i: F.call_function("substring_index", host, F.lit("."), -i)))


def path_prefixes(path: Column, most: Column) -> Column:
    """The empty prefix and the path up to each of its first ``most`` slashes."""
    return F.transform(F.sequence(F.lit(0), F.least(occurrences(path, "/"), most)), lambda i: F.when(i == 0, F.lit("")).otherwise(
        F.concat(F.call_function("substring_index", path, F.lit("/"), i), F.lit("/"))))


def digest(host: Column, prefix: Column) -> Column:
    """SHA-256 (hex) of an expression; the NUL keeps host and path apart."""
    return F.sha2(F.concat(host, F.lit("\0"), prefix).cast("binary"), 256)


def short(full: Column) -> Column:
    """The first four bytes of a digest."""
    return F.substring(full, 1, 8)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with columns host, path, rule and verdict added.

    ``rules`` has host, path and action; hosts are compared in lower case (A-Z), rows with a null
    or an empty host are no rules, a null path is empty, repeated rules count once. Of the fitting
    rules the one with the longest host and path together wins, then the one with the longest host,
    then ``block`` before ``allow`` (smaller text last). Null urls and urls without ``://`` have
    empty host and path, rule null and the default verdict. Input columns with the added names are
    replaced; every row gives one row, an empty table an empty result. Hosts and paths are expanded no
    deeper than the deepest rule, so a url of any length gives a bounded number of expressions.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(f"`{url_col}`")).alias("host"),
                          url_path(F.col(f"`{url_col}`")).alias("path"))
    filed = (rules.select(ascii_lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action")
             .filter("rule_host <> ''").distinct()
             .withColumn("rule_digest", digest(F.col("rule_host"), F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0)))
             .withColumn("key", short(F.col("rule_digest"))))
    deepest = filed.agg(F.struct(F.max(occurrences(F.col("rule_host"), ".") + 1).alias("labels"),
                                 F.max(occurrences(F.col("rule_path"), "/")).alias("slashes"))).scalar()
    addresses = (parsed.select("host", "path").filter("host <> ''").distinct().withColumn("deepest", deepest)
                 .select("host", "path", F.coalesce("deepest.labels", F.lit(0)).alias("labels"), F.coalesce("deepest.slashes", F.lit(0)).alias("slashes")))
    expressions = (addresses.select("host", "path", "slashes", F.explode(host_suffixes(F.col("host"), F.col("labels"))).alias("suffix"))
                   .select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"), F.col("slashes"))).alias("prefix"))
                   .select("host", "path", digest(F.col("suffix"), F.col("prefix")).alias("full"))
                   .withColumn("key", short(F.col("full"))))
    confirmed = (expressions.join(filed, "key")
                 .filter((F.col("full") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"),
                    F.col("action").alias("act"), "rule_host", "rule_path")
    best = (confirmed.groupBy("host", "path").agg(F.max(rank).alias("best"))
            .select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.act").alias("verdict")))
    return (parsed.join(best, ["host", "path"], "left")
            .select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


# -- query ---------------------------------------------------------------------------------------

def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url under the four fixed rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)

ORACLE_SQL = f"""
WITH rules(rule_host, rule_path, action) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parsed AS (
  SELECT n, page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
fits AS (
  SELECT n, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, action DESC) AS r
  FROM parsed JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, '{DEFAULT}') AS verdict
FROM parsed LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (n)
"""
