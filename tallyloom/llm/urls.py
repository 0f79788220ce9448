"""URL rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to
    `?`, `#` or the end. Both empty for null or without `://`."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    whole = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(whole, r"(?s)^[^/]*", 0)
    return F.translate(host, UPPER, LOWER), F.substring(whole, F.length(host) + 1, F.length(whole))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _hashed(expression: Column) -> list[Column]:
    """A 32-bit prefix to join on and the whole digest to confirm."""
    digest = F.sha2(expression, 256)
    return [F.substring(digest, 1, 8).alias("prefix"), digest.alias("digest")]


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict of the rules on every row of `pages`.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
    rule's path; of fitting rules the longest (host and path together, then host) wins, and `block`
    wins between two rules for one place. With no fitting rule the verdict is `default` and the
    rule null. Null or malformed URLs have empty host and path and fit no rule with a host. Rules
    with null host or path fit nothing. Repeated rows and ids each keep their row; empty inputs
    give no rows or the default. Other columns of `pages` are ignored.
    Returns (id, host, path, rule, verdict).

    Each distinct (host, path) is expanded into its host suffixes of as many labels, and its path
    prefixes of as many characters, as rules have: a long host or path costs its length, not its
    square. Distinct expressions, with how many URLs have them, meet the rules in an equi-join on
    32-bit hash prefixes, and whole SHA-256 digests confirm; what a hot expression such as `com/`
    says goes back to its URLs by broadcast, the rest by a shuffle. URLs are aggregated before, so
    a hot URL is judged once, and its rows get the verdict by a join that spreads hot keys."""
    host, path = host_and_path(url_col)
    rows = cut(pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("_key", F.sha2(F.concat("host", F.lit("\n"), "path"), 256)))
    urls = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.first("host").alias("host"), F.first("path").alias("path"))
    rules = rules.where("host is not null and path is not null")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."))) + 1
    counts = sorted(r[0] for r in rules.select(dots(F.col("host"))).distinct().collect())
    some = lambda numbers, most: F.filter(F.array(*[F.lit(n) for n in numbers]).cast("array<int>"), lambda n: n <= most)
    suffixes = F.transform(some(counts, dots(F.col("host"))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(some(lengths, F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = urls.select("_key", F.explode(suffixes).alias("_host"), prefixes.alias("_paths")).select("_key", "_host", F.explode("_paths").alias("_path"))
    asked = cut(expressions.select("_key", F.unhex(F.sha2(F.concat("_host", F.lit("\n"), "_path"), 256)).alias("digest")))
    distinct = asked.groupBy("digest").agg(F.count("*").alias("_n")).withColumn("prefix", F.lower(F.hex(F.substring("digest", 1, 4))))
    known = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        *[c.alias(f"r_{n}") for c, n in zip(_hashed(F.concat("host", F.lit("\n"), "path")), ("prefix", "digest"), strict=True)],
        F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict").alias("rule"),
    )
    confirmed = cut(distinct.join(known, F.col("prefix") == F.col("r_prefix")).where(F.lower(F.hex("digest")) == F.col("r_digest")).select("digest", "_n", "rule"))
    fits = join_hot(asked, confirmed, "digest", "_n").where("rule is not null")
    best = fits.groupBy("_key").agg(F.max("rule").alias("best"))
    judged = cut(urls.select("_key", "_n").join(best, "_key", "left"))
    return join_hot(rows, judged, "_key", "_n").select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
