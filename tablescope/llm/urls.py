"""Operator 7, URL filters: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of eight 32-bit words. A URL sets and tests one bit in each word of one block, so a
lookup is a join with a single row; only URLs whose eight bits are all set go on to the exact join with the list.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from .links import join_small

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Parts of host names that put a URL on the list of the query.
LISTED_HOSTS = ("casino", "bets", "pills", "loans", "porn")
WORDS, URLS_PER_BLOCK = 8, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path, both '' for NULL or without '://'."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), "^[^?#]*", 0)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading 'www.' and path without trailing slashes; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, NULL if none."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _bit(url: Column, i: int) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(F.xxhash64(url, F.lit(7)), 5 * i).bitwiseAND(F.lit(31)).cast("int"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) from distinct (url); the words of a block are OR-ed as they come, before the shuffle too."""
    return listed.groupBy(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block")).agg(*[F.bit_or(_bit(F.col("url"), i)).alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: host, path, rule, possible (the filter's answer), listed (the exact one), verdict.

    The longest fitting rule decides; without one a listed URL is blocked and any other allowed. `listed` has a column
    `url` of canonical URLs; NULLs and '' in it are ignored. A NULL or malformed URL has host and path '', no rule, and is
    allowed. Equal rows give equal results; other columns are not looked at.
    """
    known = freeze(listed.select("url").where("url <> ''").distinct())
    n = known.count()
    blocks = max(1, -(-n // URLS_PER_BLOCK))
    table = freeze(bloom(known, blocks))
    host, path = host_and_path(F.col("raw"))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("raw")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = _rule(F.col("host"), F.col("path"), rules)
    own = own.select("*", name.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("url"))
    own = own.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks)))
    tested = join_small(own, table, ["block"], "left", 64)
    possible = F.lit(True)
    for i in range(WORDS):
        possible = possible & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(_bit(F.col("url"), i)) != 0)
    tested = tested.select("page_id", "host", "path", "rule", "by_rule", possible.alias("possible"), F.when(possible, F.col("url")).alias("maybe"))
    exact = join_small(tested, known.select(F.col("url").alias("maybe"), F.lit(True).alias("hit")), ["maybe"], "left", 100)
    hit = F.coalesce("hit", F.lit(False))
    return exact.select("page_id", "host", "path", "rule", "possible", hit.alias("listed"),
                        F.coalesce("by_rule", F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = host_and_path(F.col("url"))
    listed = pages.select(host.alias("host"), canonical(host, path).alias("url")).where(F.col("host").rlike("|".join(LISTED_HOSTS))).select("url")
    return judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")
