"""URL filter: host rules, then a blocked Bloom filter in front of an exact join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, broadcast_if, stored

#: (host, path, verdict); fixed values.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
WORDS_A_BLOCK = 8
BITS_A_KEY = 16
#: Blocks that may be broadcast (8 longs each); more are joined by shuffle.
MOST_BLOCKS = 50_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path as text; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The listed form: host without a leading www., path without trailing slashes; scheme, query and fragment dropped."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and the path's start; nulls if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def bits(key: Column) -> list[Column]:
    """One bit of each of a block's words, from one 64-bit hash."""
    h = F.xxhash64(F.lit(1), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS_A_BLOCK)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: block, w0..w7. Built by bit_or, with partial aggregation before the shuffle."""
    b = bits(F.col("canon"))
    keyed = listed.select(F.pmod(F.xxhash64(F.lit(0), "canon"), F.lit(blocks)).alias("block"), *[c.alias(f"w{i}") for i, c in enumerate(b)])
    return keyed.groupBy("block").agg(*[F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS_A_BLOCK)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict.

    A fitting rule decides. Otherwise a page whose canonical URL is in
    `listed(canon)` is blocked, any other allowed. The Bloom filter (a block of
    8 x 64 bits per hash, 16 bits a key) passes possible hits; only those meet
    the list in an exact hash join, which removes false positives. Null URLs have
    empty host and path and are allowed unless '' is listed; nulls and repeats in
    the list are ignored. Columns of pages named like a result are replaced.
    Pages that the filter stops, most of them, are in no shuffle; those it passes
    are joined by canonical URL, where a very frequent one is left to the skew join
    of adaptive execution, as the list has one row a key. Very long URLs are keys
    like others. The list is written once and read by filter and join.
    """
    listed = stored(listed.where("canon is not null").select("canon").distinct())
    n = listed.count()
    blocks = max(1, -(-n * BITS_A_KEY // (64 * WORDS_A_BLOCK)))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    d = pages.select(F.struct(*kept).alias("_page"), F.col(url_col).alias("_url"))
    host, path = host_path(F.col("_url"))
    d = d.withColumns({"host": host, "path": path}).drop("_url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "verdict": verdict, "canon": canonical(F.col("host"), F.col("path"))})
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(0), "canon"), F.lit(blocks)))
    d = d.join(broadcast_if(bloom(listed, blocks), blocks, MOST_BLOCKS), "block", "left")
    passed = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(c) != 0 for i, c in enumerate(bits(F.col("canon")))])
    open_ = F.col("verdict").isNull() & F.coalesce(passed, F.lit(False))
    hits = d.where(open_).join(listed.withColumn("hit", F.lit(True)), "canon", "left").withColumn("verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    rest = d.where(~open_).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    cols = ("_page.*", "host", "path", "rule", "verdict")
    return rest.select(*cols).unionByName(hits.select(*cols))


def thin_pages(pages: DataFrame, least_paragraphs: int = 2) -> DataFrame:
    """A block list from the crawl itself: canonical URLs of pages with fewer than so many paragraphs."""
    host, path = host_path(F.col("_url"))
    few = F.coalesce(F.regexp_count(F.col("html"), F.lit("<p[ >]")), F.lit(0)) < least_paragraphs
    return pages.where(few).select(F.col("url").alias("_url")).select(canonical(host, path).alias("canon"))
