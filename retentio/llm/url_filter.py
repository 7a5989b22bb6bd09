"""URL filter: a blocked Bloom filter in front of an exact hash join.

Listed canonical URLs are hashed into 64-bit blocks (one block per URL, ``BITS_SET`` bits
inside it); a block is one row ``(block, word)`` built by ``bit_or``.  Pages probe their one
block; only possible hits go on to the exact join with the list, which removes false
positives.  Host/path rules override the list.  Only SQL functions are used.

Sizes: the filter has about ``BITS_PER_URL`` bits per listed URL.  Its block table is
broadcast only if the block count is at most ``MAX_BROADCAST_BLOCKS`` (16 bytes a row);
beyond it the probe is a shuffle join on the block number.  The exact join salts the page
side and repeats the list ``SALTS`` times, so one hot URL is spread over tasks.

Defined edge cases: null url or no ``://`` gives empty host and path, rule null, verdict
``allow`` (an empty canonical URL is never listed); repeated rows are judged row by row;
an empty list blocks nothing; extra columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

BITS_PER_URL = 16
BITS_SET = 5
MAX_BROADCAST_BLOCKS = 1 << 20
SALTS = 8

# The rules of the contract, (host, path prefix, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
# Host words whose pages make up the query's URL list.
LISTED_HOST_WORDS = ["ads-", "adult", "bets", "casino", "pills", "spam"]

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path); both empty for null or a url without ``://``."""
    host = lower_ascii(F.regexp_extract(url, _SPLIT, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``; path without ``.html`` and closing slash."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):      # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """The key's bits in its block: five 6-bit slices of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def bloom_filter(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Blocks ``(block, word)`` of the distinct keys in ``listed`` and the number of blocks."""
    n = listed.select(key).distinct().count()
    blocks = 1 << max(4, math.ceil(math.log2(max(1, n) * BITS_PER_URL / 64)))
    rows = listed.select(_block(F.col(key), blocks).alias("block"), _mask(F.col(key)).alias("mask"))
    return rows.groupBy("block").agg(F.bit_or("mask").alias("word")), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """Judge every row of ``pages(page_id, url)``; ``listed`` holds canonical URLs in ``canonical_url``.

    Returns page_id, host, path, rule, verdict, canonical_url, listed.
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", canonical(F.col("host"), F.col("path")).alias("canonical_url"),
                           rule.alias("rule"), verdict.alias("by_rule"))
    listed = listed.select("canonical_url").filter(F.coalesce("canonical_url", F.lit("")) != "")
    exact = listed.distinct()
    bloom, blocks = bloom_filter(exact, "canonical_url")
    if blocks <= MAX_BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    key = F.col("canonical_url")
    mask = _mask(key)
    probed = (parsed.withColumn("block", _block(key, blocks)).join(bloom, "block", "left")
              .withColumn("maybe", F.coalesce(mask.bitwiseAND(F.col("word")) == mask, F.lit(False)))
              .drop("block", "word"))
    salt = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS))
    copies = (exact.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
              .withColumn("found", F.lit(True)))
    sure = (probed.filter("maybe").withColumn("salt", salt)
            .join(copies.hint("shuffle_hash"), ["canonical_url", "salt"], "left")
            .withColumn("listed", F.coalesce("found", F.lit(False))).drop("salt", "found"))
    both = sure.unionByName(probed.filter(~F.col("maybe")).withColumn("listed", F.lit(False)))
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical_url", "listed")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judge every page; the list: canonical URLs of pages whose host carries a listed word."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    host, path = split_url(F.col("url"))
    listed = (pages.filter(host.rlike("|".join(LISTED_HOST_WORDS)))
              .select(canonical(host, path).alias("canonical_url")))
    return filter_urls(pages, listed)


_RULE_CASES = "\n".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
    for i, (h, p, _) in sorted(enumerate(RULES), key=lambda r: -len(r[1][0] + r[1][1])))

OP5_SQL = f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '{_SPLIT}', 1), ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}',
                   '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
         coalesce(regexp_extract(url, '{_SPLIT}', 2), '') AS path
  FROM pages),
c AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') AS canonical_url,
         CASE {_RULE_CASES.format(*[h + p for h, p, _ in RULES])} END AS rule,
         CASE {_RULE_CASES.format(*[v for _, _, v in RULES])} END AS by_rule
  FROM u),
l AS (SELECT DISTINCT canonical_url FROM c
      WHERE canonical_url <> '' AND regexp_matches(host, '{"|".join(LISTED_HOST_WORDS)}'))
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical_url, l.canonical_url IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.canonical_url = l.canonical_url
"""
