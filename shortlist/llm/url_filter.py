"""URL verdicts: host rules first, then a list of URLs behind a blocked Bloom filter.

Every listed canonical URL sets one bit in each of the eight 64-bit words of one block;
a page whose URL finds all its bits set is a possible hit, and only possible hits are
shuffled to an exact join with the list, which removes the false positives. The filter
is at most ``MAX_BLOCKS`` blocks, so what is broadcast has a fixed bound; a longer list
makes it let more pages through, never a wrong verdict.

Nulls: a null url, or one without ``://``, has an empty host and path and no canonical
form, so no rule fits it and it is never listed. Rows that repeat a page are judged one
by one. A null in the list is ignored; an empty list blocks nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
MAX_BLOCKS = 1 << 15
URLS_PER_BLOCK = 32


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL, empty if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    before = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(before, r"^([^/]*)", 1)
    path = F.substring(before, F.length(host) + 1, F.length(before))
    return F.coalesce(_ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without a slash at its end, sorted query; else null.

    Scheme, fragment and ``utm_`` parameters do not tell pages apart.
    """
    host, path = host_and_path(url)
    rest = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(rest, "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    query = F.array_join(F.array_sort(kept), "&")
    bare = F.regexp_replace(host, r"^www\.", "")
    text = F.concat(bare, F.regexp_replace(path, r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", text)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. Rules are code, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _bits(url: Column) -> list[Column]:
    """The bit of each word: six bits each of a second hash."""
    second = F.xxhash64(url, F.lit(1))
    return [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom_blocks(urls: DataFrame, n_urls: int) -> tuple[DataFrame, int]:
    """Blocks (``block``, ``w0`` .. ``w7``) of the distinct ``canonical`` urls, and their number."""
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * URLS_PER_BLOCK < n_urls:
        blocks *= 2
    one = F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col("canonical")))]
    rows = urls.select(_block(F.col("canonical"), blocks).alias("block"), *words)
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def _block(url: Column, blocks: int) -> Column:
    return F.xxhash64(url).bitwiseAND(F.lit(blocks - 1))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """Host, path, canonical form, rule, ``listed`` and verdict of every page.

    ``listed`` has a column ``canonical``. A rule's verdict stands; without a rule a
    listed URL is blocked and any other allowed.
    """
    urls = listed.select("canonical").where("canonical is not null").distinct()
    # Only steers the size of the filter, so an estimate will do.
    n_urls = urls.agg(F.approx_count_distinct("canonical")).first()[0]
    blocks, n_blocks = bloom_blocks(urls, n_urls)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), canonical_url(F.col("url")).alias("canonical"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    # Only pages without a rule need the list.
    rows = rows.withColumn("block", F.when(F.col("rule").isNull(), _block(F.col("canonical"), n_blocks)))
    held = rows.join(F.broadcast(blocks), "block", "left")
    all_set = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canonical"))):
        word = F.col(f"w{i}")
        all_set = all_set & F.call_function("getbit", word, bit).eqNullSafe(F.lit(1))
    held = held.withColumn("possible", F.coalesce(all_set, F.lit(False))).drop("block", *(f"w{i}" for i in range(WORDS)))
    surely_not = held.where(~F.col("possible")).withColumn("listed", F.lit(False))
    # A left join, so that Spark can split a url that many pages share.
    possible = held.where("possible").join(urls.withColumn("hit", F.lit(True)), "canonical", "left")
    possible = possible.withColumn("listed", F.coalesce("hit", F.lit(False))).drop("hit")
    both = surely_not.unionByName(possible)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return both.select(
        "page_id", "host", "path", "canonical", "rule", "listed", F.coalesce("says", method).alias("verdict")
    )
