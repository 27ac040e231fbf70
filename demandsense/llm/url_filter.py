"""URL filter: host and path rules, and a list of canonical URLs looked up through a blocked Bloom filter.

A listed URL's hash picks one block of the filter and one bit in each of the block's eight words, so a lookup reads
one block.  Blocks are built by a grouped ``bit_or``; their number follows the list up to ``MOST_BLOCKS``, which bounds
what is sent to the executors.  A longer list only lets more URLs through to the second step: possible hits are
joined with the list itself, which removes all false positives, so results never depend on the filter.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is not listed;
repeated rows are judged each on its own; extra columns are ignored; an empty list blocks nothing.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut

WORDS, WORD_BITS = 8, 5
BITS_A_URL, MOST_BLOCKS = 12, 1 << 16
# Parts of a URL that do not tell pages apart.
PORTS, MIRRORS, TRACKING, INDEX = r":(?:80|443)$", r"^(?:www|m)\.", r"^(?:utm_.*|ref|fbclid|gclid)(?:=.*)?$", r"(?:index\.html?|\.html?)$"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without mirror prefix and default port, path without index names and end slash, other parameters sorted; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), PORTS, ""), MIRRORS, "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), INDEX, ""), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; one ``CASE`` over the (few) rules, longest first."""
    out: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r)):
        told = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits(r, host, path), told) if out is None else out.when(fits(r, host, path), told)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(0)), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """The bit of each word, as a word."""
    h = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, WORD_BITS * k).bitwiseAND(F.lit(2 ** WORD_BITS - 1)).cast("int")) for k in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0 .. w7: the filter of column ``canonical``."""
    words = _bits(F.col("canonical"))
    return listed.select(_block(F.col("canonical"), blocks).alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(words)]).groupBy("block").agg(
        *[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def blocks_for(n: int) -> int:
    return min(max(1, -(-n * BITS_A_URL // (WORDS * 2 ** WORD_BITS))), MOST_BLOCKS)


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed; ``listed`` has a column ``url``."""
    known = cut(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct())
    blocks = blocks_for(known.count())
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    told = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", told["rule"].alias("rule"), told["verdict"].alias("ruled"), "canonical")
    asked = rows.withColumn("block", F.when(F.col("ruled").isNull(), _block(F.col("canonical"), blocks)))
    # at most MOST_BLOCKS rows of nine numbers
    tested = asked.join(F.broadcast(bloom_blocks(known, blocks)), "block", "left")
    possible = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(bit) == bit for k, bit in enumerate(_bits(F.col("canonical")))])
    tested = tested.select("page_id", "host", "path", "rule", "ruled", "canonical", F.coalesce(possible, F.lit(False)).alias("possible"))
    sure = tested.where(~F.col("possible")).withColumn("listed", F.lit(False))
    hits = tested.where("possible").join(known.withColumn("listed", F.lit(True)), "canonical", "left")
    both = sure.unionByName(hits.withColumn("listed", F.coalesce("listed", F.lit(False))))
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def farm_urls(pages: DataFrame, word: str = "spam") -> DataFrame:
    """The list of the registered query: URLs on hosts with a label that starts with ``word``."""
    return pages.where(host_of(F.col("url")).rlike(rf"(?:^|\.){word}")).select("url")
