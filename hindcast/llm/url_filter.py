"""Block or allow pages by url: host and path rules first, then a list of canonical urls.

The list is met in two steps. A blocked Bloom filter of the listed urls (one 512-bit block per url, one bit in each of
its eight words) is broadcast and passes possible hits; an exact join with the list removes the false ones. The filter
has at most ``MAX_BLOCKS`` blocks, so the broadcast is bounded for lists of any length: a longer list only lets more
false hits through to the join. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import quoted
from hindcast.llm.common import LOWER, UPPER
from hindcast.session import materialize

WORDS = 8
URLS_PER_BLOCK = 40  # 512 bits for 40 urls: one false hit in about 400.
MAX_BLOCKS = 1 << 18  # 16 MB of bits.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a last slash, and the query without tracking parameters, sorted.
    Scheme and fragment go. A url without ``://`` is empty."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/$", "")
    asked = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _fits(rule: str, host: Column, path: Column) -> Column:
    domain, _, start = rule.partition("/")
    return ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")


def match_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits the host or a domain above it; null where none does.
    ``rules`` is a short list that lives in the plan."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule = F.when(_fits(text, host, path), text).otherwise(rule)
        verdict = F.when(_fits(text, host, path), said).otherwise(verdict)
    return rule, verdict


def _bit(key: Column, word: int) -> Column:
    return F.expr("1L") if word < 0 else F.call_function("shiftleft", F.expr("1L"),
                                                         F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int"))


def bloom_filter(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter as rows, at most ``blocks`` of them; words of a block are or-ed on the map side."""
    key = F.xxhash64(F.col(column))
    return (listed.select(key.alias("key"), F.pmod(key, F.lit(blocks)).alias("block")).groupBy("block")
            .agg(*[F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)]))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, url: str = "url",
                key: str = "page_id") -> DataFrame:
    """One row per page: (key, host, path, rule, verdict, canonical_url, possible_hit, listed).

    ``listed`` has one column of urls to block; they are canonicalised here. Verdict: the rule's, else ``block`` for a
    listed url and ``allow`` for any other. A null url has empty host and path, fits no rule, is never listed and is
    allowed. Repeated rows come out as often as they went in; other columns of either table are not looked at; an empty
    list or table is fine.
    """
    names = materialize(listed.select(canonical(F.col(quoted(listed.columns[0]))).alias("name"))
                        .where("name != ''").distinct())
    blocks = min(MAX_BLOCKS, names.count() // URLS_PER_BLOCK + 1)
    bits = bloom_filter(names, "name", blocks)
    at = F.col(quoted(url))
    rows = pages.select(F.col(quoted(key)).alias("page_id"), host_of(at).alias("host"), path_of(at).alias("path"),
                        canonical(at).alias("canonical_url"))
    rule, said = match_rule(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), said.alias("said"), F.xxhash64("canonical_url").alias("key"))
    hit = F.lit(True)
    for i in range(WORDS):
        hit &= F.col(f"w{i}").bitwiseAND(_bit(F.col("key"), i)) != 0
    # Bounded by MAX_BLOCKS rows of 72 bytes, whatever the length of the list.
    probed = rows.withColumn("block", F.pmod("key", F.lit(blocks))).join(F.broadcast(bits), "block", "left") \
        .withColumn("possible_hit", F.coalesce(hit, F.lit(False))).drop("block", "key", *[f"w{i}" for i in range(WORDS)])
    passed = probed.where("NOT possible_hit").withColumn("listed", F.lit(False))
    hits = probed.where("possible_hit").join(names.withColumn("found", F.lit(True)),
                                             F.col("canonical_url") == F.col("name"), "left") \
        .withColumn("listed", F.coalesce("found", F.lit(False))).drop("name", "found")
    verdict = F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow"))
    return passed.unionByName(hits).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical_url",
                                           "possible_hit", "listed")
