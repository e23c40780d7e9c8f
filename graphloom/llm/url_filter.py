"""URL filters (native): host/path rules, and a blocked Bloom filter of listed canonical URLs whose
possible hits go to an exact hash join that removes false positives.

Defined results for odd input
* null and empty urls and urls without ``://``: host, path and canonical URL are empty; no rule fits, they are not listed, and
  where the filter is joined by block they go around that join, so however many there are they meet in no block;
* very long urls are worked on whole;
* ties (rules of equal length that fit): block wins, then the smaller rule string;
* repeated rows stay; empty tables give empty results; extra columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

BITS_PER_KEY = 16
#: A block is 8 words of 32 bits; each key sets one bit in each word.
WORDS = 8
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, query without tracking parameters; no
    scheme and no fragment. Empty where there is no host."""
    host, path = url_host(url), url_path(url)
    asked = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    asked = F.regexp_replace(F.concat(F.lit("&"), asked), r"&(utm_[^=&]*|ref|gclid|fbclid)=[^&]*", "")
    asked = F.regexp_replace(asked, r"^&+", "")
    out = F.concat(
        F.regexp_replace(host, r"^www\.", ""),
        F.regexp_replace(path, r"/+$", ""),
        F.when(asked == "", F.lit("")).otherwise(F.concat(F.lit("?"), asked)),
    )
    return F.when(host == "", F.lit("")).otherwise(out)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct(rule, verdict), else null.

    The rules are a literal map by host that is probed with each suffix of a url's host, so a page
    costs a lookup for each of its labels, whatever the number of rules, and nothing is shuffled.
    The map is part of the plan: at most 10,000 rules.
    """
    if len(rules) > 10_000:
        raise ValueError("more than 10,000 rules: give them as listed URLs instead")
    by: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, h, p in rules:
        by.setdefault(h, []).append((verdict, h, p))
    if not by:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entry = lambda v, h, p: F.struct(
        F.lit(len(h) + len(p)).alias("n"), F.lit(int(v == "block")).alias("b"), F.lit(h + p).alias("rule"), F.lit(p).alias("p"), F.lit(v).alias("verdict")
    )
    table = F.create_map(*[x for h, rs in sorted(by.items()) for x in (F.lit(h), F.array(*[entry(*r) for r in rs]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.slice(F.element_at(F.map_values(table), 1), 1, 0)))), lambda r: F.startswith(path, r["p"]))
    # the longest, then block, then the smaller string
    best = F.reduce(
        fits,
        F.lit(None).cast("struct<n:int,b:int,rule:string,p:string,verdict:string>"),
        lambda a, r: F.when(a.isNull() | (r["n"] > a["n"]) | ((r["n"] == a["n"]) & ((r["b"] > a["b"]) | ((r["b"] == a["b"]) & (r["rule"] < a["rule"])))), r).otherwise(a),
    )
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _block(canonical: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canonical), F.lit(blocks))


def _bit(canonical: Column, i: int) -> Column:
    return F.shiftright(F.xxhash64(canonical, F.lit(i // 4)), 8 * (i % 4)).bitwiseAND(F.lit(31)).cast("int")


def _mask(canonical: Column, i: int) -> Column:
    """Bit of word ``i`` that the key sets; eight bits of a hash for each word, of which five count."""
    return F.call_function("shiftleft", F.lit(1), _bit(canonical, i))


def bloom_filter(listed: DataFrame, n: int, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the distinct ``canonical`` of ``listed``, of which there are ``n``, and the number of blocks."""
    blocks = 1 << max(0, (max(1, n) * bits_per_key // 256)).bit_length()
    c = F.col("canonical")
    return listed.groupBy(_block(c, blocks).alias("block")).agg(*[F.bit_or(_mask(c, i)).alias(f"w{i}") for i in range(WORDS)]), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """Judges every url: ``key``, host, path, canonical, rule, verdict, bloom_hit, listed.

    ``listed`` has a column ``canonical``. A rule's verdict holds where one fits; elsewhere a
    listed URL is blocked and any other allowed. Only rows that the filter passes are shuffled, to
    the exact join; the filter itself (its size is known before it is built) is broadcast up to
    64 MB and joined by block beyond that.
    """
    listed = materialize(listed.select("canonical").where("canonical is not null and canonical <> ''").distinct(), "listed")
    bloom, blocks = bloom_filter(listed, listed.count(), bits_per_key)
    p = pages.select(F.col(key).alias("key_"), F.col(url).alias("url_"))
    p = p.select("key_", url_host(F.col("url_")).alias("host"), url_path(F.col("url_")).alias("path"), canonical_url(F.col("url_")).alias("canonical"))
    p = p.withColumn("block", _block(F.col("canonical"), blocks))
    small = blocks * (8 + 4 * WORDS) * 2 <= BROADCAST_BYTES
    bloom = F.broadcast(bloom) if small else bloom
    passes = F.lit(True)
    for i in range(WORDS):
        m = _mask(F.col("canonical"), i)
        passes = passes & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = (p if small else p.where("canonical <> ''")).join(bloom, "block", "left").withColumn("bloom_hit", F.coalesce(passes, F.lit(False)))
    if not small:
        probed = probed.select(*p.columns, "bloom_hit").unionByName(p.where("canonical = ''").withColumn("bloom_hit", F.lit(False)))
    hits = probed.where("bloom_hit").join(listed.withColumn("found", F.lit(True)), "canonical", "left")
    cols = ["key_", "host", "path", "canonical", "bloom_hit"]
    both = hits.select(*cols, F.coalesce("found", F.lit(False)).alias("listed")).unionAll(probed.where("not bloom_hit").select(*cols, F.lit(False).alias("listed")))
    return both.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select(
        F.col("key_").alias(key),
        "host",
        "path",
        "canonical",
        F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "bloom_hit",
        "listed",
    )
