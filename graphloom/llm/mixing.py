"""Mixing sources to target weights (native): a multivariate-hypergeometric splitting tree.

Each source's words, in a permuted order of its documents, form a stream; a target of T words takes
the first T words of the stream, which starts again where T exceeds the source (so a document is
taken twice at most, and only the document at the cut is taken in part). The T words are blocks of
``block`` words. The splitting tree deals the blocks out to output shards: at each node the quota
of every source is split between the two halves of the shards by a multivariate hypergeometric
draw, so all shards get equally many blocks and each source's quotas add up exactly. A shard's blocks of
a source are a run of the permuted stream (disjoint from all others), and each shard is shuffled
locally.

Ranks within a source come from two levels: documents are dealt by hash to cells, a cell's words are
summed before the shuffle, and only rows of one cell meet in a window. So a source that holds a
third of all rows is spread over all its cells.

Defined results for odd input: null texts have size 0 and are never taken; null is a source of its
own, ordered last; a source without words has target 0; rows of one key follow each other in the permuted order by their
texts' hash, then by the hash of the carried columns (maps do not count); rows that are equal in all of these follow each
other too, each with a place of its own, and which is which cannot be told; very long texts are rows like others, and are cut by words; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

WORD = r"[^\x20\x09-\x0D]+"
#: The driver holds a row for each source and a quota for each source and shard.
MAX_SOURCES = 100_000
#: numpy draws hypergeometric numbers from populations below 1e9.
MAX_BLOCKS = 500_000_000
PART_ROWS = 2_000


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hashable(column: Column, kind: DataType) -> list[Column]:
    """The parts of a column that can be hashed: structs are taken apart, what holds a map is left out."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in _hashable(column.getField(f.name), f.dataType)]
    return [] if "map<" in kind.simpleString() else [column]


def water_fill(sizes: list[int], weights: list[int], total: float, cap: float) -> list[float]:
    """Targets by weight that stop at ``cap`` times the size; the excess is reshared by weight until
    none is above. The result is min(cap * size, level * weight) for the one level that adds up."""
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])
    left, mass, out = float(total), float(sum(weights)), [0.0] * len(sizes)
    for at, i in enumerate(order):
        level = left / mass
        if cap * sizes[i] > level * weights[i]:
            for j in order[at:]:
                out[j] = level * weights[j]
            return out
        out[i] = cap * sizes[i]
        left, mass = left - out[i], mass - weights[i]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard its quota of each source. All shards get equally many blocks (within one)."""
    rng = np.random.default_rng(seed)

    def draw(have: list[int], n: int) -> list[int]:
        """Multivariate hypergeometric: n blocks out of those that the sources have."""
        rest, got = sum(have), []
        for x in have:
            k = int(rng.hypergeometric(x, rest - x, n)) if 0 < n < rest and 0 < x < rest else min(x, n)
            got.append(k)
            rest, n = rest - x, n - k
        return got

    def split(have: list[int], lo: int, hi: int) -> list[list[int]]:
        if hi - lo == 1:
            return [have]
        mid, total = (lo + hi) // 2, sum(have)
        left = draw(have, total * (mid - lo) // (hi - lo))
        return split(left, lo, mid) + split([a - b for a, b in zip(have, left)], mid, hi)

    return split(list(quotas), 0, shards)


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    block: int = 64,
    seed: int = 17,
    key: str = "doc_id",
    carry: tuple[str, ...] = (),
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """For every document: ``key``, ``carry``, size, source_size, target, taken, slices.

    ``slices`` lists what is taken: array of struct(pass, shard, start, words), ``start`` counting
    the words of the document that go before. Sources by code point, null last, weigh ``weights``,
    repeating. Two small jobs run at once: the source totals (one row for each source, at most
    100,000) and the quota tree on the driver.
    """
    if shards < 1 or block < 1 or not 0 < cap <= 2:
        raise ValueError("shards and block must be positive, cap in (0, 2]")
    spark = docs.sparkSession
    tie = [x for c in carry for x in _hashable(F.col(c), docs.select(c).schema[0].dataType)]
    d = docs.select(F.col(key), *[F.col(c) for c in carry if c != key], F.col(source).alias("source_"), words(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("order_"), F.xxhash64(F.lit(seed), *tie).alias("tie_"))
    # null-safe key: the marker keeps a null apart from an empty name
    d = d.withColumn("s", F.when(F.col("source_").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source_")))).drop("source_")
    sums = d.groupBy("s").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group the small ones first")
    sums.sort(key=lambda r: r["s"])  # Python orders strings by code point
    sizes = [int(r["n"]) for r in sums]
    total = sum(sizes)
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * total, cap)
    takes = [min(round(t), int(cap * n)) for t, n in zip(targets, sizes)]
    block = max(block, math.ceil(sum(takes) / MAX_BLOCKS))
    quotas = split_quotas([math.ceil(t / block) for t in takes], shards, seed)
    edges, at = [[0] for _ in sums], [0] * len(sums)
    for q in quotas:
        for i, k in enumerate(q):
            at[i] += k
            edges[i].append(min(at[i] * block, takes[i]))
    rows = [(r["s"], n, t, k, e) for r, n, t, k, e in zip(sums, sizes, targets, takes, edges)]
    plan = spark.createDataFrame(rows, "s string, source_size long, target double, take long, edges array<long>")
    cells = 1 << max(8, min(16, (sum(r["rows"] for r in sums) // 4096).bit_length()))
    d = d.withColumn("cell", F.pmod(F.shiftright("order_", 20), F.lit(cells)).cast("int"))
    per = d.groupBy("s", "cell").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("from_", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # the plan has one row for each source: at most 100,000, bounded above
    inside = Window.partitionBy("s", "cell").orderBy("order_", "size", "tie_").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(per, ["s", "cell"]).withColumn("start_", F.col("from_") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("from_", "cell")
    d = d.join(F.broadcast(plan), "s")
    # shards that the run [lo, hi) of the stream touches: the last edge at or below lo, up to the first at or above hi
    lo = "start_ + p * source_size"
    piece = f"""transform(sequence(0, 1), p -> filter(transform(sequence(0, {shards} - 1), j -> named_struct('pass', p, 'shard', j,
        'start', greatest({lo}, get(edges, j)) - ({lo}), 'words', least({lo} + size, get(edges, j + 1)) - greatest({lo}, get(edges, j)))), x -> x.words > 0))"""
    d = d.withColumn("slices", F.expr(f"if(size > 0 and start_ < take, flatten({piece}), cast(array() as array<struct<pass:int,shard:int,start:bigint,words:bigint>>))"))
    d = d.withColumn("taken", F.expr("aggregate(slices, 0L, (a, x) -> a + x.words)"))
    return d.select(key, *[c for c in carry if c != key], "size", "source_size", "target", "taken", "slices")


def mix(docs: DataFrame, text: str = "text", **parameters) -> DataFrame:
    """The mixed corpus itself, a row for each slice: the document's columns with the slice's text, and
    shard_, part_, place_ (order in the part). Rows of a shard's part are together and shuffled.

    A slice is whole words with the white space between them; the slices of a document taken once
    in one shard are its whole text.
    """
    key, seed, source = parameters.pop("key", "doc_id"), parameters.get("seed", 17), parameters.pop("source", "source")
    # the document travels as one struct, so its columns cannot clash with the plan's
    d = docs.select(F.col(key).alias("key_"), F.struct("*").alias("row_"))
    d = mix_plan(d, key="key_", carry=("row_",), text=f"row_.{text}", source=f"row_.{source}", **parameters).select("key_", "row_", F.col("size").alias("n_"), F.explode("slices").alias("x_"))
    whole = F.col(f"row_.{text}")
    cut = F.when(F.col("x_.words") >= F.col("n_"), whole).otherwise(cut_words(whole, F.col("x_.start"), F.col("x_.words")))
    d = d.withColumn("cut_", cut)
    place = F.xxhash64(F.lit(seed + 1), F.col("key_"), F.col("x_.pass"), F.col("x_.start"), F.col("cut_"))
    d = d.select(*[F.col("cut_").alias(c) if c == text else F.col(f"row_.`{c}`").alias(c) for c in docs.columns], F.col("x_.shard").alias("shard_"), place.alias("place_"))
    # a shard is dealt by hash to as many parts as keep a part near PART_ROWS rows
    shards = parameters.get("shards", 16)
    parts = max(1, math.ceil(docs.count() * 1.5 / shards / PART_ROWS))
    return d.withColumn("part_", F.pmod(F.shiftright("place_", 40), F.lit(parts)).cast("int")).repartition(shards * parts, "shard_", "part_").sortWithinPartitions("shard_", "part_", "place_")


def cut_words(text: Column, start: Column, n: Column) -> Column:
    """Words start+1 .. start+n of the text with the white space that follows each but the last."""
    parts = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    return F.regexp_replace(F.array_join(F.slice(parts, (start + 1).cast("int"), n.cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
