"""A full-text index on Parquet: postings by term in blocks with their best score, and BM25 top-k that skips blocks.

``terms`` has a row for each term (its document count), ``postings`` one for each block of a term: the term's documents of one
cell, laid out by term so that a search reads the files of its terms only; ``stats`` has the counts that BM25 needs. A document's
cell is the hash of its key, modulo a power of two that gives about ``BLOCK`` documents of the term for each block; so the
blocks of a rarer term are unions of those that a commoner term has, and no block of even the commonest term is large. A block
carries the largest contribution of any of its documents. The texts are never read by a search.

A search runs in three steps: the heads of the blocks are read without their documents; the documents of the blocks that promise most
give a threshold that the k-th best reaches; blocks none of whose cells can reach it with the best of all terms are skipped, the
others are scored. Results are those of a full scan.

Defined results for odd input: null and empty texts are no documents; a key that comes several times counts as one document whose
texts follow each other; null keys with a text are refused; terms that no document has count for nothing; a query
without known terms has no hits; equal scores go by key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import discard, materialize

K1, B = 1.2, 0.75
#: Documents of a block, about.
BLOCK = 128
WORD = "[a-z]+"


def terms_of(text: Column) -> Column:
    """Lower-cased runs of a to z."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def query_terms(query: str) -> dict[str, int]:
    """Distinct terms of a query string, with their number."""
    out: dict[str, int] = {}
    for w in re.findall(WORD, query.lower()):
        out[w] = out.get(w, 0) + 1
    return out


def _idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


class FullTextIndex:
    """An index in the folder ``path``; ``key`` values are kept as they are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.stats = spark.read.parquet(f"{self.path}/stats").first()

    @staticmethod
    def build(docs: DataFrame, path: str, key: str = "id", text: str = "text") -> FullTextIndex:
        """Writes the index of ``docs``; one that is there is replaced.

        Terms are counted by (term, key) in tasks before the shuffle; blocks are gathered by term and cell.
        """
        spark, path = docs.sparkSession, path.rstrip("/")
        if not docs.where(F.col(key).isNull() & F.col(text).isNotNull()).isEmpty():
            raise ValueError("null keys are refused")
        d = docs.select(F.col(key).alias("key"), F.explode(terms_of(F.col(text))).alias("term"))
        tf = materialize(d.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
        lengths = tf.groupBy("key").agg(F.sum("tf").alias("n"))
        n, total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        mean = total / n if n else 0.0
        spark.createDataFrame([(n, float(mean))], "docs long, mean double").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        cells = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("df") / BLOCK)))).cast("long")
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("cells", cells)
        df.repartitionByRange(F.col("term")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        df = spark.read.parquet(f"{path}/terms")
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / (mean or 1.0)))
        posted = tf.join(lengths, "key").join(df, "term").select("term", "cells", F.pmod(F.xxhash64("key"), F.col("cells")).alias("cell"), F.struct("key", part.alias("part")).alias("x"))
        blocks = posted.groupBy("term", "cells", "cell").agg(F.max("x.part").alias("best"), F.collect_list("x").alias("list"))
        blocks = materialize(blocks, "blocks")
        blocks.repartitionByRange(F.col("term"), F.col("cell")).sortWithinPartitions("term", "cell").write.mode("overwrite").parquet(f"{path}/postings")
        for x in (tf, blocks):
            discard(x)
        return FullTextIndex(spark, path)

    def terms(self) -> DataFrame:
        """(term, df, cells)."""
        return self.spark.read.parquet(f"{self.path}/terms")

    def postings(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms: the filter reaches the files, which are sorted by term."""
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("term").isin(terms))

    def _weights(self, query: str) -> dict[str, float]:
        """The weight of each known term of the query."""
        asked = query_terms(query)
        known = self.terms().where(F.col("term").isin(list(asked))).select("term", _idf(F.lit(self.stats["docs"]), F.col("df")).alias("idf")).collect() if asked else []
        return {r["term"]: r["idf"] * asked[r["term"]] for r in known}

    def live_blocks(self, weights: dict[str, float], k: int, margin: float = 0.0) -> DataFrame:
        """The blocks (with ``weight``) that can hold one of the top ``k``, or a document up to ``margin`` below these."""
        weight = F.try_element_at(F.create_map(*[F.lit(x) for t, w in sorted(weights.items()) for x in (t, w)]), F.col("term"))
        blocks = self.postings(list(weights)).withColumn("weight", weight)
        heads = blocks.select("term", "cells", "cell", (F.col("weight") * F.col("best")).alias("best"))
        # documents in the most promising blocks, scored by those blocks alone: their true scores are not lower
        seeds = heads.orderBy(F.desc("best"), "term", "cell").limit(max(4, -(-4 * k // BLOCK))).select("term", "cell")
        top = self._scored(blocks.join(F.broadcast(seeds), ["term", "cell"], "left_semi")).orderBy(F.desc("score")).limit(k).collect()
        least = top[-1]["score"] * (1 - 1e-9) - margin if len(top) == k else 0.0
        if least <= 0:
            return blocks
        # the finest cells of the terms at hand: a block stands in all of them that it covers
        fine = heads.agg(F.max("cells")).first()[0]
        covered = heads.select("term", "cell", "best", F.explode(F.expr(f"sequence(cell, {fine - 1}L, cells)")).alias("at"))
        reach = covered.groupBy("at").agg(F.sum("best").alias("most")).where(F.col("most") >= least).select("at")
        return blocks.join(covered.join(reach, "at").select("term", "cell").distinct(), ["term", "cell"], "left_semi")

    def _scored(self, blocks: DataFrame) -> DataFrame:
        """(id, score) of the documents of some blocks."""
        d = blocks.select("weight", F.explode("list").alias("x"))
        return d.groupBy(F.col("x.key").alias("id")).agg(F.sum(F.col("weight") * F.col("x.part")).alias("score"))

    def search(self, query: str, k: int, digits: int = 6) -> DataFrame:
        """(id, score): the top ``k`` by BM25, equal scores by id."""
        weights = self._weights(query)
        if not weights:
            none = self.spark.read.parquet(f"{self.path}/postings").limit(0)
            return none.select(F.explode("list").alias("x")).select(F.col("x.key").alias("id"), F.lit(0.0).alias("score"))
        d = self._scored(self.live_blocks(weights, k, 2 * 10.0**-digits)).select("id", (F.round("score", digits) + 0.0).alias("score"))
        return d.orderBy(F.desc("score"), "id").limit(k)
