"""Pluggable model functions, and deterministic stand-ins: embedding, entity extraction, summaries, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384


def byte_embedding(text: str, dims: int = DIMENSIONS) -> list[float]:
    """Byte i adds b / 255 at i modulo the size; scaled to length 1."""
    b = np.frombuffer((text or "").encode(), np.uint8) / 255.0
    v = np.zeros(dims)
    np.add.at(v, np.arange(len(b)) % dims, b)
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


#: Vectors that a task of ``embedder`` holds at once.
EMBEDDED = 256


def embedder(model: Callable[[str], list[float]] = byte_embedding):
    """Pandas UDF: text -> array<double> by any model of one text. A batch of texts gives its vectors in parts of ``EMBEDDED``, as flat numbers."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for lo in range(0, max(1, len(texts)), EMBEDDED):
                yield pd.Series([np.asarray(model(t if isinstance(t, str) else ""), np.float64) for t in texts.iloc[lo : lo + EMBEDDED]], dtype=object)

    return embed


def softmax(scores: DataFrame, key: str, score: str = "score", digits: int = 6) -> DataFrame:
    """Adds p, the softmax of the scores of each key (nulls are a key). Maxima and sums are made in tasks first and joined back, so a key of
    many rows is never in one place."""
    same = lambda d, other: d.join(other, F.col(key).eqNullSafe(F.col("key_")))
    top = scores.groupBy(F.col(key).alias("key_")).agg(F.max(score).alias("top_"))
    d = same(scores, top).withColumn("e_", F.exp(F.col(score) - F.col("top_"))).drop("key_", "top_")
    total = d.groupBy(F.col(key).alias("key_")).agg(F.sum("e_").alias("total_"))
    return same(d, total).withColumn("p", F.round(F.col("e_") / F.col("total_"), digits)).drop("e_", "key_", "total_")


def overlap_score(query: str):
    """text -> the share of the query's words that it has: a stand-in for a cross-encoder, by built-in functions. Null texts have none."""
    asked = sorted(set(query.lower().split()))
    words = F.array(*[F.lit(w) for w in asked]).cast("array<string>")
    return lambda text: F.size(F.array_intersect(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), words)) / F.lit(float(max(1, len(asked))))


def rerank(candidates: DataFrame, scorer: Column, n: int = 5) -> DataFrame:
    """The n candidates of the highest score, ties by id."""
    return candidates.withColumn("score", F.round(scorer, 6)).orderBy(F.desc("score"), "id").limit(n)


def kmeans_step(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, cluster): the nearest center (cluster, center) of each vector; ties to the smallest cluster. Centers are few and broadcast."""
    from graphloom.operators.vectors import euclidean

    d = vectors.crossJoin(F.broadcast(centers)).withColumn("d", F.round(euclidean(F.col("vector"), F.col("center")), 6))
    return d.groupBy("id").agg(F.min(F.struct("d", "cluster")).alias("x")).select("id", "x.cluster", F.col("x.d").alias("distance"))


def kmeans(vectors: DataFrame, k: int = 5, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(id, cluster) by the library's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k < 1:
        raise ValueError("k must be positive")
    d = vectors.select("id", array_to_vector("vector").alias("features"))
    return KMeans(k=k, maxIter=rounds, seed=seed).fit(d).transform(d).select("id", F.col("prediction").alias("cluster"))
