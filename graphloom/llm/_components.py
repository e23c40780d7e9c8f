"""Connected components of a large undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b) but the
    smallest of each component.

    Each round links every node's larger neighbours to its smallest neighbour, then every node and
    its smaller neighbours to the smallest of them; the edges end up as stars. Rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder, only its count and a
    checksum come to the driver. Hubs: the smallest neighbour is a sum that is combined before the
    shuffle, and the joins on a hub are plain equi-joins that adaptive execution splits.
    """
    stars = materialize(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), tag)
    seen = None
    for _ in range(MAX_ROUNDS):
        both = stars.select(F.col("x").alias("u"), F.col("y").alias("v")).unionAll(stars.select(F.col("y").alias("u"), F.col("x").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct(), tag)
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionAll(low.select("x", F.col("m").alias("y")))
        stars = materialize(small.distinct(), tag)
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
        if tuple(now) == seen:
            return stars.select(F.col("x").alias("node"), F.col("y").alias("component"))
        seen = tuple(now)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
