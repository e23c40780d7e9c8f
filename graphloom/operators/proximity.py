"""Proximity graphs over vectors: a navigable graph for each shard, searched by beams; and a stored neighbour graph.

Vectors are dealt to the cells of a coarse codebook, and a cell beyond ``SHARD`` vectors to several shards by hash. A shard's graph is
built in one task: each vector is linked to those of its nearest that are not nearer to one already chosen, filled up to
``links``, and back; some vectors of each shard are entries. A search starts at the entries of a shard and goes on from the best
vector it has seen and not yet left, until its ``beam`` best have all been left. Queries run side by side. They visit the
``probes`` nearest cells, and the shards' results are merged.

What the codebook leaves out (null, zero and odd vectors) has no neighbours here and is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import index as X
from graphloom.session import discard, materialize, scratch

#: Vectors of a shard, about; links of a vector one way (twice as many with those back); nearest that are looked at for links.
SHARD, LINKS, NEAR = 10_000, 16, 48
#: Queries that one task searches a shard for at once, and in all.
SIDE, QUERIES = 256, 20_000
#: Similarities that are held at once while links are looked for.
STRIP = 1 << 20


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row of unit vectors, nearest first; of so many rows at once that ``STRIP`` similarities are held."""
    out, step = np.empty((len(x), k), np.int32), max(1, STRIP // max(1, len(x)))
    for lo in range(0, len(x), step):
        s = x[lo : lo + step] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        at = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
        out[lo : lo + step] = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)
    return out


def links_of(x: np.ndarray, links: int = LINKS, near: int = NEAR) -> np.ndarray:
    """(rows, 2 links) places that each row is linked to; -1 where there are fewer."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1, np.int32)
    there = nearest(x, min(near, n - 1))
    pairs = []
    for i, own in enumerate(there):
        s, among, chosen = x[own] @ x[i], x[own] @ x[own].T, []
        for j in range(len(own)):
            if len(chosen) < links and not any(among[j, c] >= s[j] for c in chosen):
                chosen.append(j)
        rest = [j for j in range(len(own)) if j not in set(chosen)]
        pairs.extend((i, own[j]) for j in chosen + rest[: links - len(chosen)])
    a = np.array(pairs, np.int64)
    both = np.unique(np.concatenate([a, a[:, ::-1]]), axis=0)
    order = np.lexsort((-(x[both[:, 0]] * x[both[:, 1]]).sum(1), both[:, 0]))
    both = both[order]
    rank = np.arange(len(both)) - np.searchsorted(both[:, 0], both[:, 0])
    keep = rank < 2 * links
    out = np.full((n, 2 * links), -1, np.int32)
    out[both[keep, 0], rank[keep]] = both[keep, 1]
    return out


def beams(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, similarities, vectors compared) of each query's ``beam`` best; -1 where there are fewer."""
    m, side = len(q), np.arange(len(q))
    seen = np.zeros((m, len(x)), bool)
    seen[:, entries] = True
    s = q @ x[entries].T
    compared = np.full(m, len(entries), np.int64)
    width = max(beam, 1)
    best = np.argsort(-s, axis=1, kind="stable")[:, :width]
    place, sim = entries[best], np.take_along_axis(s, best, 1)
    if place.shape[1] < width:
        extra = width - place.shape[1]
        place, sim = np.pad(place, ((0, 0), (0, extra)), constant_values=-1), np.pad(sim, ((0, 0), (0, extra)), constant_values=-np.inf)
    left = place < 0
    while True:
        open_ = np.where(left, -np.inf, sim)
        at = open_.argmax(1)
        live = side[np.isfinite(open_[side, at])]
        if not len(live):
            return place, sim, compared
        left[live, at[live]] = True
        there = links[place[live, at[live]]]
        fresh = (there >= 0) & ~seen[live[:, None], np.maximum(there, 0)]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], there[rows, cols]] = True
        new = np.full(there.shape, -np.inf)
        new[rows, cols] = (x[there[rows, cols]] * q[live[rows]]).sum(1)
        compared[live] += fresh.sum(1)
        p, v, f = (np.concatenate([a[live], b], axis=1) for a, b in ((place, np.where(fresh, there, -1)), (sim, new), (left, ~fresh)))
        top = np.argpartition(-v, width - 1, axis=1)[:, :width]
        place[live], sim[live], left[live] = (np.take_along_axis(a, top, 1) for a in (p, v, f))


class ProximityIndex:
    """A proximity-graph index of (id, vector) in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.coarse = X.VectorIndex(spark, f"{self.path}/coarse")

    @staticmethod
    def build(vectors: DataFrame, path: str, shard: int = SHARD, links: int = LINKS, seed: int = 0) -> ProximityIndex:
        """Writes codebook, shards and graphs; an index that is there is replaced."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        coarse = X.VectorIndex.build(vectors.select("id", "vector"), f"{path}/coarse", max(1, -(-vectors.count() // shard)), seed)
        rows = coarse.rows().where("cell >= 0")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
        # a row for each cell: as many as the codebook
        dealt = rows.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vector")

        def link(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("id")
            x = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
            x = X._unit(x)
            n = len(x)
            entry = np.zeros(n, bool)
            entry[np.random.default_rng(seed).choice(n, max(1, min(n, int(n**0.5 / 2))), replace=False)] = True
            at = links_of(x, links)
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((at >= 0).sum(1))], pa.int32()), pa.array(at[at >= 0], pa.int32()))
            unit = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            return pa.table({"cell": table.column("cell"), "part": table.column("part"), "place": pa.array(np.arange(n), pa.int32()), "id": table.column("id"), "unit": unit, "links": places, "entry": pa.array(entry)})

        kind = rows.schema["id"].dataType.simpleString()
        graph = materialize(dealt.groupBy("cell", "part").applyInArrow(link, f"cell long, part int, place int, id {kind}, unit array<double>, links array<int>, entry boolean"), "graph")
        graph.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part", "place").write.mode("overwrite").parquet(f"{path}/graph")
        discard(graph)
        return ProximityIndex(spark, path)

    def graph(self) -> DataFrame:
        """(cell, part, place, id, unit, links, entry)."""
        return self.spark.read.parquet(f"{self.path}/graph")

    def knn_join(self, queries: DataFrame, k: int, beam: int = 32, probes: int = 3, self_join: bool = False, digits: int = 6) -> DataFrame:
        """(src, dst, sim, rank, compared): for each query (id, vector) about its k most similar vectors; ``compared`` is the number of
        vectors that the query was compared with, in all shards."""
        centers, dims = self.coarse.centers, self.coarse.centers.shape[1]
        asked_for = k + 1 if self_join else k
        width = max(beam, asked_for)
        shared = self.spark.sparkContext.broadcast(centers)
        kind = self.graph().schema["id"].dataType.simpleString()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    part = part.filter(pa.array([X.fit_for(v, dims) for v in part.column("vector").to_pylist()], pa.bool_()))
                    if part.num_rows:
                        x = X._unit(np.array(part.column("vector").to_pylist(), np.float64))
                        d = X._far(x, shared.value)
                        n = min(probes, d.shape[1])
                        cells = np.argpartition(d, n - 1, axis=1)[:, :n]
                        unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dims, pa.int32()), pa.array(x.ravel()))
                        yield pa.RecordBatch.from_arrays([part.column("id"), unit, pa.array(list(cells), pa.list_(pa.int64()))], names=["src", "q", "cells"])

        asked = queries.select(F.col("id").cast(kind).alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        asked = asked.mapInArrow(place, f"src {kind}, q array<double>, cells array<long>").select("src", "q", F.explode("cells").alias("cell"))
        shards = self.graph().select("cell", "part").distinct()
        visits = asked.join(F.broadcast(shards), "cell")
        # a shard that many queries visit is copied, so that no task gets more than QUERIES of them
        slices = materialize(visits.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("slices")), "slices")
        visits = visits.join(F.broadcast(slices), ["cell", "part"]).withColumn("slice", F.pmod(F.xxhash64("src"), F.col("slices")).cast("int")).drop("slices")
        copies = self.graph().join(F.broadcast(slices), ["cell", "part"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

        def search(shard: pa.Table, wanted: pa.Table) -> pa.Table:
            out = {c: [] for c in ("src", "dst", "sim", "compared")}
            if shard.num_rows and wanted.num_rows:
                shard = shard.combine_chunks().sort_by("place")
                x = np.asarray(shard.column("unit").combine_chunks().flatten(), np.float64).reshape(shard.num_rows, -1)
                held = shard.column("links").combine_chunks()
                size = np.diff(np.asarray(held.offsets))
                at = np.full((len(x), max(1, int(size.max(initial=1)))), -1, np.int32)
                at[np.repeat(np.arange(len(x)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(held.flatten())
                ids, entries = np.asarray(shard.column("id")), np.flatnonzero(np.asarray(shard.column("entry")))
                src = np.asarray(wanted.column("src"))
                q = np.asarray(wanted.column("q").combine_chunks().flatten(), np.float64).reshape(wanted.num_rows, -1)
                for lo in range(0, len(q), SIDE):
                    p, s, n = beams(x, at, entries, q[lo : lo + SIDE], width)
                    own = src[lo : lo + SIDE]
                    s = np.where(p < 0, -np.inf, np.round(s, digits) + 0.0)
                    if self_join:
                        s[ids[np.maximum(p, 0)] == own[:, None]] = -np.inf
                    order = np.lexsort((ids[np.maximum(p, 0)], -s), axis=1)[:, :k]
                    took = np.take_along_axis(s, order, 1)
                    keep = np.isfinite(took)
                    first = np.zeros(keep.shape, np.int64)
                    first[:, 0] = n
                    for c, v in (("src", np.broadcast_to(own[:, None], keep.shape)[keep]), ("dst", ids[np.take_along_axis(p, order, 1)][keep]), ("sim", took[keep]), ("compared", first[keep])):
                        out[c].append(v)
            cat = {c: np.concatenate(v) if v else [] for c, v in out.items()}
            return pa.table({"src": pa.array(cat["src"], wanted.schema.field("src").type), "dst": pa.array(cat["dst"], shard.schema.field("id").type), "sim": pa.array(cat["sim"], pa.float64()), "compared": pa.array(cat["compared"], pa.int64())})

        keys = ("cell", "part", "slice")
        found = copies.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(search, f"src {kind}, dst {kind}, sim double, compared long")
        by = Window.partitionBy("src")
        ranked = found.withColumn("rank", F.row_number().over(by.orderBy(F.desc("sim"), "dst"))).withColumn("compared", F.sum("compared").over(by))
        return ranked.where(F.col("rank") <= k).select("src", "dst", "sim", "rank", "compared")

    def search(self, query: list[float], k: int, beam: int = 64, probes: int = 3, digits: int = 6) -> DataFrame:
        """(id, score): about the top-k of one query."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "id long, vector array<double>")
        kind = self.graph().schema["id"].dataType
        found = self.knn_join(one.withColumn("id", F.col("id").cast(kind)), k, beam, probes, digits=digits)
        return found.select(F.col("dst").alias("id"), F.col("sim").alias("score")).orderBy(F.desc("score"), "id").limit(k)


class NeighbourGraph:
    """The nearest ``k`` of every vector, stored once in ``path`` and read by whatever needs them: (src, dst, sim, rank)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(vectors: DataFrame, path: str, k: int, exact: bool = True, beam: int = 32, probes: int = 3) -> NeighbourGraph:
        """By the coarse index, which visits every cell that may hold a nearer vector (exact), or by beams over proximity graphs."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        if exact:
            found = X.VectorIndex.build(vectors, scratch(spark, "coarse")).knn_join(vectors, k, self_join=True)
        else:
            found = ProximityIndex.build(vectors, scratch(spark, "graphs")).knn_join(vectors, k, beam, probes, self_join=True)
        found.select("src", "dst", "sim", "rank").repartitionByRange(F.col("src")).sortWithinPartitions("src", "rank").write.mode("overwrite").parquet(path)
        return NeighbourGraph(spark, path)

    def edges(self, k: int | None = None) -> DataFrame:
        d = self.spark.read.parquet(self.path)
        return d if k is None else d.where(F.col("rank") <= k)
