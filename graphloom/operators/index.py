"""Vector indexes on Parquet: a coarse-quantised index, a segmented index, and a warm cache of searches.

The coarse index deals unit vectors to the cells of a codebook (k-means on a bounded sample), and lays the rows out by cell, so
that a search reads the cells it visits and skips the rest by file statistics. A search without ``probes`` is exact: a cell is
visited unless its distance, less its radius, is beyond the k-th best. With ``probes`` it visits so many of the nearest cells.
Cells number about the square root of the vectors; the codebook is all that the driver holds.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import vectors as V
from graphloom.session import discard, materialize
from graphloom.sources.log import CommitLog

#: Vectors that a codebook is fitted on, about, if eight for each cell are not more.
SAMPLE = 20_000
#: Vectors of a cell that one task compares, and rows of a segment.
BLOCK, ROLL = 4096, 100_000
#: Cells that an exact join visits first.
FIRST = 2


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances (rows, centers) of unit vectors."""
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]))


def codebook(x: np.ndarray, k: int, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """Centers by Lloyd's rounds from distinct rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_far(x[lo : lo + 4096], c).argmin(1) for lo in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
    return c


def fit_for(v, dims: int) -> bool:
    """A vector that cells can hold: of that length, finite and not zero."""
    return v is not None and len(v) == dims and None not in v and any(v) and bool(np.isfinite(v).all())


class VectorIndex:
    """A coarse index of (id, vector, any other columns) in the folder ``path``, of vectors of the commonest length.

    Zero vectors, those of another length, and rows whose vector is null or holds null or non-finite components are in cell -1,
    which every search visits; joins find no neighbours for them, and do not give them as such.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centers").orderBy("cell").collect()
        self.centers = np.array([r["center"] for r in rows], np.float64) if rows else np.zeros((0, 1))
        self.radius = np.array([r["radius"] for r in rows])

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 0) -> VectorIndex:
        """Fits, assigns and writes; rows that are there already are replaced."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        d = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
        good = F.coalesce(F.expr("forall(vector, c -> c is not null and not isnan(c) and abs(c) < double('inf')) and exists(vector, c -> c <> 0)"), F.lit(False))
        common = d.where(good).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        dims, n = tuple(common) if common else (0, 0)
        good = good & (F.size("vector") == dims)
        k = cells or max(1, round(n**0.5))
        share = min(1.0, max(SAMPLE, 8 * k) / max(1, n))
        taken = d.where(good & (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) <= share * (1 << 30))).select("id", "vector").toPandas().sort_values("id")
        centers = codebook(_unit(np.array(taken["vector"].tolist())), k, seed) if len(taken) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast(centers)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.column("vector").to_pylist()
                some = [i for i, v in enumerate(rows) if fit_for(v, dims)]
                cell, far = np.full(len(rows), -1, np.int64), np.zeros(len(rows))
                for lo in range(0, len(some), 2048):
                    at = some[lo : lo + 2048]
                    d = _far(_unit(np.array([rows[i] for i in at], np.float64)), shared.value)
                    cell[at], far[at] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
        # written first: the range partitioning samples its input, which would assign twice
        assigned = materialize(d.mapInArrow(assign, f"{fields}, cell long, far double"), "assigned")
        assigned.repartitionByRange(F.col("cell")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
        discard(assigned)
        rows = spark.read.parquet(f"{path}/rows")
        sizes = {r["cell"]: (r["radius"], r["n"]) for r in rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
        held = [(i, c.tolist(), float(sizes.get(i, (0.0, 0))[0]), int(sizes.get(i, (0.0, 0))[1])) for i, c in enumerate(centers)]
        spark.createDataFrame(held, "cell long, center array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
        return VectorIndex(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _visit(self, cells: np.ndarray) -> DataFrame:
        return self.rows().where(F.col("cell").isin([-1, *cells.tolist()]))

    def search(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None, digits: int = 6) -> DataFrame:
        """Top-k by cosine, as ``vectors.search`` gives it; candidates are filtered first."""
        finish = lambda d: V.search(d, query, k, where=where, digits=digits).drop("cell", "far")
        if not len(self.centers) or not fit_for(query, self.centers.shape[1]):
            return finish(self.rows())
        far = _far(_unit(np.array([query], np.float64)), self.centers)[0]
        order = np.argsort(far, kind="stable")
        if probes is not None:
            return finish(self._visit(order[:probes]))
        seen = max(1, min(len(order), 4))
        while True:
            scores = [r["score"] for r in finish(self._visit(order[:seen])).select("score").collect()]
            if len(scores) == k or seen == len(order):
                break
            seen = min(len(order), seen * 4)
        if len(scores) < k:
            return finish(self.rows())
        # a score s is the distance sqrt(2 - 2 s); scores are rounded, so a little more is visited
        worst = max(0.0, 2 - 2 * (min(scores) - 2 * 10.0**-digits)) ** 0.5 + 1e-9
        return finish(self._visit(np.flatnonzero(far - self.radius <= worst)))

    def knn_join(self, queries: DataFrame, k: int, probes: int | None = None, self_join: bool = False, digits: int = 6) -> DataFrame:
        """(src, dst, sim, rank): for each query its k most similar vectors among the ``probes`` cells nearest to it, or, without ``probes``, of all.

        A cell is compared block by block: a task holds a block of the index and streams the queries, of which it keeps k rows each.
        Up to ``FIRST`` cells go that way. The exact way visits the ``FIRST`` nearest cells, and then, by blocks of queries, those cells whose distance less their radius does not lie
        beyond the k-th best so found (all, for queries that have found fewer than k).
        """
        if probes is None:
            first = materialize(self.knn_join(queries, k, min(FIRST, max(1, len(self.centers))), self_join, digits), "first")
            worst = first.groupBy("src").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("worst"))
            return materialize(self._visited(queries.join(worst.withColumnRenamed("src", "id"), "id", "left"), k, 0, self_join, digits), "neighbours")
        if probes > FIRST:
            return self._visited(queries, k, probes, self_join, digits)
        found = self._compared(queries, k, probes, self_join, digits)
        w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _visited(self, queries: DataFrame, k: int, probes: int, self_join: bool, digits: int) -> DataFrame:
        """(src, dst, sim, rank), by blocks of queries that lie together and blocks of cells: no query is copied to its cells. A block of cells is read by
        the blocks of queries of which one has a cell there."""
        placed = materialize(self._placed(queries, probes), "placed")
        # by the nearest cell, so that queries of a block visit much the same cells
        n = placed.count()
        near = placed.repartitionByRange(max(1, -(-n // V.block_for(n))), "own", "id").sortWithinPartitions("own")
        exact = not probes
        # cells of the exact way are listed for a block and not for a query: a query's are a share of all cells, so such lists would outgrow the input
        asked = V.blocks(near, "worst double", V.block_for(n), ("any array<long>", self._reached(digits))) if exact else V.blocks(near, "cells array<long>", V.block_for(n))
        rows = self.rows().where("cell >= 0").select("id", "vector", "cell")
        n = rows.count()
        rows = rows.repartitionByRange(max(1, -(-n // V.block_for(n))), "cell", "id").sortWithinPartitions("cell")
        there = V.blocks(rows, "cell long", V.block_for(n)).withColumn("has", F.array_distinct("cell"))
        if not exact:
            asked = asked.withColumn("any", F.array_distinct(F.flatten("cells"))).withColumnRenamed("cells", "visits")
        return V.best_of_blocks(asked, there, k, self_join, digits, F.arrays_overlap("any", "t_has"))

    def _reached(self, digits: int) -> Callable[[np.ndarray, pa.Table], list]:
        """The cells that the k-th best so far (``worst``) of some vector of a block does not rule out."""
        shared, radius = self.spark.sparkContext.broadcast(self.centers), self.radius

        def reached(x: np.ndarray, rows: pa.Table) -> list:
            s = rows.column("worst").to_numpy().astype(np.float64)
            # scores are rounded, so a little more is visited
            reach = np.sqrt(np.maximum(0, 2 - 2 * (np.where(np.isnan(s), -1.0, s) - 2 * 10.0**-digits))) + 1e-9
            hit = np.zeros(len(radius), bool)
            for lo in range(0, len(x), 1024):
                hit |= (_far(x[lo : lo + 1024], shared.value) - radius[None, :] <= reach[lo : lo + 1024, None]).any(0)
            return np.flatnonzero(hit).tolist()

        return reached

    def _placed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(id, vector, worst, own, cells): the nearest cell, and the ``probes`` to visit (none are listed with ``probes`` of 0)."""
        shared, dims = self.spark.sparkContext.broadcast(self.centers), self.centers.shape[1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    part = part.filter(pa.array([fit_for(v, dims) for v in part.column("vector").to_pylist()]))
                    x = _unit(np.array(part.column("vector").to_pylist(), np.float64).reshape(part.num_rows, -1))
                    if len(x):
                        d = _far(x, shared.value)
                        cells = list(np.argpartition(d, probes - 1, axis=1)[:, :probes] if 0 < probes < d.shape[1] else np.broadcast_to(np.arange(min(probes, d.shape[1])), (len(d), min(probes, d.shape[1]))))
                        yield pa.RecordBatch.from_pydict({"id": part.column("id"), "vector": part.column("vector"), "worst": part.column("worst"), "own": pa.array(d.argmin(1)), "cells": pa.array(cells, pa.list_(pa.int64()))})

        worst = F.col("worst") if not probes else F.lit(None).cast("double")
        return queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), worst.alias("worst")).mapInArrow(place, "id long, vector array<double>, worst double, own long, cells array<long>")

    def _compared(self, queries: DataFrame, k: int, probes: int, self_join: bool, digits: int) -> DataFrame:
        """The best k of each query and block of the ``probes`` nearest cells."""
        asked = self._placed(queries, probes)
        rows = self.rows().where("cell >= 0").select(F.col("id").cast("long").alias("id"), "vector", "cell")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        # a row for each cell: as many as the codebook, which the driver holds
        here = rows.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(0).alias("kind"), "id", "vector")
        there = asked.select("id", "vector", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "vector")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for b in batches:
                at = np.stack([np.asarray(b.column(c), np.int64) for c in ("cell", "block", "kind")], axis=1)
                ids = np.asarray(b.column("id"))
                for lo, hi in _runs(at):
                    part = b.slice(lo, hi - lo)
                    x = _unit(np.asarray(part.column("vector").flatten(), np.float64).reshape(hi - lo, -1))
                    if tuple(at[lo, :2]) != now:
                        now, held = tuple(at[lo, :2]), []
                    if at[lo, 2] == 0:
                        held.append((ids[lo:hi].copy(), x.copy()))
                        continue
                    if not held:
                        continue
                    names, index = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    for q in range(0, hi - lo, 256):
                        own = ids[lo + q : min(lo + q + 256, hi)]
                        s = np.round(x[q : q + 256] @ index.T, digits) + 0.0
                        if self_join:
                            s[own[:, None] == names[None, :]] = -np.inf
                        order = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :k]
                        took = np.take_along_axis(s, order, 1)
                        keep = np.isfinite(took)
                        yield pa.RecordBatch.from_pydict({"src": pa.array(np.repeat(own, keep.sum(1))), "dst": pa.array(names[order][keep]), "sim": pa.array(took[keep])})

        return here.unionAll(there).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(compare, "src long, dst long, sim double")


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal rows."""
    if not len(at):
        return []
    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(at)]))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(pairs, recall): the share of the pairs (src, dst) of an exact join that another one has."""
    hit = found.select("src", "dst").distinct().withColumn("hit", F.lit(1))
    return exact.join(hit, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("hit") / F.count(F.lit(1)), F.lit(1.0)).alias("recall"))


class SegmentedIndex:
    """Vectors (id, vector, any other columns) in segments of ``roll`` rows below one folder; a search takes each segment's top-k and
    then the top-k of these.

    Adds and removals are batches with an entry in a commit log: what is cut off has none and is not there. An add goes on
    in the last segment until that is full. A removal takes the rows that were added before it; an id may be added again.
    """

    def __init__(self, spark: SparkSession, path: str, roll: int = ROLL):
        self.spark, self.path, self.roll = spark, path.rstrip("/"), roll
        self.log = CommitLog(spark, f"{self.path}/_log")

    def _entries(self) -> list[tuple[int, dict]]:
        return [(v, self.log.entry(v)) for v in self.log.versions()]

    def _batches(self, kind: str) -> DataFrame | None:
        """All rows of the committed batches of a kind, with ``at_``: the number of their commit."""
        at = {e["batch"]: v for v, e in self._entries() if e["kind"] == kind}
        if not at:
            return None
        root = f"{self.path}/{kind}"
        d = self.spark.read.option("basePath", root).parquet(*[f"{root}/batch_={b}" for b in at])
        number = F.create_map(*[F.lit(x) for b, v in at.items() for x in (b, v)])
        return d.withColumn("at_", F.try_element_at(number, F.col("batch_"))).drop("batch_")

    def rows(self) -> DataFrame | None:
        """The rows that are there, with their segment; None before the first add."""
        d, gone = self._batches("add"), self._batches("remove")
        if d is None or gone is None:
            return d if d is None else d.drop("at_")
        gone = gone.groupBy("id").agg(F.max("at_").alias("gone_"))
        return d.join(gone, "id", "left").where("gone_ is null or gone_ < at_").select(*[c for c in d.columns if c != "at_"])

    def segments(self) -> DataFrame:
        """(segment, n): how many vectors each holds."""
        d = self.rows()
        return self.spark.createDataFrame([], "segment int, n long") if d is None else d.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))

    def _commit(self, kind: str, write: Callable[[str, int], int]) -> None:
        """Writes a batch after all that is committed, and again if another writer was faster; an entry holds the rows added so far."""
        while True:
            now = self.log.last()
            before = self.log.entry(now)["added"] if now else 0
            batch = uuid.uuid4().hex
            at = f"{self.path}/{kind}/batch_={batch}"
            added = before + write(at, before)
            if self.log.put(now + 1, {"kind": kind, "batch": batch, "added": added}):
                return
            p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def add(self, vectors: DataFrame) -> None:
        """Fills the last segment and opens new ones; what is there is not touched."""
        from graphloom.operators import ordering

        numbered = materialize(ordering.running(vectors, ["id"], out="place_"), "segment")
        n = numbered.count()

        def write(at: str, before: int) -> int:
            segment = F.floor((F.col("place_") - 1 + before) / self.roll).cast("int").alias("segment")
            numbered.select(*vectors.columns, segment).repartition("segment").write.partitionBy("segment").parquet(at)
            return n

        if n:
            self._commit("add", write)
        discard(numbered)

    def remove(self, ids: DataFrame) -> None:
        """Takes the ids out of all segments; their rows stay in the files until ``optimize``."""

        def write(at: str, before: int) -> int:
            ids.select("id").where("id is not null").distinct().write.parquet(at)
            return 0

        self._commit("remove", write)

    def optimize(self, path: str) -> SegmentedIndex:
        """The rows that are there, in full segments, in another folder."""
        out, d = SegmentedIndex(self.spark, path, self.roll), self.rows()
        if d is not None:
            out.add(d.drop("segment"))
        return out

    def search(self, query: list[float], k: int, name: str = "cosine", where: Column | None = None, digits: int = 6) -> DataFrame:
        """Top-k by similarity; the filter counts in every segment. Before the first add: no rows (id, vector, segment, score)."""
        d = self.rows()
        if d is None:
            return self.spark.createDataFrame([], "id long, vector array<double>, segment int, score double")
        d = d if where is None else d.where(where)
        d = V.scored(d, query, name, digits)
        # a row is ranked within its segment; Spark keeps k rows of a segment before it shuffles
        w = Window.partitionBy("segment").orderBy(F.desc("score"), "id")
        return V.top_k(d.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= k).drop("rank_"), k)


class WarmCache:
    """Results of searches (a few rows each) for ``ttl`` seconds; what is not held, or is too old, comes from the cold side."""

    def __init__(self, cold: Callable[..., DataFrame], ttl: float = 3600.0, size: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.cold, self.ttl, self.size, self.clock, self.held = cold, ttl, size, clock, {}
        self.hits = self.misses = 0

    def get(self, *key) -> list:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.ttl:
            self.hits += 1
            return self.held[key][1]
        self.misses += 1
        rows = self.cold(*key).collect()
        self.held.pop(key, None)
        self.held[key] = (now, rows)
        while len(self.held) > self.size:
            del self.held[next(iter(self.held))]
        return rows

    def clear(self) -> None:
        self.held.clear()
