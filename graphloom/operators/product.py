"""Product codes: a codebook for each part of a vector, one byte a part, and searches by distance tables.

Unit vectors are cut into ``parts``; each part has ``2 ** 8`` entries at most, fitted on a bounded sample. A search adds up, for each
code, the entries of the query's table of inner products (one row a part), keeps the best ``recall`` codes of each task and then of
all, and ranks these again by the exact cosine. A code has its distance from the vector with it, which bounds what the code can be wrong by: a second scan
takes every code that this does not rule out, so the result is exact. Codes are kept apart from the vectors, so a scan reads ``parts`` + 8 bytes a row.

Vectors of another length than the commonest, zero vectors and those with null or non-finite components have no code: no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import index as X
from graphloom.operators import vectors as V
from graphloom.session import discard, materialize

#: Vectors that the codebooks are fitted on, about.
SAMPLE = 20_000


class ProductIndex:
    """Codes of (id, vector, any other columns) in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/books").orderBy("part").collect()
        self.books = [np.array(r["entries"], np.float64) for r in rows]

    @staticmethod
    def build(vectors: DataFrame, path: str, parts: int | None = None, seed: int = 0) -> ProductIndex:
        """Fits, encodes and writes; ``parts`` defaults to a quarter of the length, so codes have a sixteenth of the size of single floats."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        d = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
        good = F.coalesce(F.expr("forall(vector, c -> c is not null and not isnan(c) and abs(c) < double('inf')) and exists(vector, c -> c <> 0)"), F.lit(False))
        common = d.where(good).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        dims, n = tuple(common) if common else (0, 0)
        d = d.where(good & (F.size("vector") == dims))
        share = min(1.0, SAMPLE / max(1, n))
        taken = d.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) <= share * (1 << 30)).select("id", "vector").toPandas().sort_values("id")
        parts = max(1, min(dims, parts or dims // 4)) if dims else 0
        cut = np.linspace(0, dims, parts + 1).astype(int) if parts else [0]
        unit = X._unit(np.array(taken["vector"].tolist(), np.float64)) if len(taken) else np.zeros((0, 0))
        books = [X.codebook(unit[:, a:b], 256, seed) for a, b in zip(cut, cut[1:])]
        spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(books)], "part int, entries array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
        shared, kind = spark.sparkContext.broadcast(books), d.schema["id"].dataType.simpleString()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    part = b.slice(lo, 4096)
                    x = X._unit(np.asarray(part.column("vector").flatten(), np.float64).reshape(part.num_rows, -1))
                    codes = np.stack([X._far(x[:, a:e], c).argmin(1) for (a, e), c in zip(zip(cut, cut[1:]), shared.value)], axis=1).astype(np.uint8)
                    far = np.linalg.norm(x - np.concatenate([c[codes[:, i]] for i, c in enumerate(shared.value)], axis=1), axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(far)], names=["id", "code", "far"])

        coded = materialize(d.select("id", "vector").mapInArrow(encode, f"id {kind}, code binary, far double"), "codes")
        coded.repartitionByRange(F.col("id")).write.mode("overwrite").parquet(f"{path}/codes")
        discard(coded)
        d.repartitionByRange(F.col("id")).sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/rows")
        return ProductIndex(spark, path)

    def codes(self) -> DataFrame:
        """(id, code, far): far is the distance of the unit vector from its code."""
        return self.spark.read.parquet(f"{self.path}/codes")

    def _near(self, query: list[float], codes: DataFrame, recall: int | None = None, least: float = -np.inf) -> DataFrame:
        """(id, near) of codes whose vectors may have the cosine ``least``; with ``recall`` so many of each batch, the best."""
        q, at, table = X._unit(np.array([query], np.float64))[0], 0, []
        for b in self.books:
            table.append(np.pad(b @ q[at : at + b.shape[1]], (0, 256 - len(b))))
            at += b.shape[1]
        table = np.array(table).reshape(len(self.books), 256)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                s = table[np.arange(len(table))[None, :], code].sum(1)
                top = np.flatnonzero(s + np.asarray(b.column("far")) >= least)
                top = top if recall is None else top[np.argsort(-s[top], kind="stable")[:recall]]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(top)), pa.array(s[top])], names=["id", "near"])

        kind = codes.schema["id"].dataType.simpleString()
        return codes.select("id", "code", "far").mapInArrow(scan, f"id {kind}, near double")

    def candidates(self, query: list[float], recall: int, codes: DataFrame | None = None) -> DataFrame:
        """(id, near): the ``recall`` best of all codes, or of some, each task's first."""
        return self._near(query, self.codes() if codes is None else codes, recall).orderBy(F.desc("near"), "id").limit(recall)

    def search(self, query: list[float], k: int, recall: int = 200, where: Column | None = None, digits: int = 6) -> DataFrame:
        """Top-k by exact cosine: of the ``recall`` best by code, and then of all whose code does not rule out that they are better. A filter is applied before the scans."""
        if not self.books or not X.fit_for(query, sum(b.shape[1] for b in self.books)):
            return V.scored(self.spark.read.parquet(f"{self.path}/rows"), query, "cosine", digits).limit(0)
        rows = self.spark.read.parquet(f"{self.path}/rows")
        codes = self.codes() if where is None else self.codes().join(rows.where(where).select("id"), "id", "left_semi")
        found = self.candidates(query, max(k, recall), codes)
        # at most ``recall`` ids
        first = V.top_k(V.scored(rows.join(F.broadcast(found.select("id")), "id", "left_semi"), query, "cosine", digits), k).select("score").collect()
        # scores are rounded, so a little more is taken
        least = min(r["score"] for r in first) - 2 * 10.0**-digits if len(first) == k > 0 else -np.inf
        open_ = self._near(query, codes, least=least).select("id")
        return V.top_k(V.scored(rows.join(open_, "id", "left_semi"), query, "cosine", digits), k)
