"""A spatial index on Parquet: places laid out along a space-filling curve, and searches that read the stretches they need.

A place's key interleaves the bits of its row (latitude) and column (longitude) in a grid of 2^LEVEL by 2^LEVEL cells, so that a square of
cells at any coarser level is one stretch of keys. Rows are written in key order; a search covers its circle with a few stretches,
which Parquet statistics turn into files and row groups to skip, and then takes the exact distance. Circles over the date line are two boxes,
circles over a pole take all longitudes.

Rows whose coordinates are null, NaN or out of range (90 and 180 degrees) are kept with key -1, and no search finds them. Ties in
distance go by id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.predicates import EARTH_RADIUS_M, haversine
from graphloom.session import discard, materialize

LEVEL = 16
#: Stretches that a circle is covered with at most.
STRETCHES = 48
#: Counts around centers look at cells so many levels finer than the circle, while there are no more than 2^FINEST columns.
FINER, FINEST = 2, 10
#: Circles are covered with this much more, relative and in degrees, as distances are in floating point.
SLACK, DEGREES = 1e-9, 1e-7


def _spread(x: Column) -> Column:
    """A zero bit between any two of the 16 low bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def place(v: Column, low: float, span: float, level: int = LEVEL) -> Column:
    """The row or column of a coordinate; the upper end belongs to the last one."""
    n = 1 << level
    return F.least(F.lit(n - 1), F.floor((v - low) / span * n)).cast("long")


def key(lat: Column, lon: Column) -> Column:
    fine = F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))
    return F.when(fine, F.shiftleft(_spread(place(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(place(lon, -180.0, 360.0)))).otherwise(F.lit(-1).cast("long"))


def boxes(lat: float, lon: float, metres: float) -> list[tuple[float, float, float, float]]:
    """(south, north, west, east) boxes that together hold the circle."""
    r = metres / EARTH_RADIUS_M * (1 + SLACK)
    d = math.degrees(r) + DEGREES
    south, north = max(-90.0, lat - d), min(90.0, lat + d)
    if lat - d <= -90 or lat + d >= 90 or r >= math.pi / 2:
        return [(south, north, -180.0, 180.0)]
    w = math.degrees(math.asin(min(1.0, math.sin(r) / math.cos(math.radians(lat))))) + DEGREES
    if w >= 180:
        return [(south, north, -180.0, 180.0)]
    west, east = lon - w, lon + w
    if west < -180:
        return [(south, north, west + 360, 180.0), (south, north, -180.0, east)]
    if east > 180:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360)]
    return [(south, north, west, east)]


def cover(found: list[tuple[float, float, float, float]], most: int = STRETCHES) -> list[tuple[int, int]]:
    """Stretches of keys (both ends included) that hold all cells of the boxes: squares are split, largest first, while there are few."""
    n = 1 << LEVEL
    cells = []
    for south, north, west, east in found:
        at = lambda v, low, span: max(0, min(n - 1, int(math.floor((v - low) / span * n))))
        cells.append((at(south, -90, 180), at(north, -90, 180), at(west, -180, 360), at(east, -180, 360)))

    def meets(row: int, col: int, size: int) -> int:
        """0 apart, 1 in part, 2 wholly inside."""
        best = 0
        for a, b, c, d in cells:
            if row <= b and row + size > a and col <= d and col + size > c:
                best = max(best, 2 if a <= row and row + size - 1 <= b and c <= col and col + size - 1 <= d else 1)
        return best

    done, open_ = [], [(0, 0, n)]
    while open_ and len(done) + len(open_) < most:
        row, col, size = open_.pop(0)
        how = meets(row, col, size)
        if how == 2 or (how and size == 1):
            done.append((row, col, size))
        elif how:
            half = size // 2
            open_.extend(q for q in ((row, col, half), (row, col + half, half), (row + half, col, half), (row + half, col + half, half)) if meets(*q))
    bits = lambda v: sum(((v >> i) & 1) << (2 * i) for i in range(LEVEL))
    out = sorted((first := (bits(row) << 1) | bits(col), first + size * size - 1) for row, col, size in done + [o for o in open_ if meets(*o)])
    joined: list[tuple[int, int]] = []
    for lo, hi in out:
        if joined and lo == joined[-1][1] + 1:
            joined[-1] = joined[-1][0], hi
        else:
            joined.append((lo, hi))
    return joined


class SpatialIndex:
    """Rows (id, lat, lon, any other columns) in the folder ``path``, in the order of their keys (``cell_``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(rows: DataFrame, path: str) -> SpatialIndex:
        d = rows.withColumn("cell_", key(F.col("lat").cast("double"), F.col("lon").cast("double")))
        d.repartitionByRange(F.col("cell_")).sortWithinPartitions("cell_").write.mode("overwrite").parquet(path)
        return SpatialIndex(rows.sparkSession, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def within(self, lat: float, lon: float, metres: float, where: Column | None = None) -> DataFrame:
        """The rows in a circle, with their distance in metres."""
        d = self.rows()
        stretches = None
        for lo, hi in cover(boxes(lat, lon, metres)):
            one = F.col("cell_").between(lo, hi)
            stretches = one if stretches is None else stretches | one
        d = d.where(stretches) if where is None else d.where(stretches & where)
        d = d.withColumn("metres", haversine(F.col("lat").cast("double"), F.col("lon").cast("double"), lat, lon))
        return d.where(F.col("metres") <= metres).drop("cell_")

    def nearest(self, lat: float, lon: float, k: int, start: float = 50_000.0) -> DataFrame:
        """The k nearest rows: circles are doubled until one holds k, which none outside can then better."""
        half = math.pi * EARTH_RADIUS_M
        reach = start
        while reach < half and self.within(lat, lon, reach).limit(k).count() < k:
            reach *= 2
        return self.within(lat, lon, min(reach, half * (1 + SLACK))).orderBy("metres", "id").limit(k)

    def join(self, centers: DataFrame, metres: float) -> DataFrame:
        """(center, id, metres): the rows within ``metres`` of each of ``centers`` (center, lat, lon).

        Both sides meet by cells of a grid as high as the circle, so a center looks at three rows of cells, and in them at the columns
        that its circle can reach; the distance is taken for rows of these cells only. Cells that many rows share are split by Spark's skew join.
        """
        c = centers.select("center", F.col("lat").cast("double").alias("c_lat"), F.col("lon").cast("double").alias("c_lon"))
        return self._near(c, self._at("id"), metres).select("center", "id", "metres")

    def around(self, centers: DataFrame, metres: float) -> DataFrame:
        """(center, n, farthest): how many rows lie within ``metres`` of each of ``centers`` (center, lat, lon), and how far the farthest is; none: no row.

        Rows at one place are counted together, and centers at one place are looked for once, so the work grows with the places that differ
        and not with the pairs.
        """
        c = centers.select("center", F.col("lat").cast("double").alias("c_lat"), F.col("lon").cast("double").alias("c_lon"))
        c = materialize(c.groupBy("center", "c_lat", "c_lon").agg(F.count(F.lit(1)).alias("times")), "centers")
        places = self._at().groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("rows"))
        found = self._near(c.select("c_lat", "c_lon").distinct(), places, metres, FINER).groupBy("c_lat", "c_lon").agg(F.sum("rows").alias("rows"), F.max("metres").alias("farthest"))
        return c.join(found, ["c_lat", "c_lon"]).groupBy("center").agg(F.sum(F.col("rows") * F.col("times")).alias("n"), F.max("farthest").alias("farthest"))

    def _at(self, *columns: str) -> DataFrame:
        return self.rows().where("cell_ >= 0").select(*columns, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))

    @staticmethod
    def _near(c: DataFrame, d: DataFrame, metres: float, finer: int = 0) -> DataFrame:
        """The pairs of ``c`` (c_lat, c_lon, ...) and ``d`` (lat, lon, ...) within ``metres``, with that; by cells as high as the circle or ``finer`` levels below."""
        level = max(1, min(LEVEL, int(math.floor(math.log2(180.0 / (math.degrees(metres / EARTH_RADIUS_M) + DEGREES))))))
        level = max(level, min(level + finer, FINEST))
        n = 1 << level
        fine = lambda lat, lon: F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))
        r = metres / EARTH_RADIUS_M * (1 + SLACK)
        lat, lon = F.col("c_lat"), F.col("c_lon")
        reach = math.degrees(r) + DEGREES
        polar = (lat - reach <= -90) | (lat + reach >= 90) | F.lit(r >= math.pi / 2)
        wide = F.when(polar, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(r, math.pi / 2))) / F.cos(F.radians(lat))))) + DEGREES))
        c = c.where(fine(lat, lon))
        c = c.withColumn("row", F.explode(F.sequence(place(F.greatest(F.lit(-90.0), lat - reach), -90.0, 180.0, level), place(F.least(F.lit(90.0), lat + reach), -90.0, 180.0, level))))
        # columns go around: from the western one on, each once
        first = F.floor((lon - wide + 180) / 360 * n).cast("long")
        span = F.least(F.lit(n - 1).cast("long"), F.floor((lon + wide + 180) / 360 * n).cast("long") - first)
        c = c.withColumn("col", F.explode(F.sequence(first, first + span))).withColumn("col", F.pmod("col", F.lit(n)))
        if finer:
            # few bytes make much work: all tasks take part
            c = c.repartition(4 * c.sparkSession.sparkContext.defaultParallelism, "row", "col")
        d = d.withColumn("row", place(F.col("lat"), -90.0, 180.0, level)).withColumn("col", place(F.col("lon"), -180.0, 360.0, level))
        return c.join(d, ["row", "col"]).withColumn("metres", haversine(F.col("lat"), F.col("lon"), lat, lon)).where(F.col("metres") <= metres)


def refresh(index: SpatialIndex, rows: DataFrame) -> SpatialIndex:
    """The index with rows replaced by id; it is written anew, in order."""
    new = rows.withColumn("cell_", key(F.col("lat").cast("double"), F.col("lon").cast("double")))
    whole = materialize(index.rows().join(new.select("id"), "id", "left_anti").unionByName(new), "places")
    whole.repartitionByRange(F.col("cell_")).sortWithinPartitions("cell_").write.mode("overwrite").parquet(index.path)
    discard(whole)
    return SpatialIndex(index.spark, index.path)
