"""A data source over stores: ``spark.read.format("graphloom").option("key", ...).load(path)``.

A partition is a file of a segment that is part of the state. Its rows count unless a later segment has their key; later files are looked
into only where their key range, which Parquet statistics tell, overlaps. Comparisons of the key with literals are pushed down: they skip
files by the same statistics, and rows within files. ``version`` reads an older state. Files are read by Arrow, so the path
must be one that Arrow's file systems open (local disks, HDFS, S3, GCS); ``Store.read`` has no such bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

GONE = "gone_"
_BOUNDS = {EqualTo: ("==",), GreaterThan: (">",), GreaterThanOrEqual: (">=",), LessThan: ("<",), LessThanOrEqual: ("<=",)}
_TEST = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}


@dataclass
class FilePart(InputPartition):
    """A file, the later files that may overwrite its rows, and the bounds on the key."""

    path: str
    later: tuple[str, ...]
    bounds: tuple[tuple[str, object], ...]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def state(path: str, version: int | None = None) -> list[str]:
    """The segments of the state, in order, from the commit log."""
    system, root = _opened(path)
    names: list[str] = []
    log = [f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/_log", allow_not_found=True)) if f.base_name.isdigit()]
    for v in sorted(map(int, log), reverse=True):
        if version is None or v <= version:
            with system.open_input_stream(f"{root}/_log/{v:012d}") as f:
                name = json.loads(f.read())["segment"]
            if system.get_file_info(f"{root}/{name}/_SUCCESS").type == fs.FileType.File:
                names.append(name)
                if name.endswith(".base"):
                    break
    return names[::-1]


def files(path: str, segment: str) -> list[str]:
    system, root = _opened(path)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{root}/{segment}")) if f.base_name.endswith(".parquet"))


def key_range(system: fs.FileSystem, path: str, key: str) -> tuple | None:
    """(least, greatest) key of a file by its statistics; None if it has no rows."""
    meta = pq.ParquetFile(path, filesystem=system).metadata
    at = meta.schema.names.index(key)
    found = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
    if not found:
        return None
    if any(s is None or not s.has_min_max for s in found):
        return (None, None)
    return min(s.min for s in found), max(s.max for s in found)


def _meets(range_: tuple | None, other: tuple | None) -> bool:
    return range_ is not None and other is not None and (None in range_ or None in other or (range_[0] <= other[1] and other[0] <= range_[1]))


def _within(range_: tuple, bounds: tuple) -> bool:
    if None in range_:
        return True
    low, high = range_
    return all({"==": low <= v <= high, ">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v}[op] for op, v in bounds)


class StoreReader(DataSourceReader):
    def __init__(self, path: str, key: str, version: int | None, schema: StructType):
        self.path, self.key, self.version, self.names = path, key, version, schema.names
        self.bounds: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _BOUNDS and f.attribute == (self.key,) and f.value is not None:
                self.bounds.append((_BOUNDS[type(f)][0], f.value))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        system, _ = _opened(self.path)
        held = [[(f, key_range(system, f, self.key)) for f in files(self.path, s)] for s in state(self.path, self.version)]
        out = []
        for i, segment in enumerate(held):
            for f, r in segment:
                if r is not None and _within(r, tuple(self.bounds)):
                    later = tuple(g for s in held[i + 1 :] for g, q in s if _meets(r, q))
                    out.append(FilePart(f, later, tuple(self.bounds)))
        return out

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        newer = [pq.read_table(f, columns=[self.key], filesystem=system).column(self.key) for f in partition.later]
        gone = pa.chunked_array([c for x in newer for c in x.chunks]) if newer else None
        file = pq.ParquetFile(partition.path, filesystem=system)
        have = file.schema_arrow.names
        for b in file.iter_batches(columns=[c for c in [*self.names, GONE] if c in have]):
            t = pa.Table.from_batches([b])
            keep = pc.fill_null(pc.invert(t.column(GONE)), True) if GONE in t.column_names else pa.chunked_array([pa.array([True] * t.num_rows, pa.bool_())])
            for op, v in partition.bounds:
                keep = pc.and_(keep, pc.fill_null(_TEST[op](t.column(self.key), pa.scalar(v, t.column(self.key).type)), False))
            if gone is not None:
                keep = pc.and_(keep, pc.invert(pc.is_in(t.column(self.key), value_set=gone.combine_chunks())))
            t = t.filter(keep)
            kinds = {f.name: f.type for f in file.schema_arrow}
            columns = [t.column(c) if c in t.column_names else pa.nulls(t.num_rows, kinds.get(c, pa.null())) for c in self.names]
            for r in pa.table(columns, names=self.names).to_batches():
                if r.num_rows:
                    yield r


class StoreSource(DataSource):
    """Options: ``path`` (the store's folder), ``key`` (its key column, id if not given), ``version``."""

    @classmethod
    def name(cls) -> str:
        return "graphloom"

    def _option(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.options.items() if k.lower() == name), default)

    def schema(self) -> StructType:
        """The columns of all segments, in order of their first."""
        path, version = self._option("path"), self._option("version")
        names = state(path, int(version) if version else None)
        if not names:
            raise ValueError(f"no store at {path}")
        system, _ = _opened(path)
        fields: dict[str, pa.Field] = {}
        for segment in names:
            for f in files(path, segment)[:1]:
                for x in pq.ParquetFile(f, filesystem=system).schema_arrow:
                    fields.setdefault(x.name, x)
        fields.pop(GONE, None)
        return from_arrow_schema(pa.schema(fields.values()))

    def reader(self, schema: StructType) -> DataSourceReader:
        version = self._option("version")
        return StoreReader(self._option("path"), self._option("key", "id"), int(version) if version else None, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
