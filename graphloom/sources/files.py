"""Tables in files: Parquet, CSV, JSON lines and ORC, by name; schemas are kept beside formats that have none."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Format -> options of reader and writer. Null and empty strings stay apart in CSV; JSON keeps null fields.
FORMATS = {"parquet": {}, "orc": {}, "json": {"ignoreNullFields": "false"}, "csv": {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true"}}


def kind_of(path: str, kind: str | None = None) -> str:
    kind = (kind or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind or path}")
    return kind


def write(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists") -> None:
    kind = kind_of(path, kind)
    df.write.mode(mode).options(**FORMATS[kind]).format(kind).save(path)


def read(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """CSV and JSON are read by a schema if one is given (nothing is scanned to infer it)."""
    kind = kind_of(path, kind)
    r = spark.read.options(**FORMATS[kind]).format(kind)
    return (r.schema(schema) if schema is not None else r).load(path)
