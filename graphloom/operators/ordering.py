"""Global ranks and running totals without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

ROWS_PER_RANGE = 200_000


def running(df: DataFrame, order: list[str], value: Column | None = None, out: str = "running") -> DataFrame:
    """Adds ``out``: the sum of ``value`` (1: the rank from 1) over all rows up to this one, by ``order``.

    Rows are dealt to key ranges; a range's sum is added to what goes before it, and a window works inside a range only. The
    ranges are written once, so a range keeps its rows if tasks are run again. The window over the ranges has a row for each.
    """
    n = max(1, -(-df.count() // ROWS_PER_RANGE))
    v = F.lit(1) if value is None else value
    d = df.withColumn("value_", v).repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id())
    d = materialize(d, "ranges")
    ahead = F.coalesce(F.sum("sum_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = d.groupBy("range_").agg(F.sum("value_").alias("sum_")).select("range_", ahead.alias("ahead_"))
    inside = F.sum("value_").over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.join(F.broadcast(sums), "range_").withColumn(out, F.col("ahead_") + inside).drop("range_", "value_", "ahead_")
