"""Places of rows in a total order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import staged


def placed(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``df`` with each row's place from 1: ranges of the order are sorted apart, then counted up.

    Only the counts of ranges meet in one task. The sorted ranges are staged, as their
    borders are sampled and must not be drawn twice. Equal rows get places in any order.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = staged(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(F.col("_range").alias("_at")).agg(F.count("*").alias("_n"))
    counts = counts.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = ranges.join(F.broadcast(counts), F.col("_range") == F.col("_at"))  # a row for each range
    return met.withColumn(out, F.col("_row") + F.col("_before") + 1).select(*df.columns, out)
