"""Numbers for the rows of a table in the order of some columns, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popspark.sources.shared import written


def numbered(rows: DataFrame, by: str | list[str], name: str, more: str | None = None, total: str = "total") -> DataFrame:
    """rows with name: their place from 1 by columns of any type, nulls first; rows equal in them follow each other anyhow.

    Rows are dealt out by ranges, sorted in each and written with their number in it; the sizes of the ranges before
    are added. With more, a numeric column, also total: its sum over all rows before.
    """
    keys = [F.col(c).asc_nulls_first() for c in ([by] if isinstance(by, str) else by)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id())
    placed = written(placed.withColumn("range_", F.shiftrightunsigned("at_", 33)), "numbered")
    sums = [F.count("*").alias("ahead_"), F.min("at_").alias("first_"), *([F.sum(more).alias("sum_ahead_")] if more else [])]
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = placed.groupBy("range_").agg(*sums)
    starts = starts.select("range_", "first_", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["ahead_", *(["sum_ahead_"] if more else [])]])
    out = placed.join(F.broadcast(starts), "range_").withColumn(name, F.col("at_") - F.col("first_") + F.col("ahead_") + 1)
    if more:
        own = Window.partitionBy("range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(total, (F.coalesce(F.sum(more).over(own), F.lit(0)) + F.col("sum_ahead_")).cast("long"))
    return out.drop("range_", "first_", "ahead_", "sum_ahead_", "at_")
