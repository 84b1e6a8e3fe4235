"""Scans along an order within groups: ranges of rows are scanned apart, and what one range leaves is carried into the next.

A group may hold any share of all rows, as ranges cut through groups. What is carried is a row for each range and group
that meet, so it is small, and its own scan takes no more rows of a group than there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popspark.sources.shared import written

#: Names that the scans add: the range of a row and its place among all rows.
RANGE, PLACE = "range_", "place_"


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows as a written table with their range and place, which ascend by the columns by and then order, nulls first."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(PLACE, F.monotonically_increasing_id())
    return written(placed.withColumn(RANGE, F.shiftrightunsigned(PLACE, 33)), "ranged")


def _own(by: list[str]):
    return Window.partitionBy(RANGE, *by).orderBy(PLACE)


def before(by: list[str], value: Column, how) -> Column:
    """how (an aggregate) of value over the rows before within range and group."""
    return how(value).over(_own(by).rowsBetween(Window.unboundedPreceding, -1))


def upto(by: list[str], value: Column, how) -> Column:
    """The same with the row itself."""
    return how(value).over(_own(by).rowsBetween(Window.unboundedPreceding, 0))


def carried(rows: DataFrame, by: list[str], name: str, left: Column, how) -> DataFrame:
    """rows with name: how, over all ranges before, of what they leave for the group; left is that aggregate of a range's rows of a group.

    how is the aggregate over ranges; null if no range before has rows of the group.
    """
    each = rows.groupBy(RANGE, *by).agg(left.alias("left_"))
    scan = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    found = each.select(RANGE, *[F.col(c).alias(f"{c}_of") for c in by], how("left_").over(scan).alias(name)).withColumnRenamed(RANGE, "range_of")
    on = rows[RANGE] == found["range_of"]
    for c in by:
        on = on & rows[c].eqNullSafe(found[f"{c}_of"])
    return rows.join(found, on).drop("range_of", *[f"{c}_of" for c in by])


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the rows of the group before, in order."""
    out = carried(ranged(rows, by, order), by, "carried_", F.sum(value), F.sum)
    own = before(by, F.col(value), F.sum)
    return out.withColumn(name, F.coalesce(own, F.lit(0)) + F.coalesce("carried_", F.lit(0))).drop("carried_", RANGE, PLACE)
