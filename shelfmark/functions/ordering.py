"""Places and running totals in an order over a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import named, unused
from .staging import staged

#: Low bits of an increasing id, which count the rows of a partition.
LOW = 33


def _ranges(rows: DataFrame, order: tuple[Column, ...], place: str, part: str) -> DataFrame:
    """rows, sorted by ranges and staged, with their place in their range and the range's number."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    return staged(sorted_rows, "sorted").withColumn(part, F.shiftright(place, LOW)).withColumn(place, F.col(place).bitwiseAND((1 << LOW) - 1))


def numbered(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 1: a sort by ranges, then each range counts on from those before it."""
    place, part, before = unused(rows.columns, "place", "part", "before")
    placed = _ranges(rows, order, place, part)
    sizes = placed.groupBy(part).agg(F.count("*").alias(before))
    starts = sizes.select(part, (F.sum(before).over(W.orderBy(part)) - F.col(before)).alias(before))  # a row for each range
    return placed.join(F.broadcast(starts), part).select(*map(named, rows.columns), (F.col(before) + F.col(place) + 1).alias(name))


def running(rows: DataFrame, value: str, *order: Column, name: str = "before") -> DataFrame:
    """rows with the sum of a column over all rows that come before them in the order."""
    place, part, before, own = unused([*rows.columns, name], "place", "part", "before", "own")
    placed = _ranges(rows, order, place, part)
    within = W.partitionBy(part).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn(own, F.coalesce(F.sum(value).over(within), F.lit(0)))
    sums = placed.groupBy(part).agg(F.sum(value).alias(before))
    starts = sums.select(part, (F.sum(before).over(W.orderBy(part)) - F.col(before)).alias(before))
    return placed.join(F.broadcast(starts), part).select(*map(named, rows.columns), (F.col(before) + F.col(own)).alias(name))
