"""Exact medians of keys of any size, without all values of a key in one task.

Values fall into ranges that are the same for all keys, a few hundredths wide in their logarithm and in order. A first pass counts the values of
each key and range, which is a small table; running counts tell the one or two ranges that hold the middle. A second pass takes
only the rows of these, counts equal values, and goes through them in order. Both shuffles are by key and range (or
value) after a count on the map side, so a key with all rows is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import unused

#: Ranges of a doubling of the value, and what lifts their numbers above 0 for all doubles.
FINE, LIFT = 32, 1100 * 32


def range_of(value: Column) -> Column:
    """The number of a value's range: it never falls where the value rises."""
    size = F.floor(F.log2(F.abs(value)) * FINE) + LIFT
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, name (null where a key has no value), and n, how many values it has. Nulls in keys are a key; null values do not count."""
    v, part, n, before, total, low, high, own = unused([*rows.columns, name], "v", "part", "n", "before", "total", "low", "high", "own")
    held = rows.select(*keys, F.col(value).cast("double").alias(v)).withColumn(part, range_of(F.col(v)))
    counts = held.groupBy(*keys, part).agg(F.count(v).alias(n))
    whole = W.partitionBy(*keys)
    placed = counts.withColumn(before, F.sum(n).over(whole.orderBy(part)) - F.col(n)).withColumn(total, F.sum(n).over(whole))
    # places of the middle, from 0: one, or two that may lie in different ranges
    placed = placed.withColumn(low, F.floor((F.col(total) - 1) / 2)).withColumn(high, F.floor(F.col(total) / 2))
    holds = lambda at: (F.col(before) <= F.col(at)) & (F.col(at) < F.col(before) + F.col(n))
    middle = placed.filter((F.col(n) > 0) & (holds(low) | holds(high))).select(*(F.col(k).alias(f"{own}_{k}") for k in keys), F.col(part).alias(f"{own}_part"), before, low, high)
    same = F.col(part) == F.col(f"{own}_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{own}_{k}"))
    near = held.join(middle, same).groupBy(*keys, part, v).agg(F.count("*").alias(n), F.first(before).alias(before), F.first(low).alias(low), F.first(high).alias(high))
    start = F.sum(n).over(W.partitionBy(*keys, part).orderBy(v)) - F.col(n) + F.col(before)
    near = near.withColumn(before, start)
    ends = near.groupBy(*keys).agg(F.max(F.when(holds(low), F.col(v))).alias(low), F.max(F.when(holds(high), F.col(v))).alias(high))
    found = ends.select(*(F.col(k).alias(f"{own}_{k}") for k in keys), F.when(F.col(low) == F.col(high), F.col(low)).otherwise(0.5 * F.col(low) + 0.5 * F.col(high)).alias(name))
    totals = counts.groupBy(*keys).agg(F.sum(n).alias(own))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{own}_{k}"))
    return totals.join(found, match, "left").select(*keys, name, F.col(own).alias("n"))
