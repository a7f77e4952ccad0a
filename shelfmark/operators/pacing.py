"""When calls of a run start: lanes side by side, and a least interval between calls of one host.

Calls go in rounds of one for each lane. Within a round, calls of a host start an interval apart, and a round ends when
its last call has ended and each host may be called again. So a round's start is the sum of the rounds before it: a
running total over ranges, not a loop over calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import numbered, running


def scheduled(calls: DataFrame, lanes: int, *order: Column, host: str = "host", seconds: str = "seconds", interval: str = "interval") -> DataFrame:
    """calls with seq (from 1, in the order), lane (from 0), starts_at and ends_at in seconds from the run's start.

    calls: host, seconds (how long one takes), interval (the least time between starts of calls of its host).
    """
    placed = numbered(calls, *order, name="seq")
    placed = placed.withColumn("round", F.floor((F.col("seq") - 1) / lanes)).withColumn("lane", ((F.col("seq") - 1) % lanes).cast("int"))
    same = W.partitionBy("round", host).orderBy("seq")
    placed = placed.withColumn("wait", (F.row_number().over(same) - 1) * F.col(interval))
    free = F.greatest(F.col("wait") + F.col(seconds), F.col("wait") + F.col(interval))
    rounds = placed.groupBy("round").agg(F.max(free).alias("lasts"))
    starts = running(rounds, "lasts", F.col("round"), name="since").select("round", "since")
    out = placed.join(starts, "round").withColumn("starts_at", F.col("since") + F.col("wait"))
    return out.withColumn("ends_at", F.col("starts_at") + F.col(seconds)).drop("round", "wait", "since")
