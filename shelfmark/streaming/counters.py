"""Increments of event streams: counters, notifications once, retention, micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import looks_automated


def stream_of(spark: SparkSession, folder: str, schema, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def window_counts(events: DataFrame, key: str, at: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events of each key and tumbling window; state goes when the watermark passes."""
    counted = events.withWatermark(at, late).groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n")


def denied(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("denied", F.col("n") > limit)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Denials(StatefulProcessor):
    """Counts of a key by window, in one value with one timer. A window counts until the watermark has passed it, so events may come
    in any order within that; what is denied is told once, when a window's count first exceeds the limit. Windows that are over go
    when their key comes again, or when a timer finds its last one over."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width  # width in milliseconds

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "starts array<long>, counts array<int>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802  Spark's name
        windows: dict[int, int] = {}
        for _, _, start in rows:
            windows[start] = windows.get(start, 0) + 1
        held = self.counts.get()
        before = dict(zip(*held, strict=True)) if held else {}
        counts = dict(before)
        for start, more in sorted(windows.items()):
            n = counts.get(start, 0)
            counts[start] = min(n + more, self.limit + 1)
            if n <= self.limit < n + more:
                yield Row(key=key[0], until=start + self.width)
        # rows are late by the watermark of the batch before, so a window that is over counts in this batch and goes after it
        over = timerValues.getCurrentWatermarkInMs() - self.width
        kept = {start: n for start, n in counts.items() if start > over}
        if kept == before:
            return
        if kept:
            self.counts.update((list(kept), list(kept.values())))
        else:
            self.counts.clear()
        last, last_before = max(kept, default=None), max(before, default=None)
        if last != last_before:
            if last_before is not None:
                self.handle.deleteTimer(last_before + self.width)
            if last is not None:
                self.handle.registerTimer(last + self.width)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802  Spark's name
        self.counts.clear()  # the key's one timer is that of its last window
        return iter([])

    def close(self) -> None:
        pass


def denied_until(events: DataFrame, key: str, at: str, limit: int, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Each key and window that goes over the limit: key, until (the window's end). The counts are kept in RocksDB, which the
    session is set to use."""
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = events.schema[key].dataType.simpleString()
    ms, width = F.unix_millis(F.col(at).cast("timestamp")), minutes * 60_000
    rows = events.select(F.col(key).alias("key"), F.col(at).alias("at"), (ms - F.pmod(ms, F.lit(width))).alias("start")).withWatermark("at", late)
    found = rows.groupBy("key").transformWithState(Denials(limit, width), f"key {kind}, until long", "Append", "EventTime")
    return found.select("key", F.timestamp_millis("until").alias("until"))


def once(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each notification once, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def view_counts(events: DataFrame, key: str, agent: str) -> DataFrame:
    """Views by readers that do not look automated."""
    return events.filter(~looks_automated(F.col(agent))).groupBy(key).agg(F.count("*").alias("views"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    counted = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that has landed, in micro-batches, then stop."""
    stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()
