"""A run's log, from what its stages write: counts are taken while rows are written, in the same pass."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source string, status string, started_at timestamp, finished_at timestamp, n_rows long, counts map<string, long>, error string"


class RunLog:
    """Each stage is a source: its rows are written, or its error is kept and the run goes on with the next."""

    def __init__(self, spark: SparkSession, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.spark, self.clock, self.entries = spark, clock, []

    def write(self, source: str, make: Callable[[], DataFrame], path: str, **counts: Column) -> DataFrame | None:
        """The rows of make, written at path and read back; None if that failed. counts: conditions whose rows are counted beside all rows."""
        began, seen = self.clock(), Observation()
        try:
            rows = make()
            rows = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()))
            rows.write.parquet(path)
            got = seen.get
            self.entries.append((source, "SUCCESS", began, self.clock(), got["n_rows"], {n: got[n] for n in counts}, None))
            return self.spark.read.schema(rows.schema).parquet(path)
        except Exception as e:
            self.entries.append((source, "ERROR", began, self.clock(), 0, {}, told(e)))
            return None

    def rows(self) -> DataFrame:
        """A row for each stage so far."""
        return self.spark.createDataFrame(self.entries, SCHEMA)


def told(error: Exception) -> str:
    """The first line of an error that says what went wrong."""
    said = str(error)
    for line in said.splitlines():
        if "[USER_RAISED_EXCEPTION]" in line:
            return line.split("[USER_RAISED_EXCEPTION]")[1].split(" SQLSTATE")[0].strip()
    return next((line.strip() for line in said.splitlines() if line.strip()), type(error).__name__)
