"""Roll-ups kept up with changes: only the keys and days that a change touched are computed anew.

A rematch, a rejection or a correction leaves a table of touched (figure_id, day). Sales are semi-joined to it, and read no further
back than its days, so the work follows the change and not the history.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unused
from ..functions.dates import utc_day
from . import rollup


def touched(before: DataFrame, after: DataFrame, keys: list[str], figure: str = "figure_id", at: str = "sold_at") -> DataFrame:
    """Distinct (figure_id, day) of sales that came, went, or changed their figure, for the figure before and after. A key that
    stands more than once may add figures that did not change, which costs work and nothing else."""
    a = before.select(*keys, F.struct(F.col(figure).alias("figure_id"), utc_day(F.col(at)).alias("day")).alias("was"))
    b = after.select(*keys, F.struct(F.col(figure).alias("figure_id"), utc_day(F.col(at)).alias("day")).alias("now"))
    changed = a.join(b, keys, "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    both = changed.select(F.explode(F.array_compact(F.array("was", "now"))).alias("x")).select("x.figure_id", "x.day")
    return both.filter("figure_id IS NOT NULL").distinct()


def _since(sales: DataFrame, days: DataFrame, at: str) -> DataFrame:
    """The sales from the first touched day to the last: two values that prune the scan."""
    first, last = days.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return sales.limit(0)
    return sales.filter((F.col(at) >= F.lit(first).cast("timestamp_ntz")) & (F.col(at) < F.date_add(F.lit(last), 1).cast("timestamp_ntz")))


def snapshots(held: DataFrame, sales: DataFrame, days: DataFrame) -> DataFrame:
    """Daily snapshots of sold prices after a change. held: those before; sales: all sales after; days: touched."""
    figure_of, day_of = unused([*sales.columns, *held.columns], "touched_figure", "touched_day")
    keys = days.select(F.col("figure_id").alias(figure_of), F.col("day").alias(day_of))
    own = _since(sales, days, "sold_at").join(keys, (F.col("figure_id") == F.col(figure_of)) & (utc_day(F.col("sold_at")) == F.col(day_of)), "left_semi")
    stay = held.join(days.select("figure_id", "day"), ["figure_id", "day"], "left_anti").select(held.columns)
    return stay.unionByName(rollup.daily_sold(own).select(held.columns))


def stats(held: DataFrame, sales: DataFrame, days: DataFrame, now: datetime) -> DataFrame:
    """Figures' statistics after a change. held: those before, one row for each figure; figures that lost all sales are cleared."""
    figures = days.select("figure_id").distinct()
    again = held.select("figure_id").join(figures, "figure_id", "left_semi")
    new = rollup.with_figure_stats(again, sales.join(figures, "figure_id", "left_semi"), now)
    return held.join(figures, "figure_id", "left_anti").select(held.columns).unionByName(new.select(held.columns))


def ask_medians(held: DataFrame, listings: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures' asks after listings of some were rejected, expired or found. figures: figure_id of those touched."""
    own = figures.select("figure_id").distinct()
    new = rollup.ask_medians(held.select("figure_id").join(own, "figure_id", "left_semi"), listings.join(own, "figure_id", "left_semi"))
    return held.join(own, "figure_id", "left_anti").select(held.columns).unionByName(new.select(held.columns))
