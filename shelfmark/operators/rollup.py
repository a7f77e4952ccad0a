"""Sales and asks rolled up to daily snapshots and to current statistics."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_before, utc_day
from ..functions.semantics import half_away, half_up
from . import medians

CHARTED = ["NEW_SEALED", "USED_COMPLETE"]
MIN_SCORE, MIN_LISTINGS = 0.72, 3


def daily_sold(sales: DataFrame, day: date | None = None, spread: bool = False) -> DataFrame:
    """Per figure, condition and UTC day: least, median, mean and greatest price, and the number of sales.

    sales: figure_id, condition, amount_usd, sold_at. day: that day alone, so that it prunes the scan. spread: with two
    passes, in which no task holds all prices of a key (medians); the result is the same.
    """
    rows = sales.filter(F.col("condition").isin(*CHARTED))
    if day is not None:
        rows = rows.filter((F.col("sold_at") >= F.lit(day).cast("timestamp_ntz")) & (F.col("sold_at") < F.date_add(F.lit(day), 1).cast("timestamp_ntz")))
    price = F.col("amount_usd").cast("double")
    mean = F.sum(price.cast("decimal(20,6)")).cast("double") / F.count(price)  # a sum of decimals does not depend on its order
    if spread:
        keys = ["figure_id", "condition", "day"]
        rows = rows.withColumn("day", utc_day(F.col("sold_at")))
        plain = rows.groupBy(*keys).agg(half_up(F.min(price)).alias("min_usd"), half_up(mean).alias("avg_usd"), half_up(F.max(price)).alias("max_usd"), F.count("*").alias("sample_size"))
        middle = medians.medians(rows, keys, "amount_usd").select(*(F.col(k).alias(f"of_{k}") for k in keys), half_up(F.col("median")).alias("median_usd"))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys))
        return plain.join(middle, same, "left").select(*keys, "min_usd", "median_usd", "avg_usd", "max_usd", "sample_size")
    return rows.groupBy("figure_id", "condition", utc_day(F.col("sold_at")).alias("day")).agg(
        half_up(F.min(price)).alias("min_usd"), half_up(F.median(price)).alias("median_usd"), half_up(mean).alias("avg_usd"), half_up(F.max(price)).alias("max_usd"), F.count("*").alias("sample_size")
    )


def lowest_ask(listings: DataFrame) -> DataFrame:
    """The least active ask of each figure and condition; any score counts."""
    return listings.filter("is_active AND figure_id IS NOT NULL").groupBy("figure_id", "condition").agg(F.min("amount_usd").alias("lowest_ask_usd"))


def with_lowest_ask(sold: DataFrame, listings: DataFrame) -> DataFrame:
    return sold.join(lowest_ask(listings), ["figure_id", "condition"], "left")


def trusted_asks(listings: DataFrame) -> DataFrame:
    """Active, sealed, well matched; a null score is not."""
    return listings.filter(F.col("figure_id").isNotNull() & F.col("is_active") & (F.col("condition") == "NEW_SEALED") & (F.col("match_score") >= MIN_SCORE))


def ask_snapshot(listings: DataFrame, day: date) -> DataFrame:
    """Asks of figures with enough trusted listings, dated with the day given."""
    grouped = trusted_asks(listings).groupBy("figure_id").agg(F.min("amount_usd").alias("low"), F.median("amount_usd").alias("mid"), F.max("amount_usd").alias("high"), F.count("*").alias("ask_count"))
    return grouped.filter(F.col("ask_count") >= MIN_LISTINGS).select(
        "figure_id", F.lit("NEW_SEALED").alias("condition"), F.lit(day).alias("day"),
        *(half_away(F.col(c)).cast("double").alias(n) for c, n in (("low", "ask_min_usd"), ("mid", "ask_median_usd"), ("high", "ask_max_usd"))), "ask_count",
    )


def ask_medians(figures: DataFrame, listings: DataFrame, spread: bool = False) -> DataFrame:
    """Every figure with its trusted asks' median and number; null and 0 if there are too few. spread: as in daily_sold."""
    asks = trusted_asks(listings)
    asks = medians.medians(asks, ["figure_id"], "amount_usd", "mid") if spread else asks.groupBy("figure_id").agg(F.median("amount_usd").alias("mid"), F.count("*").alias("n"))
    asks = asks.filter(F.col("n") >= MIN_LISTINGS)
    return figures.select("figure_id").join(asks, "figure_id", "left").select("figure_id", half_away(F.col("mid")).cast("double").alias("ask_median_usd"), F.coalesce("n", F.lit(0)).alias("ask_listings"))


def figure_stats(sales: DataFrame, now: datetime, spread: bool = False) -> DataFrame:
    """Market value, change against the 30 days before, and volume, from sealed sales of 90 days, in one pass, or spread as in daily_sold."""
    price, at = F.col("amount_usd").cast("double"), F.col("sold_at")
    d30, d60, d90 = (days_before(now, d) for d in (30, 60, 90))
    rows = sales.filter((F.col("condition") == "NEW_SEALED") & (at >= d90))
    if spread:
        spans = F.array_compact(F.array(F.lit("all"), F.when(at >= d30, "current").when(at >= d60, "prior")))
        each = medians.medians(rows.select("figure_id", price.alias("usd"), F.explode(spans).alias("span")), ["figure_id", "span"], "usd")
        own = lambda span: F.max(F.when(F.col("span") == span, F.col("median"))).alias(span)
        volume = rows.groupBy(F.col("figure_id").alias("of")).agg(F.count("*").alias("volume_90d"))
        stats = each.groupBy("figure_id").agg(own("current"), own("prior"), own("all")).join(volume, F.col("figure_id").eqNullSafe(F.col("of"))).drop("of")
    else:
        stats = rows.groupBy("figure_id").agg(
            F.median(F.when(at >= d30, price)).alias("current"), F.median(F.when((at >= d60) & (at < d30), price)).alias("prior"), F.median(price).alias("all"), F.count("*").alias("volume_90d")
        )
    change = F.try_divide(F.col("current") - F.col("prior"), F.col("prior")) * 100
    return stats.select("figure_id", half_up(F.coalesce("current", "all")).alias("market_value_usd"), half_up(change).alias("change_30d_pct"), "volume_90d")


def with_figure_stats(figures: DataFrame, sales: DataFrame, now: datetime, spread: bool = False) -> DataFrame:
    """All figures; those without recent sales are cleared."""
    return figures.select("figure_id").join(figure_stats(sales, now, spread), "figure_id", "left").withColumn("volume_90d", F.coalesce("volume_90d", F.lit(0)))


def all_time_stats(snapshots: DataFrame, listings: DataFrame) -> DataFrame:
    """Extremes, volume and latest median of each figure's sold days, with its cheapest active ask.

    An ask-only day has no sold median; the latest median is then null, not 0.
    """
    stats = snapshots.groupBy("figure_id").agg(
        F.min("min_usd").alias("all_time_low"), F.max("max_usd").alias("all_time_high"), F.sum("sample_size").alias("total_sales"),
        F.max("day").alias("last_day"), F.max_by("median_usd", F.struct("day", "condition")).alias("last_median_usd"),
    )
    cheapest = listings.filter("is_active AND figure_id IS NOT NULL").groupBy("figure_id").agg(F.min("amount_usd").alias("cheapest_usd"))
    return stats.join(cheapest, "figure_id", "left")


def price_history(sold: DataFrame, asks: DataFrame) -> DataFrame:
    """One row a day and figure: what was sold, else what was asked; days with neither are left out."""
    keys = ["figure_id", "condition", "day"]
    days = sold.select(*keys, "min_usd", "median_usd", "max_usd", "sample_size").join(asks.select(*keys, "ask_min_usd", "ask_median_usd", "ask_max_usd", "ask_count"), keys, "full_outer")
    return day_values(days)


def day_values(days: DataFrame) -> DataFrame:
    """A recorded sold price of 0 is still a sold price."""
    sold = F.col("median_usd").isNotNull()
    pick = lambda a, b: F.when(sold, F.col(a)).otherwise(F.col(b))
    return days.filter("median_usd IS NOT NULL OR ask_median_usd IS NOT NULL").select(
        "figure_id", "condition", "day", pick("median_usd", "ask_median_usd").alias("median"), pick("min_usd", "ask_min_usd").alias("low"), pick("max_usd", "ask_max_usd").alias("high"),
        F.coalesce(pick("sample_size", "ask_count"), F.lit(0)).alias("volume"), F.when(sold, "sold").otherwise("asking").alias("basis"),
    )


def chart_extent(history: DataFrame) -> DataFrame:
    """Bounds of a figure's chart, padded by 12 % of their distance or 2."""
    low, high = F.min(F.least("low", "median")), F.max(F.greatest("high", "median"))
    got = history.groupBy("figure_id").agg(low.alias("lo"), high.alias("hi"))
    pad = F.greatest((F.col("hi") - F.col("lo")) * 0.12, F.lit(2.0))
    return got.select("figure_id", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))
