"""Exchange rates: inverted quotes, monthly means, as-of lookups and the chain of fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import half_up
from . import tables

#: Days a daily rate may be old.
REACH_DAYS = 7


def inverted(quotes: DataFrame) -> DataFrame:
    """currency, day, rate_to_usd from units per dollar; quotes that are not above 0 are dropped."""
    return quotes.filter(F.col("per_usd") > 0).select(F.upper("currency").alias("currency"), "day", (1 / F.col("per_usd")).alias("rate_to_usd"))


def from_day_maps(days: DataFrame) -> DataFrame:
    """currency, day, per_usd from rows (day string, rates map<string, double>)."""
    return days.select(F.col("day").cast("date").alias("day"), F.explode("rates").alias("currency", "per_usd"))


def monthly(quotes: DataFrame) -> DataFrame:
    """The mean of the inverted quotes of each month, and their number."""
    month = F.trunc("day", "MM").alias("month")
    return inverted(quotes).groupBy("currency", month).agg(F.avg("rate_to_usd").alias("rate_to_usd"), F.count("*").alias("days"))


def latest(rates: DataFrame) -> DataFrame:
    return rates.groupBy("currency").agg(F.max("day").alias("day"), F.max_by("rate_to_usd", "day").alias("rate_to_usd"))


def to_usd(rows: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (amount, currency) with amount_usd, and the rows without a rate."""
    spot = latest(rates).select("currency", "rate_to_usd")
    code = F.upper("currency")
    joined = rows.withColumn("currency", code).join(spot, "currency", "left")
    usd = F.when(F.col("currency") == "USD", F.col("amount")).otherwise(half_up(F.col("amount") * F.col("rate_to_usd")))
    joined = joined.withColumn("amount_usd", usd).drop("rate_to_usd")
    return joined.filter("amount_usd IS NOT NULL"), joined.filter("amount_usd IS NULL")


def as_of(rows: DataFrame, rates: DataFrame, reach_days: int = REACH_DAYS, on: str = "currency", day: str = "day") -> DataFrame:
    """rows with the newest rate of their currency that is at most reach_days older than their day.

    Both sides are laid in one order by day and the last rate is carried on, so the work follows the rows, not
    the pairs. Each currency is cut into spans of days that overlap by the reach, and the rows of a span are dealt
    over several salts, to each of which its few rates go: no currency or day is a single task.
    """
    span, salts = 64, 16
    at = lambda c: F.unix_date(F.col(c))
    names = rows.columns
    left = rows.withColumn("__span", F.floor(at(day) / span)).withColumn("__day", at(day)).withColumn("__rate", F.lit(None).cast("double")).withColumn("__row", F.lit(1)).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    right = rates.select(F.col("currency").alias(on), at("day").alias("__day"), F.col("rate_to_usd").cast("double").alias("__rate"))
    spans = F.sequence(F.floor(F.col("__day") / span), F.floor((F.col("__day") + reach_days) / span))
    right = right.withColumn("__span", F.explode(spans)).withColumn("__row", F.lit(0)).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = left.unionByName(right, allowMissingColumns=True)
    order = W.partitionBy(on, "__span", "__salt").orderBy("__day", "__row")
    seen = F.last(F.when(F.col("__row") == 0, F.struct("__day", "__rate")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    found = both.withColumn("__seen", seen).filter("__row = 1")
    fresh = F.col("__day") - F.col("__seen.__day") <= reach_days
    return found.select(*names, F.when(fresh, F.col("__seen.__rate")).alias("rate_to_usd"), F.when(fresh, F.date_from_unix_date("__seen.__day")).alias("rate_day"))


def historical(rows: DataFrame, daily: DataFrame, months: DataFrame, display: str) -> DataFrame:
    """rows (id, amount, currency, day or null, precision) in the display currency: by rates of the day, else of
    the month, else of today; both currencies' rates come from the same tier. Rows without any have a null amount."""
    day = F.col("day").cast("date")
    base = rows.withColumn("currency", F.upper("currency")).withColumn("day", day)
    dated = base.filter("day IS NOT NULL")
    by_day = as_of(dated.select("id", "currency", "day"), daily).select("id", F.col("rate_to_usd").alias("d_from"))
    display_days = dated.select("day").distinct().withColumn("currency", F.lit(display))
    to_day = as_of(display_days, daily).select("day", F.col("rate_to_usd").alias("d_to"))
    spot = latest(daily).select("currency", F.col("rate_to_usd").alias("t_from"))
    m_from = months.select("currency", F.col("month").alias("m"), F.col("rate_to_usd").alias("m_from"))
    m_to = months.filter(F.col("currency") == display).select(F.col("month").alias("m2"), F.col("rate_to_usd").alias("m_to"))
    joined = base.join(by_day, "id", "left").join(to_day, "day", "left").withColumn("m", F.trunc("day", "MM")).join(m_from, ["currency", "m"], "left").join(m_to, F.col("m") == F.col("m2"), "left").join(spot, "currency", "left")
    joined = joined.join(latest(daily).filter(F.col("currency") == display).select(F.col("rate_to_usd").alias("t_to"), F.lit(display).alias("shown")), F.lit(display) == F.col("shown"), "left")
    dollar = lambda c, code: F.when(code == "USD", 1.0).otherwise(F.col(c))
    legs = {t: (dollar(f"{t}_from", F.col("currency")), dollar(f"{t}_to", F.lit(display))) for t in ("d", "m", "t")}
    tier = lambda t, when: F.when(when & (legs[t][0] > 0) & (legs[t][1] > 0), F.struct((F.col("amount") * legs[t][0] / legs[t][1]).alias("amount"), F.lit("today" if t == "t" else "release").alias("basis")))
    same = F.when(F.col("currency") == display, F.struct(F.col("amount").cast("double").alias("amount"), F.when(F.col("day").isNotNull(), "release").otherwise("today").alias("basis")))
    best = F.coalesce(same, tier("d", F.col("day").isNotNull() & (F.col("precision") == "DAY")), tier("m", F.col("day").isNotNull()), tier("t", F.lit(True)))
    return joined.select("id", best["amount"].alias("converted"), best["basis"].alias("basis"))


def backfilled(held_daily: DataFrame, held_months: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily and monthly rates after a history came in: a day's rate that is held stays, a month's mean is taken anew."""
    new = inverted(quotes)
    daily = tables.insert_if_absent(held_daily, new.select(held_daily.columns), ["currency", "day"])
    months = monthly(quotes).select(held_months.columns)
    return daily, held_months.join(months.select("currency", "month"), ["currency", "month"], "left_anti").select(held_months.columns).unionByName(months)
