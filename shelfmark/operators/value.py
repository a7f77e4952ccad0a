"""What a figure, a holding or a reported price is worth, and on what basis."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_before, instant
from ..functions.semantics import half_up

BASES = ["sold", "asking", "msrp"]


def ahead(at: str, now: datetime) -> Column:
    return F.coalesce(F.col(at).cast("timestamp_ntz") > instant(now), F.lit(False))


def figure_value(figures: DataFrame, now: datetime) -> DataFrame:
    """figures with amount_usd, basis, listings and reissue: sold beats all; a retail price counts before a release; then asks."""
    sold, ask, msrp = F.col("market_value_usd"), F.col("ask_median_usd"), F.col("msrp_usd")
    retail = (ahead("release_date", now) | ahead("reissue_due_at", now)) & msrp.isNotNull()
    basis = F.when(sold.isNotNull(), "sold").when(retail, "msrp").when(ask.isNotNull(), "asking")
    return (
        figures.withColumn("basis", basis)
        .withColumn("amount_usd", F.when(F.col("basis") == "sold", sold).when(F.col("basis") == "msrp", msrp).when(F.col("basis") == "asking", ask))
        .withColumn("listings", F.when(F.col("basis") == "asking", F.coalesce("ask_listings", F.lit(0))).when(F.col("basis").isNotNull(), 0))
        .withColumn("reissue", F.when(F.col("basis") == "msrp", ~ahead("release_date", now)))
    )


def majority_basis(sold: Column, asking: Column, msrp: Column) -> Column:
    """The basis of most items; of equals the earlier of sold, asking, msrp."""
    best = F.greatest(sold, asking, msrp)
    return F.when(best == 0, None).when(sold == best, "sold").when(asking == best, "asking").otherwise("msrp")


def portfolio_totals(holdings: DataFrame) -> DataFrame:
    """Per user: counts and quantity-weighted sums. holdings: user_id, quantity, paid_usd, amount_usd, basis.

    The gain covers only holdings with both a cost and a value.
    """
    q, paid, value = F.col("quantity"), F.col("paid_usd").cast("decimal(38,6)"), F.col("amount_usd").cast("decimal(38,6)")
    both = paid.isNotNull() & value.isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0))
    money = lambda c, when=None: F.coalesce(F.sum(c * q if when is None else F.when(when, c * q)), F.lit(0)).cast("double")
    got = holdings.groupBy("user_id").agg(
        count(F.lit(True)).alias("item_count"), F.count("*").alias("unique_figures"),
        money(value).alias("value"), money(paid).alias("paid"), money(value, both).alias("comparable_value"), money(paid, both).alias("comparable_paid"),
        *(count(F.col("basis") == b).alias(f"from_{b}") for b in BASES), count(value.isNull()).alias("items_without_value"), count(paid.isNull()).alias("items_without_cost"),
    )
    gain = F.col("comparable_value") - F.col("comparable_paid")
    return got.select(
        "user_id", "item_count", "unique_figures", half_up(F.col("value")).alias("market_value_usd"), majority_basis(*(F.col(f"from_{b}") for b in BASES)).alias("value_basis"),
        *(f"from_{b}" for b in BASES), "items_without_value", "items_without_cost", half_up(F.col("paid")).alias("paid_usd"), half_up(gain).alias("gain_usd"),
        F.when(F.col("comparable_paid") > 0, half_up(gain / F.col("comparable_paid") * 100)).alias("gain_pct"),
    )


# Bounds of reported prices.
LOW_OF_SALES, HIGH_OF_SALES, LOW_OF_MSRP, HIGH_OF_MSRP, CEILING, LEAST_SAMPLES = 0.25, 4, 0.2, 10, 2000, 3


def reference_prices(sales: DataFrame, figures: DataFrame, now: datetime, newest: int = 500) -> DataFrame:
    """Per figure: kind sales with median and number of at most the newest sales of a year, else msrp, else none."""
    from pyspark.sql import Window as W

    recent = sales.filter(F.col("sold_at") >= days_before(now, 365))
    order = W.partitionBy("figure_id").orderBy(F.desc("sold_at"), "amount_usd")
    recent = recent.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= newest)
    stats = recent.groupBy("figure_id").agg(F.median("amount_usd").alias("median_usd"), F.count("*").alias("sample_size"))
    joined = figures.select("figure_id", "msrp_usd").join(stats, "figure_id", "left")
    kind = F.when(F.col("sample_size") >= LEAST_SAMPLES, "sales").when(F.col("msrp_usd").isNotNull(), "msrp").otherwise("none")
    return joined.select("figure_id", kind.alias("kind"), "median_usd", F.coalesce("sample_size", F.lit(0)).alias("sample_size"), "msrp_usd")


def screen(reports: DataFrame) -> DataFrame:
    """reports (amount, kind, median_usd, msrp_usd) with status and reason."""
    x, median, msrp = F.col("amount"), F.col("median_usd"), F.col("msrp_usd")
    reason = (
        F.when(F.col("kind") == "sales", F.when(x < median * LOW_OF_SALES, "below median").when(x > median * HIGH_OF_SALES, "above median"))
        .when(F.col("kind") == "msrp", F.when((x < msrp * LOW_OF_MSRP) | (x > msrp * HIGH_OF_MSRP), "far from retail"))
        .otherwise(F.when(x > CEILING, "no history"))
    )
    return reports.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "APPROVED").otherwise("PENDING_REVIEW"))


def validate(reports: DataFrame, now: datetime) -> DataFrame:
    """reports (amount, sold_at) with the first error, or null."""
    x, at = F.col("amount"), F.col("sold_at")
    error = (
        F.when(x.isNull() | F.isnan(x.cast("double")), "amount: invalid")
        .when(x < 0.5, "amount: too low").when(x > 100_000, "amount: too high")
        .when(at.isNull(), "sold_at: invalid").when(at > days_before(now, -1), "sold_at: in the future")
        .when(at < F.add_months(F.lit(now.date()), -120).cast("timestamp_ntz"), "sold_at: too old")
    )
    return reports.withColumn("error", error)


def within_report_limits(reports: DataFrame, per_day: int = 20, per_figure: int = 5) -> DataFrame:
    """reports (user_id, figure_id, reported_at) with whether each keeps to the limits of its day."""
    from pyspark.sql import Window as W

    day = F.col("reported_at").cast("date")
    before = lambda *keys: F.count("*").over(W.partitionBy(*keys, day).orderBy("reported_at", "report_id").rowsBetween(W.unboundedPreceding, -1))
    return reports.withColumn("allowed", (before("user_id") < per_day) & (before("user_id", "figure_id") < per_figure))
