"""What people decide: reported sales approved, listings rejected; and what has to be counted again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fx, rollup


def approved_sales(sales: DataFrame, reports: DataFrame, approved: DataFrame, rates: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sales, reports and figures' statistics after reports are approved.

    An open report that has its figure, price and date becomes a sale in dollars, once; one without a rate stays open. Only figures
    with a new sale are counted again. sales: figure_id, source, external_id, condition, amount_usd, sold_at. reports: report_id,
    status, figure_id, amount, currency, condition, sold_at. approved: report_id.
    """
    ready = reports.filter("status = 'OPEN' AND figure_id IS NOT NULL AND amount IS NOT NULL AND sold_at IS NOT NULL").join(approved.select("report_id").distinct(), "report_id", "left_semi")
    priced, _ = fx.to_usd(ready.withColumn("currency", F.coalesce("currency", F.lit("USD"))), rates)
    new = priced.select(
        "figure_id", F.lit("user").alias("source"), F.concat(F.lit("submission:"), F.col("report_id").cast("string")).alias("external_id"), F.coalesce("condition", F.lit("UNKNOWN")).alias("condition"), "amount_usd", "sold_at",
    )
    new = new.join(sales.select("source", "external_id"), ["source", "external_id"], "left_anti").select(sales.columns)
    after = sales.unionByName(new)
    done = priced.select("report_id", F.lit(True).alias("__done"))
    states = reports.join(done, "report_id", "left").withColumn("status", F.when(F.col("__done"), "APPROVED").otherwise(F.col("status"))).drop("__done")
    touched = new.select("figure_id").distinct()
    return after, states, rollup.figure_stats(after.join(touched, "figure_id", "left_semi"), now)


def rejected_listings(listings: DataFrame, rejections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings after people took them off their figures, which stay barred to them, and the asks of the figures that lost one.

    listings: listing_id, figure_id, match_score, rejected (array of figure ids as strings), condition, is_active, amount_usd.
    """
    hit = listings.join(rejections.select("listing_id").distinct().withColumn("__hit", F.lit(True)), "listing_id", "left")
    off = F.coalesce(F.col("__hit"), F.lit(False)) & F.col("figure_id").isNotNull()
    more = F.array_distinct(F.concat(F.coalesce("rejected", F.array().cast("array<string>")), F.array(F.col("figure_id").cast("string"))))
    lost = hit.filter(off).select("figure_id").distinct()
    none = {c: F.lit(None).cast(listings.schema[c].dataType) for c in ("figure_id", "match_score")}
    after = hit.select(*(F.when(off, more if c == "rejected" else none[c]).otherwise(F.col(c)).alias(c) if c in ("rejected", *none) else F.col(c) for c in listings.columns))
    return after, rollup.ask_medians(lost, after)
