"""Printings, reissues and release states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import days_before, has_shipped, instant, reissue_due

SEPARATE_DAYS = 92


def upcoming_reissue(printings: DataFrame, now: datetime) -> DataFrame:
    """Per figure the next printing that is no original and has not shipped; without a date, while preorders are open."""
    shipped = has_shipped(F.col("release_date"), F.col("precision"), now)
    waiting = F.when(F.col("release_date").isNotNull(), ~shipped).otherwise(F.coalesce(F.col("preorder_closes_at") > instant(now), F.lit(False)))
    rows = printings.filter((F.col("kind") != "original") & waiting)
    order = W.partitionBy("figure_id").orderBy(F.col("release_date").asc_nulls_last(), "printing_id")
    rows = rows.withColumn("i", F.row_number().over(order)).filter("i = 1").drop("i")
    return rows.withColumn("due_at", reissue_due(F.col("release_date"), F.col("precision"), F.col("preorder_closes_at")))


def folded_printings(printings: DataFrame) -> DataFrame:
    """Printings of a figure and kind within 92 days of the first of a run are one; its gaps are filled from later rows.

    Which run a row joins depends on all rows before it, so the rows of a figure, which are few, are folded in the order of
    their ids: the state is the array of runs so far. Runs stand by date, those without one last; the first is the original.
    """
    row = F.struct("printing_id", "kind", "label", F.col("release_date").cast("date").alias("release_date"), F.col("price").cast("double").alias("price"), "currency", "jan")
    run = "array<struct<kind:string,label:string,release_date:date,price:double,currency:string,jan:string>>"

    def same(r: Column, x: Column) -> Column:
        near = F.abs(F.datediff(r["release_date"], x["release_date"])) <= SEPARATE_DAYS
        return F.coalesce((r["kind"] == x["kind"]) & near, F.lit(False))

    def filled(r: Column, x: Column) -> Column:
        priced = F.when(r["price"].isNull() & x["price"].isNotNull(), x["currency"]).otherwise(r["currency"])
        return F.struct(r["kind"].alias("kind"), F.coalesce(r["label"], x["label"]).alias("label"), r["release_date"].alias("release_date"), F.coalesce(r["price"], x["price"]).alias("price"), priced.alias("currency"), F.coalesce(r["jan"], x["jan"]).alias("jan"))

    def step(runs: Column, x: Column) -> Column:
        at = F.array_position(F.transform(runs, lambda r: same(r, x)), True)  # from 1; 0: none
        joined = F.transform(runs, lambda r, i: F.when(i + 1 == at, filled(r, x)).otherwise(r))
        new = F.struct(*(x[c].alias(c) for c in ("kind", "label", "release_date", "price", "currency", "jan")))
        return F.when(at > 0, joined).otherwise(F.concat(runs, F.array(new)))

    ordered = printings.groupBy("figure_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    runs = ordered.select("figure_id", F.aggregate("rows", F.array().cast(run), step).alias("runs"))
    keyed = F.transform("runs", lambda r, i: F.struct(r["release_date"].isNull().alias("undated"), r["release_date"].alias("at"), i.alias("i"), r.alias("r")))
    placed = runs.select("figure_id", F.posexplode(F.array_sort(keyed)).alias("place", "x"))
    label = F.when(F.col("place") == 0, "Original").otherwise(F.coalesce("x.r.label", F.lit("Reissue")))
    return placed.select("figure_id", F.col("x.r.kind").alias("kind"), label.alias("label"), F.col("x.r.release_date").alias("release_date"), F.col("x.r.price").alias("price"), F.col("x.r.currency").alias("currency"), F.col("x.r.jan").alias("jan"))


def marked_released(figures: DataFrame, now: datetime) -> DataFrame:
    """Announced and preordered figures whose date is past become released; delayed and cancelled ones stay."""
    due = F.col("status").isin("PREORDER", "ANNOUNCED") & has_shipped(F.col("release_date"), F.col("precision"), now)
    return figures.withColumn("status", F.when(due, "RELEASED").otherwise(F.col("status")))


def expired_listings(listings: DataFrame, now: datetime, days: int = 3) -> DataFrame:
    """Active listings not seen for some days become inactive."""
    stale = F.col("is_active") & (F.col("last_seen_at") < days_before(now, days))
    return listings.withColumn("is_active", F.when(F.coalesce(stale, F.lit(False)), False).otherwise(F.col("is_active")))


def msrp_in_usd(figures: DataFrame, reissue_prices: DataFrame, rates: DataFrame) -> DataFrame:
    """Retail prices of unreleased figures in dollars of today; a reissue's price comes before the first release's.

    figures: figure_id, pending, price, currency, msrp_usd. Adds new_msrp_usd and action: keep, set, clear, unconvertible.
    """
    override = reissue_prices.select("figure_id", F.col("price").alias("r_price"), F.col("currency").alias("r_currency"))
    rows = figures.join(override, "figure_id", "left")
    price = F.when(F.col("r_price").isNotNull(), F.col("r_price")).otherwise(F.col("price"))
    code = F.upper(F.when(F.col("r_price").isNotNull(), F.col("r_currency")).otherwise(F.col("currency")))
    rows = rows.withColumn("__price", price).withColumn("__code", code).join(rates.select(F.col("currency").alias("__code"), "rate_to_usd"), "__code", "left")
    usd = F.round(F.col("__price") * F.when(F.col("__code") == "USD", 1.0).otherwise(F.col("rate_to_usd")), 2)
    new = F.when(F.col("pending"), usd)
    small = F.abs(new - F.col("msrp_usd")) < 0.005
    action = (
        F.when(~F.col("pending"), F.when(F.col("msrp_usd").isNull(), "keep").otherwise("clear"))
        .when(F.col("__price").isNull(), "keep").when(usd.isNull(), "unconvertible").when(F.coalesce(small, F.lit(False)), "keep").otherwise("set")
    )
    return rows.select("figure_id", F.when(action == "set", new).when(action == "clear", None).otherwise(F.col("msrp_usd")).alias("new_msrp_usd"), action.alias("action"))
