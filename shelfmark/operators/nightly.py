"""Runs: what is ingested, and what a night does in its order."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_before
from ..functions.text import search_text
from . import catalog, fx, lifecycle, match, rollup, tables


def ingested_listings(held: DataFrame, items: DataFrame, figures: DataFrame, rates: DataFrame, now: datetime) -> DataFrame:
    """Listings after a poll: items with a rate are matched and upserted by (source_id, external_id). Unmatched ones are kept.

    held: source_id, external_id, title, amount, currency, amount_usd, figure_id, match_score, is_active, last_seen_at.
    """
    priced, _ = fx.to_usd(items, rates)
    titled = priced.withColumn("title_id", F.to_json(F.struct("source_id", "external_id")))
    found = match.best_match(titled.select("title_id", "title"), figures)
    new = titled.join(found, "title_id", "left").select("source_id", "external_id", "title", "amount", "currency", "amount_usd", "figure_id", F.col("score").alias("match_score"), F.lit(True).alias("is_active"), F.lit(now).cast("timestamp_ntz").alias("last_seen_at"))
    return tables.upsert(held, new.select(held.columns), ["source_id", "external_id"], "last_seen_at")


def ingested_sales(held: DataFrame, items: DataFrame, figures: DataFrame, rates: DataFrame) -> DataFrame:
    """Sales after a poll: unmatched ones are dropped; of a known sale only the figure changes, its price and date stay."""
    priced, _ = fx.to_usd(items, rates)
    titled = priced.withColumn("title_id", F.to_json(F.struct("source_id", "external_id")))
    found = match.best_match(titled.select("title_id", "title"), figures).filter("figure_id IS NOT NULL")
    new = titled.join(found, "title_id").select(*(c for c in held.columns if c != "figure_id"), "figure_id").select(held.columns)
    return tables.upsert_partly(held, new, ["source_id", "external_id"], ["figure_id"])


SOLD = ["min_usd", "median_usd", "avg_usd", "max_usd", "sample_size", "lowest_ask_usd"]
ASKED = ["ask_min_usd", "ask_median_usd", "ask_max_usd", "ask_count"]


def aggregated(sales: DataFrame, listings: DataFrame, figures: DataFrame, snapshots: DataFrame, day: date, now: datetime) -> dict[str, DataFrame]:
    """A night's tables: snapshots of what was sold on the day given, and of what is asked today, and the figures' statistics.

    Both are written over what is held of a figure, condition and day, column by column: sold prices leave a row's asks as
    they are, and asks its sold prices. Snapshots of other keys stay.
    """
    keys = ["figure_id", "condition", "day"]
    kinds = {f.name: f.dataType for f in snapshots.schema}
    whole = lambda rows: rows.select(*(F.col(c).cast(kinds[c]).alias(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in snapshots.columns))
    sold = rollup.with_lowest_ask(rollup.daily_sold(sales, day), listings)
    held = tables.upsert_partly(snapshots, whole(sold), keys, SOLD)
    held = tables.upsert_partly(held, whole(rollup.ask_snapshot(listings, now.date())), keys, ASKED)
    stats = rollup.with_figure_stats(figures, sales, now).join(rollup.ask_medians(figures, listings), "figure_id")
    return {"snapshots": held, "figures": stats}


def purged_sales(sales: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """After, never before, aggregation: single sales go once they are older than the window."""
    return tables.retained(sales, "sold_at", days_before(now, days))


def run_log(stages: DataFrame) -> DataFrame:
    """One row for each source of a run: status, rows, and the first error. stages: source, ok, n_rows, error."""
    return stages.groupBy("source").agg(F.when(F.bool_and("ok"), "SUCCESS").otherwise("ERROR").alias("status"), F.sum(F.when(F.col("ok"), F.col("n_rows")).otherwise(0)).alias("n_rows"), F.min("error").alias("error"))


def pending_reissues(figures: DataFrame, printings: DataFrame, now: datetime) -> DataFrame:
    """figures with reissue_due_at of their next printing, cleared where none is to come."""
    due = lifecycle.upcoming_reissue(printings, now).select("figure_id", F.col("due_at").alias("__due"))
    return figures.join(due, "figure_id", "left").withColumn("reissue_due_at", F.col("__due")).drop("__due")


def reindexed(figures: DataFrame, terms: list[str]) -> DataFrame:
    """figures with search_text rebuilt from their columns, and whether it changed: only those rows have to be written."""
    new = search_text(F.array(*(F.col(t).cast("string") for t in terms)))
    return figures.withColumn("changed", ~F.col("search_text").eqNullSafe(new)).withColumn("search_text", new)


def night(held: dict[str, DataFrame], day: date, now: datetime, search_terms: list[str]) -> dict[str, DataFrame]:
    """A whole night in its order: roll up, reissues, releases, retail prices, search texts, and only then the purge of sales,
    since what is purged before it is rolled up is lost.

    held: sales, listings, figures, snapshots, printings, reissue_prices, rates.
    """
    done = aggregated(held["sales"], held["listings"], held["figures"], held["snapshots"], day, now)
    figures = pending_reissues(held["figures"], held["printings"], now)
    figures = lifecycle.marked_released(figures, now)
    pending = figures.withColumn("pending", F.col("status").isin("PREORDER", "ANNOUNCED") | F.col("reissue_due_at").isNotNull())
    prices = lifecycle.msrp_in_usd(pending, held["reissue_prices"], held["rates"]).select("figure_id", F.col("new_msrp_usd").alias("msrp_usd"))
    figures = reindexed(figures.drop("msrp_usd").join(prices, "figure_id"), search_terms)
    figures = figures.join(done["figures"], "figure_id")
    return {"figures": figures, "snapshots": done["snapshots"], "sales": purged_sales(held["sales"], now), "listings": lifecycle.expired_listings(held["listings"], now)}


def polled(figures: DataFrame, now: datetime, k: int, min_age: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The figures that a run asks for, by demand and age, and all figures with those marked as polled.

    min_age: hours since the last poll; figures never polled always count.
    """
    due = figures if min_age is None else figures.filter(F.col("last_polled_at").isNull() | (F.col("last_polled_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(min_age))))
    chosen = catalog.poll_priority(due, now, k)
    hit = chosen.select("figure_id", F.lit(True).alias("__hit"))
    at = F.when(F.col("__hit"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_polled_at"))
    return chosen, figures.join(hit, "figure_id", "left").withColumn("last_polled_at", at).drop("__hit")


def without_demo(sales: DataFrame, listings: DataFrame, prefix: str = "demo-") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sales and listings without made-up rows, and the figures that had one: their snapshots and statistics have to be rebuilt."""
    made_up = F.coalesce(F.col("external_id").startswith(prefix), F.lit(False))
    touched = sales.filter(made_up).select("figure_id").unionByName(listings.filter(made_up).select("figure_id")).distinct()
    return sales.filter(~made_up), listings.filter(~made_up), touched
