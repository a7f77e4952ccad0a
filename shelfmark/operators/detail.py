"""What pages show: cards, one figure whole, queues, offers, profiles, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_https


def cards(figures: DataFrame, manufacturers: DataFrame, series: DataFrame, photos: DataFrame) -> DataFrame:
    """Figures with their maker, their series with its franchise, and their first displayable photo, as nested structs."""
    order = W.partitionBy("figure_id").orderBy(F.desc("is_primary"), "place", "url")
    photo = photos.filter(is_https(F.col("url"))).withColumn("i", F.row_number().over(order)).filter("i = 1").select("figure_id", F.col("url").alias("photo"))
    maker = manufacturers.select("maker_id", F.struct(*(c for c in manufacturers.columns if c != "maker_id")).alias("maker"))
    tree = series.select("series_id", F.struct(*(c for c in series.columns if c != "series_id")).alias("series"))
    return figures.join(maker, "maker_id", "left").join(tree, "series_id", "left").join(photo, "figure_id", "left")


def with_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[Column], int]]) -> DataFrame:
    """parents with the first rows of each child table as an array of structs, in order; none gives an empty array."""
    out = parents
    for name, (rows, order, k) in children.items():
        first = rows.withColumn("__i", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__i") <= k)
        cells = [c for c in rows.columns if c != key]
        lists = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__i", *cells))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def offers_in_order(offers: DataFrame) -> DataFrame:
    """What is available first, then what is not stated, then the rest; the cheapest first."""
    order = W.partitionBy("figure_id").orderBy(F.when(F.col("available"), 0).when(F.col("available").isNull(), 1).otherwise(2), F.col("price").asc_nulls_last(), "source")
    return offers.withColumn("place", F.row_number().over(order))


def stale_offers(offers: DataFrame, done: DataFrame, k: int) -> DataFrame:
    """The offers checked longest ago, never first, without those just done."""
    return offers.join(done.select("figure_id"), "figure_id", "left_anti").orderBy(F.col("checked_at").asc_nulls_first(), "figure_id", "source").limit(k)


def moderation_queue(submissions: DataFrame, k: int = 50) -> DataFrame:
    return submissions.filter(F.col("status") == "PENDING_REVIEW").orderBy("created_at", "submission_id").limit(k)


def candidate_order() -> list[Column]:
    return [F.col("number").desc_nulls_last(), F.desc("listings"), F.col("first_seen"), F.col("key")]


def candidate_queue(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(*candidate_order())


def suggested_names(rows: DataFrame, query: str, prefetch: int = 30, k: int = 8) -> DataFrame:
    """Names that contain the query, those that begin with it first. The prefetch is taken by name, before ranking."""
    q = query.strip().lower()
    found = rows.select("name").distinct().filter(F.lower("name").contains(q)).orderBy("name").limit(prefetch)
    return found.orderBy(F.lower("name").startswith(q).desc(), "name").limit(k)


def public_profile(holdings: DataFrame, users: DataFrame) -> DataFrame:
    """Holdings of users who show them, without what was paid."""
    return holdings.join(users.filter("is_public").select("user_id", "username"), "user_id").select("username", "figure_id", "quantity", "condition")


def held_products(products: DataFrame, figures: DataFrame) -> DataFrame:
    """(product_id, figure_id): the only figure of the same compared name whose maker and category do not contradict; unknown ones agree, OTHER does with all.

    Figures are counted by name, maker and category, and without either; a product asks for the counts that agree with it, so no
    pair of product and figure is made.
    """
    said = lambda c: F.concat(F.lit("="), F.lower(F.trim(F.col(c))))
    maker = F.when(F.col("maker").isNull(), "any").otherwise(said("maker"))
    category = F.when(F.col("category").isNull() | (F.col("category") == "OTHER"), "any").otherwise(said("category"))
    # what agrees with every product is counted under "any", and all there is under "all"
    asked = lambda key: F.when(key == "any", F.array(F.lit("all"))).otherwise(F.array(key, F.lit("any")))
    sums = figures.filter(F.col("compared").isNotNull()).groupBy("compared", maker.alias("maker"), category.alias("category")).agg(F.count("*").alias("n"), F.min("figure_id").alias("figure_id"))
    both = lambda c: F.explode(F.array(F.col(c), F.lit("all"))).alias(c)
    held = sums.select("compared", both("maker"), "category", "n", "figure_id").select("compared", "maker", both("category"), "n", "figure_id")
    held = held.groupBy("compared", "maker", "category").agg(F.sum("n").alias("n"), F.min("figure_id").alias("figure_id"))
    # products of one name, maker and category ask alike
    kinds = products.select("compared", maker.alias("of_maker"), category.alias("of_category"), "product_id").filter(F.col("compared").isNotNull())
    asks = kinds.select("compared", "of_maker", "of_category").distinct().select("*", F.explode(asked(F.col("of_maker"))).alias("maker")).select("*", F.explode(asked(F.col("of_category"))).alias("category"))
    found = asks.join(held, ["compared", "maker", "category"]).groupBy("compared", "of_maker", "of_category").agg(F.sum("n").alias("n"), F.min("figure_id").alias("figure_id"))
    hits = kinds.join(found, ["compared", "of_maker", "of_category"])
    return hits.groupBy("product_id").agg(F.sum("n").alias("n"), F.min("figure_id").alias("figure_id")).filter("n = 1").drop("n")


def subject_tokens(titles: DataFrame, group: str, k: int = 4) -> DataFrame:
    """The tokens that stand in at least two titles of a group, most frequent first."""
    rows = titles.select(group, F.explode(F.array_distinct("tokens")).alias("token")).groupBy(group, "token").agg(F.count("*").alias("n")).filter("n >= 2")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "token"))).filter(F.col("place") <= k)


def proposals(titles: DataFrame, least: int = 3) -> DataFrame:
    """(character, maker, form) named by enough titles, with their prices' range; unknown forms and makers are none."""
    rows = titles.filter((F.col("form") != "unknown") & F.col("maker").isNotNull())
    return rows.groupBy("character", "maker", "form").agg(F.count("*").alias("n"), F.min("amount_usd").alias("low"), F.max("amount_usd").alias("high")).filter(F.col("n") >= least)


def tally(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
