"""Shops: which products are figures and why others are not, how products reach the catalogue, and what becomes of offers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_accessory
from . import tables

# Marks of bonus items among a shop's tags.
BONUS_TAG = r"(?i)^bonus(?:[ _-]?item)?s?$"


def archive_verdict(name: Column, classes: Column, spec: Column, denied: list[str], kinds: dict[str, str]) -> Column:
    """struct(reason, category) of an archive's entry: the first reason that speaks against a figure, else the category of its
    first class that has one. An entry without a specification is not refused for its class alone.

    denied: classes of other goods; kinds: figure classes and their categories.
    """
    hit = F.filter(classes, lambda c: c.isin(*denied))
    known = F.filter(classes, lambda c: c.isin(*kinds))
    category = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.get(known, F.lit(0)))
    cloth = spec.rlike(r"(?i)polyester|cotton|fabric|textile") & ~spec.rlike(r"(?i)abs|pvc|plastic|resin")
    reason = (
        F.when(name.isNull() | (name == ""), "no name").when(F.size(hit) > 0, "non-figure category").when(F.size(known) == 0, "unknown category")
        .when(is_accessory(name), "accessory name").when(spec.isNull(), "no spec table").when(cloth, "outfit, not a figure")
    )
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), category).alias("category"))


def store_verdict(title: Column, tags: Column, product_type: Column, price: Column, character_kit: Column) -> Column:
    """Why a store's product is no figure of the catalogue, or null: bonus items come before all, since most have no type."""
    kind = F.trim(F.coalesce(product_type, F.lit("")))
    unit = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t).contains("support-unit"))
    kit = (kind == "Plastic Model") & F.coalesce(character_kit, F.lit(False))
    return (
        F.when(F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t).rlike(BONUS_TAG)), "bonus item").when(is_accessory(title), "accessory").when(kit & unit, "support unit")
        .when((kind != "Figure") & ~kit, F.when(kind == "", "no product_type").otherwise(F.concat(F.lit("product_type "), kind))).when(price.isNull() | ~(price > 0), "no price")
    )


def category_of(specification: Column, scale: Column) -> Column:
    """A product's category by what its specification says; what it does not say is not guessed."""
    kind = F.lower(F.coalesce(specification, F.lit("")))
    return (
        F.when(kind.contains("plastic model") | kind.contains("model kit"), "MODEL_KIT").when(kind.contains("trading"), "TRADING")
        .when(scale.isNotNull() | kind.rlike("pre-?painted"), "SCALE").otherwise("OTHER")
    )


def shop_of(url: Column, hosts: dict[str, str]) -> Column:
    """The shop whose host a URL has, or is under. hosts: host to shop."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    out = F.lit(None).cast("string")
    for name, shop in reversed(list(hosts.items())):
        out = F.when((host == name) | host.endswith(f".{name}"), shop).otherwise(out)
    return out


def decorated(url: Column, params: dict[str, dict[str, str]]) -> Column:
    """A URL with its host's parameters behind those it has; other URLs as they are. params: host to name and value."""
    host, (bare, mark) = F.lower(F.try_parse_url(url, F.lit("HOST"))), (F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "(#.*)$", 1))
    out = url
    for name, values in params.items():
        more = F.lit("&".join(f"{k}={v}" for k, v in values.items()))
        joined = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), more, mark)
        out = F.when((host == name) | host.endswith(f".{name}"), joined).otherwise(out)
    return out


STEPS = ["product_id", "line_number", "jan", "compared"]


def imported(products: DataFrame, figures: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """products with figure_id and by: the first step in which exactly one figure has the product's value, else by create.

    Steps are columns of both, as STEPS: the shop's own id, the number of a line, the barcode, the compared name.
    A value that several figures have says nothing, and the next step is asked.
    """
    out, steps = products, steps or STEPS
    for s in steps:
        one = figures.filter(F.col(s).isNotNull()).groupBy(s).agg(F.count_distinct("figure_id").alias("__n"), F.min("figure_id").alias(f"__{s}")).filter("__n = 1").drop("__n")
        out = out.join(one, s, "left")
    found = F.coalesce(*(F.col(f"__{s}") for s in steps))
    by = reduce(lambda rest, s: F.when(F.col(f"__{s}").isNotNull(), s).otherwise(rest), reversed(steps), F.lit("create"))
    return out.select(*products.columns, found.alias("figure_id"), by.alias("by"))


def refreshed_offers(offers: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """Offers after their pages were looked at: gone ones go, good ones have the new price and state, others stay as they were.

    offers: source, product_id, price, available, checked_at. answers: source, product_id, verdict, price, available.
    """
    keys = ["source", "product_id"]
    new = answers.select(*keys, "verdict", F.col("price").alias("__price"), F.col("available").alias("__available"))
    joined = offers.join(new, keys, "left").filter(~F.col("verdict").eqNullSafe("gone"))
    ok = F.col("verdict").eqNullSafe("ok")
    return joined.select(
        *keys, F.when(ok, F.coalesce("__price", "price")).otherwise(F.col("price")).alias("price"), F.when(ok, F.col("__available")).otherwise(F.col("available")).alias("available"),
        F.when(ok, now).otherwise(F.col("checked_at")).alias("checked_at"),
    )


def recorded_variants(variants: DataFrame, shop: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The variants and identifiers (figure_id, kind, value) after a shop's variants came in: known ones have the new price, and a
    barcode that no figure holds goes to the variant's figure, the least one if several claim it.

    variants, shop: figure_id, source, code, price, jan, seen_at.
    """
    kept = tables.upsert(variants, shop, ["source", "code"], "seen_at")
    claims = shop.filter(F.col("jan").isNotNull()).select(F.lit("JAN").alias("kind"), F.col("jan").alias("value"), "figure_id").groupBy("kind", "value").agg(F.min("figure_id").alias("figure_id"))
    return kept, tables.insert_if_absent(identifiers, claims.select(identifiers.columns), ["kind", "value"])


def assigned_franchises(series: DataFrame, curated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series with their franchise, the franchises that are left with their slugs, and curated names that no series has.

    A curated franchise comes first, then the one held; a series without either becomes a franchise of its own name.
    Franchises without series are not in the result, which frees their slugs: of equal slugs the first name has it bare, later
    ones with a number. series: name, franchise (or null). curated: series, franchise.
    """
    from pyspark.sql import Window as W

    from ..functions.text import slug, unicode_form

    wanted = curated.groupBy(F.col("series").alias("name")).agg(F.min("franchise").alias("__curated"))
    out = series.join(wanted, "name", "left").withColumn("franchise", F.coalesce("__curated", "franchise", "name")).select(series.columns)
    names = out.select(F.col("franchise").alias("name")).distinct().withColumn("base", slug(unicode_form(F.col("name"), "NFKD")))
    place = F.row_number().over(W.partitionBy("base").orderBy("name"))
    franchises = names.withColumn("place", place).select("name", F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("place").cast("string"))).alias("slug"))
    return out, franchises, wanted.join(series.select("name"), "name", "left_anti").select("name")
