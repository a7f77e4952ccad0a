"""Fields of a catalogue filled in later, from what shops and pages have said since. Each gives the table's new rows and may run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unused
from . import tables
from .lifecycle import SEPARATE_DAYS
from .shops import shop_of


def barcode_kind(code: Column) -> Column:
    """JAN for the prefixes of Japan, UPC for other codes of 12 or 13 digits, null for anything else."""
    return F.when(code.rlike("^4[59][0-9]{11}$"), "JAN").when(code.rlike("^[0-9]{12,13}$"), "UPC")


def barcodes(identifiers: DataFrame, figures: DataFrame, products: DataFrame) -> DataFrame:
    """identifiers (figure_id, kind, value) with the codes of products that carry a figure's line and number; of several such
    products of a figure the first by product_id counts, and an identifier that another figure holds stays with it.

    figures: figure_id, line, number. products: product_id, line, number, code.
    """
    told = products.filter(barcode_kind(F.col("code")).isNotNull())
    hits = figures.filter("line IS NOT NULL AND number IS NOT NULL").select("figure_id", "line", "number").join(told, ["line", "number"])
    first = hits.groupBy("figure_id").agg(F.min_by("code", F.struct("product_id", "code")).alias("value"))
    new = first.select("figure_id", barcode_kind(F.col("value")).alias("kind"), "value")
    return tables.insert_if_absent(identifiers, new, ["kind", "value"])


def offers(held: DataFrame, figures: DataFrame, hosts: dict[str, str]) -> DataFrame:
    """Offers (figure_id, source, url) with the lone store link of each figure, under the shop that its host names; links to other hosts give none."""
    named = figures.select("figure_id", shop_of(F.col("store_url"), hosts).alias("source"), F.col("store_url").alias("url")).filter("source IS NOT NULL")
    return tables.insert_if_absent(held, named, ["figure_id", "source"])


def folded_printings(printings: DataFrame, figures: DataFrame) -> DataFrame:
    """printings (figure_id, printing_key, release_date, price, currency) with each folded figure's own release, kept as a printing of the one
    it was folded into where both dates are known and far enough apart. figures: figure_id, superseded_by, release_date, price, currency."""
    survivor = figures.select(F.col("figure_id").alias("superseded_by"), F.col("release_date").alias("first_date"))
    folded = figures.filter("superseded_by IS NOT NULL").join(survivor, "superseded_by")
    apart = folded.filter(F.abs(F.datediff("release_date", "first_date")) > SEPARATE_DAYS)
    new = apart.select(F.col("superseded_by").alias("figure_id"), F.col("figure_id").cast("string").alias("printing_key"), "release_date", "price", "currency")
    return tables.upsert_partly(printings, new, ["figure_id", "printing_key"], ["release_date", "price", "currency"])


def is_reading(name: Column) -> Column:
    """Whether a name is written in kana alone, which says how it is spoken and not what it is."""
    return name.rlike(r"^[\x{3040}-\x{30FF}\s・]+$")


def japanese_names(figures: DataFrame, names: DataFrame) -> DataFrame:
    """figures with name_ja and reading as their Japanese pages give them. What name_ja held moves to the reading if it is one and the page
    has none; a figure without a page keeps a name, but not a reading in its place. names: figure_id, page_name, page_reading."""
    came = dict(zip(("page_name", "page_reading"), unused([*figures.columns], "page_name", "page_reading"), strict=True))
    pages = tables.first_of_each(names.filter("page_name IS NOT NULL"), ["figure_id"]).select("figure_id", *(F.col(a).alias(b) for a, b in came.items()))
    rows = figures.join(pages, "figure_id", "left")
    old, found = F.col("name_ja"), F.col(came["page_name"]).isNotNull()
    spoken = F.when(is_reading(old), old)
    name = F.when(found, F.col(came["page_name"])).when(spoken.isNull(), old)
    reading = F.when(found, F.coalesce(F.col(came["page_reading"]), spoken, "reading")).otherwise(F.coalesce("reading", spoken))
    return rows.select(*(name.alias(c) if c == "name_ja" else reading.alias(c) if c == "reading" else F.col(c) for c in figures.columns))


#: URLs that a sitemap may have.
MOST_URLS = 50_000


def sitemap(figures: DataFrame, fixed: list[tuple[str, str, float]], site: str, most: int = MOST_URLS) -> DataFrame:
    """url, last_modified, change_frequency, priority: the fixed pages, and those of the figures changed last that are not superseded, most in all."""
    spark = figures.sparkSession
    pages = spark.createDataFrame([(f"{site}{path}", often, priority) for path, often, priority in fixed], "url string, change_frequency string, priority double")
    last = figures.filter("superseded_by IS NULL").orderBy(F.desc("updated_at"), "slug").limit(most - len(fixed))
    rows = last.select(F.concat(F.lit(f"{site}/figures/"), F.col("slug")).alias("url"), F.col("updated_at").alias("last_modified"), F.lit("weekly").alias("change_frequency"), F.lit(0.7).alias("priority"))
    return pages.select("url", F.lit(None).cast(rows.schema["last_modified"].dataType).alias("last_modified"), "change_frequency", "priority").unionByName(rows)
