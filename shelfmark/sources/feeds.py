"""Landed feeds as rows: JSON listings, rate maps, shop items. Nothing here reaches a network; pages and answers are files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import amount

LISTING = "itemId string, title string, itemWebUrl string, condition string, price struct<value: string, currency: string>, shippingOptions array<struct<shippingCost: struct<value: string>>>, image struct<imageUrl: string>, seller struct<username: string>"


def listings_from_json(raw: DataFrame, column: str, url_prefix: str = "https://example.com/itm/", keep: tuple[str, ...] = ()) -> DataFrame:
    """Listings of a marketplace's answers: those without id or title, or a price that is finite and above 0, are dropped. keep: columns of raw that stay."""
    rows = raw.select(*keep, F.from_json(column, LISTING).alias("j")).select(*keep, "j.*")
    price = amount(F.col("price.value"))
    return rows.filter(F.col("itemId").isNotNull() & (F.col("itemId") != "") & F.col("title").isNotNull() & (F.col("title") != "") & (price > 0)).select(
        *keep, F.col("itemId").alias("external_id"), "title", F.coalesce("itemWebUrl", F.concat(F.lit(url_prefix), "itemId")).alias("url"), price.alias("amount"), F.upper(F.coalesce("price.currency", F.lit("USD"))).alias("currency"),
        F.try_element_at(F.col("shippingOptions"), F.lit(1))["shippingCost"]["value"].try_cast("double").alias("shipping"), "condition", F.col("image.imageUrl").alias("image_url"), F.col("seller.username").alias("seller"),
    )


def second_market_items(raw: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of a second marketplace: the taxed price before the plain one. keep: columns of raw that stay."""
    rows = raw.select(*keep, F.from_json(column, "gcode string, gname string, price double, c_price_taxed double, thumb_url string, instock_flg int").alias("j")).select(*keep, "j.*")
    price = F.coalesce("c_price_taxed", "price")
    return rows.filter(F.col("gcode").isNotNull() & F.col("gname").isNotNull() & (price > 0)).select(*keep, F.col("gcode").alias("external_id"), F.col("gname").alias("title"), price.alias("amount"), F.lit("JPY").alias("currency"), F.col("thumb_url").alias("image_url"), (F.col("instock_flg") == 1).alias("available"))


def rates_from_json(raw: DataFrame, column: str) -> DataFrame:
    """currency, day, per_usd of a history of quotes (day to currency to quote)."""
    rows = raw.select(F.from_json(column, "rates map<string, map<string, double>>").alias("j"))
    return rows.select(F.explode("j.rates").alias("day", "quotes")).select(F.col("day").cast("date").alias("day"), F.explode("quotes").alias("currency", "per_usd"))


def spot_from_json(raw: DataFrame, column: str) -> DataFrame:
    """currency and rate_to_usd of today's quotes; those not above 0 are dropped."""
    rows = raw.select(F.explode(F.from_json(column, "rates map<string, double>")["rates"]).alias("currency", "per_usd"))
    return rows.filter("per_usd > 0").select(F.upper("currency").alias("currency"), (1 / F.col("per_usd")).alias("rate_to_usd"))


def shop_products(raw: DataFrame, column: str) -> DataFrame:
    """Products of a shop's JSON feed with their tags, variants and first price."""
    schema = "products array<struct<id: long, handle: string, title: string, vendor: string, product_type: string, tags: array<string>, published_at: string, variants: array<struct<id: long, sku: string, price: string, available: boolean, barcode: string>>, images: array<struct<src: string>>>>"
    rows = raw.select(F.explode(F.from_json(column, schema)["products"]).alias("p")).select("p.*")
    first = F.try_element_at(F.col("variants"), F.lit(1))
    return rows.select(F.col("id").alias("product_id"), "handle", "title", "vendor", "product_type", "tags", first["price"].try_cast("double").alias("price"), first["available"].alias("available"), first["barcode"].alias("jan"), F.try_element_at(F.col("images"), F.lit(1))["src"].alias("image_url"))


def pages_from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of cached pages: url (the path) and html."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def cache_pages(pages: DataFrame, path: str, folders: int = 64) -> None:
    """Pages (url, html) kept as JSON lines, many to a file, in folders by a checksum of their URL; a page cached again replaces none: the newest is taken when read."""
    kept = pages.select("url", "html", F.current_timestamp().alias("cached_at"), (F.crc32(F.col("url").cast("binary")) % folders).cast("int").alias("folder"))
    kept.repartition("folder").write.mode("append").partitionBy("folder").option("compression", "gzip").json(path)


def cached_pages(spark: SparkSession, path: str, urls: DataFrame | None = None, folders: int = 64) -> DataFrame:
    """url and html of cached pages, the newest of each URL. urls: those alone, and no other folders are opened."""
    rows = spark.read.schema("url string, html string, cached_at timestamp, folder int").json(path)
    if urls is not None:
        rows = rows.join(urls.select("url", (F.crc32(F.col("url").cast("binary")) % folders).cast("int").alias("folder")).distinct(), ["url", "folder"], "left_semi")
    return rows.groupBy("url").agg(F.max_by("html", "cached_at").alias("html"))


def exported_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("product string, characters array<string>").json(path)


def export_links(rows: DataFrame, path: str) -> None:
    """Character links keyed by product, as JSON lines that exported_links reads back."""
    rows.groupBy("product").agg(F.sort_array(F.collect_set("character")).alias("characters")).write.mode("overwrite").json(path)


def resumed(rows: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The next n rows after a cursor, from the start again when the end is reached."""
    after = rows if cursor is None else rows.filter(F.col(key) > cursor)
    before = rows.limit(0) if cursor is None else rows.filter(F.col(key) <= cursor)
    both = after.withColumn("__turn", F.lit(0)).unionByName(before.withColumn("__turn", F.lit(1)))
    return both.orderBy("__turn", key).limit(n).drop("__turn")
