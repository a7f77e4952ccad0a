"""Fields read from landed HTML pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, named, unused
from ..functions.dates import parsed_date
from ..functions.text import decoded_entities, height_mm, jan_code, price_jpy, scale_of, squeezed, stripped_tags


LINK = r"""<a\s[^>]*href="([^"]*)\""""


def links(rows: DataFrame, id_col: str, html: str, pattern: str = LINK) -> DataFrame:
    """Distinct links of each page."""
    return rows.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))).alias("link"))


def spec_map(html: Column, label: str, value: str) -> Column:
    """The first value of each label of a list or table; values that hold markup of scripts are dropped."""
    zipped = F.arrays_zip(F.transform(F.regexp_extract_all(html, F.lit(label), F.lit(1)), lambda x: F.regexp_replace(stripped_tags(x), r"[\s:：]+$", "")).alias("k"), F.regexp_extract_all(html, F.lit(value), F.lit(1)).alias("v"))
    pairs = F.filter(F.transform(zipped, lambda z: F.struct(z["k"].alias("key"), stripped_tags(z["v"]).alias("value"))), lambda p: p["key"].isNotNull() & (p["key"] != "") & p["value"].isNotNull() & ~p["value"].rlike(r"[<>{}]"))
    first = lambda pairs: lambda keys: F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_entries(let(pairs, lambda pairs: let(F.transform(pairs, lambda q: q["key"]), first(pairs))))


def definition_list(html: Column, holding: str) -> Column:
    """The map of the first <dl> that holds a label."""
    lists = F.regexp_extract_all(html, F.lit(r"(?is)<dl\b[^>]*>(.*?)</dl>"), F.lit(1))
    own = F.try_element_at(F.filter(lists, lambda x: x.contains(holding)), F.lit(1))
    return spec_map(own, r"(?is)<dt\b[^>]*>(.*?)</dt>", r"(?is)<dd\b[^>]*>(.*?)</dd>")


def spec_table(html: Column) -> Column:
    """The map of table rows of a head and a cell."""
    row = r"(?is)<tr\b[^>]*>\s*<th\b[^>]*>(.*?)</th>\s*<td\b[^>]*>.*?</td>"
    return spec_map(html, row, row.replace("(.*?)</th>", ".*?</th>").replace(">.*?</td>", ">(.*?)</td>"))


def product_fields(rows: DataFrame, html: str = "html", label: str = "Product Name") -> DataFrame:
    """rows with name, price_jpy, scale, height_mm, jan, release_date and precision of a product's list or table."""
    maps = F.struct(definition_list(F.col(html), label).alias("listed"), spec_table(F.col(html)).alias("tabled"))
    specs = let(maps, lambda m: F.coalesce(F.map_zip_with(m["listed"], m["tabled"], lambda k, a, b: F.coalesce(a, b)), m["listed"], m["tabled"]))
    columns, (whole_as, date_as) = [*rows.columns, "specs"], unused([*rows.columns, "specs"], "whole", "date")
    entries = F.array_join(F.transform(F.map_entries("specs"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    first_date = F.coalesce(*(parsed_date(F.element_at("specs", k)) for k in ("Release Date", "Release", "発売日", "発売時期", "発売月")))
    # columns of their own, so that each is made once
    rows = rows.withColumn("specs", specs).withColumns({whole_as: entries, date_as: first_date})
    whole, date = F.col(whole_as), F.col(date_as)
    return rows.select(*map(named, columns), F.element_at("specs", label).alias("name"), price_jpy(whole).alias("price_jpy"), scale_of(whole).alias("scale"), height_mm(whole).alias("height_mm"), jan_code(whole).alias("jan"), date["date"].alias("release_date"), date["precision"].alias("precision"))


AVAILABLE = {"InStock": True, "PreOrder": True, "LimitedAvailability": True, "OutOfStock": False, "SoldOut": False, "Discontinued": False}


def linked_product(html: str | None) -> dict | None:
    """The first Product anywhere in a page's JSON-LD blocks."""
    for raw in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html or ""):
        text = re.sub(r"^\s*(?://)?\s*<!\[CDATA\[|(?://)?\s*\]\]>\s*$", "", raw.strip())
        try:
            todo = [json.loads(text, strict=False)]
        except ValueError:
            continue
        while todo:
            node = todo.pop(0)
            if isinstance(node, dict):
                kind = node.get("@type")
                if kind == "Product" or isinstance(kind, list) and "Product" in kind:
                    return node
                todo += node.values()
            elif isinstance(node, list):
                todo += node
    return None


PRODUCT = "name string, sku string, jan string, brand string, image string, price double, currency string, available boolean"


def product_of(page: str | None) -> list:
    """The fields of PRODUCT of a page's linked data, all null if it has none; availability that is not stated is null."""

    def text(x):
        return x if isinstance(x, str) else None

    p = linked_product(page)
    if p is None:
        return [None] * 8
    offer = p.get("offers") or {}
    offer = (offer[0] if offer else {}) if isinstance(offer, list) else offer
    offer = offer if isinstance(offer, dict) else {}
    brand, image = p.get("brand"), p.get("image")
    image = image[0] if isinstance(image, list) and image else image
    try:
        price = float(offer.get("price"))
    except (TypeError, ValueError):
        price = None
    return [text(p.get("name")), text(p.get("sku")), text(p.get("gtin13")), text(brand.get("name") if isinstance(brand, dict) else brand), text(image.get("url") if isinstance(image, dict) else image), price, text(offer.get("priceCurrency")), AVAILABLE.get(str(offer.get("availability") or "").rsplit("/", 1)[-1])]


def json_ld_products(rows: DataFrame, html: str = "html") -> DataFrame:
    """rows with product, the fields of a page's linked data."""

    @F.pandas_udf(PRODUCT)
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([product_of(page) for page in pages], columns=["name", "sku", "jan", "brand", "image", "price", "currency", "available"])

    return rows.withColumn("product", read(F.col(html)))


def embedded_array(page: str | None, marker: str) -> str | None:
    """The JSON array after a marker: brackets are matched outside strings."""
    at = (page or "").find(marker)
    at = page.find("[", at) if at >= 0 else -1
    if at < 0:
        return None
    depth, quoted, i = 0, False, at
    while i < len(page):
        c = page[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return page[at : i + 1]
        i += 1
    return None


def embedded_variants(rows: DataFrame, html: str = "html", marker: str = "let variantItems = ") -> DataFrame:
    """rows with variants: array of (code, name, price, available) from an array in a page's script."""

    @F.pandas_udf("string")
    def read(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in pages:
            yield page.map(lambda x: embedded_array(x, marker))

    return rows.withColumn("variants", F.from_json(read(F.col(html)), "array<struct<code: string, name: string, price: double, available: boolean>>"))


def data_layer(rows: DataFrame, html: str = "html") -> DataFrame:
    """rows with item (name, price, id, available; null if the JSON is broken) and the order window, written in Japan's time, as UTC."""
    raw = F.regexp_extract(html, r"(?s)dataLayer\.push\((\{.*?\})\);", 1)
    item = F.from_json(raw, "ecommerce struct<items: array<struct<item_id: string, item_name: string, price: double>>>")["ecommerce"]["items"][0]
    window = r"([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})(?:[^0-9]{1,12}([0-9]{1,2}):([0-9]{2}))?"
    stamp = lambda part: F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", *(F.regexp_extract(part, window, i) for i in (1, 2, 3))), F.concat_ws(":", F.when(F.regexp_extract(part, window, 4) == "", "23").otherwise(F.regexp_extract(part, window, 4)), F.when(F.regexp_extract(part, window, 5) == "", "59").otherwise(F.regexp_extract(part, window, 5)))), F.lit("y-M-d H:m")), "Asia/Tokyo")
    span = F.regexp_extract(html, rf"({window}[^<]{{0,20}}[~〜～–-]\s*{window})", 1)
    ends = F.split(span, r"\s*[~〜～–]\s*", 2)
    return rows.select("*", F.struct(item["item_id"].alias("id"), item["item_name"].alias("name"), item["price"].alias("price")).alias("item"), stamp(ends[0]).alias("opens_at"), stamp(F.get(ends, F.lit(1))).alias("closes_at"))


def archive_tiles(rows: DataFrame, html: str = "html") -> DataFrame:
    """The product tiles of listing pages: product_id, number, name, image, classes."""
    tile = r"""(?is)<div class="([^"]*)"[^>]*data-id="([0-9]+)"[^>]*>(.*?)(?=<div class="[^"]*"[^>]*data-id=|$)"""
    found = F.arrays_zip(*(F.regexp_extract_all(html, F.lit(tile), F.lit(i)).alias(n) for i, n in ((1, "classes"), (2, "product_id"), (3, "body"))))
    rows = rows.select("*", F.explode(found).alias("t"))
    body = F.col("t.body")
    return rows.select(F.col("t.product_id").alias("product_id"), F.split("t.classes", r"\s+").alias("classes"), F.regexp_extract(body, r'class="num"[^>]*>\s*([0-9]+(?:-[A-Za-z]+)?)', 1).alias("number"), squeezed(decoded_entities(F.regexp_extract(body, r'alt="([^"]*)"', 1))).alias("name"), F.regexp_extract(body, r'src="([^"]*)"', 1).alias("image"))


def response_verdicts(rows: DataFrame, status: str = "status", body: str = "html") -> DataFrame:
    """rows with verdict: ok, gone or transient."""
    gone = F.col(status).isin(404, 410) | (F.col(status).between(200, 299) & F.lower(body).rlike("page not found|no longer available"))
    verdict = F.when(gone, "gone").when(F.col(status).between(200, 299) & (F.length(body) > 0), "ok").otherwise("transient")
    return rows.withColumn("verdict", verdict)


def checked_verdicts(rows: DataFrame, least: int = 3) -> DataFrame:
    """The verdicts, unless all of several pages are gone: then the site is at fault, and nothing may be removed."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "gone").alias("gone")).first()
    if n.n >= least and n.gone == n.n:
        raise ValueError("every page is gone: the site, not the products, has changed")
    return rows
