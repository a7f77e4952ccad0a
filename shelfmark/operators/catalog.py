"""Browsing, searching and counting the catalogue."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_PER_PAGE, FACET_HEAD = 60, 60


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a search: scales whole, other words of more than one character."""
    text = " ".join(query.split()).lower()
    scale = re.compile(r"(?<![A-Za-z0-9_])\d{1,2}/\d{1,2}(?![A-Za-z0-9_])")
    words = [w for w in re.findall(r"[^\W_]+", scale.sub(" ", text)) if len(w) > 1]
    return list(dict.fromkeys([*scale.findall(text), *words]))


def matches_query(query: str, text: str = "search_text", name: str = "name") -> Column:
    """All tokens stand in the search text or the name; without tokens the whole query does."""
    tokens = query_tokens(query) or [" ".join(query.split()).lower()]
    return reduce(lambda a, b: a & b, (F.col(text).contains(t) | F.lower(name).contains(t) for t in tokens))


@dataclass
class Filters:
    query: str | None = None
    category: str | None = None
    manufacturer: str | None = None
    series: str | None = None
    franchise: str | None = None
    character: str | None = None
    min_usd: float | None = None
    max_usd: float | None = None


def where(figures: DataFrame, f: Filters, characters: DataFrame | None = None, collabs: DataFrame | None = None) -> DataFrame:
    """Figures that are not superseded and pass all filters. Many-to-many filters are semi-joins, and a franchise
    is the figure's own or one of its collaborations."""
    preds = [F.col("superseded_by").isNull()]
    if f.query and f.query.strip():
        preds.append(matches_query(f.query))
    for column, value in (("category", f.category), ("manufacturer", f.manufacturer), ("series", f.series)):
        if value is not None:
            preds.append(F.col(column) == value)
    if f.min_usd is not None:
        preds.append(F.col("market_value_usd") >= f.min_usd)
    if f.max_usd is not None:
        preds.append(F.col("market_value_usd") <= f.max_usd)
    rows = figures.filter(reduce(lambda a, b: a & b, preds))
    if f.franchise is not None:
        own = rows.filter(F.col("franchise") == f.franchise).select("figure_id")
        other = collabs.filter(F.col("franchise") == f.franchise).select("figure_id") if collabs is not None else own.limit(0)
        rows = rows.join(own.union(other).distinct(), "figure_id", "left_semi")
    if f.character is not None and characters is not None:
        rows = rows.join(characters.filter(F.col("character") == f.character), "figure_id", "left_semi")
    return rows


def order_by(sort: str) -> list[Column]:
    """Named orders, nulls placed by hand and the id last, so that pages are stable."""
    value, last = F.col("market_value_usd"), F.col("figure_id").asc()
    return {
        "trending": [F.col("change_30d_pct").desc_nulls_first(), F.col("volume_90d").desc_nulls_last(), last],
        "value-desc": [value.desc_nulls_last(), last],
        "value-asc": [value.asc_nulls_last(), last],
        "newest": [F.col("release_date").desc_nulls_first(), last],
        "name": [F.col("name").asc(), last],
    }[sort]


def page(figures: DataFrame, sort: str, number: int = 1, per_page: int = 24) -> DataFrame:
    size = max(1, min(per_page, MOST_PER_PAGE))
    return figures.orderBy(*order_by(sort)).offset((max(1, number) - 1) * size).limit(size)


def page_count(figures: DataFrame, per_page: int = 24) -> DataFrame:
    size = max(1, min(per_page, MOST_PER_PAGE))
    return figures.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def quick_search(figures: DataFrame, query: str, k: int = 8) -> DataFrame:
    return where(figures, Filters(query=query)).orderBy(F.col("volume_90d").desc_nulls_last(), "figure_id").limit(k)


def entity_matches(kinds: dict[str, DataFrame], query: str, each: int = 5, k: int = 5) -> DataFrame:
    """The entities of several kinds (name, n) that contain the query: prefixes first, then by number and name."""
    q = query.strip().lower()
    rank = [F.col("prefix").desc(), F.col("n").desc(), F.col("name").asc()]
    parts = []
    for kind, rows in kinds.items():
        found = rows.filter(F.lower("name").contains(q) & F.lit(len(q) >= 2)).select(F.lit(kind).alias("kind"), "name", "n", F.lower("name").startswith(q).alias("prefix"))
        parts.append(found.orderBy(*rank).limit(each))
    return reduce(DataFrame.unionByName, parts).orderBy(*rank, "kind").limit(k).select("kind", "name", "n")


def movers(figures: DataFrame, up: bool = True, least_volume: int = 3, k: int = 6) -> DataFrame:
    change = F.col("change_30d_pct")
    rows = figures.filter((change > 0 if up else change < 0) & (F.col("volume_90d") >= least_volume))
    return rows.orderBy(change.desc() if up else change.asc(), "figure_id").limit(k)


def most_tracked(figures: DataFrame, holdings: DataFrame, k: int = 8) -> DataFrame:
    tracked = holdings.groupBy("figure_id").agg(F.count("*").alias("tracked"))
    return figures.join(tracked, "figure_id").orderBy(F.desc("tracked"), "figure_id").limit(k)


def facet(rows: DataFrame, column: str, head: int = FACET_HEAD) -> DataFrame:
    """Values by falling number; the head is cut before values without rows go."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(head).filter("n > 0")


def relation_facet(own: DataFrame, collabs: DataFrame) -> DataFrame:
    """Figures by franchise: of its own series and of collaborations; a figure in both counts twice."""
    counts = own.groupBy("franchise").agg(F.count("*").alias("n")).unionByName(collabs.groupBy("franchise").agg(F.count("*").alias("n")))
    return counts.groupBy("franchise").agg(F.sum("n").alias("n"))


def top_children(children: DataFrame, parent: str, order: list[Column], k: int) -> DataFrame:
    """The first k children of each parent."""
    return children.withColumn("place", F.row_number().over(W.partitionBy(parent).orderBy(*order))).filter(F.col("place") <= k)


def poll_priority(figures: DataFrame, now, k: int | None = None) -> DataFrame:
    """Figures by demand and by how long ago they were polled; those of no priority are left out."""
    from ..functions.dates import days_between, instant

    since_release = days_between(instant(now), F.col("release_date"))
    recent = F.when(since_release.between(-120, 180), 8).otherwise(0)
    demand = F.col("collection_count") * 10 + F.col("wishlist_count") * 6 + F.least("view_count", F.lit(100)) * 0.5 + recent
    waited = F.when(F.col("last_polled_at").isNull(), 60.0).otherwise(F.greatest(F.lit(0.0), days_between(instant(now), F.col("last_polled_at"))))
    rows = figures.withColumn("demand", demand.cast("double")).withColumn("priority", (demand + 1) * F.least(waited, F.lit(30.0))).filter("priority > 0")
    return rows if k is None else rows.orderBy(F.desc("priority"), "figure_id").limit(k)


def queue_counts(submissions: DataFrame, kinds: list[str]) -> DataFrame:
    """Open submissions by kind, one column each, 0 where there are none."""
    return submissions.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def wishlist(rows: DataFrame) -> DataFrame:
    """A user's wishes in order: the dearest to them first, then the newest."""
    order = W.partitionBy("user_id").orderBy(F.col("priority").desc_nulls_last(), F.desc("added_at"), "figure_id")
    return rows.withColumn("place", F.row_number().over(order))


def import_order(products: DataFrame, k: int) -> DataFrame:
    """What an import takes first: known products, then numbered ones, then the rest."""
    return products.orderBy(F.col("known").desc(), F.col("number").isNotNull().desc(), "product_id").limit(k)


def other_printings(printings: DataFrame) -> DataFrame:
    """Printings that are not the figure's own, in order: originals first, then the newest."""
    rows = printings.filter(F.col("figure_id") != F.col("own_id"))
    order = W.partitionBy("own_id").orderBy((F.col("kind") == "original").desc(), F.col("release_date").desc_nulls_last(), "figure_id")
    return rows.withColumn("place", F.row_number().over(order))


def page_links(at: Column, last: Column, around: int = 2) -> Column:
    """The pages that a page links to: the first, the last, and those around it."""
    near = F.sequence(F.greatest(F.lit(1), at - around), F.least(last, at + around))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1).cast("int"), last.cast("int")), near.cast("array<int>"))))
