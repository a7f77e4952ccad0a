"""The text rules as SQL functions, and the readers of pages as table functions, for queries written in SQL.

    register(spark)
    spark.sql("SELECT page_id, link FROM pages, LATERAL fi_links(html)")
    spark.sql("SELECT fi_tokens(title) FROM titles")

The scalar ones are SQL functions over the same patterns and lists as the columns of ``functions.text``; only Unicode forms, which
Spark has no function for, run in Python. They last as long as the session.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import pages
from . import text as T


def quoted(value: str) -> str:
    """A SQL string literal, in which nothing is escaped."""
    mark = next(m for m in ("'", '"') if m not in value)
    return f"r{mark}{value}{mark}"


def replaced(sql: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(by)})"
    return sql


def listed(values: list[str]) -> str:
    return "array(" + ", ".join(map(quoted, values)) + ")"


def functions() -> dict[str, tuple[str, str, str]]:
    """Name to parameters, type and body, in an order in which each knows those that it calls."""
    apart = replaced(f"fi_nfkc({replaced('fi_nfd(lower(t))', T.ACCENTS)})", *T.APART)
    same = "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in T.SYNONYMS.items()) + ")"
    words = f"split(n, {quoted(T.BETWEEN_WORDS)})"
    # each word with the one before it, since a lambda may not name what comes from Python
    paired = f"arrays_zip({words}, concat(array(CAST(NULL AS STRING)), {words}))"
    unit = f"array_contains({listed(T.UNITS)}, x['0']) AND coalesce(x['1'] rlike '^[0-9]+$', false)"
    kept = f"transform(filter({paired}, x -> x['0'] IS NOT NULL AND NOT ({unit})), x -> x['0'])"
    kept = f"filter({kept}, w -> length(w) > 1 AND NOT array_contains({listed(T.STOPWORDS)}, w))"
    return {
        "fi_normalize": ("t STRING", "STRING", f"trim({replaced(apart, (T.WHITE + '+', ' '))})"),
        "fi_tokens_of": ("n STRING", "ARRAY<STRING>", f"array_distinct(transform({kept}, w -> coalesce(try_element_at({same}, w), w)))"),
        "fi_tokens": ("t STRING", "ARRAY<STRING>", "fi_tokens_of(fi_normalize(t))"),
    }


@F.udtf(returnType="link string")
class Links:
    """Distinct links of a page."""

    def eval(self, html: str):
        for link in dict.fromkeys(re.findall(pages.LINK, html or "")):
            yield (link,)


@F.udtf(returnType=pages.PRODUCT)
class Products:
    """The product in a page's linked data, if there is one."""

    def eval(self, html: str):
        if pages.linked_product(html) is not None:
            yield tuple(pages.product_of(html))


@F.udtf(returnType="code string, name string, price double, available boolean")
class Variants:
    """The variants in an array of a page's script."""

    def eval(self, html: str, marker: str):
        import json

        try:
            found = json.loads(pages.embedded_array(html, marker) or "[]")
        except ValueError:
            found = []
        for x in found:
            if isinstance(x, dict):
                price = x.get("price")
                yield x.get("code"), x.get("name"), float(price) if isinstance(price, int | float) else None, x.get("available")


def register(spark: SparkSession) -> None:
    for name, form in (("fi_nfd", T._nfd), ("fi_nfkc", T._nfkc)):
        spark.udf.register(name, form)
    for name, (parameters, kind, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, table in (("fi_links", Links), ("fi_products", Products), ("fi_variants", Variants)):
        spark.udtf.register(name, table)
