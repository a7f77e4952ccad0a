"""Queries of the readers: rows become pages, feeds or files, and are read back; the SQL twin has the rows.

What is read back is checked against what was written, so each twin says what a reader must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T
from ..functions.columns import spread
from ..functions.staging import fresh_path
from ..operators import fx, hygiene, lifecycle, tables
from ..sources import feeds, pages
from . import views as V
from .queries import half_up, query


def items(spark, d) -> DataFrame:
    """Parts as products: k, name, brand, kind, size, price."""
    return spread(V.table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


ITEMS = "items AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price FROM part)"


def cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def every(n: int, *values) -> Column:
    """One of the values by k modulo n; the last for all further remainders."""
    out = values[-1] if isinstance(values[-1], Column) else F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col("k") % n == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


RELEASE = "make_date(CAST(2000 + k % 10 AS BIGINT), CAST(1 + k % 12 AS BIGINT), CAST(CASE WHEN k % 3 = 0 THEN 15 ELSE 1 + k % 28 END AS BIGINT))"


def release() -> Column:
    return F.make_date(2000 + F.col("k") % 10, 1 + F.col("k") % 12, 1 + F.col("k") % 28)


@query(f"""WITH {ITEMS} SELECT k, name || ' & co' AS name, CAST(floor(price * 10) AS INTEGER) AS price_jpy, '1/' || (size % 8 + 4) AS scale, CAST(size * 5 AS INTEGER) AS height_mm,
    '45' || lpad(CAST(k AS VARCHAR), 11, '0') AS jan, {RELEASE} AS release_date, CASE WHEN k % 3 = 0 THEN 'MONTH' ELSE 'DAY' END AS precision FROM items""")
def product_pages(spark, d):
    rows = items(spark, d)
    day = release()
    date = F.when(F.col("k") % 3 == 0, F.date_format(day, "yyyy年M月")).when(F.col("k") % 3 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "d MMM yyyy"))
    specs = {
        "Product Name": cat("<b>", F.col("name"), "</b> &amp; co"), "Price": cat("¥", F.format_number(F.floor(F.col("price") * 10), 0), " (tax)"), "Scale": cat("1/", F.col("size") % 8 + 4),
        "Height": cat("Approximately height ", F.col("size") * 5, " mm"), "Code": cat("JAN 45", F.lpad(F.col("k").cast("string"), 11, "0")), "Release Date": date,
    }
    listed = cat("<dl class='x'><dt>Other</dt><dd>1</dd></dl><dl>", *(cat(f"<dt>{k}: </dt><dd>", v, "</dd>") for k, v in specs.items()), "</dl>")
    tabled = cat("<table>", *(cat(f"<tr><th>{k}</th> <td>", v, "</td></tr>") for k, v in specs.items()), "</table>")
    html = F.when(F.col("k") % 2 == 0, listed).otherwise(tabled)
    return pages.product_fields(rows.select("k", html.alias("html"))).select("k", "name", "price_jpy", "scale", "height_mm", "jan", "release_date", "precision")


@query(f"""WITH {ITEMS} SELECT k, name, 'S' || k AS sku, CASE WHEN k % 4 = 3 THEN NULL ELSE '49' || lpad(CAST(k AS VARCHAR), 11, '0') END AS jan, brand, CASE WHEN k % 5 = 4 THEN NULL ELSE price END AS price, 'JPY' AS currency,
    CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS available FROM items""")
def linked_data_products(spark, d):
    state = every(4, "https://schema.org/InStock", "http://schema.org/SoldOut", "PreOrder", "Unknown")
    offer = F.struct(F.when(F.col("k") % 5 != 4, F.col("price").cast("string")).otherwise("call").alias("price"), F.lit("JPY").alias("priceCurrency"), state.alias("availability"))
    common = [F.lit("Product").alias("@type"), "name", cat("S", F.col("k")).alias("sku"), F.when(F.col("k") % 4 != 3, cat("49", F.lpad(F.col("k").cast("string"), 11, "0"))).alias("gtin13")]
    flat = F.to_json(F.struct(*common, "brand", offer.alias("offers")))
    nested = F.to_json(F.struct(F.array(F.struct(F.lit("WebPage").alias("@type"), F.struct(*common, F.struct(F.lit("Brand").alias("@type"), F.col("brand").alias("name")).alias("brand"), F.array(offer).alias("offers")).alias("mainEntity"))).alias("@graph")))
    block = '<script type="application/ld+json">'
    html = cat("<html>", f"{block}not json</script>", block, every(2, flat, cat("//<![CDATA[\n", nested, "\n//]]>")), "</script></html>")
    p = F.col("product")
    return pages.json_ld_products(items(spark, d).select("k", html.alias("html"))).select("k", *(p[c].alias(c) for c in ("name", "sku", "jan", "brand", "price", "currency", "available")))


@query(f"""WITH {ITEMS} SELECT k, CAST(k AS VARCHAR) AS id, name, price, strftime(make_timestamp(CAST(2001 + k % 5 AS BIGINT), CAST(1 + k % 12 AS BIGINT), 10, 12, 30, 0) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS opens_at,
    strftime(make_timestamp(CAST(2001 + k % 5 AS BIGINT), CAST(1 + k % 12 AS BIGINT), 20, 23, 59, 0) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS closes_at FROM items""")
def store_pages(spark, d):
    item = F.struct(F.col("k").cast("string").alias("item_id"), F.col("name").alias("item_name"), "price")
    extra = F.when(F.col("k") % 50 == 0, F.repeat(F.lit("long "), 6000))
    data = F.to_json(F.struct(extra.alias("more"), F.struct(F.array(item).alias("items")).alias("ecommerce")))
    month = cat(2001 + F.col("k") % 5, "年", 1 + F.col("k") % 12)
    slash = F.regexp_replace(month, "年", "/")
    html = cat("<script>dataLayer.push(", data, ");</script><p>受注期間 ", slash, "/10 12:30 ～ ", slash, "/20</p>")
    got = pages.data_layer(items(spark, d).select("k", html.alias("html")))
    return got.select("k", "item.*", *(F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("opens_at", "closes_at")))


@query(f"""WITH {ITEMS} SELECT k, k || '-' || i AS code, name || ' [' || i || '] "x"' AS name, price + i AS price, i = 1 AS available FROM items, (VALUES (1), (2)) t(i)""")
def embedded_variant_rows(spark, d):
    variant = lambda i: F.struct(cat(F.col("k"), f"-{i}").alias("code"), cat(F.col("name"), f' [{i}] "x"').alias("name"), (F.col("price") + i).alias("price"), F.lit(i == 1).alias("available"))
    html = cat("<script>let other = [1]; let variantItems = ", F.to_json(F.array(variant(1), variant(2))), "; let more = [2];</script>")
    return pages.embedded_variants(items(spark, d).select("k", html.alias("html"))).select("k", F.inline("variants"))


@query(f"""WITH {ITEMS} SELECT CAST(k AS VARCHAR) AS product_id, ['hitItem', lower(kind)] AS classes, k || CASE WHEN k % 2 = 0 THEN '-DX' ELSE '' END AS number, name || ' & co' AS name, '/i/' || k || '.jpg' AS image FROM items""")
def archive_tile_rows(spark, d):
    tile = cat('<div class="hitItem ', F.lower("kind"), '" data-id="', F.col("k"), '"><img src="/i/', F.col("k"), '.jpg" alt=" ', F.col("name"), ' &amp; co"><span class="num"> ', F.col("k"), F.when(F.col("k") % 2 == 0, "-DX").otherwise(""), "</span></div>")
    html = items(spark, d).select("brand", F.floor(F.col("k") / 100).alias("page"), "k", tile.alias("tile")).groupBy("brand", "page").agg(F.sort_array(F.collect_list(F.struct("k", "tile"))).alias("t"))
    return pages.archive_tiles(html.select(cat("<body>", F.array_join("t.tile", "\n"), "</body>").alias("html")))


@query(f"WITH {ITEMS} SELECT 'g' || k AS external_id, name AS title, CASE WHEN k % 3 = 0 THEN price + 10 ELSE price END AS amount, 'JPY' AS currency, '/t/' || k AS image_url, k % 2 = 1 AS available FROM items WHERE k % 7 <> 0")
def second_market_rows(spark, d):
    price = F.when(F.col("k") % 7 != 0, F.col("price")).otherwise(0.0)
    raw = F.to_json(F.struct(cat("g", F.col("k")).alias("gcode"), F.col("name").alias("gname"), price.alias("price"), F.when((F.col("k") % 3 == 0) & (F.col("k") % 7 != 0), F.col("price") + 10).alias("c_price_taxed"), cat("/t/", F.col("k")).alias("thumb_url"), (F.col("k") % 2).cast("int").alias("instock_flg")))
    return feeds.second_market_items(items(spark, d).select(raw.alias("raw")), "raw")


@query(f"""WITH {ITEMS}, shops AS (SELECT *, 'h' || k AS handle FROM items) SELECT k AS product_id, handle, name AS title, brand AS vendor, kind AS product_type, ['figure', kind] AS tags, price, k % 2 = 0 AS available,
    '45' || lpad(CAST(k AS VARCHAR), 11, '0') AS jan, '/i/' || k AS image_url FROM shops""")
def shop_feed_rows(spark, d):
    variant = F.struct(F.col("k").alias("id"), cat("s", F.col("k")).alias("sku"), F.col("price").cast("string").alias("price"), (F.col("k") % 2 == 0).alias("available"), cat("45", F.lpad(F.col("k").cast("string"), 11, "0")).alias("barcode"))
    product = F.struct(F.col("k").alias("id"), cat("h", F.col("k")).alias("handle"), F.col("name").alias("title"), F.col("brand").alias("vendor"), F.col("kind").alias("product_type"), F.array(F.lit("figure"), F.col("kind")).alias("tags"), F.array(variant).alias("variants"), F.array(F.struct(cat("/i/", F.col("k")).alias("src"))).alias("images"))
    raw = items(spark, d).withColumn("page", F.floor(F.col("k") / 50)).groupBy("page").agg(F.to_json(F.struct(F.collect_list(product).alias("products"))).alias("raw"))
    return feeds.shop_products(raw, "raw")


def day_quotes(spark, d) -> DataFrame:
    """A row for each day: day (string) and rates (currency to units per dollar)."""
    rows = V.table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("currency")).agg(F.max("value").alias("q"))
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("currency", "q")))).alias("rates"))


DAY_QUOTES = "quotes AS (SELECT CAST(ts AS DATE) AS day, event_type AS currency, max(value) AS per_usd FROM events GROUP BY ALL)"


@query(f"WITH {DAY_QUOTES} SELECT day, currency, per_usd FROM quotes")
def fx_history_feed(spark, d):
    raw = day_quotes(spark, d).select(F.to_json(F.struct(F.create_map("day", "rates").alias("rates"))).alias("raw"))
    return feeds.rates_from_json(raw, "raw")


@query(f"WITH {DAY_QUOTES} SELECT upper(currency) AS currency, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS days, {half_up('min(1 / per_usd)')} AS least FROM quotes WHERE per_usd > 0 GROUP BY ALL")
def fx_day_maps(spark, d):
    """Maps of days as rows, inverted; the least of each month stands for all."""
    rates = fx.inverted(fx.from_day_maps(day_quotes(spark, d)))
    month = F.trunc("day", "MM").alias("month")
    return rates.groupBy("currency", month).agg(F.count("*").alias("days"), (F.floor(F.min("rate_to_usd") * 100 + 0.5) / 100).alias("least"))


@query("SELECT upper(event_type) AS currency, 1 / max(value) AS rate_to_usd FROM events GROUP BY ALL HAVING max(value) > 0")
def fx_spot_feed(spark, d):
    rows = V.table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("q"))
    raw = rows.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("event_type", "q"))).alias("rates"))).alias("raw"))
    return feeds.spot_from_json(raw, "raw")


@query(f"""WITH {ITEMS} SELECT k, CASE k % 5 WHEN 3 THEN 'plain ' || name ELSE name END AS name, CASE k % 5 WHEN 0 THEN '初音ミク' WHEN 1 THEN 'ミク(冬)' ELSE NULL END AS name_ja,
    name AS read_name, CASE WHEN k % 2 = 0 THEN 'みく' END AS reading FROM items""")
def japanese_name_splits(spark, d):
    raw = every(5, cat(F.col("name"), "（初音ミク）"), cat(F.col("name"), " (ミク(冬))"), cat(F.col("name"), "（初音ミ"), cat("plain ", F.col("name")), cat(F.col("name"), " -"))
    said = F.when(F.col("k") % 2 == 0, cat(F.col("name"), " （みく）")).otherwise(F.col("name"))
    got, read = names.split_japanese(raw), names.split_reading(said)
    return items(spark, d).select("k", got["name"].alias("name"), got["name_ja"].alias("name_ja"), read["name"].alias("read_name"), read["reading"].alias("reading"))


@query(f"""WITH {ITEMS} SELECT k, CASE WHEN k BETWEEN 10 AND 9999 AND k % 4 < 2 THEN CAST(k AS VARCHAR) END AS number, k % 3 < 2 AS web, k % 3 = 0 AS https FROM items""")
def release_links(spark, d):
    url = cat(every(3, "https://", "http://", "ftp://"), "shop.example.com/", every(4, "nendoroid-", "figma-no-", "scale-", "x/"), F.col("k"), ".html")
    return items(spark, d).select("k", names.release_in_slug(url).alias("number"), T.is_web(url).alias("web"), T.is_https(url).alias("https"))


@query("SELECT CAST(l_partkey AS VARCHAR) AS product, list_sort(list(DISTINCT 'c' || l_suppkey)) AS characters FROM lineitem GROUP BY ALL")
def exported_character_links(spark, d):
    """Links written as JSON lines and read back."""
    path = fresh_path(spark, "links")
    rows = V.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("product"), cat("c", F.col("l_suppkey")).alias("character"))
    feeds.export_links(rows, path)
    return feeds.exported_links(spark, path)


@query("SELECT CAST(page_id AS VARCHAR) AS url, length(html) AS chars, sha256(html) AS digest FROM pages WHERE html IS NOT NULL")
def cached_pages(spark, d):
    """Pages cached in files of many, half of them twice, and read back by URL."""
    folder = fresh_path(spark, "pages")
    rows = V.table(spark, d, "pages").filter("html IS NOT NULL").select(F.col("page_id").cast("string").alias("url"), "html", "page_id")
    feeds.cache_pages(rows.filter("page_id % 2 = 0").withColumn("html", F.lit("an older page")), folder)
    feeds.cache_pages(rows, folder)
    got = feeds.cached_pages(spark, folder, rows.select("url"))
    return got.select("url", F.length("html").cast("long").alias("chars"), F.sha2("html", 256).alias("digest"))


@query("SELECT o_orderkey AS k, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def resumed_scan(spark, d):
    """The next rows after a cursor."""
    return feeds.resumed(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), "k", 100, 50)


ORDERS = "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS total FROM orders"


def order_versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as held, without some, and as they come: some dearer, some gone."""
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return rows.filter("k % 5 <> 0"), rows.filter("k % 7 <> 0").withColumn("total", F.col("total") + F.when(F.col("k") % 3 == 0, 1.0).otherwise(0.0))


VERSIONS = f"held AS (SELECT * FROM ({ORDERS}) WHERE k % 5 <> 0), came AS (SELECT k, status, total + CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END AS total FROM ({ORDERS}) WHERE k % 7 <> 0)"


@query(f"""WITH {VERSIONS} SELECT CASE WHEN held.k IS NULL THEN 'insert' WHEN came.k IS NULL THEN 'delete' ELSE 'update' END AS action, coalesce(held.k, came.k) AS k, came.status, came.total
    FROM held FULL JOIN came ON held.k = came.k WHERE held.k IS NULL OR came.k IS NULL OR held.total <> came.total""")
def planned_changes(spark, d):
    """What a run would change, before it is applied."""
    old, new = order_versions(spark, d)
    return tables.planned(old, new, ["k"])


@query(f"WITH {VERSIONS} SELECT * FROM came")
def applied_changes(spark, d):
    old, new = order_versions(spark, d)
    return tables.applied(old, tables.planned(old, new, ["k"]), ["k"])


@query("""WITH c AS (SELECT * FROM customer WHERE c_custkey % 4 <> 0) SELECT 'customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))""")
def replicated_tables(spark, d):
    """Tables copied with parents first, without rows whose parent is not there."""
    held = {
        "customer": V.table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("customer")),
        "orders": V.table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer")),
        "lineitem": V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), "l_linenumber"),
    }
    out = tables.replicated(held, [("orders", "customer", "customer"), ("lineitem", "order", "orders")], ["customer", "orders", "lineitem"])
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in out.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"SELECT true AS kept, count(*) AS n FROM ({ORDERS}) WHERE total >= 100000 UNION ALL SELECT false, count(*) FROM ({ORDERS}) WHERE total < 100000")
def backup_before_delete(spark, d):
    """Rows that go are in a backup first."""
    path = fresh_path(spark, "backup")
    rows = V.table(spark, d, "orders")
    stay = tables.backed_up(rows, F.col("o_totalprice") < 100000, path)
    count = lambda x, kept: x.agg(F.count("*").alias("n")).select(F.lit(kept).alias("kept"), "n")
    return count(stay, True).unionByName(count(spark.read.parquet(path), False))


@query(f"WITH {ITEMS} SELECT k, name, 'c' || i AS character FROM items, (VALUES (1), (2), (3)) t(i)")
def zipped_arrays(spark, d):
    """Parallel arrays as rows."""
    rows = items(spark, d).select("k", F.array_repeat("name", 3).alias("name"), F.array(*(F.lit(f"c{i}") for i in (1, 2, 3))).alias("character"))
    return tables.zipped(rows, ["name", "character"], ["k"])


@query(f"""WITH {ITEMS}, p AS (SELECT *, coalesce(CASE WHEN k % 3 = 0 THEN price END, CASE WHEN k % 2 = 0 THEN price / 2 END) AS p, k % 4 <> 0 AS pending FROM items)
    SELECT k AS figure_id, CASE WHEN NOT pending THEN NULL WHEN p IS NULL THEN 1.0 ELSE {half_up("p")} END AS new_msrp_usd,
           CASE WHEN NOT pending THEN 'clear' WHEN p IS NULL THEN 'keep' ELSE 'set' END AS action FROM p""")
def msrp_in_dollars(spark, d):
    """Retail prices in dollars; a reissue's price comes first. All are dollars here; rates are told by fx_spot."""
    rows = items(spark, d).select(F.col("k").alias("figure_id"), (F.col("k") % 4 != 0).alias("pending"), F.when(F.col("k") % 2 == 0, F.col("price") / 2).alias("price"), F.lit("usd").alias("currency"), F.lit(1.0).alias("msrp_usd"))
    reissues = items(spark, d).filter("k % 3 = 0").select(F.col("k").alias("figure_id"), "price", F.lit("USD").alias("currency"))
    return lifecycle.msrp_in_usd(rows, reissues, spark.createDataFrame([], "currency string, rate_to_usd double"))


@query(f"""WITH {ITEMS} SELECT 'p' || k AS product_id, k AS figure_id, CASE k % 3 WHEN 0 THEN 'jan' WHEN 1 THEN 'name' ELSE 'specs' END AS by FROM items""")
def linked_shop_products(spark, d):
    """Products of a shop linked with figures by barcode, by Japanese name and maker, or by specification."""
    rows = items(spark, d)
    jan, ja = cat("45", F.lpad(F.col("k").cast("string"), 11, "0")), cat("名", F.col("k"))
    spec = [F.col("brand").alias("maker"), F.lit("1/7").alias("scale"), F.col("k").cast("int").alias("height_mm"), F.lit("2001-05-06").cast("date").alias("release_date")]
    figures = rows.select(F.col("k").alias("figure_id"), jan.alias("jan"), ja.alias("name_ja"), *spec)
    products = rows.select(cat("p", F.col("k")).alias("product_id"), F.when(F.col("k") % 3 == 0, jan).alias("jan"), F.when(F.col("k") % 3 == 1, cat("名 ", F.col("k"))).alias("name_ja"), *spec)
    return hygiene.linked_products(products, figures).select("product_id", "figure_id", "by")
