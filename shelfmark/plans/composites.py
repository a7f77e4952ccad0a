"""Queries of the composites: shops, imports, offers, nights, polls, reviews and streams with memory, with their SQL twins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import spread
from ..functions.staging import fresh_path
from ..operators import catalog, fx, match, nightly, reviews, shops
from ..streaming import counters
from . import views as V
from .queries import half_up, query
from .round_trips import DAY_QUOTES, ITEMS, cat, day_quotes, every, items
from .rules import MATCHED, catalogue, listed_titles
from .views import NOW


@query(f"""WITH {ITEMS} SELECT k, CASE k % 8 WHEN 0 THEN 'no name' WHEN 1 THEN 'non-figure category' WHEN 2 THEN 'unknown category' WHEN 3 THEN 'accessory name' WHEN 4 THEN 'no spec table' WHEN 5 THEN 'outfit, not a figure' END AS reason,
    CASE k % 8 WHEN 6 THEN 'NENDOROID' WHEN 7 THEN 'SCALE' END AS category FROM items""")
def archive_classes(spark, d):
    """Archive entries: why they are no figures, in order, or their category."""
    name = every(8, "", F.col("name"), F.col("name"), cat(F.col("name"), " decal set"), F.col("name"))
    classes = F.split(every(8, "hitItem nendoroid", "goods nendoroid", "hitItem other", "hitItem nendoroid", "hitItem scale", "hitItem nendoroid", "hitItem nendoroid", "scale x"), " ")
    spec = every(8, "ABS", "ABS", "ABS", "ABS", F.lit(None).cast("string"), "Polyester", "Polyester, PVC figure", "PVC 1/7")
    got = shops.archive_verdict(name, classes, spec, ["goods"], {"nendoroid": "NENDOROID", "scale": "SCALE"})
    return items(spark, d).select("k", got["reason"].alias("reason"), got["category"].alias("category"))


@query(f"""WITH {ITEMS} SELECT k, CASE k % 8 WHEN 0 THEN 'bonus item' WHEN 1 THEN 'accessory' WHEN 2 THEN 'support unit' WHEN 3 THEN 'no product_type' WHEN 4 THEN 'product_type Book' WHEN 5 THEN 'no price' END AS reason,
    CASE k % 4 WHEN 0 THEN 'MODEL_KIT' WHEN 1 THEN 'TRADING' WHEN 2 THEN 'SCALE' ELSE 'OTHER' END AS category FROM items""")
def store_classes(spark, d):
    title = F.when(F.col("k") % 8 == 1, cat(F.col("name"), " decal set")).otherwise(F.col("name"))
    tags = every(8, F.array(F.lit("new"), F.lit(" Bonus Item ")), F.array(F.lit("new")), F.array(F.lit("Kit_Support-Unit")), F.lit(None).cast("array<string>"))
    kind = every(8, "", "Figure", "Plastic Model", " ", "Book", "Figure", "Figure", "Plastic Model")
    reason = shops.store_verdict(title, tags, kind, F.when(F.col("k") % 8 != 5, F.col("price")), F.col("k") % 8 != 4)
    category = shops.category_of(every(4, "Plastic Model kit", "Trading figure", "Pre-painted", "PVC"), F.lit(None).cast("string"))
    return items(spark, d).select("k", reason.alias("reason"), category.alias("category"))


@query(f"""WITH {ITEMS} SELECT k, CASE k % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS shop,
    CASE k % 4 WHEN 0 THEN 'https://shop.example.com/p/' || k || '?tag=x&n=1' WHEN 1 THEN 'https://www.shop.example.com/p/' || k || '?a=b&tag=x&n=1#top' WHEN 2 THEN 'https://other.example.org/p/' || k ELSE 'https://notshop.example.com/p/' || k END AS url FROM items""")
def shop_links(spark, d):
    """Shops by host, and links with their host's parameters."""
    url = every(4, cat("https://shop.example.com/p/", F.col("k")), cat("https://www.shop.example.com/p/", F.col("k"), "?a=b#top"), cat("https://other.example.org/p/", F.col("k")), cat("https://notshop.example.com/p/", F.col("k")))
    shop = shops.shop_of(url, {"shop.example.com": "first", "other.example.org": "second"})
    return items(spark, d).select("k", shop.alias("shop"), shops.decorated(url, {"shop.example.com": {"tag": "x", "n": "1"}}).alias("url"))


@query(f"""WITH {ITEMS} SELECT k AS product, CASE WHEN k % 6 < 4 THEN k END AS figure_id, CASE k % 6 WHEN 0 THEN 'product_id' WHEN 1 THEN 'line_number' WHEN 2 THEN 'jan' WHEN 3 THEN 'compared' ELSE 'create' END AS by FROM items""")
def imported_products(spark, d):
    """Products of a shop: known by its id, else by number, barcode or name; else new. A name of several figures says nothing."""
    rows = items(spark, d)
    key = lambda n, p: F.when(F.col("k") % 6 == n, cat(p, F.col("k")))
    figures = rows.filter("k % 6 < 5").select(F.col("k").alias("figure_id"), key(0, "i").alias("product_id"), key(1, "n").alias("line_number"), key(2, "j").alias("jan"), F.when(F.col("k") % 6 == 4, F.lit("same name")).otherwise(cat("name ", F.col("k"))).alias("compared"))
    figures = figures.unionByName(rows.limit(0).select(F.col("k").alias("figure_id"), *(F.lit(None).cast("string").alias(c) for c in shops.STEPS)))
    more = spark.createDataFrame([(-1, None, None, None, "same name"), (-2, None, None, None, "same name")], figures.schema)
    products = rows.select(F.col("k").alias("product"), key(0, "i").alias("product_id"), key(1, "n").alias("line_number"), key(2, "j").alias("jan"), F.when(F.col("k") % 6 == 4, F.lit("same name")).when(F.col("k") % 6 == 3, cat("name ", F.col("k"))).otherwise(cat("other ", F.col("k"))).alias("compared"))
    return shops.imported(products, figures.unionByName(more)).select("product", "figure_id", "by")


@query(f"""WITH {ITEMS} SELECT brand AS source, k AS product_id, CASE WHEN k % 4 = 1 THEN price + 1 ELSE price END AS price, CASE WHEN k % 4 = 1 THEN false ELSE true END AS available, k % 4 = 1 AS checked FROM items WHERE k % 4 <> 0""")
def refreshed_shop_offers(spark, d):
    """Offers after their pages were looked at: gone ones are deleted."""
    rows = items(spark, d).select(F.col("brand").alias("source"), F.col("k").alias("product_id"), "price", F.lit(True).alias("available"), F.lit(None).cast("timestamp_ntz").alias("checked_at"))
    verdict = F.when(F.col("product_id") % 4 == 0, "gone").when(F.col("product_id") % 4 == 1, "ok").otherwise("transient")
    answers = rows.filter("product_id % 4 < 3").select("source", "product_id", verdict.alias("verdict"), (F.col("price") + 1).alias("price"), F.lit(False).alias("available"))
    got = shops.refreshed_offers(rows, answers, F.lit(NOW).cast("timestamp_ntz"))
    return got.select("source", "product_id", "price", "available", F.col("checked_at").isNotNull().alias("checked"))


@query(f"""WITH {ITEMS} SELECT 'JAN' AS kind, 'j' || k AS value, CASE WHEN k % 3 = 0 THEN -k ELSE k END AS figure_id FROM items WHERE k % 2 = 0 OR k % 3 = 0""")
def claimed_barcodes(spark, d):
    """Barcodes of variants go to their figures, unless a figure holds them."""
    rows = items(spark, d)
    identifiers = rows.filter("k % 3 = 0").select((-F.col("k")).alias("figure_id"), F.lit("JAN").alias("kind"), cat("j", F.col("k")).alias("value"))
    shop = rows.select(F.col("k").alias("figure_id"), F.lit("s").alias("source"), cat("c", F.col("k")).alias("code"), "price", F.when(F.col("k") % 2 == 0, cat("j", F.col("k"))).alias("jan"), F.lit(1).alias("seen_at"))
    return shops.recorded_variants(shop.limit(0), shop, identifiers)[1]


@query(f"""WITH {ITEMS}, f AS (SELECT DISTINCT CASE WHEN k % 5 = 0 THEN 'Big Saga' WHEN k % 5 = 1 THEN 'held ' || k % 7 ELSE 'Series ' || k END AS name FROM items) SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM f""")
def assigned_franchise_rows(spark, d):
    """Franchises after curated ones took their series: each other series has its own, and empty ones are gone."""
    rows = items(spark, d)
    series = rows.select(cat("Series ", F.col("k")).alias("name"), F.when(F.col("k") % 5 == 1, cat("held ", F.col("k") % 7)).when(F.col("k") % 5 == 0, cat("empty ", F.col("k"))).alias("franchise"))
    curated = rows.filter("k % 5 = 0").select(cat("Series ", F.col("k")).alias("series"), F.lit("Big Saga").alias("franchise")).unionByName(rows.limit(1).select(F.lit("nowhere").alias("series"), F.lit("Big Saga").alias("franchise")))
    return shops.assigned_franchises(series, curated)[1]


@query(f"""WITH m AS ({MATCHED}) SELECT title_id, CASE WHEN figure_id IS NULL THEN NULL WHEN title_id % 16 = 0 THEN figure_id ELSE figure_id + 1 END AS figure_id FROM m""")
def rematch_without_moves(spark, d):
    """A new match applied without its moves: what was wrong goes, what is new comes, what is elsewhere stays there."""
    found = match.best_match(listed_titles(spark, d), catalogue(spark, d))
    before = F.when(F.col("k") % 16 != 0, F.col("k") + 1)
    held = items(spark, d).select(F.col("k").alias("title_id"), before.alias("figure_id"))
    return match.applied_rematch(match.rematch(held, found), moves="none").select("title_id", "figure_id")


def night_of(spark, d) -> dict[str, DataFrame]:
    rows = items(spark, d)
    none = "figure_id long, condition string, day date, min_usd double, median_usd double, avg_usd double, max_usd double, sample_size long, lowest_ask_usd double, ask_min_usd double, ask_median_usd double, ask_max_usd double, ask_count long"
    later = F.lit("2001-12-24").cast("timestamp_ntz")
    figures = rows.select(
        F.col("k").alias("figure_id"), "name", "brand", F.when(F.col("k") % 3 == 0, "PREORDER").otherwise("DELAYED").alias("status"), F.when(F.col("k") % 2 == 0, F.lit("2001-01-01").cast("timestamp_ntz")).otherwise(later).alias("release_date"), F.lit("DAY").alias("precision"),
        "price", F.lit("USD").alias("currency"), F.lit(None).cast("double").alias("msrp_usd"), F.when(F.col("k") % 5 == 0, cat(F.lower("name"), " · ", F.lower("brand"))).alias("search_text"),
    )
    printings = rows.filter("k % 4 = 0").select(F.col("k").alias("printing_id"), F.col("k").alias("figure_id"), F.lit("reissue").alias("kind"), later.alias("release_date"), F.lit("DAY").alias("precision"), F.lit(None).cast("timestamp_ntz").alias("preorder_closes_at"))
    return {
        "sales": V.sales(spark, d), "listings": V.listings(spark, d), "figures": figures, "snapshots": spark.createDataFrame([], none), "printings": printings,
        "reissue_prices": rows.limit(0).select(F.col("k").alias("figure_id"), "price", F.lit("USD").alias("currency")), "rates": spark.createDataFrame([], "currency string, rate_to_usd double"),
    }


@query(f"""WITH {ITEMS} SELECT k AS figure_id, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'RELEASED' WHEN k % 3 = 0 THEN 'PREORDER' ELSE 'DELAYED' END AS status, CASE WHEN k % 4 = 0 THEN DATE '2001-12-25' END AS reissue_due_at,
    CASE WHEN k % 4 = 0 OR (k % 3 = 0 AND k % 2 = 1) THEN {half_up("price")} END AS msrp_usd, k % 5 <> 0 AS changed FROM items""")
def whole_night(spark, d):
    """The figures after a whole night in its order."""
    done = nightly.night(night_of(spark, d), date(2001, 11, 3), NOW, ["name", "brand"])["figures"]
    return done.select("figure_id", "status", "reissue_due_at", "msrp_usd", "changed")


@query("SELECT count(*) AS n, count(DISTINCT l_partkey) AS figures FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-08-06'")
def night_purge(spark, d):
    """Sales that a night leaves: those of its window."""
    kept = nightly.night(night_of(spark, d), date(2001, 11, 3), NOW, ["name"])["sales"]
    return kept.agg(F.count("*").alias("n"), F.count_distinct("figure_id").alias("figures"))


@query(f"""WITH {ITEMS}, c AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT items.k, coalesce(n, 0) AS n, CASE WHEN items.k % 3 = 0 THEN NULL ELSE items.k % 40 END AS days FROM items LEFT JOIN c ON c.k = items.k),
    p AS (SELECT k, days, (n * 10 + 1) * least(coalesce(days, 60), 30) AS priority FROM f WHERE days IS NULL OR days * 24 > 48), t AS (SELECT k FROM p WHERE priority > 0 ORDER BY priority DESC, k LIMIT 25)
    SELECT k AS figure_id, k IN (SELECT k FROM t) OR (k % 3 <> 0 AND k % 40 = 0) AS fresh FROM items""")
def poll_run(spark, d):
    """A run's figures are those of most demand that waited longest; they are marked as polled."""
    tracked = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("collection_count"))
    days = F.when(F.col("k") % 3 != 0, F.col("k") % 40)
    rows = items(spark, d).join(tracked, "k", "left").select(
        F.col("k").alias("figure_id"), F.coalesce("collection_count", F.lit(0)).alias("collection_count"), F.lit(0).alias("wishlist_count"), F.lit(0).alias("view_count"), F.lit("1990-01-01").cast("timestamp_ntz").alias("release_date"),
        (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(days.cast("int"))).alias("last_polled_at"),
    )
    _, after = nightly.polled(rows, NOW, 25, min_age=48)
    return after.select("figure_id", F.coalesce(F.col("last_polled_at") >= F.lit(NOW).cast("timestamp_ntz"), F.lit(False)).alias("fresh"))


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'APPROVED' WHEN o_orderkey % 4 = 1 THEN 'OPEN' WHEN o_orderkey % 4 = 2 THEN 'OPEN' ELSE 'DONE' END AS status, count(*) AS n FROM orders GROUP BY ALL""")
def approved_reports(spark, d):
    """Reports after all were approved: those without a price, and those handled before, stay as they are."""
    reports = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.when(F.col("o_orderkey") % 4 == 3, "DONE").otherwise("OPEN").alias("status"), F.col("o_custkey").alias("figure_id"), F.when(F.col("o_orderkey") % 4 != 1, F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderkey") % 4 == 2, "XXX").otherwise("usd").alias("currency"), F.lit("NEW_SEALED").alias("condition"), F.col("o_orderdate").alias("sold_at"),
    )
    sales = V.sales(spark, d).select("figure_id", F.lit("shop").alias("source"), "external_id", "condition", "amount_usd", "sold_at")
    _, states, _ = reviews.approved_sales(sales, reports, reports.select("report_id"), spark.createDataFrame([], "currency string, day date, rate_to_usd double"), NOW)
    return states.groupBy("status").agg(F.count("*").alias("n"))


LOST = """listings AS (SELECT l_partkey AS figure_id, l_orderkey * 10 + l_linenumber AS listing_id, l_extendedprice AS usd, l_orderkey % 3 = 0 AS off FROM lineitem)"""


@query(f"""WITH {LOST}, a AS (SELECT figure_id, median(usd) AS mid, count(*) AS n FROM listings WHERE NOT off GROUP BY 1 HAVING count(*) >= 3)
    SELECT f.figure_id, CAST(round(CAST(mid AS DECIMAL(20,8)), 2) AS DOUBLE) AS ask_median_usd, coalesce(n, 0) AS ask_listings FROM (SELECT DISTINCT figure_id FROM listings WHERE off) f LEFT JOIN a ON a.figure_id = f.figure_id""")
def asks_after_rejections(spark, d):
    """Asks of the figures that lost a listing."""
    rows = V.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"), F.col("l_partkey").alias("figure_id"), F.lit(0.9).alias("match_score"), F.lit(None).cast("array<string>").alias("rejected"), F.lit("NEW_SEALED").alias("condition"), F.lit(True).alias("is_active"), F.col("l_extendedprice").alias("amount_usd"),
    )
    return reviews.rejected_listings(rows, rows.filter(F.floor(F.col("listing_id") / 10) % 3 == 0).select("listing_id"))[1]


@query(f"WITH {DAY_QUOTES}, d AS (SELECT upper(currency) AS currency, day, CASE WHEN day(day) % 2 = 0 THEN 1.0 ELSE 1 / per_usd END AS rate FROM quotes WHERE per_usd > 0) SELECT currency, count(*) AS days, count(*) FILTER (rate = 1.0) AS held FROM d GROUP BY 1")
def fx_backfill(spark, d):
    """Daily rates that are held stay when a history comes in."""
    quotes = fx.from_day_maps(day_quotes(spark, d))
    held = fx.inverted(quotes).filter(F.day("day") % 2 == 0).withColumn("rate_to_usd", F.lit(1.0))
    daily, _ = fx.backfilled(held, fx.monthly(quotes.limit(0)), quotes)
    return daily.groupBy("currency").agg(F.count("*").alias("days"), F.count_if(F.col("rate_to_usd") == 1.0).alias("held"))


@query("SELECT count(*) AS n, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey % 5 = 0) AS touched FROM lineitem WHERE l_suppkey % 5 <> 0")
def purged_demo_rows(spark, d):
    """Sales without made-up ones, and how many figures have to be rebuilt."""
    sales = V.sales(spark, d).withColumn("external_id", F.when(F.col("source_id") % 5 == 0, cat("demo-", F.col("external_id"))).otherwise(F.col("external_id")))
    kept, _, touched = nightly.without_demo(sales, sales.limit(0))
    return kept.agg(F.count("*").alias("n")).join(touched.agg(F.count("*").alias("touched")), F.lit(True))


@query("SELECT o_custkey AS user_id, o_orderkey AS figure_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def wishlist_order(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("figure_id"), (F.col("o_orderkey") % 4).alias("priority"), F.col("o_orderdate").alias("added_at"))
    return catalog.wishlist(rows).select("user_id", "figure_id", "place")


@query(f"WITH {ITEMS} SELECT k AS product_id FROM items ORDER BY k % 3 = 0 DESC, k % 2 = 0 DESC, k LIMIT 40")
def import_head(spark, d):
    rows = items(spark, d).select(F.col("k").alias("product_id"), (F.col("k") % 3 == 0).alias("known"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("number"))
    return catalog.import_order(rows, 40).select("product_id")


@query(f"""WITH {ITEMS} SELECT brand AS own_id, k AS figure_id, CAST(row_number() OVER (PARTITION BY brand ORDER BY k % 4 = 0 DESC, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 11 END DESC NULLS LAST, k) AS INTEGER) AS place FROM items WHERE k % 9 <> 0""")
def other_printing_order(spark, d):
    rows = items(spark, d).select(F.col("brand").alias("own_id"), F.col("k"), F.when(F.col("k") % 9 == 0, F.col("brand")).otherwise(F.col("k").cast("string")).alias("figure_id"), F.when(F.col("k") % 4 == 0, "original").otherwise("reissue").alias("kind"), F.when(F.col("k") % 5 != 0, F.col("k") % 11).alias("release_date"))
    got = catalog.other_printings(rows.withColumn("figure_id", F.when(F.col("figure_id") == F.col("own_id"), F.col("figure_id")).otherwise(F.lpad(F.col("k").cast("string"), 12, "0"))))
    return got.select("own_id", F.col("k").alias("figure_id"), "place")


@query(f"""WITH {ITEMS}, p AS (SELECT k, 1 + k % 9 AS page FROM items) SELECT k, list_sort(list_distinct(list_concat([1, 9], list_transform(range(greatest(1, page - 2), least(9, page + 2) + 1), lambda x: CAST(x AS INTEGER))))) AS links FROM p""")
def page_link_windows(spark, d):
    return items(spark, d).select("k", catalog.page_links((1 + F.col("k") % 9).cast("int"), F.lit(9)).alias("links"))


@query(f"""WITH {ITEMS} SELECT k, CASE WHEN k % 3 = 0 THEN 'key' || k END AS kid, sha256('c' || k || 'tokenhttps://x') AS answer FROM items""")
def signed_headers(spark, d):
    """Headers of notifications, and what answers a challenge."""
    header = F.base64(F.to_json(F.struct(cat("key", F.col("k")).alias("kid"), F.lit("sig").alias("signature"))).cast("binary"))
    got = T.signed_header(every(3, header, "not base 64!", F.base64(F.lit("[]").cast("binary"))))
    return items(spark, d).select("k", got["kid"].alias("kid"), T.challenge_answer(cat("c", F.col("k")), "token", "https://x").alias("answer"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS denied FROM (SELECT user_id, date_trunc('day', ts) AS day FROM events GROUP BY ALL HAVING count(*) > 2) GROUP BY user_id")
def streamed_denials(spark, d):
    """In how many days each user went over two requests: a stream whose state has timers, with events in any order within two days."""
    landed, out, state = (fresh_path(spark, n) for n in ("landed", "denials", "state"))
    events = V.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # four landings, each with the days of its quarter and some of the days around it, out of order
    shifted = events.withColumn("at", F.unix_seconds("ts") + 3600 * F.pmod(F.hash("user_id", "ts"), F.lit(24)))
    first, last = shifted.agg(F.min("at"), F.max("at")).first()

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(out)

    for k in range(4):
        quarter = F.floor((F.col("at") - first) * 4 / (last - first + 1)) == k
        spread(shifted.filter(quarter)).sortWithinPartitions(F.hash("ts")).drop("at").write.mode("append").parquet(landed)
        # each run goes on from the state of the one before, and takes the whole landing at once, whatever its files
        rows = counters.denied_until(counters.stream_of(spark, landed, events.schema), "user_id", "ts", 2, 24 * 60, "3 days")
        counters.run_available(rows, state, each)
    got = spark.read.schema(rows.schema).parquet(out)
    return got.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("denied"))
