"""One query for each part of the operator inventory, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, semantics
from ..functions import text as T
from ..functions.columns import spread
from ..operators import catalog, detail, fx, hygiene, lifecycle, match, rollup, tables, value
from ..sources import feeds, pages
from . import views as V
from .views import ASKS, BRAND_SALES, FIGURES, LISTINGS, NOW, SALES, STATS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def half_up(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def stats(spark: SparkSession, d: str) -> DataFrame:
    return rollup.figure_stats(V.sales(spark, d), NOW)


DAILY = f"SELECT figure_id, condition, CAST(sold_at AS DATE) AS day, {half_up('min(amount_usd)')} AS min_usd, {half_up('median(amount_usd)')} AS median_usd, {half_up('CAST(sum(CAST(amount_usd AS DECIMAL(20,6))) AS DOUBLE) / count(*)')} AS avg_usd, {half_up('max(amount_usd)')} AS max_usd, count(*) AS sample_size FROM brand_sales WHERE condition IN ('NEW_SEALED', 'USED_COMPLETE') GROUP BY ALL"


@query(f"WITH {BRAND_SALES} {DAILY}")
def daily_sold_rollup(spark, d):
    return rollup.daily_sold(V.brand_sales(spark, d))


@query(f"WITH {BRAND_SALES} SELECT * FROM ({DAILY}) WHERE day = DATE '2000-06-15'")
def daily_sold_one_day(spark, d):
    return rollup.daily_sold(V.brand_sales(spark, d), date(2000, 6, 15))


@query(f"WITH {LISTINGS} SELECT figure_id, condition, min(amount_usd) AS lowest_ask_usd FROM listings WHERE is_active GROUP BY ALL")
def lowest_ask(spark, d):
    return rollup.lowest_ask(V.listings(spark, d))


@query(f"WITH {SALES}, {LISTINGS}, s AS (SELECT figure_id, condition, CAST(sold_at AS DATE) AS day, count(*) AS sample_size FROM sales WHERE condition IN ('NEW_SEALED', 'USED_COMPLETE') AND CAST(sold_at AS DATE) = DATE '2001-06-15' GROUP BY ALL), a AS (SELECT figure_id, condition, min(amount_usd) AS lowest_ask_usd FROM listings WHERE is_active GROUP BY ALL) SELECT s.*, lowest_ask_usd FROM s LEFT JOIN a USING (figure_id, condition)")
def sold_with_lowest_ask(spark, d):
    sold = rollup.daily_sold(V.sales(spark, d), date(2001, 6, 15)).select("figure_id", "condition", "day", "sample_size")
    return rollup.with_lowest_ask(sold, V.listings(spark, d))


ASK_SNAPSHOT = "SELECT figure_id, 'NEW_SEALED' AS condition, DATE '2001-11-04' AS day, CAST(round(CAST(min(amount_usd) AS DECIMAL(20,8)), 2) AS DOUBLE) AS ask_min_usd, CAST(round(CAST(median(amount_usd) AS DECIMAL(20,8)), 2) AS DOUBLE) AS ask_median_usd, CAST(round(CAST(max(amount_usd) AS DECIMAL(20,8)), 2) AS DOUBLE) AS ask_max_usd, count(*) AS ask_count FROM listings WHERE is_active AND condition = 'NEW_SEALED' AND match_score >= 0.72 GROUP BY figure_id HAVING count(*) >= 3"


@query(f"WITH {LISTINGS} {ASK_SNAPSHOT}")
def ask_snapshot(spark, d):
    return rollup.ask_snapshot(V.listings(spark, d), NOW.date())


@query(f"WITH {LISTINGS}, {ASKS} SELECT p_partkey AS figure_id, ask_median_usd, coalesce(ask_listings, 0) AS ask_listings FROM part LEFT JOIN asks ON figure_id = p_partkey")
def ask_median_all_figures(spark, d):
    return rollup.ask_medians(V.figures(spark, d), V.listings(spark, d))


@query(f"WITH {SALES}, {STATS} SELECT * FROM stats")
def figure_stats(spark, d):
    return stats(spark, d)


@query(f"WITH {SALES}, {STATS} SELECT p_partkey AS figure_id, market_value_usd, change_30d_pct, coalesce(volume_90d, 0) AS volume_90d FROM part LEFT JOIN stats ON figure_id = p_partkey")
def figure_stats_all(spark, d):
    return rollup.with_figure_stats(V.figures(spark, d), V.sales(spark, d), NOW)


SOLD = f"sold AS (SELECT figure_id, condition, CAST(sold_at AS DATE) AS day, {half_up('min(amount_usd)')} AS min_usd, {half_up('median(amount_usd)')} AS median_usd, {half_up('max(amount_usd)')} AS max_usd, count(*) AS sample_size FROM sales WHERE condition IN ('NEW_SEALED', 'USED_COMPLETE') GROUP BY ALL)"


@query(f"WITH {SALES}, {LISTINGS}, {SOLD}, s AS (SELECT figure_id, min(min_usd) AS all_time_low, max(max_usd) AS all_time_high, CAST(sum(sample_size) AS BIGINT) AS total_sales, max(day) AS last_day, arg_max(median_usd, {{'d': day, 'c': condition}}) AS last_median_usd FROM sold GROUP BY figure_id), c AS (SELECT figure_id, min(amount_usd) AS cheapest_usd FROM listings WHERE is_active GROUP BY figure_id) SELECT s.*, cheapest_usd FROM s LEFT JOIN c USING (figure_id)")
def all_time_stats(spark, d):
    return rollup.all_time_stats(rollup.daily_sold(V.sales(spark, d)), V.listings(spark, d))


HISTORY = f"WITH {SALES}, {LISTINGS}, {SOLD}, ask AS ({ASK_SNAPSHOT}), h AS (SELECT figure_id, condition, day, CASE WHEN median_usd IS NOT NULL THEN median_usd ELSE ask_median_usd END AS median, CASE WHEN median_usd IS NOT NULL THEN min_usd ELSE ask_min_usd END AS low, CASE WHEN median_usd IS NOT NULL THEN max_usd ELSE ask_max_usd END AS high, coalesce(sample_size, ask_count, 0) AS volume, CASE WHEN median_usd IS NOT NULL THEN 'sold' ELSE 'asking' END AS basis FROM sold FULL JOIN ask USING (figure_id, condition, day))"


@query(f"{HISTORY} SELECT * FROM h")
def price_history(spark, d):
    return rollup.price_history(rollup.daily_sold(V.sales(spark, d)), rollup.ask_snapshot(V.listings(spark, d), NOW.date()))


@query(f"{HISTORY}, e AS (SELECT figure_id, min(least(low, median)) AS lo, max(greatest(high, median)) AS hi FROM h GROUP BY figure_id) SELECT figure_id, round(lo - greatest((hi - lo) * 0.12, 2), 4) AS lo, round(hi + greatest((hi - lo) * 0.12, 2), 4) AS hi FROM e")
def chart_extent(spark, d):
    got = rollup.chart_extent(price_history(spark, d))
    return got.select("figure_id", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("SELECT p_brand, o_month, volume, round(change_pct, 6) AS change_pct, round(moving, 4) AS moving FROM (SELECT *, (mid - lag(mid) OVER w) / lag(mid) OVER w * 100 AS change_pct, avg(mid) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving FROM (SELECT p_brand, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS o_month, count(*) AS volume, median(l_extendedprice) AS mid FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) WINDOW w AS (PARTITION BY p_brand ORDER BY o_month))")
def period_change(spark, d):
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    month = rows.groupBy("p_brand", dates.month_start(F.col("l_shipdate")).alias("o_month")).agg(F.count("*").alias("volume"), F.median("l_extendedprice").alias("mid"))
    w = W.partitionBy("p_brand").orderBy("o_month")
    change = (F.col("mid") - F.lag("mid").over(w)) / F.lag("mid").over(w) * 100
    return month.select("p_brand", "o_month", "volume", F.round(change, 6).alias("change_pct"), F.round(F.avg("mid").over(w.rowsBetween(-2, 0)), 4).alias("moving"))


def valued(spark, d) -> DataFrame:
    base = V.figures(spark, d).withColumn("release_date", F.when(F.col("figure_id") % 7 == 0, F.lit("2002-03-15").cast("timestamp_ntz"))).withColumn("reissue_due_at", F.when(F.col("figure_id") % 11 == 0, F.lit("2002-01-01").cast("timestamp_ntz")))
    return value.figure_value(base.join(stats(spark, d), "figure_id", "left").join(rollup.ask_medians(V.figures(spark, d), V.listings(spark, d)), "figure_id", "left"), NOW)


VALUED = f"""{SALES}, {STATS}, {LISTINGS}, {ASKS}, {FIGURES}, v0 AS (SELECT f.*, market_value_usd, volume_90d, change_30d_pct, ask_median_usd, coalesce(ask_listings, 0) AS ask_listings, f.figure_id % 7 = 0 AS unreleased, f.figure_id % 11 = 0 AS reissue_pending
    FROM figures f LEFT JOIN stats s ON s.figure_id = f.figure_id LEFT JOIN asks a ON a.figure_id = f.figure_id),
    v1 AS (SELECT *, CASE WHEN market_value_usd IS NOT NULL THEN 'sold' WHEN unreleased OR reissue_pending THEN 'msrp' WHEN ask_median_usd IS NOT NULL THEN 'asking' END AS basis FROM v0),
    v AS (SELECT *, CASE basis WHEN 'sold' THEN market_value_usd WHEN 'msrp' THEN msrp_usd WHEN 'asking' THEN ask_median_usd END AS amount_usd FROM v1)"""


@query(f"WITH {VALUED} SELECT figure_id, amount_usd, basis, CASE WHEN basis = 'asking' THEN ask_listings WHEN basis IS NOT NULL THEN 0 END AS listings, CASE WHEN basis = 'msrp' THEN NOT unreleased END AS reissue FROM v")
def figure_value(spark, d):
    return valued(spark, d).select("figure_id", "amount_usd", "basis", F.col("listings").cast("long").alias("listings"), "reissue")


def holdings(spark, d) -> DataFrame:
    rows = V.table(spark, d, "orders").join(V.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("figure_id"), F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_extendedprice")).alias("paid_usd"))
    return own.join(valued(spark, d).select("figure_id", "amount_usd", "basis"), "figure_id", "left")


@query(f"""WITH {VALUED}, h AS (SELECT o_custkey AS user_id, CAST(l_quantity AS BIGINT) AS q, CAST(CASE WHEN l_orderkey % 3 <> 0 THEN l_extendedprice END AS DECIMAL(38,6)) AS paid, CAST(amount_usd AS DECIMAL(38,6)) AS val, basis
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN v ON v.figure_id = l_partkey),
    g AS (SELECT user_id, CAST(sum(q) AS BIGINT) AS item_count, count(*) AS unique_figures, CAST(coalesce(sum(val * q), 0) AS DOUBLE) AS value, CAST(coalesce(sum(paid * q), 0) AS DOUBLE) AS paid,
    CAST(coalesce(sum(val * q) FILTER (paid IS NOT NULL AND val IS NOT NULL), 0) AS DOUBLE) AS cv, CAST(coalesce(sum(paid * q) FILTER (paid IS NOT NULL AND val IS NOT NULL), 0) AS DOUBLE) AS cp,
    CAST(coalesce(sum(q) FILTER (basis = 'sold'), 0) AS BIGINT) AS from_sold, CAST(coalesce(sum(q) FILTER (basis = 'asking'), 0) AS BIGINT) AS from_asking, CAST(coalesce(sum(q) FILTER (basis = 'msrp'), 0) AS BIGINT) AS from_msrp,
    CAST(coalesce(sum(q) FILTER (val IS NULL), 0) AS BIGINT) AS items_without_value, CAST(coalesce(sum(q) FILTER (paid IS NULL), 0) AS BIGINT) AS items_without_cost FROM h GROUP BY user_id)
    SELECT user_id, item_count, unique_figures, {half_up('value')} AS market_value_usd, CASE WHEN greatest(from_sold, from_asking, from_msrp) = 0 THEN NULL WHEN from_sold = greatest(from_sold, from_asking, from_msrp) THEN 'sold' WHEN from_asking = greatest(from_sold, from_asking, from_msrp) THEN 'asking' ELSE 'msrp' END AS value_basis,
    from_sold, from_asking, from_msrp, items_without_value, items_without_cost, {half_up('paid')} AS paid_usd, {half_up('cv - cp')} AS gain_usd, CASE WHEN cp > 0 THEN {half_up('(cv - cp) / cp * 100')} END AS gain_pct FROM g""")
def portfolio_totals(spark, d):
    return value.portfolio_totals(holdings(spark, d))


@query(f"""WITH {SALES}, {FIGURES}, r AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY sold_at DESC, amount_usd) AS i FROM sales WHERE sold_at >= TIMESTAMP '2000-11-04'), m AS (SELECT figure_id, median(amount_usd) AS median_usd, count(*) AS n FROM r WHERE i <= 500 GROUP BY figure_id),
    k AS (SELECT f.figure_id, CASE WHEN n >= 3 THEN 'sales' ELSE 'msrp' END AS kind, median_usd, msrp_usd FROM figures f LEFT JOIN m USING (figure_id)), x AS (SELECT external_id, amount_usd AS amount, k.* FROM sales JOIN k USING (figure_id)),
    y AS (SELECT external_id, figure_id, amount, kind, CASE WHEN kind = 'sales' AND amount < median_usd * 0.25 THEN 'below median' WHEN kind = 'sales' AND amount > median_usd * 4 THEN 'above median' WHEN kind = 'msrp' AND (amount < msrp_usd * 0.2 OR amount > msrp_usd * 10) THEN 'far from retail' END AS reason FROM x)
    SELECT *, CASE WHEN reason IS NULL THEN 'APPROVED' ELSE 'PENDING_REVIEW' END AS status FROM y""")
def screen_sales(spark, d):
    reference = value.reference_prices(V.sales(spark, d), V.figures(spark, d), NOW)
    reports = V.sales(spark, d).select("external_id", "figure_id", F.col("amount_usd").alias("amount")).join(reference, "figure_id")
    return value.screen(reports).select("external_id", "figure_id", "amount", "kind", "reason", "status")


@query("SELECT event_id, value, CASE WHEN value < 0.5 THEN 'amount: too low' WHEN value > 100000 THEN 'amount: too high' WHEN ts > TIMESTAMP '2024-01-21' THEN 'sold_at: in the future' WHEN ts < TIMESTAMP '2014-01-20' THEN 'sold_at: too old' END AS error FROM events")
def validate_reports(spark, d):
    from datetime import datetime

    rows = V.table(spark, d, "events").select("event_id", "value", F.col("value").alias("amount"), F.col("ts").alias("sold_at"))
    return value.validate(rows, datetime(2024, 1, 20)).select("event_id", "value", "error")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 2 AND count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1 AS allowed FROM events")
def report_limits(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.col("event_id").alias("report_id"), "user_id", F.col("event_type").alias("figure_id"), F.col("ts").alias("reported_at"))
    return value.within_report_limits(rows, 2, 1).select("event_id", "user_id", "allowed")


def browsed(spark, d) -> DataFrame:
    """Figures with nation as series and region as franchise, by their first supplier."""
    supplier = V.table(spark, d, "supplier").join(F.broadcast(V.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(V.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n = supplier.select(F.col("s_suppkey"), F.col("n_name").alias("series"), F.col("r_name").alias("franchise"))
    rows = V.figures(spark, d).join(V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("figure_id")).agg(F.min("l_suppkey").alias("s_suppkey")), "figure_id", "left").join(n, "s_suppkey", "left")
    rows = rows.withColumn("search_text", F.lower(F.concat_ws(" · ", "name", "manufacturer", "series"))).withColumn("superseded_by", F.when(F.col("figure_id") % 13 == 0, F.col("figure_id") - 1)).withColumn("release_date", F.when(F.col("size") % 5 != 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("size"))))
    return rows.join(stats(spark, d), "figure_id", "left")


BROWSED = f"""{SALES}, {STATS}, {FIGURES}, fs AS (SELECT l_partkey AS figure_id, min(l_suppkey) AS k FROM lineitem GROUP BY ALL),
    b AS (SELECT f.*, n_name AS series, r_name AS franchise, lower(concat_ws(' · ', name, manufacturer, n_name)) AS search_text, CASE WHEN f.figure_id % 13 = 0 THEN f.figure_id - 1 END AS superseded_by,
    CASE WHEN size % 5 <> 0 THEN DATE '2000-01-01' + size END AS release_date, market_value_usd, change_30d_pct, volume_90d FROM figures f LEFT JOIN fs USING (figure_id) LEFT JOIN supplier ON s_suppkey = k LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN stats USING (figure_id))"""
CARD = ["figure_id", "name", "manufacturer", "series", "franchise", "market_value_usd"]
CARDS = ", ".join(CARD)


@query(f"WITH {BROWSED} SELECT {CARDS} FROM b WHERE superseded_by IS NULL AND market_value_usd >= 20000 AND market_value_usd <= 60000 ORDER BY market_value_usd DESC NULLS LAST, figure_id LIMIT 24 OFFSET 24")
def browse_page(spark, d):
    return catalog.page(catalog.where(browsed(spark, d), catalog.Filters(min_usd=20000, max_usd=60000)), "value-desc", 2).select(CARD)


for _sort, _sql in (("trending", "change_30d_pct DESC NULLS FIRST, volume_90d DESC NULLS LAST, figure_id"), ("newest", "release_date DESC NULLS FIRST, figure_id"), ("name", "name, figure_id"), ("value-asc", "market_value_usd NULLS LAST, figure_id")):
    _name = f"browse_{_sort.replace('-', '_')}"
    QUERIES[_name] = lambda spark, d, sort=_sort: catalog.page(catalog.where(browsed(spark, d), catalog.Filters()), sort, 1).select(CARD)
    ORACLES[_name] = f"WITH {BROWSED} SELECT {CARDS} FROM b WHERE superseded_by IS NULL ORDER BY {_sql} LIMIT 24"


def collabs(spark, d) -> DataFrame:
    region = V.table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("k"), F.col("r_name").alias("franchise"))
    return V.figures(spark, d).filter("figure_id % 10 = 0").withColumn("k", (F.col("figure_id") / 10 % 5 + 1).cast("int")).join(F.broadcast(region), "k").select("figure_id", "franchise")


COLLABS = "collabs AS (SELECT p_partkey AS figure_id, r_name AS franchise FROM part JOIN region ON r_regionkey = CAST(floor(p_partkey / 10) AS BIGINT) % 5 WHERE p_partkey % 10 = 0)"


@query(f"WITH {BROWSED}, {COLLABS}, own AS (SELECT figure_id FROM b WHERE superseded_by IS NULL AND franchise = 'ASIA' UNION SELECT figure_id FROM collabs WHERE franchise = 'ASIA') SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 24) AS BIGINT)) AS pages FROM b SEMI JOIN own USING (figure_id) WHERE superseded_by IS NULL")
def browse_count(spark, d):
    return catalog.page_count(catalog.where(browsed(spark, d), catalog.Filters(franchise="ASIA"), collabs=collabs(spark, d)))


@query(f"WITH {BROWSED}, c AS (SELECT DISTINCT l_partkey AS figure_id FROM lineitem WHERE l_suppkey = 7) SELECT {CARDS} FROM b SEMI JOIN c USING (figure_id) WHERE superseded_by IS NULL AND manufacturer = 'Brand#11'")
def browse_by_character(spark, d):
    bridge = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("figure_id"), F.col("l_suppkey").alias("character"))
    return catalog.where(browsed(spark, d), catalog.Filters(character=7, manufacturer="Brand#11"), characters=bridge).select(CARD)


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(source), 'the')) AND (contains(lower(text), 'ing') OR contains(lower(source), 'ing'))")
def token_search(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.lower("text").alias("search_text"), F.col("source").alias("name"))
    return docs.filter(catalog.matches_query("The  ing the")).select("doc_id")


@query(f"WITH {BROWSED} SELECT {CARDS} FROM b WHERE superseded_by IS NULL AND contains(search_text, 'brand') AND contains(search_text, '11') ORDER BY volume_90d DESC NULLS LAST, figure_id LIMIT 8")
def quick_search(spark, d):
    return catalog.quick_search(browsed(spark, d), "Brand#11").select(CARD)


@query("""WITH k AS (SELECT 'nation' AS kind, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT 'region', r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) FROM region),
    m AS (SELECT *, starts_with(lower(name), 'an') AS prefix, row_number() OVER (PARTITION BY kind ORDER BY starts_with(lower(name), 'an') DESC, n DESC, name) AS i FROM k WHERE contains(lower(name), 'an')) SELECT kind, name, n FROM m WHERE i <= 5 ORDER BY prefix DESC, n DESC, name, kind LIMIT 5""")
def typeahead(spark, d):
    nations, suppliers = V.table(spark, d, "nation"), V.table(spark, d, "supplier")
    by_nation = nations.join(suppliers.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), "n_nationkey", "left").select(F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    by_region = V.table(spark, d, "region").join(nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n")), "r_regionkey", "left").select(F.col("r_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    by_brand = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return catalog.entity_matches({"nation": by_nation, "brand": by_brand, "region": by_region}, "AN ")


for _up in (True, False):
    _name = "top_movers_up" if _up else "top_movers_down"
    QUERIES[_name] = lambda spark, d, up=_up: catalog.movers(stats(spark, d), up, 2)
    ORACLES[_name] = f"WITH {SALES}, {STATS} SELECT * FROM stats WHERE change_30d_pct {'>' if _up else '<'} 0 AND volume_90d >= 2 ORDER BY change_30d_pct {'DESC' if _up else 'ASC'}, figure_id LIMIT 6"


@query("WITH t AS (SELECT l_partkey AS figure_id, count(*) AS tracked FROM lineitem GROUP BY ALL) SELECT figure_id, p_name AS name, tracked FROM t JOIN part ON p_partkey = figure_id ORDER BY tracked DESC, figure_id LIMIT 8")
def most_tracked(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("figure_id"))
    return catalog.most_tracked(V.figures(spark, d), rows).select("figure_id", "name", "tracked")


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, value LIMIT 60")
def facets(spark, d):
    return catalog.facet(V.figures(spark, d), "category")


@query(f"WITH {BROWSED}, {COLLABS}, u AS (SELECT franchise, count(*) AS n FROM b WHERE franchise IS NOT NULL GROUP BY ALL UNION ALL SELECT franchise, count(*) FROM collabs GROUP BY ALL) SELECT franchise, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL")
def relation_facets(spark, d):
    return catalog.relation_facet(browsed(spark, d).filter("franchise IS NOT NULL").select("franchise"), collabs(spark, d))


@query("SELECT (SELECT count(*) FROM part) AS figures, (SELECT count(*) FROM lineitem) AS sales, (SELECT count(*) FROM supplier) AS sources")
def catalog_totals(spark, d):
    count = lambda name, alias: V.table(spark, d, name).agg(F.count("*").alias(alias))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(count("part", "figures")).join(one(count("lineitem", "sales")), "k").join(one(count("supplier", "sources")), "k").drop("k")


@query("SELECT figure_id, amount_usd, sold_at, CAST(i AS INTEGER) AS place FROM (SELECT l_partkey AS figure_id, l_extendedprice AS amount_usd, l_shipdate AS sold_at, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey || '-' || l_linenumber, l_extendedprice) AS i FROM lineitem) WHERE i <= 3")
def top_k_children(spark, d):
    return catalog.top_children(V.sales(spark, d), "figure_id", [F.desc("sold_at"), F.asc("external_id"), F.asc("amount_usd")], 3).select("figure_id", "amount_usd", "sold_at", "place")


@query("SELECT l_partkey AS figure_id, arg_min({'c': l_extendedprice, 'k': l_orderkey}, {'o': CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 3 ELSE 5 END, 'p': l_extendedprice, 'k': l_orderkey})['c'] AS best_usd FROM lineitem GROUP BY ALL")
def best_by_condition(spark, d):
    rows = V.sales(spark, d).withColumn("place", semantics.ordinal(F.col("condition"), semantics.CONDITIONS))
    return rows.groupBy("figure_id").agg(F.min_by("amount_usd", F.struct("place", "amount_usd")).alias("best_usd"))


def quotes(spark, d) -> DataFrame:
    return V.table(spark, d, "events").select(F.col("event_type").alias("currency"), F.col("ts").cast("date").alias("day"), F.col("value").alias("per_usd"), "event_id")


def daily_rates(spark, d) -> DataFrame:
    """One quote a currency and day, with gaps."""
    kept = quotes(spark, d).filter("day(day) % 4 < 2").groupBy("currency", "day").agg(F.max("per_usd").alias("per_usd"))
    return fx.inverted(kept)


RATES = "rates AS (SELECT upper(event_type) AS currency, CAST(ts AS DATE) AS day, 1 / max(value) AS rate_to_usd FROM events WHERE day(ts) % 4 < 2 GROUP BY ALL HAVING max(value) > 0)"


@query(f"WITH {RATES} SELECT event_id, max_by(rate_to_usd, r.day) AS rate_to_usd, max(r.day) AS rate_day FROM events e LEFT JOIN rates r ON r.currency = upper(event_type) AND r.day <= CAST(ts AS DATE) AND r.day >= CAST(ts AS DATE) - 7 GROUP BY event_id")
def fx_asof(spark, d):
    rows = quotes(spark, d).select("event_id", F.upper("currency").alias("currency"), "day")
    return fx.as_of(rows, daily_rates(spark, d)).select("event_id", "rate_to_usd", "rate_day")


@query("SELECT upper(event_type) AS currency, CAST(date_trunc('month', CAST(ts AS DATE)) AS DATE) AS month, round(avg(1 / value), 12) AS rate_to_usd, count(*) AS days FROM events WHERE value > 0 GROUP BY ALL")
def fx_monthly(spark, d):
    return fx.monthly(quotes(spark, d)).withColumn("rate_to_usd", F.round("rate_to_usd", 12))


@query(f"""WITH {RATES}, m AS (SELECT currency, date_trunc('month', day) AS month, avg(rate_to_usd) AS r FROM rates WHERE currency <> 'SIGNUP' GROUP BY ALL), t AS (SELECT currency, arg_max(rate_to_usd, day) AS r FROM rates GROUP BY ALL),
    e AS (SELECT event_id AS id, value AS amount, upper(event_type) AS currency, CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) + CASE WHEN event_id % 3 = 0 THEN 20 ELSE 0 END END AS day, CASE WHEN event_id % 2 = 0 THEN 'DAY' ELSE 'MONTH' END AS precision FROM events),
    x AS (SELECT e.*, (SELECT max_by(rate_to_usd, r.day) FROM rates r WHERE r.currency = e.currency AND r.day <= e.day AND r.day >= e.day - 7) AS df, (SELECT max_by(rate_to_usd, r.day) FROM rates r WHERE r.currency = 'VIEW' AND r.day <= e.day AND r.day >= e.day - 7) AS dt,
    (SELECT r FROM m WHERE m.currency = e.currency AND month = date_trunc('month', e.day)) AS mf, (SELECT r FROM m WHERE m.currency = 'VIEW' AND month = date_trunc('month', e.day)) AS mt, (SELECT r FROM t WHERE t.currency = e.currency) AS tf, (SELECT r FROM t WHERE t.currency = 'VIEW') AS tt FROM e)
    SELECT id, round(CASE WHEN currency = 'VIEW' THEN amount WHEN day IS NOT NULL AND precision = 'DAY' AND df > 0 AND dt > 0 THEN amount * df / dt WHEN day IS NOT NULL AND mf > 0 AND mt > 0 THEN amount * mf / mt WHEN tf > 0 AND tt > 0 THEN amount * tf / tt END, 6) AS converted,
    CASE WHEN currency = 'VIEW' THEN CASE WHEN day IS NULL THEN 'today' ELSE 'release' END WHEN day IS NOT NULL AND precision = 'DAY' AND df > 0 AND dt > 0 THEN 'release' WHEN day IS NOT NULL AND mf > 0 AND mt > 0 THEN 'release' WHEN tf > 0 AND tt > 0 THEN 'today' END AS basis FROM x""")
def fx_fallback(spark, d):
    rates = daily_rates(spark, d)
    months = rates.filter("currency <> 'SIGNUP'").groupBy("currency", F.trunc("day", "MM").alias("month")).agg(F.avg("rate_to_usd").alias("rate_to_usd"))
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("currency"), F.when(F.col("event_id") % 5 != 0, F.date_add(F.col("ts").cast("date"), F.when(F.col("event_id") % 3 == 0, 20).otherwise(0))).alias("day"), F.when(F.col("event_id") % 2 == 0, "DAY").otherwise("MONTH").alias("precision"))
    return fx.historical(rows, rates, months, "VIEW").select("id", F.round("converted", 6).alias("converted"), "basis")


@query(f"WITH {RATES}, t AS (SELECT currency, arg_max(rate_to_usd, day) AS r FROM rates GROUP BY ALL) SELECT event_id, {half_up('value * r')} AS amount_usd FROM events JOIN t ON currency = upper(event_type)")
def fx_spot(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.col("value").alias("amount"), F.col("event_type").alias("currency"))
    return fx.to_usd(rows, daily_rates(spark, d))[0].select("event_id", "amount_usd")


@query("""WITH f AS (SELECT user_id AS figure_id, count(*) FILTER (event_type = 'purchase') AS c, count(*) FILTER (event_type = 'click') AS w, count(*) FILTER (event_type = 'view') AS v, min(ts) AS rel, CASE WHEN user_id % 3 <> 0 THEN max(ts) END AS polled FROM events GROUP BY user_id),
    p AS (SELECT figure_id, CAST(c * 10 + w * 6 + least(v, 100) * 0.5 + CASE WHEN (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(rel)) / 86400000000.0 BETWEEN -120 AND 180 THEN 8 ELSE 0 END AS DOUBLE) AS demand, CASE WHEN polled IS NULL THEN 60.0 ELSE greatest(0.0, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(polled)) / 86400000000.0) END AS waited FROM f)
    SELECT figure_id, demand, round((demand + 1) * least(waited, 30.0), 6) AS priority FROM p WHERE (demand + 1) * least(waited, 30.0) > 0 ORDER BY (demand + 1) * least(waited, 30.0) DESC, figure_id LIMIT 40""")
def poll_priority(spark, d):
    from datetime import datetime

    rows = V.table(spark, d, "events").groupBy(F.col("user_id").alias("figure_id")).agg(F.count_if(F.col("event_type") == "purchase").alias("collection_count"), F.count_if(F.col("event_type") == "click").alias("wishlist_count"), F.count_if(F.col("event_type") == "view").alias("view_count"), F.min("ts").alias("release_date"), F.max("ts").alias("last"))
    rows = rows.withColumn("last_polled_at", F.when(F.col("figure_id") % 3 != 0, F.col("last")))
    return catalog.poll_priority(rows, datetime(2024, 3, 1), 40).select("figure_id", "demand", F.round("priority", 6).alias("priority"))


@query("SELECT count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'refund') AS refund FROM events")
def queue_counts(spark, d):
    return catalog.queue_counts(V.table(spark, d, "events").select(F.col("event_type").alias("kind")), ["view", "click", "refund"])


@query("SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_windows(spark, d):
    rows = V.table(spark, d, "events").groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("window_start"), "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS protocol, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, starts_with(url, 'https://') AS https FROM pages")
def page_hosts(spark, d):
    url = F.col("url")
    return V.table(spark, d, "pages").select("page_id", F.try_parse_url(url, F.lit("PROTOCOL")).alias("protocol"), F.try_parse_url(url, F.lit("HOST")).alias("host"), T.is_https(url).alias("https"))


@query("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark, d):
    return pages.links(V.table(spark, d, "pages"), "page_id", "html")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark, d):
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return V.table(spark, d, "pages").select("page_id", raw.alias("raw"), T.squeezed(T.decoded_entities(raw)).alias("title"))


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"SELECT doc_id, CAST(len(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND NOT list_contains([{STOP}], w)))) AS BIGINT) AS n_tokens FROM documents")
def tokenize_docs(spark, d):
    docs = V.table(spark, d, "documents")
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*T.STOPWORDS))
    return docs.select("doc_id", F.size(F.array_distinct(kept)).cast("long").alias("n_tokens"))


@query()
def normalized_tokens(spark, d):
    """Unicode normalisation is not in SQL: tests hold it against plain Python."""
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", T.normalized(F.col("text")).alias("norm"))
    return rows.select("conv_id", "turn", F.sha2("norm", 256).alias("norm_sha256"), F.size(T.tokens_of(F.col("norm"))).alias("n_tokens"))


@query("WITH t AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 7 WHEN 0 THEN ' 1/7 scale' WHEN 1 THEN ' 1:1' WHEN 2 THEN ' 1/0.5 big' WHEN 3 THEN ' 1/144 kit' WHEN 4 THEN ' 21/7 none' WHEN 5 THEN ' 1/8th and 1/4' ELSE ' 1 / ' || p_size END AS title FROM part UNION ALL SELECT -1 - doc_id, text FROM documents), m AS (SELECT id, regexp_extract(title, '(?:^|[^0-9.])1\\s*[/:]\\s*([0-9]{1,2}(?:\\.[0-9]+)?)(?:$|[^0-9.])', 1) AS d FROM t) SELECT CAST(id AS BIGINT) AS id, CASE WHEN d IS NULL OR d = '' THEN NULL WHEN CAST(d AS DOUBLE) < 1 THEN CAST(CAST(floor(1 / CAST(d AS DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) || '/1' ELSE '1/' || d END AS scale FROM m")
def extract_scale(spark, d):
    """Scales in names of parts with one of seven endings, and in all texts."""
    said = [" 1/7 scale", " 1:1", " 1/0.5 big", " 1/144 kit", " 21/7 none", " 1/8th and 1/4"]
    end = F.coalesce(*(F.when(F.col("p_partkey") % 7 == k, x) for k, x in enumerate(said)), F.concat(F.lit(" 1 / "), F.col("p_size").cast("string")))
    titles = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", end).alias("title"))
    texts = V.table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("title"))
    return titles.unionByName(texts).select("id", T.scale_of(F.col("title")).alias("scale"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^A-Za-z0-9_])(new|brand new|nib|misb|sealed|unopened)') THEN CASE WHEN contains(lower(text), 'open') THEN 'NEW_OPENED' ELSE 'NEW_SEALED' END WHEN regexp_matches(lower(text), 'damaged|broken|parts only|for parts|junk') THEN 'DAMAGED' WHEN regexp_matches(lower(text), 'missing|incomplete|no box') THEN 'USED_INCOMPLETE' WHEN regexp_matches(lower(text), 'used|pre-owned|preowned|second hand|open box') THEN 'USED_COMPLETE' ELSE 'UNKNOWN' END AS condition FROM documents")
def conditions(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.condition_of(F.col("text")).alias("condition"))


@query()
def match_titles(spark, d):
    """A title for every part against all parts as figures; tests hold the blocked join against all pairs."""
    parts = spread(V.table(spark, d, "part"), "p_partkey")
    none = F.lit(None)
    key = F.concat(F.lit("No."), F.col("p_partkey").cast("string"))
    figs = parts.select(F.col("p_partkey").alias("figure_id"), F.concat_ws(" ", "p_name", "p_type", key).alias("name"), none.cast("string").alias("name_ja"), F.when(F.col("p_size") <= 12, F.concat(F.lit("1/"), F.col("p_size").cast("string"))).alias("scale"), (F.col("p_size") * 10).alias("height_mm"), F.lit("SCALE").alias("category"), F.col("p_brand").alias("maker"), none.cast("string").alias("line_number"), none.cast("string").alias("series"), none.cast("array<string>").alias("series_aliases"), F.array("p_name").alias("characters"), none.cast("array<string>").alias("characters_ja"))
    titles = parts.select(F.col("p_partkey").alias("title_id"), F.concat_ws(" ", "p_brand", "p_name", "p_type", key, F.concat(F.lit("1/"), F.col("p_size").cast("string")), F.concat((F.col("p_size") * 10).cast("string"), F.lit("mm"))).alias("title"))
    return match.best_match(titles, figs)


@query("WITH r AS (SELECT p_name AS name, p_partkey AS figure_id, rank() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC) AS r FROM part) SELECT name, CASE WHEN count(*) = 1 THEN min(figure_id) END AS figure_id FROM r WHERE r = 1 GROUP BY name")
def unique_or_null(spark, d):
    return hygiene.unique_or_null(V.figures(spark, d), "name", "figure_id", [F.desc("msrp_usd")])


@query("WITH g AS (SELECT p_name AS name, p_brand, count(DISTINCT p_partkey) AS n, min(p_partkey) AS figure_id FROM part GROUP BY ALL) SELECT name || '|' || p_brand AS key, figure_id FROM g WHERE n = 1")
def sole_match(spark, d):
    rows = V.figures(spark, d).select(F.concat_ws("|", "name", "manufacturer").alias("key"), "figure_id")
    return hygiene.sole(rows, "key", "figure_id")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_brand AS id FROM part), e AS (SELECT DISTINCT 'Brand#' || CAST(1 + s_suppkey % 11 AS VARCHAR) AS a, 'Brand#' || CAST(1 + (s_suppkey % 11) * 7 % 25 AS VARCHAR) AS b FROM supplier),
    u AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n) UNION SELECT b, a FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)), r AS (SELECT id, id AS c FROM n UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.c) SELECT id, min(c) AS component FROM r GROUP BY id""")
def series_components(spark, d):
    nodes = V.table(spark, d, "part").select(F.col("p_brand").alias("id")).distinct()
    name = lambda x: F.concat(F.lit("Brand#"), (1 + x).cast("string"))
    edges = V.table(spark, d, "supplier").select(name(F.col("s_suppkey") % 11).alias("a"), name((F.col("s_suppkey") % 11) * 7 % 25).alias("b"))
    edges = edges.join(nodes.withColumnRenamed("id", "a"), "a", "left_semi").join(nodes.withColumnRenamed("id", "b"), "b", "left_semi")
    return hygiene.linked_components(nodes, edges)


@query("""WITH f AS (SELECT p_partkey AS figure_id, p_name AS name, p_brand AS maker, CASE WHEN p_size % 9 = 0 THEN p_size END AS number, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS listings, DATE '2000-01-01' + p_size AS rel FROM part),
    g AS (SELECT *, count(*) OVER w AS n, min(number) OVER w AS lo, max(number) OVER w AS hi FROM f WINDOW w AS (PARTITION BY name, maker)) SELECT figure_id, first_value(figure_id) OVER (PARTITION BY name, maker ORDER BY (number IS NOT NULL) DESC, listings DESC, rel NULLS FIRST, figure_id) AS survivor FROM g WHERE n > 1 AND (lo IS NULL OR lo = hi)""")
def fold_survivor(spark, d):
    sold = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("figure_id")).agg(F.count("*").alias("listings"))
    rows = V.figures(spark, d).join(sold, "figure_id", "left").withColumn("listings", F.coalesce("listings", F.lit(0))).withColumn("number", F.when(F.col("size") % 9 == 0, F.col("size"))).withColumn("release_date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("size")))
    return hygiene.fold_survivors(rows.withColumn("maker", F.col("manufacturer")), ["name", "maker"])


@query("WITH t AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, user_id, event_type FROM events WHERE event_type <> 'signup') SELECT key, count(DISTINCT user_id) AS listings, array_to_string(list_slice(list_sort(list(DISTINCT event_type)), 1, 4), ',') AS samples FROM t WHERE key NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) AND key NOT IN (7, 9) GROUP BY key HAVING count(DISTINCT user_id) >= 3")
def discover_missing(spark, d):
    rows = V.table(spark, d, "events").filter("event_type <> 'signup'").select(F.get_json_object("props", "$.k").cast("long").alias("key"), F.col("user_id").alias("external_id"), F.col("event_type").alias("title"))
    known = V.table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"))
    got = hygiene.discovered(rows, known, spark.createDataFrame([(7,), (9,)], "key long"))
    return got.withColumn("samples", F.array_join("samples", ","))


@query("WITH a AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'create' WHEN b.key IS NULL THEN 'delist' ELSE 'update' END AS action FROM a FULL JOIN b ON a.key = b.key")
def sync_plan(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), "l_shipdate")
    return tables.checked_sync(rows.filter("l_shipdate < TIMESTAMP_NTZ '1996-01-01'"), rows.filter("l_shipdate >= TIMESTAMP_NTZ '2001-06-01'"), "key")


@query("""WITH a(id, msrp, maker, locks) AS (VALUES (1, NULL, 'A', ['manufacturer']), (2, 5.0, NULL, ['manufacturer']), (3, NULL, '', NULL)), b(id, msrp, maker) AS (VALUES (1, 9.5, 'X'), (2, 7.0, 'Y'), (3, NULL, 'Z')) SELECT CAST(a.id AS BIGINT) AS id, CAST(CASE WHEN a.msrp IS NULL AND b.msrp IS NOT NULL THEN b.msrp ELSE a.msrp END AS DOUBLE) AS msrp, CASE WHEN (a.maker IS NULL OR a.maker = '') AND NOT list_contains(coalesce(locks, []), 'manufacturer') AND b.maker IS NOT NULL THEN b.maker ELSE a.maker END AS maker FROM a LEFT JOIN b ON a.id = b.id""")
def fill_missing(spark, d):
    a = spark.createDataFrame([(1, None, "A", ["manufacturer"]), (2, 5.0, None, ["manufacturer"]), (3, None, "", None)], "id long, msrp double, maker string, locks array<string>")
    b = spark.createDataFrame([(1, 9.5, "X"), (2, 7.0, "Y"), (3, None, "Z")], "id long, msrp double, maker string")
    return tables.fill_missing(a, b, "id", {"msrp": "msrp", "maker": "manufacturer"}).drop("locks")


SLICE = "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS price, l_shipdate AS seen FROM lineitem WHERE"


@query(f"WITH u AS (SELECT *, 0 AS new FROM ({SLICE} l_orderkey % 3 <> 0) UNION ALL SELECT k, n, price + 1, seen + INTERVAL 1 DAY, 1 FROM ({SLICE} l_orderkey % 3 <> 1)) SELECT k, n, price, seen FROM (SELECT *, row_number() OVER (PARTITION BY k, n ORDER BY seen DESC, new DESC, price DESC) AS i FROM u) WHERE i = 1")
def upsert_merge(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("seen"))
    new = rows.filter("k % 3 <> 1").withColumn("price", F.col("price") + 1).withColumn("seen", F.col("seen") + F.expr("INTERVAL 1 DAY"))
    return tables.upsert(rows.filter("k % 3 <> 0"), new, ["k", "n"], "seen")


@query(f"WITH a AS ({SLICE} l_orderkey % 3 <> 0), b AS (SELECT k, n, price + 1 AS price, seen + INTERVAL 1 DAY AS seen FROM ({SLICE} l_orderkey % 3 <> 1) QUALIFY row_number() OVER (PARTITION BY k, n ORDER BY price NULLS FIRST, seen NULLS FIRST) = 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, b.n) AS n, CASE WHEN b.k IS NOT NULL THEN b.price ELSE a.price END AS price, coalesce(a.seen, b.seen) AS seen FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n")
def upsert_partial(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("seen"))
    new = rows.filter("k % 3 <> 1").withColumn("price", F.col("price") + 1).withColumn("seen", F.col("seen") + F.expr("INTERVAL 1 DAY"))
    return tables.upsert_partly(rows.filter("k % 3 <> 0"), new, ["k", "n"], ["price"])


@query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def insert_if_absent(spark, d):
    rows = V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return tables.insert_if_absent(rows.filter("k % 2 = 0"), rows.filter("k % 3 = 0").withColumn("name", F.lit("new")), ["k"])


@query(f"WITH {SALES}, {STATS} SELECT p_partkey AS figure_id, CASE WHEN s.figure_id IS NOT NULL THEN market_value_usd ELSE p_retailprice END AS msrp_usd, s.figure_id IS NOT NULL AND market_value_usd IS DISTINCT FROM p_retailprice AS changed FROM part LEFT JOIN stats s ON s.figure_id = p_partkey")
def update_from_join(spark, d):
    new = stats(spark, d).select("figure_id", F.col("market_value_usd").alias("msrp_usd"))
    return tables.update_from(V.figures(spark, d).select("figure_id", "msrp_usd"), new, ["figure_id"], ["msrp_usd"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-08-06'")
def retention(spark, d):
    rows = V.table(spark, d, "lineitem")
    return tables.retained(rows, "l_shipdate", dates.days_before(NOW, 90)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderdate_day AS day, price FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate_day, o_totalprice AS price FROM orders) WHERE o_orderdate_day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 50 = 1) UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 0.0 FROM orders WHERE o_orderkey % 50 = 1")
def replace_days(spark, d):
    rows = V.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"))
    return tables.replace_part(rows, rows.filter("o_orderkey % 50 = 1").withColumn("price", F.lit(0.0)), "day")


@query(f"WITH {LISTINGS} SELECT figure_id, count(*) AS active FROM listings WHERE is_active AND last_seen_at >= TIMESTAMP '2001-11-01' GROUP BY ALL")
def expired_listings(spark, d):
    return lifecycle.expired_listings(V.listings(spark, d), NOW).filter("is_active").groupBy("figure_id").agg(F.count("*").alias("active"))


@query("SELECT o_orderkey AS figure_id, CASE WHEN o_orderstatus IN ('O', 'F') AND o_orderdate < CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2000-03-10' ELSE TIMESTAMP '2000-03-01' END THEN 'RELEASED' ELSE CASE o_orderstatus WHEN 'O' THEN 'PREORDER' WHEN 'F' THEN 'ANNOUNCED' ELSE 'DELAYED' END END AS status FROM orders")
def mark_released(spark, d):
    from datetime import datetime

    status = F.when(F.col("o_orderstatus") == "O", "PREORDER").when(F.col("o_orderstatus") == "F", "ANNOUNCED").otherwise("DELAYED")
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("figure_id"), status.alias("status"), F.col("o_orderdate").alias("release_date"), F.when(F.col("o_orderkey") % 2 == 0, "DAY").otherwise("MONTH").alias("precision"))
    return lifecycle.marked_released(rows, datetime(2000, 3, 10)).select("figure_id", "status")


@query("""WITH p AS (SELECT o_custkey AS figure_id, o_orderkey AS printing_id, CASE WHEN o_orderkey % 3 = 0 THEN 'original' ELSE 'reissue' END AS kind, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS rel, CASE WHEN o_orderkey % 2 = 0 THEN 'DAY' ELSE 'MONTH' END AS precision, o_orderdate AS closes FROM orders),
    w AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY rel NULLS LAST, printing_id) AS i FROM p WHERE kind <> 'original' AND CASE WHEN rel IS NOT NULL THEN NOT (rel < CASE WHEN precision = 'DAY' THEN TIMESTAMP '2000-03-10' ELSE TIMESTAMP '2000-03-01' END) ELSE closes > TIMESTAMP '2000-03-10' END)
    SELECT figure_id, printing_id, CASE WHEN rel IS NULL THEN CAST(closes AS DATE) WHEN precision = 'DAY' THEN CAST(rel AS DATE) + 1 ELSE CAST(date_trunc('month', rel) + INTERVAL 1 MONTH AS DATE) END AS due_at FROM w WHERE i = 1""")
def upcoming_reissue(spark, d):
    from datetime import datetime

    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("figure_id"), F.col("o_orderkey").alias("printing_id"), F.when(F.col("o_orderkey") % 3 == 0, "original").otherwise("reissue").alias("kind"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("release_date"), F.when(F.col("o_orderkey") % 2 == 0, "DAY").otherwise("MONTH").alias("precision"), F.col("o_orderdate").alias("preorder_closes_at"))
    return lifecycle.upcoming_reissue(rows, datetime(2000, 3, 10)).select("figure_id", "printing_id", "due_at")


@query("""WITH RECURSIVE p AS (SELECT o_custkey AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderdate) AS i, CASE WHEN o_orderkey % 3 = 0 THEN 'original' ELSE 'reissue' END AS kind, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders),
    r AS (SELECT f, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(kind VARCHAR, d DATE, price DOUBLE)[]) AS runs FROM (SELECT DISTINCT f FROM p) UNION ALL
          SELECT f, i, CASE WHEN coalesce(hit, 0) = 0 THEN list_append(runs, new) ELSE list_transform(runs, lambda x, k: CASE WHEN k = hit THEN {'kind': x.kind, 'd': x.d, 'price': coalesce(x.price, new.price)} ELSE x END) END
          FROM (SELECT r.f, p.i, runs, {'kind': p.kind, 'd': p.d, 'price': p.price} AS new, list_position(list_transform(runs, lambda x: x.kind = p.kind AND abs(date_diff('day', x.d, p.d)) <= 92), true) AS hit FROM r JOIN p ON p.f = r.f AND p.i = r.i + 1)),
    u AS (SELECT f, unnest(runs) AS x, unnest(range(len(runs))) AS k FROM (SELECT f, arg_max(runs, i) AS runs FROM r GROUP BY f))
    SELECT f AS figure_id, x.kind AS kind, CASE WHEN row_number() OVER (PARTITION BY f ORDER BY x.d, k) = 1 THEN 'Original' ELSE 'Reissue' END AS label, x.d AS release_date, x.price AS price, 'JPY' AS currency, CAST(NULL AS VARCHAR) AS jan FROM u""")
def printings(spark, d):
    """Which printings are one depends on the order of all before: a fold, in SQL a recursion."""
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("figure_id"), F.col("o_orderkey").alias("printing_id"), F.when(F.col("o_orderkey") % 3 == 0, "original").otherwise("reissue").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("o_orderdate").cast("date").alias("release_date"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"), F.lit("JPY").alias("currency"), F.lit(None).cast("string").alias("jan"))
    return lifecycle.folded_printings(rows)


@query("SELECT l_orderkey || '-' || l_linenumber AS external_id, l_extendedprice AS amount, 'USD' AS currency, 'title ' || l_partkey AS title FROM lineitem WHERE l_extendedprice > 0")
def listing_json(spark, d):
    rows = V.table(spark, d, "lineitem")
    raw = rows.select(F.to_json(F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("itemId"), F.concat(F.lit("title "), F.col("l_partkey")).alias("title"), F.struct(F.col("l_extendedprice").cast("string").alias("value"), F.lit("usd").alias("currency")).alias("price"))).alias("json"))
    got = feeds.listings_from_json(raw, "json")
    return got.select("external_id", F.col("amount").cast("double").alias("amount"), "currency", "title")


@query("SELECT r_name AS franchise, n_name AS series, n_name IS NOT NULL AS found FROM region LEFT JOIN nation ON n_regionkey = r_regionkey")
def curated_series(spark, d):
    region, nation = V.table(spark, d, "region"), V.table(spark, d, "nation")
    return region.join(nation, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("franchise"), F.col("n_name").alias("series"), F.col("n_name").isNotNull().alias("found"))


@query("WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS prefix FROM part) SELECT p_partkey AS id, max_by(prefix, length(prefix)) AS prefix FROM part LEFT JOIN p ON starts_with(p_name, prefix) GROUP BY p_partkey")
def longest_prefix(spark, d):
    names = V.figures(spark, d).select(F.col("figure_id").alias("id"), "name")
    return hygiene.longest_prefix(names, names.select(F.split("name", " ")[0].alias("prefix")).distinct()).select("id", "prefix")


@query("WITH t AS (SELECT DISTINCT p_name AS name, unnest(string_split(lower(p_name), ' ')) AS token FROM part) SELECT token, count(DISTINCT name) AS n FROM t WHERE length(token) > 1 GROUP BY token HAVING count(DISTINCT name) BETWEEN 2 AND 12")
def token_clusters(spark, d):
    return hygiene.token_clusters(V.figures(spark, d).select("name").distinct()).select("token", "n")


@query("SELECT a.p_partkey AS figure_id, coalesce(b.p_partkey, a.p_partkey) AS shown FROM part a LEFT JOIN part b ON a.p_partkey % 13 = 0 AND b.p_partkey = a.p_partkey - 1")
def superseded_redirect(spark, d):
    rows = V.figures(spark, d).withColumn("superseded_by", F.when(F.col("figure_id") % 13 == 0, F.col("figure_id") - 1))
    target = V.figures(spark, d).select(F.col("figure_id").alias("superseded_by"), F.col("figure_id").alias("target"))
    return rows.join(target, "superseded_by", "left").select("figure_id", F.coalesce("target", "figure_id").alias("shown"))


@query("SELECT p_partkey AS figure_id, p_brand AS maker, n_name AS series, r_name AS franchise FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30 LEFT JOIN region ON n_regionkey = r_regionkey")
def cards(spark, d):
    figs = V.figures(spark, d).select("figure_id", F.col("manufacturer").alias("maker_id"), (F.col("figure_id") % 30).alias("series_id"))
    makers = V.table(spark, d, "part").select(F.col("p_brand").alias("maker_id"), F.col("p_brand").alias("name")).distinct()
    tree = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("series_id"), F.col("n_name").alias("name"), F.col("r_name").alias("franchise"))
    photos = V.table(spark, d, "pages").select((F.col("page_id") + 1).alias("figure_id"), "url", F.lit(False).alias("is_primary"), F.lit(0).alias("place"))
    return detail.cards(figs, makers, tree, photos).select("figure_id", F.col("maker.name").alias("maker"), F.col("series.name").alias("series"), F.col("series.franchise").alias("franchise"))


@query("WITH s AS (SELECT l_partkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey || '-' || l_linenumber, l_extendedprice) AS i FROM lineitem), g AS (SELECT l_partkey, count(*) AS n, sum(CAST(p AS DECIMAL(20,4))) AS total FROM s WHERE i <= 20 GROUP BY ALL) SELECT p_partkey AS figure_id, coalesce(n, 0) AS n_sales, CAST(coalesce(total, 0) AS DOUBLE) AS shown_usd FROM part LEFT JOIN g ON l_partkey = p_partkey")
def figure_detail(spark, d):
    sold = V.sales(spark, d).select("figure_id", "external_id", F.col("amount_usd").cast("decimal(20,4)").alias("amount"), "sold_at")
    whole = detail.with_children(V.figures(spark, d), "figure_id", {"sales": (sold, [F.desc("sold_at"), F.asc("external_id"), F.asc("amount")], 20)})
    total = F.aggregate("sales", F.lit(0).cast("decimal(30,4)"), lambda a, x: (a + x["amount"]).cast("decimal(30,4)"))
    return whole.select("figure_id", F.size("sales").cast("long").alias("n_sales"), total.cast("double").alias("shown_usd"))


@query("WITH a AS (SELECT p_partkey AS product_id, lower(p_name) AS n, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS m, CASE WHEN p_partkey % 4 = 0 THEN 'OTHER' ELSE p_type END AS c FROM part WHERE p_partkey % 5 = 0), b AS (SELECT p_partkey AS figure_id, lower(p_name) AS n, p_brand AS m, p_type AS c FROM part WHERE p_partkey % 5 <> 0) SELECT product_id, min(figure_id) AS figure_id FROM a JOIN b ON a.n = b.n AND (a.m IS NULL OR lower(a.m) = lower(b.m)) AND (a.c = 'OTHER' OR b.c = 'OTHER' OR lower(a.c) = lower(b.c)) GROUP BY product_id HAVING count(*) = 1")
def held_product(spark, d):
    rows = V.figures(spark, d).withColumn("compared", T.product_name(F.col("name")))
    mine = rows.filter("figure_id % 5 = 0").select(F.col("figure_id").alias("product_id"), "compared", F.when(F.col("figure_id") % 3 != 0, F.col("manufacturer")).alias("maker"), F.when(F.col("figure_id") % 4 == 0, "OTHER").otherwise(F.col("category")).alias("category"))
    return detail.held_products(mine, rows.filter("figure_id % 5 <> 0").select("figure_id", "compared", F.col("manufacturer").alias("maker"), "category"))


@query("SELECT name FROM (SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 're') ORDER BY name LIMIT 30) ORDER BY starts_with(lower(name), 're') DESC, name LIMIT 8")
def suggest_names(spark, d):
    return detail.suggested_names(V.figures(spark, d), " Re")


@query("SELECT o_orderkey AS figure_id, 'shop' AS source FROM orders WHERE o_orderkey % 7 <> 0 ORDER BY CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END NULLS FIRST, o_orderkey LIMIT 60")
def stale_offers(spark, d):
    orders = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("figure_id"), F.lit("shop").alias("source"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("checked_at"))
    return detail.stale_offers(orders, orders.filter("figure_id % 7 = 0"), 60).select("figure_id", "source")


@query("WITH t AS (SELECT l_returnflag AS character, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'maker' || (l_suppkey % 5) END AS maker, CASE l_linenumber WHEN 1 THEN 'unknown' ELSE 'form' || l_linenumber END AS form, l_extendedprice AS p FROM lineitem) SELECT character, maker, form, count(*) AS n, min(p) AS low, max(p) AS high FROM t WHERE form <> 'unknown' AND maker IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def product_proposals(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("character"), F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("maker"), F.col("l_suppkey") % 5)).alias("maker"), F.when(F.col("l_linenumber") == 1, "unknown").otherwise(F.concat(F.lit("form"), F.col("l_linenumber"))).alias("form"), F.col("l_extendedprice").alias("amount_usd"))
    return detail.proposals(rows)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def tally(spark, d):
    return detail.tally(V.table(spark, d, "events"), "event_type")


@query("WITH t AS (SELECT DISTINCT lang, doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM documents), c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY lang, token HAVING count(*) >= 2), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS INTEGER) AS place FROM c) SELECT * FROM p WHERE place <= 4")
def subject_tokens(spark, d):
    docs = V.table(spark, d, "documents").select("lang", F.split(F.lower("text"), "[^a-z]+").alias("tokens"))
    return detail.subject_tokens(docs, "lang")
