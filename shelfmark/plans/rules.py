"""Queries of the rules: texts, dates, numbers, matching, characters, clean-up, nights and streams, with their SQL twins.

Most lay a rule over all rows of a table, in a form that the row's key chooses, so that every branch is met.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names, semantics
from ..functions import text as T
from ..functions.ordering import numbered
from ..functions.staging import fresh_path
from ..operators import catalog, characters, detail, hygiene, match, nightly, rollup, tables, value
from ..sources import feeds
from ..streaming import counters
from . import views as V
from .queries import DAILY, half_up, query
from .round_trips import ITEMS, cat, every, items
from .views import ASKS, LISTINGS, NOW, SALES, STATS


def strings(values) -> str:
    """A SQL list of values."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def cents(value: str) -> str:
    """A number rounded to cents, half away from 0, in SQL."""
    return f"CAST(round(CAST({value} AS DECIMAL(20,8)), 2) AS DOUBLE)"


def code(key: Column) -> Column:
    """A number as letters, none of them a vowel, so that no spelling rule joins two."""
    return F.translate(key.cast("string"), "0123456789", "bdfghklmnp")


def code_sql(key: str) -> str:
    return f"translate(CAST({key} AS VARCHAR), '0123456789', 'bdfghklmnp')"


# What titles say after a part's name, and what they are then: accessory, no figure, unofficial, listing of an accessory, several or other goods.
SAYINGS = [
    ("nendoroid 1/7 figure", 0, 0, 0, 0, 0), ("chopstick rest", 1, 0, 0, 1, 0), ("chopstick rest figure bonus", 1, 0, 0, 0, 0), ("acrylic stand", 0, 1, 0, 0, 1), ("acrylic stand figure", 0, 0, 0, 0, 1),
    ("hand made figure", 0, 0, 1, 0, 0), ("3d printed statue", 0, 0, 1, 0, 0), ("figure replacement hands", 0, 0, 0, 1, 0), ("figure with spare hands", 0, 0, 0, 0, 0), ("figure poster", 0, 0, 0, 0, 1),
    ("figure with poster", 0, 0, 0, 0, 0), ("t-shirt", 0, 1, 0, 0, 1), ("figma bundle", 0, 0, 0, 0, 1), ("figure set of 3", 0, 0, 0, 0, 1), ("figure necklace", 1, 0, 0, 1, 0), ("manga vol 3", 0, 1, 0, 0, 0),
]
SAID = ", ".join(f"({i}, '{s}', {', '.join('true' if x else 'false' for x in flags)})" for i, (s, *flags) in enumerate(SAYINGS))


@query(f"""WITH {ITEMS} SELECT k, accessory, no_figure, unofficial, accessory_listing, no_single FROM items JOIN (VALUES {SAID}) s(i, said, accessory, no_figure, unofficial, accessory_listing, no_single) ON k % {len(SAYINGS)} = i""")
def title_verdicts(spark, d):
    title = cat(F.col("name"), " ", every(len(SAYINGS), *(s for s, *_ in SAYINGS)))
    rows = items(spark, d).select("k", title.alias("title")).withColumn("norm", T.normalized(F.col("title")))
    rows = rows.withColumn("tokens", T.tokens_of(F.col("norm")))
    verdicts = {"accessory": T.is_accessory(F.col("title")), "no_figure": T.is_not_a_figure(F.col("title")), "unofficial": T.is_unofficial(F.col("title")), "accessory_listing": T.is_accessory_listing(F.col("title")), "no_single": T.is_not_a_single_figure(F.col("norm"), F.col("tokens"))}
    return rows.select("k", *(v.alias(c) for c, v in verdicts.items()))


@query(f"""WITH {ITEMS} SELECT k, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true END AS nsfw, CASE k % 5 WHEN 0 THEN 'retailer' WHEN 1 THEN 'retailer' WHEN 2 THEN 'keyword:cast-off' WHEN 3 THEN 'keyword:bunny' END AS source FROM items""")
def nsfw_verdicts(spark, d):
    tags = every(5, F.array(F.lit("New"), F.lit(" NSFW ")), F.array(F.lit("sfw")), F.array(F.lit("new")), F.array().cast("array<string>"), F.lit(None).cast("array<string>"))
    name = cat(F.col("name"), every(5, " nude", " castoff", " cast-off ver", " bunny ver", " plain"))
    got = T.nsfw(tags, name)
    return items(spark, d).select("k", got["nsfw"].alias("nsfw"), got["source"].alias("source"))


LETTERS = "regexp_replace(regexp_replace(lower(x), '\\bversion\\b', 'ver', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')"


@query(f"""WITH {ITEMS}, t AS (SELECT k, name || CASE k % 3 WHEN 0 THEN ' (Version) x-2!' WHEN 1 THEN ' & the nendoroid ver.' ELSE '' END AS x FROM items)
    SELECT k, trim({LETTERS}) AS product, trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
           trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[×]', ' x ', 'g'), '[:\\-!?,./()&]', ' ', 'g'), '\\s+', ' ', 'g')) AS series,
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower(x), '[^a-z0-9 ]', '', 'g'), 'ou', 'o'), 'a+', 'a', 'g'), 'e+', 'e', 'g'), 'i+', 'i', 'g'), 'o+', 'o', 'g'), 'u+', 'u', 'g') AS romaji FROM t""")
def compared_names(spark, d):
    rows = items(spark, d).select("k", cat(F.col("name"), every(3, " (Version) x-2!", " & the nendoroid ver.", "")).alias("x"))
    form = lambda f: T.unicode_form(F.col("x"), f)
    return rows.select("k", T.product_name(form("NFKC")).alias("product"), T.slug(form("NFKD")).alias("slug"), T.series_name(form("NFKC")).alias("series"), T.romaji_key(form("NFKD")).alias("romaji"))


@query(f"""WITH {ITEMS}, w AS (SELECT k, list_filter(list_distinct(string_split(name || ' figure parade xy longest', ' ')), lambda x: length(x) > 2 AND NOT list_contains({strings(T.GENERIC_WORDS)}, x)) AS w FROM items)
    SELECT k, len(w) AS n, list_max(list_transform(w, lambda x: length(x))) AS most FROM (SELECT k, w[1:3] AS w FROM (SELECT k, list_sort(list_transform(w, lambda x: (-length(x), x))) AS s, w FROM w)) """)
def telling_words(spark, d):
    """How many telling words a name has, three at most, and how long the longest is."""
    words = T.prefilter_words(cat(F.col("name"), " figure parade xy longest"))
    return items(spark, d).select("k", F.size(words).cast("long").alias("n"), F.array_max(F.transform(words, lambda w: F.length(w))).cast("long").alias("most"))


@query(f"""WITH {ITEMS} SELECT k, k % 4 IN (0, 1) AS same_name, k % 4 IN (0, 1, 2) AS same_person, k % 4 <> 3 AS same_in_series FROM items""")
def name_comparisons(spark, d):
    a = cat("sora ", code(F.col("k")))
    b = every(4, a, cat(code(F.col("k")), " sora"), cat("sora the ", code(F.col("k"))), cat("riku ", code(F.col("k") + 1)))
    key = lambda c: T.romaji_key(c)
    x, y = key(a), key(b)
    return items(spark, d).select("k", T.names_match(x, y).alias("same_name"), (T.names_match(x, y) | T.same_character(x, y)).alias("same_person"), (T.names_match(x, y) | T.same_character(x, y, True)).alias("same_in_series"))


@query(f"""WITH {ITEMS} SELECT k, lower(name) || ' · ' || lower(brand) || ' · ' || lower(kind) AS search_text FROM items""")
def search_texts(spark, d):
    terms = F.array(F.col("name"), cat(" ", F.col("brand")), F.upper("name"), F.lit(None).cast("string"), F.col("kind"), F.lit(""))
    return items(spark, d).select("k", T.search_text(terms).alias("search_text"))


@query(f"""WITH {ITEMS} SELECT k, list_filter([lower(name[1:strpos(name, ' ') - 1]), lower(name[strpos(name, ' ') + 1:]), 'nendoroid', 'swimsuit', 'x' || CAST(k % 10 AS VARCHAR)], lambda w: length(w) > 1 AND w <> 'x' || CAST(k % 10 AS VARCHAR) AND NOT list_contains({strings(T.STOPWORDS)}, w)) AS tokens FROM items""")
def title_tokens(spark, d):
    """Tokens of titles: stop words and units go, synonyms are joined, digits and letters stand apart."""
    title = cat(F.initcap("name"), " NENDO Figure swimwear 12cm x", F.col("k") % 10)
    rows = items(spark, d).select("k", T.normalized(title).alias("norm"))
    return rows.select("k", T.tokens_of(F.col("norm")).alias("tokens")).withColumn("tokens", F.filter("tokens", lambda t: ~t.rlike("^[0-9]+$")))


@query(f"""WITH {ITEMS} SELECT k, CASE k % 5 WHEN 0 THEN 'NENDOROID' WHEN 1 THEN 'FIGMA' WHEN 2 THEN 'NENDOROID' END AS line, CASE k % 5 WHEN 0 THEN CAST(100 + k % 800 AS VARCHAR) WHEN 1 THEN CAST(10 + k % 80 AS VARCHAR) WHEN 2 THEN '950' END AS number FROM items""")
def release_numbers(spark, d):
    """The greatest number that a line's name marks; a bare one needs three digits, and one that a unit follows is a size."""
    title = every(5, cat(F.col("name"), " Nendoroid ", 100 + F.col("k") % 800), cat("figma No. ", 10 + F.col("k") % 80, " ", F.col("name")), "nendoroid no. 20 and Nendoroid #950", cat("Nendoroid 100 mm ", F.col("name")), cat("figma ", F.col("name")))
    got = T.release_number(title)
    return items(spark, d).select("k", got["line"].alias("line"), got["number"].alias("number"))


@query(f"""WITH {ITEMS} SELECT k, CASE k % 5 WHEN 0 THEN 'good smile' WHEN 1 THEN 'kotobukiya' WHEN 2 THEN 'megahouse' END AS maker, CASE k % 5 WHEN 0 THEN 'nendoroid' WHEN 1 THEN 'scale' WHEN 2 THEN 'prize' WHEN 3 THEN 'plush' ELSE 'unknown' END AS form,
    CASE k % 2 WHEN 0 THEN [name, brand] ELSE [name] END AS forms, name || ' ' || kind AS search FROM items""")
def makers_and_forms(spark, d):
    title = cat(F.col("name"), every(5, " Good Smile alter Nendoroid", " KOTOBUKIYA 1/7", " sega MegaHouse prize", " plush", " thing"))
    alternative = F.when(F.col("k") % 2 == 0, cat(F.col("name"), " (", F.col("brand"), ")")).otherwise(F.col("name"))
    return items(spark, d).select("k", names.maker_in(title).alias("maker"), names.form_in(title).alias("form"), names.alternatives(alternative).alias("forms"), names.search_query(F.array(F.col("name"), F.lit(None).cast("string"), F.lit(""), F.col("kind"))).alias("search"))


@query(f"""WITH {ITEMS} SELECT k, CASE k % 4 WHEN 0 THEN ['Sora ' || {code_sql("k")}] WHEN 1 THEN ['Sora ' || {code_sql("k")}] WHEN 2 THEN [] ELSE ['Riku ' || {code_sql("k")}, 'Riku ' || {code_sql("k")} || ' [blue]'] END AS guesses,
    CASE k % 4 WHEN 2 THEN ['Sora', 'Riku'] ELSE [] END AS parts FROM items""")
def character_guesses(spark, d):
    """The names that a figure's character may have, and those that a figure of several joins."""
    c = code(F.col("k"))
    name = every(4, cat("Nendoroid Sora ", c, ": Winter Ver. DX (Reissue)"), cat("figma Sora ", c, " Ver. DX Ver."), "Nendoroid Sora & Riku Figure Set", cat("Pop Up Parade Riku ", c, " [blue]"))
    pair = every(4, "Sora", "Sora", "figma Sora & Riku: DX Ver.", "Riku 1/7")
    none = F.array().cast("array<string>")
    return items(spark, d).select("k", F.array_sort(names.character_candidates(name, none)).alias("guesses"), names.split_characters(pair, none).alias("parts"))


FORMS = ["yyyy/MM/dd", "d MMM yyyy", "yyyy年M月d日", "yyyy年M月", "yyyy-MM", "MMMM yyyy"]


@query("""SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 < 3 THEN o_orderdate ELSE date_trunc('month', o_orderdate) + INTERVAL 14 DAY END AS DATE) AS date,
    CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 < 3 THEN 'DAY' ELSE 'MONTH' END AS precision FROM orders""")
def written_dates(spark, d):
    """Dates as they are written, read back with their precision."""
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("at"))
    said = every(7, *(F.date_format("at", f) for f in FORMS), "soon")
    got = dates.parsed_date(said)
    return rows.select("k", got["date"].alias("date"), got["precision"].alias("precision"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate < TIMESTAMP '2001-11-04' ELSE o_orderdate < TIMESTAMP '2001-11-01' END AS shipped,
    CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH END AS DATE) AS due, strftime(o_orderdate, '%Y-%m') AS month,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, o_orderdate >= TIMESTAMP '2001-10-05' AS recent FROM orders""")
def release_states(spark, d):
    at, precision = F.col("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, "DAY").otherwise("MONTH")
    return V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), dates.has_shipped(at, precision, NOW).alias("shipped"), dates.reissue_due(at, precision, F.lit(None).cast("timestamp_ntz")).alias("due"),
        dates.month_key(at).alias("month"), dates.month_start(at).alias("month_start"), (at >= dates.days_before(NOW, 30)).alias("recent"),
    )


@query(f"""WITH {ITEMS} SELECT k, {half_up("price / 7")} AS rounded, CASE k % 2 WHEN 0 THEN 'JPY ' || format('{{:,}}', CAST(floor(price) AS BIGINT)) ELSE 'USD ' || format('{{:,.2f}}', price) END AS money,
    CASE WHEN size - 25 > 0 THEN '+' ELSE '' END || printf('%.1f%%', CAST(size - 25 AS DOUBLE)) AS percent, CASE WHEN size = 25 THEN 'flat' WHEN size > 25 THEN 'up' ELSE 'down' END AS trend, CASE WHEN k % 3 = 0 THEN NULL ELSE price END AS amount FROM items""")
def numbers_as_text(spark, d):
    code_of = F.when(F.col("k") % 2 == 0, "JPY").otherwise("USD")
    money = semantics.money_text(F.when(F.col("k") % 2 == 0, F.floor("price").cast("double")).otherwise(F.col("price")), code_of)
    said = every(3, "NaN", F.col("price").cast("string"), F.col("price").cast("string"))
    change = F.col("size") - 25
    return items(spark, d).select("k", semantics.half_up(F.col("price") / 7).alias("rounded"), money.alias("money"), semantics.percent_text(change).alias("percent"), semantics.trend(change).alias("trend"), semantics.amount(said).alias("amount"))


@query(f"""WITH {ITEMS} SELECT k, sha256('salt' || name) AS subject, CASE k % 3 WHEN 0 THEN '45' || lpad(CAST(k AS VARCHAR), 11, '0') WHEN 1 THEN '49' || lpad(CAST(k AS VARCHAR), 11, '0') END AS jan,
    CASE k % 3 WHEN 0 THEN k * 10 WHEN 1 THEN k * 10 END AS yen, CASE k % 3 WHEN 0 THEN size * 10 WHEN 1 THEN size END AS height FROM items""")
def codes_prices_heights(spark, d):
    jan = cat(every(3, "45", "49", "12"), F.lpad(F.col("k").cast("string"), 11, "0"))
    price = every(3, cat("price ￥", F.col("k") * 10), cat(F.col("k") * 10, "円"), "free")
    height = every(3, cat("10 mm base, 全高 約", F.col("size"), "cm"), cat("about ", F.col("size"), " mm"), "tall")
    return items(spark, d).select("k", T.subject_hash("salt", F.col("name")).alias("subject"), T.jan_code(cat("x", jan, "y")).alias("jan"), T.price_jpy(price).cast("long").alias("yen"), T.height_mm(height).alias("height"))


@query("""SELECT o_orderkey AS k, o_orderkey % 4 IN (0, 3) AS automated FROM orders""")
def automated_readers(spark, d):
    agent = every(4, "Googlebot/2.1", "Mozilla/5.0 (X11)", "Safari", F.lit(None).cast("string"))
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return rows.select("k", T.looks_automated(agent).alias("automated"))


@query("SELECT event_type AS page, count(*) AS views FROM events WHERE event_id % 3 <> 0 GROUP BY ALL")
def view_counter(spark, d):
    """Views by readers that do not look automated."""
    rows = V.table(spark, d, "events").select(F.col("event_type").alias("page"), F.col("event_id").alias("k"))
    return counters.view_counts(rows.withColumn("agent", every(3, "bot", "Mozilla", "Safari")), "page", "agent")


@query("SELECT c_name AS username, l_partkey AS figure_id, CAST(l_quantity AS INTEGER) AS quantity, l_returnflag AS condition FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0")
def public_profiles(spark, d):
    """What users who allow it show of their holdings: not what they paid."""
    orders = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    holdings = V.table(spark, d, "lineitem").join(orders, "l_orderkey").select("user_id", F.col("l_partkey").alias("figure_id"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("condition"), F.col("l_extendedprice").alias("paid"))
    users = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), (F.col("c_custkey") % 2 == 0).alias("is_public"))
    return detail.public_profile(holdings, users)


@query("SELECT o_orderkey AS submission_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def moderation_head(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("submission_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "PENDING_REVIEW").otherwise("DONE").alias("status"))
    return detail.moderation_queue(rows).drop("status")


@query("""SELECT key, CAST(row_number() OVER (ORDER BY number DESC NULLS LAST, listings DESC, key) AS INTEGER) AS place FROM
    (SELECT l_suppkey AS key, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 7 END AS number, count(*) AS listings FROM lineitem GROUP BY ALL)""")
def candidate_order(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("listings"))
    rows = rows.withColumn("number", F.when(F.col("key") % 3 != 0, F.col("key") % 7)).withColumn("first_seen", F.lit(0))
    return numbered(rows, *detail.candidate_order(), name="place").select("key", F.col("place").cast("int").alias("place"))


@query(f"WITH {ITEMS} SELECT to_json({{'k': k, 'name': name}})::VARCHAR AS json FROM items")
def rows_as_json(spark, d):
    return detail.as_json(items(spark, d).select("k", "name"))


@query("""SELECT source, CASE WHEN bool_and(ok) THEN 'SUCCESS' ELSE 'ERROR' END AS status, CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS n_rows, min(CASE WHEN NOT ok THEN 'failed ' || source END) AS error
    FROM (SELECT o_orderpriority AS source, o_orderstatus AS stage, o_orderpriority NOT LIKE '1%' OR o_orderstatus <> 'P' AS ok, count(*) AS n FROM orders GROUP BY ALL) GROUP BY source""")
def run_logs(spark, d):
    rows = V.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source"), "o_orderstatus").agg(F.count("*").alias("n_rows"))
    ok = ~F.col("source").startswith("1") | (F.col("o_orderstatus") != "P")
    rows = rows.withColumn("ok", ok).withColumn("error", F.when(~F.col("ok"), cat("failed ", F.col("source"))))
    return nightly.run_log(rows).withColumn("n_rows", F.col("n_rows").cast("long"))


@query(f"""WITH {SALES}, {LISTINGS}, {STATS}, {ASKS}, f AS (SELECT p_partkey AS figure_id FROM part)
    SELECT f.figure_id, market_value_usd, change_30d_pct, coalesce(volume_90d, 0) AS volume_90d, ask_median_usd, coalesce(ask_listings, 0) AS ask_listings FROM f LEFT JOIN stats USING (figure_id) LEFT JOIN asks USING (figure_id)""")
def nightly_figures(spark, d):
    """The figures' statistics after a night."""
    none = "figure_id long, condition string, day date, min_usd double, median_usd double, avg_usd double, max_usd double, sample_size long, lowest_ask_usd double, ask_min_usd double, ask_median_usd double, ask_max_usd double, ask_count long"
    done = nightly.aggregated(V.sales(spark, d), V.listings(spark, d), V.figures(spark, d), spark.createDataFrame([], none), date(2001, 11, 3), NOW)
    return done["figures"]


@query(f"""WITH {SALES}, {LISTINGS}, low AS (SELECT figure_id, condition, min(amount_usd) AS lowest_ask_usd FROM listings WHERE is_active GROUP BY ALL),
    sold AS ({DAILY.replace('brand_sales', 'sales')})
    SELECT figure_id, condition, day, min_usd, median_usd, avg_usd, max_usd, sample_size, lowest_ask_usd, NULL::DOUBLE AS ask_min_usd, NULL::DOUBLE AS ask_median_usd, NULL::DOUBLE AS ask_max_usd, NULL::BIGINT AS ask_count
    FROM sold LEFT JOIN low USING (figure_id, condition) WHERE day = DATE '2001-06-15'
    UNION ALL SELECT figure_id, 'NEW_SEALED', DATE '2001-11-04', NULL, NULL, NULL, NULL, NULL, NULL, {cents("min(amount_usd)")}, {cents("median(amount_usd)")}, {cents("max(amount_usd)")}, count(*)
    FROM listings WHERE is_active AND condition = 'NEW_SEALED' AND match_score >= 0.72 GROUP BY figure_id HAVING count(*) >= 3""")
def nightly_snapshots(spark, d):
    """A night's snapshots: what was sold on its day, with asks beside, and what is asked on the day that it runs."""
    none = "figure_id long, condition string, day date, min_usd double, median_usd double, avg_usd double, max_usd double, sample_size long, lowest_ask_usd double, ask_min_usd double, ask_median_usd double, ask_max_usd double, ask_count long"
    return nightly.aggregated(V.sales(spark, d), V.listings(spark, d), V.figures(spark, d), spark.createDataFrame([], none), date(2001, 6, 15), NOW)["snapshots"]


# Figures for matching: each has a name of its own and one of 5,000 numbers, since a number has four digits at most; titles name
# them, or differ in one thing that refuses the match.
def line_number() -> Column:
    return cat("ex-", 1000 + F.col("k") % 5000)


def catalogue(spark, d) -> DataFrame:
    rows = items(spark, d)
    none = F.lit(None)
    return rows.select(
        F.col("k").alias("figure_id"), cat("Nendoroid Sora", code(F.col("k")), " blaze").alias("name"), none.cast("string").alias("name_ja"), F.lit("1/7").alias("scale"), F.lit(100).alias("height_mm"), F.lit("NENDOROID").alias("category"),
        F.lit("Good Smile Company").alias("maker"), line_number().alias("line_number"), F.lit("Skyward Tales").alias("series"), none.cast("array<string>").alias("series_aliases"), F.array(cat("Sora", code(F.col("k")))).alias("characters"), none.cast("array<string>").alias("characters_ja"),
    )


def listed_titles(spark, d) -> DataFrame:
    """Titles 0: of the figure; 1: of another scale; 2: of a rival's; 3: of another number; 4: of twice its size; 5: of goods; 6: rejected; 7: without its last word."""
    name = cat("Sora", code(F.col("k")), " blaze")
    line = cat("Good Smile Company Nendoroid ", line_number())
    title = every(
        8, cat(line, " ", name, " Skyward Tales 1/7 figure"), cat(line, " ", name, " 1/8 figure"), cat("FuRyu Nendoroid ", line_number(), " ", name), cat("Nendoroid ex-", 6000 + F.col("k") % 3000, " ", name), cat(line, " ", name, " 250mm"),
        cat(line, " ", name, " acrylic stand"), cat(line, " ", name), cat("Nendoroid Sora", code(F.col("k"))),
    )
    rejected = F.when(F.col("k") % 8 == 6, F.array(F.col("k").cast("string")))
    return items(spark, d).select(F.col("k").alias("title_id"), title.alias("title"), rejected.alias("rejected"))


MATCHED = f"WITH {ITEMS} SELECT k AS title_id, CASE WHEN k % 8 = 0 THEN k END AS figure_id FROM items"


@query(MATCHED)
def matched_titles(spark, d):
    """Each title's figure, or none where a gate refuses it."""
    return match.best_match(listed_titles(spark, d), catalogue(spark, d)).select("title_id", "figure_id")


@query(f"""WITH {ITEMS}, listed AS (SELECT k, CASE WHEN k % 8 = 0 THEN k END AS figure_id FROM items WHERE k % 8 <> 6)
    SELECT 'listing' AS kind, k % 3 AS source_id, 'x/' || k AS external_id, price AS amount, price * 2 AS amount_usd, figure_id, TIMESTAMP '2001-11-04 00:00:00' AS seen FROM items JOIN listed USING (k)
    UNION ALL SELECT 'listing', k % 3, 'old/' || k, price, price, NULL, TIMESTAMP '2001-01-01 00:00:00' FROM items WHERE k % 5 = 0
    UNION ALL SELECT 'sale', k % 3, 'x/' || k, CASE WHEN k % 16 = 0 THEN price - 1 ELSE price END, CASE WHEN k % 16 = 0 THEN price - 1 ELSE price * 2 END, figure_id, CASE WHEN k % 16 = 0 THEN TIMESTAMP '2001-01-01 00:00:00' ELSE TIMESTAMP '2001-11-04 00:00:00' END
    FROM items JOIN listed USING (k) WHERE figure_id IS NOT NULL""")
def ingested_rows(spark, d):
    """Listings and sales after a poll: listings are seen again or stay, sales keep the price and date that they were first seen with; unmatched sales are dropped."""
    key = F.col("k")
    at = lambda moment: F.lit(moment).cast("timestamp_ntz")
    items_of = listed_titles(spark, d).filter("rejected IS NULL").select(F.col("title_id").alias("k"), "title").join(items(spark, d).select("k", "price"), "k")
    polled = items_of.select((key % 3).alias("source_id"), cat("x/", key).alias("external_id"), "title", F.col("price").alias("amount"), F.lit("EUR").alias("currency"))
    rates = spark.createDataFrame([("EUR", date(2001, 11, 4), 2.0)], "currency string, day date, rate_to_usd double")
    old = items(spark, d)
    listings = old.filter("k % 5 = 0").select(
        (key % 3).alias("source_id"), cat("old/", key).alias("external_id"), F.lit("old").alias("title"), F.col("price").alias("amount"), F.lit("USD").alias("currency"), F.col("price").alias("amount_usd"),
        F.lit(None).cast("long").alias("figure_id"), F.lit(None).cast("double").alias("match_score"), F.lit(False).alias("is_active"), at("2001-01-01").alias("last_seen_at"),
    )
    seen = nightly.ingested_listings(listings, polled, catalogue(spark, d), rates, NOW)
    sales = old.filter("k % 16 = 0").select(
        (key % 3).alias("source_id"), cat("x/", key).alias("external_id"), (F.col("price") - 1).alias("amount"), (F.col("price") - 1).alias("amount_usd"), at("2001-01-01").alias("sold_at"), F.lit(None).cast("long").alias("figure_id")
    )
    sold = nightly.ingested_sales(sales, polled.withColumn("sold_at", at("2001-11-04")), catalogue(spark, d), rates)
    told = lambda rows, kind, when: rows.select(F.lit(kind).alias("kind"), "source_id", "external_id", "amount", "amount_usd", "figure_id", F.col(when).alias("seen"))
    return told(seen, "listing", "last_seen_at").unionByName(told(sold, "sale", "sold_at"))


@query(f"""WITH m AS ({MATCHED}) SELECT title_id, CASE WHEN title_id % 16 = 0 THEN 'gained' WHEN title_id % 8 = 0 THEN 'same' WHEN title_id % 3 = 0 THEN 'lost' ELSE 'same' END AS change FROM m""")
def rematched_titles(spark, d):
    """What a new match changes: held before were the right figure, a wrong one, or none."""
    found = match.best_match(listed_titles(spark, d), catalogue(spark, d))
    before = F.when((F.col("k") % 8 == 0) & (F.col("k") % 16 != 0), F.col("k")).when((F.col("k") % 8 != 0) & (F.col("k") % 3 == 0), F.col("k") + 1)
    held = items(spark, d).select(F.col("k").alias("title_id"), before.alias("figure_id"))
    return match.rematch(held, found).select("title_id", "change")


@query(f"""WITH {ITEMS} SELECT k AS figure_id, CASE k % 4 WHEN 0 THEN 'Sora ' || upper(left({code_sql("k")}, 1)) || substr({code_sql("k")}, 2) WHEN 1 THEN 'Riku ' || upper(left({code_sql("k")}, 1)) || substr({code_sql("k")}, 2) END AS character,
    CASE k % 4 WHEN 0 THEN 'catalogue' WHEN 1 THEN 'cast' END AS source FROM items""")
def derived_characters(spark, d):
    """Each figure's character from the catalogue, else from the cast; what neither has stays open."""
    c = F.initcap(code(F.col("k")))
    rows = items(spark, d)
    who = every(4, cat("Sora ", c), cat("Riku ", c), cat("Kairi ", c), cat("Set of 3 ", c))
    figures = rows.select(F.col("k").alias("figure_id"), F.col("brand").alias("series"), cat("Nendoroid ", who, ": Winter Ver.").alias("name"))
    known = rows.filter("k % 4 = 0").select(F.col("brand").alias("series"), cat("Sora ", c).alias("character"))
    cast = rows.filter("k % 4 < 2").select(F.col("brand").alias("series"), F.when(F.col("k") % 4 == 1, cat("Riku ", c)).otherwise(cat("Sora ", c)).alias("character"))
    return characters.derived(figures, [("catalogue", known), ("cast", cast)])


@query(f"""WITH {ITEMS} SELECT k AS figure_id, {code_sql("k")} || '_(' || lower(kind) || ')' AS tag FROM items WHERE k % 3 = 0""")
def confirmed_tag_rows(spark, d):
    """The most used tag, if all confirmed ones name one character."""
    c = code(F.col("k"))
    rows = items(spark, d)
    tag = lambda name, n, ok: rows.select(F.col("k").alias("figure_id"), name.alias("tag"), F.lit(ok).alias("name_matches"), F.lit(n).alias("post_count"))
    tags = tag(cat(c, "_(", F.lower("kind"), ")"), 9, True).unionByName(tag(c, 5, True)).unionByName(tag(cat("other_", c), 99, False)).unionByName(tag(cat("rival_", c), 7, True).filter("figure_id % 3 = 1"))
    works = tags.select("tag", (~F.col("tag").startswith("zz")).alias("series_matches")).join(rows.filter("k % 3 = 2").select(cat(c, "_(", F.lower("kind"), ")").alias("tag")), "tag", "left_anti")
    return characters.confirmed_tags(tags.filter("figure_id % 3 <> 2"), works)


@query(f"""WITH {ITEMS}, p AS (SELECT k AS figure_id, 'Sora ' || upper(left({code_sql("k")}, 1)) || substr({code_sql("k")}, 2) AS a, 'Riku ' || upper(left({code_sql("k")}, 1)) || substr({code_sql("k")}, 2) AS b FROM items WHERE k % 2 = 0)
    SELECT figure_id, a AS part, a AS character FROM p UNION ALL SELECT figure_id, b, b FROM p""")
def widened_figures(spark, d):
    """Figures of two characters, where both are known in the franchise."""
    c = F.initcap(code(F.col("k")))
    rows = items(spark, d)
    figures = rows.select(F.col("k").alias("figure_id"), cat("figma Sora ", c, " & Riku ", c).alias("name"), F.col("brand").alias("series"), F.col("kind").alias("franchise"))
    people = rows.select(F.col("kind").alias("franchise"), F.col("brand").alias("series"), cat("Sora ", c).alias("character")).unionByName(rows.filter("k % 2 = 0").select(F.col("kind").alias("franchise"), F.lit("other").alias("series"), cat("Riku ", c).alias("character")))
    return characters.widened(figures, people)


@query("""WITH f AS (SELECT l_partkey AS figure_id, l_suppkey AS s, count(*) AS hits FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY figure_id ORDER BY hits DESC, s % 5 DESC) AS r FROM f)
    SELECT figure_id, CASE WHEN count(*) = 1 THEN min('s' || s) END AS series FROM r WHERE r = 1 GROUP BY figure_id""")
def best_series_rows(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("figure_id"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("hits"))
    return characters.best_series(rows.select("figure_id", cat("s", F.col("s")).alias("series"), "hits", (F.col("s") % 5).alias("popularity")))


@query("""SELECT DISTINCT l_partkey AS figure_id, CASE WHEN l_suppkey = 2 THEN 'c1' ELSE 'c' || l_suppkey END AS character FROM lineitem""")
def merged_characters(spark, d):
    """The figures of two characters that are one."""
    bridge = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("figure_id"), cat("c", F.col("l_suppkey")).alias("character")).distinct()
    people = bridge.select("character").distinct().withColumn("aliases", F.array().cast("array<string>"))
    return characters.merged(bridge, people, "c1", "c2")[0]


@query(f"WITH {ITEMS} SELECT k AS title_id, k AS name_id FROM items WHERE k % 3 <> 0")
def titles_with_names(spark, d):
    """Titles that hold all tokens of a name."""
    c = code(F.col("k"))
    rows = items(spark, d)
    titles = rows.select(F.col("k").alias("title_id"), F.array(F.lit("figure"), cat("a", c), every(3, F.lit("other"), cat("b", c), cat("b", c))).alias("tokens"))
    return hygiene.titles_naming(titles, rows.select(F.col("k").alias("name_id"), F.array(F.lit("figure"), cat("a", c), cat("b", c)).alias("tokens")))


@query("""WITH c AS (SELECT DISTINCT l_partkey - CASE WHEN l_partkey % 10 = 1 AND l_partkey > 1 THEN 1 ELSE 0 END AS figure_id, l_suppkey AS source FROM lineitem) SELECT figure_id, source FROM c""")
def rekeyed_children(spark, d):
    """Children of folded figures, moved to the survivors; none stands twice."""
    children = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("figure_id"), F.col("l_suppkey").alias("source")).distinct()
    folds = items(spark, d).filter("k % 10 = 1 AND k > 1").select(F.col("k").alias("figure_id"), (F.col("k") - 1).alias("survivor"))
    return hygiene.rekeyed(children, folds, "figure_id", "source")


@query(f"""WITH {ITEMS} SELECT k AS figure_id, CASE WHEN k % 6 = 0 THEN 'has a number' WHEN k % 4 = 0 THEN 'held by collection, sale' WHEN k % 4 = 2 THEN 'held by sale' END AS refused FROM items WHERE k % 2 = 0""")
def refused_removals(spark, d):
    """Accessories, and why some may not be removed."""
    rows = items(spark, d)
    figures = rows.select(F.col("k").alias("figure_id"), F.when(F.col("k") % 2 == 0, cat(F.col("name"), " decal set")).otherwise(F.col("name")).alias("name"), (F.col("k") % 6 == 0).alias("has_number"))
    held = rows.filter("k % 2 = 0").select(F.col("k").alias("figure_id"), F.lit("sale").alias("kind")).unionByName(rows.filter("k % 4 = 0").select(F.col("k").alias("figure_id"), F.lit("collection").alias("kind")))
    return hygiene.removals(figures, held, T.is_accessory(F.col("name"))).select("figure_id", "refused")


@query(f"""WITH {ITEMS} SELECT least(k, k + 1) AS a, greatest(k, k + 1) AS b, CASE WHEN k % 8 = 0 THEN 'same entry' WHEN k % 8 = 2 THEN 'same name' ELSE 'known alias' END AS evidence FROM items WHERE k % 2 = 0 AND k % 8 < 6 AND k + 1 <= (SELECT max(k) FROM items)""")
def duplicate_series_pairs(spark, d):
    """Pairs of series that one entry, one name or an alias joins; two different entries keep a pair apart."""
    pair = F.floor(F.col("k") / 2)
    c = code(pair)
    rows = items(spark, d)
    own = cat("Saga ", c, F.when(F.col("k") % 8 == 2, "").when(F.col("k") % 8 == 3, "!").otherwise(cat(" z", code(F.col("k")))))
    synonyms = F.when(F.col("k") % 8 == 4, F.array(cat("Saga ", c, " z", code(F.col("k") + 1)))).when(F.col("k") % 8 == 6, F.array(cat("Saga ", c, " z", code(F.col("k") + 1))))
    external = F.when(F.col("k") % 8 < 2, cat("e", pair)).when(F.col("k") % 8 >= 6, cat("e", F.col("k")))
    series = rows.select(F.col("k").alias("id"), external.alias("external_id"), own.alias("name"), F.lit(None).cast("string").alias("title_ja"), synonyms.alias("synonyms"))
    return hygiene.duplicate_evidence(series)


@query("SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def relation_empty(spark, d):
    """Rows that no row of another table names."""
    held = V.table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"))
    titles = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("external_id"), F.col("s_name").alias("title"))
    return hygiene.discovered(titles, held, held.limit(0), least=1).select(F.col("key").alias("k"))


@query("SELECT figure_id, source, CASE WHEN source = 'reissue' THEN price ELSE price END AS price FROM (SELECT p_partkey AS figure_id, CASE WHEN p_partkey % 3 = 0 THEN 'reissue' ELSE 'first' END AS source, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS price FROM part)")
def prices_with_override(spark, d):
    """Two price sources as one: a reissue's price comes before the first release's."""
    rows = items(spark, d)
    first = rows.select(F.col("k").alias("figure_id"), F.lit("first").alias("source"), "price", F.lit(1).alias("rank"))
    again = rows.filter("k % 3 = 0").select(F.col("k").alias("figure_id"), F.lit("reissue").alias("source"), (F.col("price") * 2).alias("price"), F.lit(2).alias("rank"))
    return tables.upsert(first, again, ["figure_id"], "rank").drop("rank")


@query(f"""WITH {ITEMS} SELECT k, list_sort(list_distinct([lower(brand), lower(kind)])) AS names FROM items""")
def united_names(spark, d):
    """Names of two lists, each once whatever its case, in order."""
    both = F.concat(F.array(F.col("brand"), F.col("kind")), F.array(F.upper("brand"), F.lower("kind"), F.lit("x")))
    return items(spark, d).select("k", F.array_sort(F.transform(names.distinct_names(both), lambda n: F.lower(n))).alias("names"))


@query(f"""WITH {ITEMS} SELECT k AS figure_id, CASE WHEN k % 5 = 0 THEN 'sold' WHEN k % 5 = 1 THEN 'msrp' WHEN k % 5 = 2 THEN 'asking' WHEN k % 5 = 3 THEN 'msrp' END AS basis,
    CASE k % 5 WHEN 0 THEN price WHEN 1 THEN price + 1 WHEN 2 THEN price + 2 WHEN 3 THEN price + 1 END AS amount_usd, CASE k % 5 WHEN 1 THEN false WHEN 3 THEN true END AS reissue FROM items""")
def value_bases(spark, d):
    """What a figure's value rests on: sales, the retail price before a release, asks."""
    k, later = F.col("k") % 5, F.lit("2030-01-01").cast("timestamp_ntz")
    rows = items(spark, d).select(
        F.col("k").alias("figure_id"), F.when(k == 0, F.col("price")).alias("market_value_usd"), (F.col("price") + 1).alias("msrp_usd"), F.when(k == 2, F.col("price") + 2).alias("ask_median_usd"), F.lit(3).alias("ask_listings"),
        F.when(k == 1, later).alias("release_date"), F.when(k == 3, later).alias("reissue_due_at"),
    )
    return value.figure_value(rows, NOW).select("figure_id", "basis", "amount_usd", "reissue")


def streamed(spark, d, run) -> DataFrame:
    """What a stream of all events leaves in a table, in micro-batches: run makes the stream's rows from the events."""
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "state")
    landed = fresh_path(spark, "landed")
    events = V.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(landed)
    # one row past all windows, so that the watermark closes them
    last = events.agg((F.max("ts") + F.make_dt_interval(F.lit(400))).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
    rows = run(counters.stream_of(spark, landed, events.schema))

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(out)

    counters.run_available(rows, state, each)
    last.coalesce(1).write.mode("append").parquet(landed)
    counters.run_available(rows, state, each)
    return spark.read.schema(rows.schema).parquet(out)


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, d):
    """Events of each kind and hour, counted by a stream with a watermark."""
    rows = streamed(spark, d, lambda s: counters.window_counts(s, "event_type", "ts", "1 hour"))
    return rows.filter("event_type <> 'end'").select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


@query("SELECT DISTINCT event_id FROM events")
def streamed_once(spark, d):
    """Each notification once, though all land twice."""
    rows = streamed(spark, d, lambda s: counters.once(s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), "event_id", "ts", "400 days"))
    return rows.filter("event_id >= 0").select("event_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions FROM s GROUP BY user_id""")
def streamed_sessions(spark, d):
    """Sessions of each user, by a stream."""
    rows = streamed(spark, d, lambda s: counters.sessions(s, "user_id", "ts"))
    return rows.filter("user_id >= 0").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query(f"""WITH {SALES}, {LISTINGS}, s AS (SELECT figure_id, condition, count(*) AS n FROM sales WHERE condition IN ('NEW_SEALED', 'USED_COMPLETE') GROUP BY ALL)
    SELECT s.figure_id, s.condition, n, low FROM s LEFT JOIN (SELECT figure_id, condition, min(amount_usd) AS low FROM listings WHERE is_active GROUP BY ALL) a ON a.figure_id = s.figure_id AND a.condition = s.condition""")
def sold_beside_asks(spark, d):
    """Snapshot buckets with the lowest ask beside them."""
    days = rollup.with_lowest_ask(rollup.daily_sold(V.sales(spark, d)), V.listings(spark, d))
    return days.groupBy("figure_id", "condition").agg(F.sum("sample_size").cast("long").alias("n"), F.first("lowest_ask_usd").alias("low"))


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, value LIMIT 60")
def facet_head(spark, d):
    return catalog.facet(items(spark, d), "brand")
