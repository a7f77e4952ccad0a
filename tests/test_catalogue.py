"""Rules that the driver's tables cannot show: nulls, ties, orphans, edges of dates and rounding."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import dates, semantics
from shelfmark.operators import catalog, fx, hygiene, lifecycle, rollup, tables, value
from shelfmark.sources import feeds, pages

NOW = datetime(2026, 8, 15, 12)


def rows(df, *columns):
    return sorted([tuple(r[c] for c in columns or df.columns) for r in df.collect()], key=repr)


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-0.125,), (0.125,), (None,)], "x double")
    got = df.select(semantics.half_up(F.col("x")).alias("a"), semantics.half_away(F.col("x")).cast("double").alias("b")).collect()
    assert [r.a for r in got] == [1.0, 2.68, -0.12, 0.13, None] and [r.b for r in got] == [1.01, 2.68, -0.13, 0.13, None]


def test_ordinals_and_money(spark):
    df = spark.createDataFrame([("DAMAGED",), ("NEW_SEALED",), (None,), ("?",)], "c string")
    assert [r.x for r in df.select(semantics.ordinal(F.col("c"), semantics.CONDITIONS).alias("x")).collect()] == [5, 1, 7, 7]
    money = spark.createDataFrame([(1234.5, "JPY"), (1234.5, "USD")], "v double, c string").select(semantics.money_text(F.col("v"), F.col("c")).alias("x"))
    assert [r.x for r in money.collect()] == ["JPY 1,234", "USD 1,234.50"]
    trend = spark.createDataFrame([(0.04,), (5.0,), (-1.0,), (None,)], "v double").select(semantics.trend(F.col("v")).alias("x"), semantics.percent_text(F.col("v")).alias("p")).collect()
    assert [r.x for r in trend] == ["flat", "up", "down", "flat"] and trend[1].p == "+5.0%"


@pytest.mark.parametrize(
    ("text", "want"),
    [("15 Aug 2026", (date(2026, 8, 15), "DAY")), ("Aug 2026", (date(2026, 8, 15), "MONTH")), ("2026年8月", (date(2026, 8, 15), "MONTH")), ("2026年8月3日", (date(2026, 8, 3), "DAY")), ("2026/02/31", None), ("2026/08", (date(2026, 8, 15), "MONTH")), ("Early May 2027", (date(2027, 5, 15), "MONTH")), ("soon", None)],
)
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(dates.parsed_date(F.col("t")).alias("d")).first().d
    assert (tuple(got) if got else None) == want


def test_stats_windows_and_division_by_zero(spark):
    sales = [(1, "NEW_SEALED", 10.0, datetime(2026, 8, 1)), (1, "NEW_SEALED", 20.0, datetime(2026, 7, 16, 12)), (1, "NEW_SEALED", 8.0, datetime(2026, 7, 1)), (2, "NEW_SEALED", 5.0, datetime(2026, 6, 1)), (3, "NEW_SEALED", 5.0, datetime(2026, 8, 1)), (3, "NEW_SEALED", 0.0, datetime(2026, 7, 1)), (4, "DAMAGED", 1.0, datetime(2026, 8, 1)), (5, "NEW_SEALED", 1.0, datetime(2025, 8, 1))]
    df = spark.createDataFrame(sales, "figure_id int, condition string, amount_usd double, sold_at timestamp_ntz")
    assert rows(rollup.figure_stats(df, NOW)) == [(1, 15.0, 87.5, 3), (2, 5.0, None, 1), (3, 5.0, None, 2)]
    figures = spark.createDataFrame([(1,), (9,)], "figure_id int")
    assert rows(rollup.with_figure_stats(figures, df, NOW)) == [(1, 15.0, 87.5, 3), (9, None, None, 0)]


def test_history_prefers_sales_and_drops_empty_days(spark):
    days = spark.createDataFrame([(1, "N", date(2026, 1, 1), 0.0, 0.0, 0.0, 1, 5.0, 5.0, 5.0, 3), (1, "N", date(2026, 1, 2), None, None, None, None, 4.0, 5.0, 6.0, 3), (1, "N", date(2026, 1, 3), *[None] * 8)], "figure_id int, condition string, day date, min_usd double, median_usd double, max_usd double, sample_size long, ask_min_usd double, ask_median_usd double, ask_max_usd double, ask_count long")
    assert rows(rollup.day_values(days), "median", "volume", "basis") == [(0.0, 1, "sold"), (5.0, 3, "asking")]


def test_null_scores_and_inactive_listings(spark):
    ask = [(1, "NEW_SEALED", 10.0, True, 0.9)] * 2 + [(1, "NEW_SEALED", 12.0, True, None), (2, "NEW_SEALED", 1.0, True, 0.72), (2, "NEW_SEALED", 2.0, True, 0.72), (2, "NEW_SEALED", 4.0, True, 0.72), (2, "NEW_SEALED", 0.5, False, 0.9), (None, "NEW_SEALED", 1.0, True, 0.9)]
    df = spark.createDataFrame(ask, "figure_id int, condition string, amount_usd double, is_active boolean, match_score double")
    assert rows(rollup.ask_snapshot(df, NOW.date()), "figure_id", "ask_min_usd", "ask_median_usd", "ask_max_usd", "ask_count") == [(2, 1.0, 2.0, 4.0, 3)]


def test_values_by_basis(spark):
    later, past = datetime(2027, 1, 1), datetime(2020, 1, 1)
    figs = [(1, 0.0, 5.0, 4, 9.0, past, None), (2, None, 5.0, 4, 9.0, later, None), (3, None, 5.0, None, 9.0, past, later), (4, None, 5.0, 4, 9.0, past, None), (5, None, None, 0, 9.0, past, None), (6, None, 5.0, 4, None, later, None)]
    df = spark.createDataFrame(figs, "id int, market_value_usd double, ask_median_usd double, ask_listings int, msrp_usd double, release_date timestamp_ntz, reissue_due_at timestamp_ntz")
    assert rows(value.figure_value(df, NOW), "id", "amount_usd", "basis", "listings", "reissue") == [(1, 0.0, "sold", 0, None), (2, 9.0, "msrp", 0, False), (3, 9.0, "msrp", 0, True), (4, 5.0, "asking", 4, None), (5, None, None, None, None), (6, 5.0, "asking", 4, None)]


def test_screening(spark):
    cases = [(61.0, "sales", 240.0, None), (959.0, "sales", 240.0, None), (2400.0, "sales", 240.0, None), (59.0, "sales", 240.0, None), (1.0, "msrp", None, 100.0), (20.0, "msrp", None, 100.0), (2000.0, "none", None, None), (2001.0, "none", None, None)]
    got = value.screen(spark.createDataFrame(cases, "amount double, kind string, median_usd double, msrp_usd double")).collect()
    assert [r.status == "APPROVED" for r in got] == [True, True, False, False, False, True, True, False]


def test_longest_prefix_of_any_length(spark):
    names = spark.createDataFrame([(1, "x" * 1500 + " b"), (2, "xy"), (3, "b")], "id int, name string")
    prefixes = spark.createDataFrame([("x" * 1200,), ("x",), ("x" * 1400,)], "prefix string")
    assert rows(hygiene.longest_prefix(names, prefixes), "id", "prefix") == [(1, "x" * 1400), (2, "x"), (3, None)]


def test_as_of_reaches_over_many_spans(spark):
    daily = spark.createDataFrame([("JPY", date(2026, 1, 1), 0.01)], "currency string, day date, rate_to_usd double")
    asked = spark.createDataFrame([(m, "JPY", date(2026, m, 15)) for m in range(1, 13)], "id int, currency string, day date")
    assert rows(fx.as_of(asked, daily, 320), "id", "rate_to_usd") == sorted([(m, 0.01 if m < 12 else None) for m in range(1, 13)], key=repr)


def test_fx_means_gaps_and_tiers(spark):
    quotes = spark.createDataFrame([("jpy", date(2026, 1, 5), 100.0), ("JPY", date(2026, 1, 6), 200.0), ("EUR", date(2026, 1, 6), 0.5), ("EUR", date(2026, 1, 7), -1.0)], "currency string, day date, per_usd double")
    assert rows(fx.monthly(quotes)) == [("EUR", date(2026, 1, 1), 2.0, 1), ("JPY", date(2026, 1, 1), 0.0075, 2)]
    daily = fx.inverted(quotes)
    asked = spark.createDataFrame([(1, "JPY", date(2026, 1, 13)), (2, "JPY", date(2026, 1, 14)), (3, "JPY", date(2026, 1, 4)), (4, "XXX", date(2026, 1, 6)), (5, "JPY", date(2026, 1, 5))], "id int, currency string, day date")
    assert rows(fx.as_of(asked, daily), "id", "rate_to_usd") == [(1, 0.005), (2, None), (3, None), (4, None), (5, 0.01)]
    prices = [(1, 100.0, "JPY", date(2026, 1, 6), "DAY"), (2, 100.0, "JPY", date(2026, 1, 31), "DAY"), (3, 100.0, "JPY", None, "DAY"), (4, 100.0, "XXX", date(2026, 1, 6), "DAY"), (5, 100.0, "USD", date(2026, 1, 6), "MONTH"), (6, 100.0, "JPY", date(2025, 1, 6), "DAY"), (7, 100.0, "eur", None, "DAY")]
    got = fx.historical(spark.createDataFrame(prices, "id int, amount double, currency string, day date, precision string"), daily, fx.monthly(quotes), "USD")
    assert rows(got) == [(1, 0.5, "release"), (2, 0.75, "release"), (3, 0.5, "today"), (4, None, None), (5, 100.0, "release"), (6, 0.5, "today"), (7, 200.0, "today")]
    good, bad = fx.to_usd(spark.createDataFrame([(1.0, "usd"), (2.0, "EUR"), (3.0, "XXX")], "amount double, currency string"), daily)
    assert rows(good, "amount_usd") == [(1.0,), (4.0,)] and rows(bad, "currency") == [("XXX",)]


def test_sorts_place_nulls_and_break_ties(spark):
    figs = [(2, "b", None, 1, 5.0, None), (1, "a", 3.0, 1, None, date(2020, 1, 1)), (3, "c", 3.0, None, 5.0, date(2021, 1, 1))]
    df = spark.createDataFrame(figs, "figure_id int, name string, change_30d_pct double, volume_90d int, market_value_usd double, release_date date")
    order = lambda sort: [r.figure_id for r in catalog.page(df, sort).collect()]
    assert (order("trending"), order("value-desc"), order("value-asc"), order("newest"), order("name")) == ([2, 1, 3], [2, 3, 1], [2, 3, 1], [2, 3, 1], [1, 2, 3])
    assert catalog.page(df, "name", 5, 2).count() == 0 and catalog.page_count(df.filter("false")).first().pages == 1
    assert catalog.query_tokens(" 1/7  Miku  a ミク, miku") == ["1/7", "miku", "ミク"] and catalog.query_tokens("a") == []


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (1, "z", 0)], "k int, v string, at int")
    assert rows(tables.upsert(old, new, ["k"], "at")) == [(1, "a", 1), (2, "c", 1), (3, "d", 2)]
    assert rows(tables.upsert_partly(old, new, ["k"], ["v"])) == [(1, "z", 1), (2, "c", 1), (3, "d", 2)]
    assert rows(tables.insert_if_absent(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(tables.update_from(old, new, ["k"], ["v"]), "k", "v", "changed") == [(1, "z", True), (2, "c", True)]
    assert rows(tables.update_where(old, F.col("v") == "a", {"at": F.lit(9)}), "k", "at") == [(1, 9), (2, 1)]
    assert rows(tables.replace_part(old, new.filter("k = 3").withColumn("at", F.lit(1)), "at"), "k") == [(3,)]
    with pytest.raises(ValueError, match="empty feed"):
        tables.checked_sync(old, new.filter("false"), "k")
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": None})], "o map<string,string>, n map<string,string>")
    assert maps.select(tables.changed_fields(maps, "o", "n").alias("x")).first().x == {"b": "3"}
    zipped = spark.createDataFrame([(7, [1, 2], ["x", "y"])], "id int, a array<int>, b array<string>")
    assert rows(tables.zipped(zipped, ["a", "b"], ["id"])) == [(7, 1, "x"), (7, 2, "y")]


def test_written_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, part string")
    tables.write_version(df, str(tmp_path / "t"), ["part"])
    tables.write_version(df.filter("part = 'x'").withColumn("k", F.lit(5)).select("k", "part"), str(tmp_path / "t"), ["part"])
    assert rows(spark.read.parquet(str(tmp_path / "t")), "k", "part") == [(2, "y"), (5, "x")]


def test_series_duplicates(spark):
    series = [(1, "Fate/Stay Night", None, None, 10, 5), (2, "fate stay night", None, None, None, 9), (3, "Re:Zero", "リゼロ", ["Re Zero Kara"], 20, 1), (4, "RE ZERO KARA", None, None, None, 2), (5, "Fate", None, None, None, 1), (6, "Character Vocal Series 01: Hatsune Miku", None, None, None, 3), (7, "Hatsune Miku", None, None, None, 4), (8, "Re:Zero", None, None, 21, 8), (9, "Other", None, None, 10, 0)]
    df = spark.createDataFrame(series, "id int, name string, title_ja string, synonyms array<string>, external_id int, figure_count int")
    pairs = {(a, b): e for a, b, e in rows(hygiene.duplicate_evidence(df))}
    assert pairs[1, 2] == "same name" and pairs[3, 4] == "known alias" and pairs[1, 9] == "same entry" and pairs[6, 7] == "one contains the other"
    assert (3, 8) not in pairs and (1, 5) not in pairs
    assert rows(hygiene.duplicate_series(df)) == [(1, 1, 1), (2, 1, 1), (3, 3, 3), (4, 3, 3), (9, 1, 1)]


def test_links_by_priority(spark):
    schema = "name_ja string, jan string, maker string, scale string, height_mm int, release_date date"
    figs = spark.createDataFrame([(1, "花火", "45", "Alter", "1/7", 200, date(2026, 5, 1)), (2, "双子", None, "Alter", "1/8", 200, date(2026, 5, 1)), (3, "双子", None, "Alter", "1/6", 210, date(2026, 5, 9))], f"figure_id int, {schema}")
    products = spark.createDataFrame([("a", "花 火", None, "ALTER", None, None, None), ("b", "双子", None, "Alter", "1/8", 200, date(2026, 5, 20)), ("c", None, None, "alter ", "1/6", 210, date(2026, 5, 30)), ("d", None, "45", None, None, None, None), ("e", None, None, None, "1/7", 200, date(2026, 5, 1))], f"id string, {schema}")
    assert rows(hygiene.linked_products(products, figs), "id", "figure_id", "by") == [("a", 1, "name"), ("b", None, None), ("c", 3, "specs"), ("d", 1, "jan"), ("e", None, None)]


def test_words_of_all_titles_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(hygiene, "HOT", 3)
    titles = [(i, ["figure", f"a{i % 7}", f"b{i % 3}", "pvc"]) for i in range(40)] + [(40, ["figure", "figure"]), (41, None), (42, [None, "a1"])]
    names = [(100 + i, ["figure", f"a{i}", f"b{i % 4}"]) for i in range(8)] + [(200, ["pvc"]), (201, ["pvc", "figure"]), (202, ["gone"]), (203, []), (204, [None, "a1"])]
    seen, real = [], hygiene.leading_rows
    monkeypatch.setattr(hygiene, "leading_rows", lambda *a: seen.append(real(*a)) or seen[-1])
    got = hygiene.titles_naming(spark.createDataFrame(titles, "title_id int, tokens array<string>"), spark.createDataFrame(names, "name_id int, tokens array<string>"))
    want = [(t, n) for t, has in titles for n, wanted in names if has and wanted and None not in wanted and set(wanted) <= set(has)]
    assert rows(got) == sorted(want, key=repr) and len(want) > 80
    left = {r.token for r in seen[0].select("token").distinct().collect()}
    assert "figure" not in left and "pvc" in left  # pvc is a name's rarest


def test_folds_and_small_joins(spark):
    children = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "z")], "figure_id int, code string")
    folds = spark.createDataFrame([(1, 1), (2, 1)], "figure_id int, survivor int")
    assert rows(hygiene.rekeyed(children, folds, "figure_id", "code")) == [(1, "x"), (1, "y"), (3, "z")]
    titles = spark.createDataFrame([(1, ["marin", "kitagawa", "figure"]), (2, ["marin"])], "title_id int, tokens array<string>")
    names = spark.createDataFrame([(9, ["kitagawa", "marin"])], "name_id int, tokens array<string>")
    assert rows(hygiene.titles_naming(titles, names)) == [(1, 9)]
    figs = spark.createDataFrame([(1, "decal set", True), (2, "decal set", False), (3, "decal set", False), (4, "Miku", False)], "figure_id int, name string, has_number boolean")
    held = spark.createDataFrame([(3, "listing")], "figure_id int, kind string")
    from shelfmark.functions.text import is_accessory

    assert rows(hygiene.removals(figs, held, is_accessory(F.col("name"))), "figure_id", "refused") == [(1, "has a number"), (2, None), (3, "held by listing")]


def test_printings(spark):
    data = [(1, 1, "original", None, date(2026, 1, 1), None, None, None), (1, 2, "reissue", None, date(2026, 6, 1), None, None, "j"), (1, 3, "reissue", "2nd", date(2026, 9, 1), 5.0, "JPY", None), (1, 4, "reissue", None, date(2026, 9, 2), 6.0, "JPY", None), (1, 5, "reissue", None, None, 7.0, "JPY", None)]
    df = spark.createDataFrame(data, "figure_id int, printing_id int, kind string, label string, release_date date, price double, currency string, jan string")
    got = [(r.label, r.release_date, r.price, r.jan) for r in lifecycle.folded_printings(df).collect()]
    assert sorted(got, key=repr) == sorted([("Original", date(2026, 1, 1), None, None), ("2nd", date(2026, 6, 1), 5.0, "j"), ("Reissue", date(2026, 9, 2), 6.0, None), ("Reissue", None, 7.0, None)], key=repr)


def test_msrp_actions(spark):
    figs = spark.createDataFrame([(1, True, 1000.0, "JPY", 10.0), (2, True, 1000.0, "JPY", 5.0), (3, False, 1000.0, "JPY", 5.0), (4, True, 1.0, "XXX", None), (5, True, None, None, None), (6, True, 1000.0, "JPY", 10.0), (7, False, None, None, None)], "figure_id int, pending boolean, price double, currency string, msrp_usd double")
    reissues = spark.createDataFrame([(6, 2000.0, "JPY")], "figure_id int, price double, currency string")
    rates = spark.createDataFrame([("JPY", 0.01)], "currency string, rate_to_usd double")
    assert rows(lifecycle.msrp_in_usd(figs, reissues, rates)) == [(1, 10.0, "keep"), (2, 10.0, "set"), (3, None, "clear"), (4, None, "unconvertible"), (5, None, "keep"), (6, 20.0, "set"), (7, None, "keep")]


def test_feeds(spark):
    raw = ['{"itemId":"1","title":"t","price":{"value":"5.5","currency":"eur"}}', '{"itemId":"2","title":"t","price":{"value":"0"}}', '{"itemId":"3","price":{"value":"5"}}', '{"itemId":"4","title":"t","price":{"value":"NaN"}}', "broken", '{"itemId":"5","title":"t","price":{"value":"7"},"shippingOptions":[{"shippingCost":{"value":"2"}}]}']
    got = feeds.listings_from_json(spark.createDataFrame([(x,) for x in raw], "j string"), "j")
    assert rows(got, "external_id", "amount", "currency", "shipping") == [("1", 5.5, "EUR", None), ("5", 7.0, "USD", 2.0)]
    days = spark.createDataFrame([('{"rates":{"2026-01-05":{"JPY":100,"EUR":0.5}}}',)], "j string")
    assert rows(feeds.rates_from_json(days, "j"), "currency", "per_usd") == [("EUR", 0.5), ("JPY", 100.0)]
    ids = spark.range(5)
    assert [r.id for r in feeds.resumed(ids, "id", 2, 4).collect()] == [3, 4, 0, 1]


def test_pages(spark):
    spec = "<dl><dt>x</dt><dd>y</dd></dl><dl><dt>Product Name</dt><dd>Miku &amp; Co</dd><dt>Price</dt><dd>¥12,800</dd><dt>Release Date</dt><dd>2026/08</dd><dt>Specifications</dt><dd>1/7 scale, Height: 23.5cm</dd><dt>Price</dt><dd>¥1</dd></dl>"
    got = pages.product_fields(spark.createDataFrame([(1, spec), (2, "<p>none</p>"), (3, None)], "id int, html string")).collect()
    assert (got[0].name, got[0].price_jpy, got[0].scale, got[0].height_mm, got[0].release_date, got[0].precision) == ("Miku & Co", 12800, "1/7", 235, date(2026, 8, 15), "MONTH")
    assert got[1].name is None and got[2].name is None
    block = '<script type="application/ld+json">%s</script>'
    html = [block % '{"@graph":[{"x":1},{"@type":["Thing","Product"],"name":"N","gtin13":"45","offers":[{"price":"12.5","priceCurrency":"USD","availability":"https://schema.org/OutOfStock"}]}]}', block % "broken" + block % '{"@type":"Product","name":"M"}', "<p>", None]
    got = pages.json_ld_products(spark.createDataFrame([(h,) for h in html], "html string")).select("product.*").collect()
    assert [(r.name, r.price, r.available) for r in got] == [("N", 12.5, False), ("M", None, None), (None, None, None), (None, None, None)]
    shop = 'x let variantItems = [{"code":"a","name":"br]ack\\"et","price":5,"available":true}]; y'
    assert pages.embedded_variants(spark.createDataFrame([(shop,), ("no",)], "html string")).collect()[0].variants[0].name == 'br]ack"et'
    store = 'dataLayer.push({"ecommerce":{"items":[{"item_id":"7","item_name":"Z","price":10}]}}); 2026/08/01 12:00 ~ 2026/09/01'
    got = pages.data_layer(spark.createDataFrame([(store,), ("dataLayer.push({broken);",)], "html string")).collect()
    assert got[0].item.name == "Z" and got[0].opens_at == datetime(2026, 8, 1, 3) and got[0].closes_at == datetime(2026, 9, 1, 14, 59) and got[1].item.name is None
    verdicts = pages.response_verdicts(spark.createDataFrame([(404, ""), (200, "ok"), (500, "x"), (200, "Page Not Found")], "status int, html string"))
    assert [r.verdict for r in verdicts.collect()] == ["gone", "ok", "transient", "gone"]
    with pytest.raises(ValueError, match="every page"):
        pages.checked_verdicts(verdicts.filter("verdict = 'gone'").union(verdicts.filter("verdict = 'gone'")))
    tiles = '<div class="hitItem nendoroid" data-id="12"><a><img src="i.jpg" alt="A &amp; B"><span class="num">34</span></a></div><div class="hitItem" data-id="13"><img src="j.jpg" alt="C"></div>'
    assert rows(pages.archive_tiles(spark.createDataFrame([(tiles,)], "html string")), "product_id", "number", "name", "image") == [("12", "34", "A & B", "i.jpg"), ("13", "", "C", "j.jpg")]


def test_null_keys_and_ties_of_keyed_changes(spark):
    schema = "k long, v long, w string"
    old = spark.createDataFrame([(1, 1, "a"), (None, 2, "b"), (None, 3, "c")], schema)
    new = spark.createDataFrame([(1, 9, "z"), (2, 8, "y"), (2, 7, "x"), (None, 6, "n")], schema)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    want = lambda *x: sorted(map(str, x))
    assert rows(tables.upsert_partly(old, new, ["k"], ["v"])) == want((1, 9, "a"), (2, 7, "x"), (None, 2, "b"), (None, 3, "c"), (None, 6, "n"))
    assert rows(tables.insert_if_absent(old, new, ["k"])) == want((1, 1, "a"), (2, 7, "x"), (None, 2, "b"), (None, 3, "c"), (None, 6, "n"))
    assert rows(tables.upsert(old, new, ["k"], "v")) == want((1, 9, "z"), (2, 8, "y"), (None, 2, "b"), (None, 3, "c"), (None, 6, "n"))


def test_replication_refuses_a_child_before_its_parent(spark):
    rows = spark.createDataFrame([(1, 1)], "a long, b long")
    with pytest.raises(ValueError, match="before"):
        tables.replicated({"x": rows, "y": rows}, [("x", "a", "y")], ["x", "y"])
