from datetime import date, datetime

from shelfmark.operators import backfills


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_barcodes_are_told_by_their_country_and_stay_with_who_holds_them(spark):
    held = spark.createDataFrame([(9, "JAN", "4500000000001")], "figure_id long, kind string, value string")
    figures = spark.createDataFrame([(1, "nendoroid", "10"), (2, "figma", "10"), (3, "figma", None), (4, "figma", "11"), (5, "figma", "12")], "figure_id long, line string, number string")
    products = [(5, "nendoroid", "10", "4900000000009"), (4, "nendoroid", "10", "no code"), (6, "nendoroid", "10", "123456789012"), (1, "figma", "10", "123456789012"), (2, "figma", None, "4500000000007"), (3, "figma", "11", None), (7, "figma", "12", "4500000000001")]
    got = backfills.barcodes(held, figures, spark.createDataFrame(products, "product_id long, line string, number string, code string"))
    assert rows(got) == [(1, "JAN", "4900000000009"), (2, "UPC", "123456789012"), (9, "JAN", "4500000000001")]
    again = backfills.barcodes(got, figures, spark.createDataFrame(products, "product_id long, line string, number string, code string"))
    assert rows(again) == rows(got)


def test_offers_and_folded_printings(spark):
    figures = spark.createDataFrame([(1, "https://www.b.example/x"), (2, "https://evilb.example/x"), (3, None), (4, "b.example/no-scheme")], "figure_id long, store_url string")
    none = spark.createDataFrame([], "figure_id long, source string, url string")
    assert rows(backfills.offers(none, figures, {"b.example": "B"})) == [(1, "B", "https://www.b.example/x")]
    figures = [(1, None, date(2020, 1, 1), 5.0, "JPY"), (2, 1, date(2020, 4, 2), 6.0, "JPY"), (3, 1, date(2020, 4, 3), 7.0, "JPY"), (4, 1, None, 8.0, "JPY"), (5, 77, date(2022, 1, 1), 9.0, "JPY")]
    printings = spark.createDataFrame([(1, "3", None, None, None)], "figure_id long, printing_key string, release_date date, price double, currency string")
    got = backfills.folded_printings(printings, spark.createDataFrame(figures, "figure_id long, superseded_by long, release_date date, price double, currency string"))
    assert rows(got) == [(1, "3", date(2020, 4, 3), 7.0, "JPY")]  # 92 days apart is the same printing, 93 is another


def test_japanese_names(spark):
    figures = spark.createDataFrame([(1, "ねんどろいど ミク", None), (2, "ねんどろいど", "held"), (3, "初音ミク", None), (4, None, "r"), (5, "かな", None), (6, "名", "x")], "figure_id long, name_ja string, reading string")
    names = spark.createDataFrame([(1, "ねんどろいど 初音ミク", None), (4, "新", "しん"), (5, None, "z"), (6, "名", "め"), (6, "名", "め")], "figure_id long, page_name string, page_reading string")
    assert rows(backfills.japanese_names(figures, names)) == [(1, "ねんどろいど 初音ミク", "ねんどろいど ミク"), (2, None, "held"), (3, "初音ミク", None), (4, "新", "しん"), (5, None, "かな"), (6, "名", "め")]


def test_a_sitemap_has_room_for_so_many(spark):
    figures = spark.createDataFrame([(f"f{k}", datetime(2026, 1, 1 + k % 5), None if k % 3 else "other") for k in range(12)], "slug string, updated_at timestamp_ntz, superseded_by string")
    got = rows(backfills.sitemap(figures, [("", "daily", 1.0)], "https://x", 5))
    assert [r[0] for r in got] == ["https://x", "https://x/figures/f2", "https://x/figures/f4", "https://x/figures/f7", "https://x/figures/f8"]
