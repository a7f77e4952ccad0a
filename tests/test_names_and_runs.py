import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import names, text
from shelfmark.operators import characters, detail, nightly


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


def rows(df, *columns):
    return sorted([tuple(r[c] for c in columns or df.columns) for r in df.collect()], key=repr)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Hatsune Miku (初音ミク)", ("Hatsune Miku", "初音ミク")), ("Ｍｉｋｕ・Rin【初音ミク（限定）】", ("Miku Rin", "初音ミク（限定）")), ("Saber (Reissue)", ("Saber (Reissue)", None)),
        ("Miku: (初音ミ", ("Miku", None)), ("初音ミク（はつね）", ("初音ミク(はつね)", None)), ("A・B", ("A B", None)),
    ],
)
def test_japanese_names(spark, raw, want):
    got = one(spark, raw, names.split_japanese)
    assert (got.name, got.name_ja) == want


@pytest.mark.parametrize(("raw", "want"), [("初音ミク（はつねみく）", ("初音ミク", "はつねみく")), ("body（チアキ）", ("body（チアキ）", None)), ("x (Reissue)", ("x (Reissue)", None)), ("（はつね）", ("（はつね）", None))])
def test_readings(spark, raw, want):
    got = one(spark, raw, names.split_reading)
    assert (got.name, got.reading) == want


def test_tags(spark):
    got = one(spark, "artoria_pendragon_(alter)_(fate)", names.parsed_tag)
    assert (got.name, got.qualifiers) == ("Artoria Pendragon", ["Alter", "Fate"])
    assert one(spark, "Steins;Gate (シュタインズ)", names.alternatives) == ["Steins;Gate", "シュタインズ"]
    assert one(spark, "Good Smile x Alter 1/7 prize", names.maker_in) == "good smile" and one(spark, "1/7 Miku", names.form_in) == "scale"


@pytest.mark.parametrize(
    ("name", "series", "want"),
    [("Nendoroid Hatsune Miku: Racing Ver.", None, ["Hatsune Miku"]), ("Fate/Grand Order Saber", "Fate/Grand Order", ["Fate/Grand Order Saber", "Saber", "Fate", "Grand Order Saber"]), ("Figure Set A", None, []), ("figma Saber (Fate) DX Ver.", None, ["Saber (Fate)", "Saber"])],
)
def test_character_candidates(spark, name, series, want):
    df = spark.createDataFrame([(name, [series] if series else None)], "n string, s array<string>")
    assert df.select(names.character_candidates(F.col("n"), F.col("s")).alias("x")).first().x == want


@pytest.mark.parametrize(("name", "want"), [("Nendoroid Rem & Ram", ["Rem", "Ram"]), ("Rin/Len/Miku 1/7", ["Rin", "Len", "Miku"]), ("Rem", []), ("A & B", []), ("Rem and rem", ["Rem"])])
def test_split_characters(spark, name, want):
    assert one(spark, name, lambda c: names.split_characters(c, F.array().cast("array<string>"))) == want


def test_derived_and_widened(spark):
    figures = spark.createDataFrame([(1, "Nendoroid Hatsune Miku: Racing Ver.", "Vocaloid", "V"), (2, "figma Tohsaka Rin", "Fate", "F"), (3, "Nendoroid Rem & Ram", "Re:Zero", "R"), (4, "Unknown", "Fate", "F")], "figure_id int, name string, series string, franchise string")
    catalogue = spark.createDataFrame([("Vocaloid", "Miku Hatsune"), ("Fate", "Saber"), ("Fate", "Sakura")], "series string, character string")
    cast = spark.createDataFrame([("Fate", "Rin Tousaka"), ("Fate", "Rin Tohsaka"), ("Vocaloid", "Other")], "series string, character string")
    assert rows(characters.derived(figures, [("catalogue", catalogue), ("cast", cast)]))[:2] == [(1, "Miku Hatsune", "catalogue"), (2, "Rin Tohsaka", "cast")]
    people = spark.createDataFrame([("R", "Re:Zero", "Rem"), ("R", "Re:Zero", "Ram"), ("R", "Other", "Rem B")], "franchise string, series string, character string")
    assert rows(characters.widened(figures, people)) == [(3, "Ram", "Ram"), (3, "Rem", "Rem")]
    tags = spark.createDataFrame([(1, "rem_(re:zero)", True, 5), (1, "rem_(maid)_(re:zero)", True, 9), (2, "a", True, 1), (2, "b", True, 1), (3, "c", False, 1)], "figure_id int, tag string, name_matches boolean, post_count int")
    works = spark.createDataFrame([("rem_(re:zero)", True), ("rem_(maid)_(re:zero)", True), ("a", True), ("b", True), ("c", True)], "tag string, series_matches boolean")
    assert rows(characters.confirmed_tags(tags, works)) == [(1, "rem_(maid)_(re:zero)")]
    found = spark.createDataFrame([(1, "a", 2, 5), (1, "b", 2, 9), (2, "a", 1, 1), (2, "b", 1, 1)], "figure_id int, series string, hits int, popularity int")
    assert rows(characters.best_series(found)) == [(1, "b"), (2, None)]
    bridge = spark.createDataFrame([(1, "Miku"), (1, "Hatsune Miku"), (2, "Miku")], "figure_id int, character string")
    cast = spark.createDataFrame([("Miku", ["初音"]), ("Hatsune Miku", None)], "character string, aliases array<string>")
    moved, left = characters.merged(bridge, cast, "Hatsune Miku", "Miku")
    assert rows(moved) == [(1, "Hatsune Miku"), (2, "Hatsune Miku")] and rows(left) == [("Hatsune Miku", ["Miku", "初音"])]


def test_cards_and_children(spark):
    figures = spark.createDataFrame([(1, 7, 3), (2, None, None)], "figure_id int, maker_id int, series_id int")
    makers, series = spark.createDataFrame([(7, "Alter")], "maker_id int, name string"), spark.createDataFrame([(3, "Fate", "F")], "series_id int, name string, franchise string")
    photos = spark.createDataFrame([(1, "http://x/a", True, 0), (1, "https://x/b", False, 1), (1, "https://x/c", False, 2), (2, "bad url", True, 0)], "figure_id int, url string, is_primary boolean, place int")
    got = {r.figure_id: r for r in detail.cards(figures, makers, series, photos).collect()}
    assert got[1].maker.name == "Alter" and got[1].series.franchise == "F" and got[1].photo == "https://x/b" and got[2].photo is None and got[2].maker is None
    sales = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 6.0)], "figure_id int, price double")
    got = {r.figure_id: [x.price for x in r.sales] for r in detail.with_children(figures, "figure_id", {"sales": (sales, [F.desc("price")], 2)}).collect()}
    assert got == {1: [7.0, 6.0], 2: []}


def test_offers_queues_and_profiles(spark):
    offers = spark.createDataFrame([(1, "a", None, 1.0, None), (1, "b", True, 9.0, datetime(2026, 1, 2)), (1, "c", True, 3.0, datetime(2026, 1, 1)), (1, "d", False, 0.5, None), (2, "a", True, 1.0, None)], "figure_id int, source string, available boolean, price double, checked_at timestamp_ntz")
    assert [r[0] for r in sorted(rows(detail.offers_in_order(offers).filter("figure_id = 1"), "source", "place"), key=lambda r: r[1])] == ["c", "b", "a", "d"]
    assert [r.source for r in detail.stale_offers(offers, spark.createDataFrame([(2,)], "figure_id int"), 3).collect()] == ["a", "d", "c"]
    users = spark.createDataFrame([(1, "u", True), (2, "v", False)], "user_id int, username string, is_public boolean")
    held = spark.createDataFrame([(1, 5, 2, "NEW", 9.0), (2, 6, 1, "NEW", 1.0)], "user_id int, figure_id int, quantity int, condition string, paid_usd double")
    assert detail.public_profile(held, users).columns == ["username", "figure_id", "quantity", "condition"] and detail.public_profile(held, users).count() == 1
    products = spark.createDataFrame([(1, "miku", None, "OTHER"), (2, "rem", "Alter", "SCALE"), (3, "ram", None, None)], "product_id int, compared string, maker string, category string")
    figs = spark.createDataFrame([(10, "miku", "GSC", "SCALE"), (11, "rem", "alter ", "SCALE"), (12, "rem", "GSC", "SCALE"), (13, "ram", None, None), (14, "ram", None, None)], "figure_id int, compared string, maker string, category string")
    assert rows(detail.held_products(products, figs)) == [(1, 10), (2, 11)]
    assert [r.name for r in detail.suggested_names(spark.createDataFrame([("Alter",), ("Walter",), ("alteration",), (None,)], "name string"), " ALT ").collect()] == ["Alter", "alteration", "Walter"]
    titles = spark.createDataFrame([("k", ["a", "b"]), ("k", ["a", "c"]), ("k", ["c"]), ("j", ["a"])], "key string, tokens array<string>")
    assert rows(detail.subject_tokens(titles, "key"), "key", "token", "n") == [("k", "a", 2), ("k", "c", 2)]


def test_nightly_run(spark):
    now, day = datetime(2026, 8, 15, 4, 30), date(2026, 8, 14)
    sales = spark.createDataFrame([(1, "NEW_SEALED", 10.0, datetime(2026, 8, 14, 3)), (1, "NEW_SEALED", 20.0, datetime(2026, 8, 14, 23)), (1, "NEW_SEALED", 5.0, datetime(2026, 8, 15, 1)), (2, "NEW_SEALED", 5.0, datetime(2026, 1, 1))], "figure_id int, condition string, amount_usd double, sold_at timestamp_ntz")
    listings = spark.createDataFrame([(1, "NEW_SEALED", x, True, 0.9) for x in (30.0, 40.0, 50.0)] + [(2, "NEW_SEALED", x, True, 0.9) for x in (1.0, 2.0, 3.0)], "figure_id int, condition string, amount_usd double, is_active boolean, match_score double")
    figures = spark.createDataFrame([(1,), (2,), (3,)], "figure_id int")
    old = spark.createDataFrame([(9, "NEW_SEALED", day, 1.0, 1.0, 1.0, 1.0, 1, None, None, None, None, None), (9, "NEW_SEALED", date(2026, 8, 13), 1.0, 1.0, 1.0, 1.0, 1, None, None, None, None, None)], "figure_id int, condition string, day date, min_usd double, median_usd double, avg_usd double, max_usd double, sample_size long, lowest_ask_usd double, ask_min_usd double, ask_median_usd double, ask_max_usd double, ask_count long")
    got = nightly.aggregated(sales, listings, figures, old, day, now)
    assert rows(got["snapshots"], "figure_id", "day", "median_usd", "lowest_ask_usd", "ask_median_usd") == [
        (1, day, 15.0, 30.0, None), (1, now.date(), None, None, 40.0), (2, now.date(), None, None, 2.0), (9, date(2026, 8, 13), 1.0, None, None), (9, day, 1.0, None, None),
    ]
    assert rows(got["figures"], "figure_id", "market_value_usd", "ask_median_usd", "ask_listings") == [(1, 10.0, 40.0, 3), (2, None, 2.0, 3), (3, None, None, 0)]
    assert nightly.purged_sales(sales, now).count() == 3
    log = spark.createDataFrame([("a", True, 5, None), ("a", True, 2, None), ("b", False, 9, "boom"), ("b", True, 1, None)], "source string, ok boolean, n_rows int, error string")
    assert rows(nightly.run_log(log)) == [("a", "SUCCESS", 7, None), ("b", "ERROR", 1, "boom")]


def test_ingest(spark):
    from .test_match import FIGURES, KNOWN

    now = datetime(2026, 8, 15)
    rates = spark.createDataFrame([("EUR", date(2026, 8, 14), 2.0)], "currency string, day date, rate_to_usd double")
    figures = spark.createDataFrame(KNOWN, FIGURES)
    schema = "source_id int, external_id string, title string, amount double, currency string, amount_usd double, figure_id string, match_score double, is_active boolean, last_seen_at timestamp_ntz"
    held = spark.createDataFrame([(1, "a", "old", 1.0, "USD", 1.0, None, None, False, datetime(2026, 1, 1))], schema)
    items = spark.createDataFrame([(1, "a", "Nendoroid Marin Kitagawa Good Smile Company", 5.0, "EUR"), (1, "b", "something else", 7.0, "USD"), (1, "c", "x", 7.0, "XXX")], "source_id int, external_id string, title string, amount double, currency string")
    assert rows(nightly.ingested_listings(held, items, figures, rates, now), "external_id", "amount_usd", "figure_id", "is_active") == [("a", 10.0, "nendo", True), ("b", 7.0, None, True)]
    sold = "source_id int, external_id string, title string, amount double, currency string, amount_usd double, sold_at date, figure_id string"
    kept = spark.createDataFrame([(1, "a", "old", 1.0, "USD", 1.0, date(2026, 1, 1), None)], sold)
    new = items.withColumn("sold_at", F.lit(date(2026, 8, 1)))
    assert rows(nightly.ingested_sales(kept, new, figures, rates), "external_id", "amount_usd", "sold_at", "figure_id") == [("a", 1.0, date(2026, 1, 1), "nendo")]


def test_held_products_make_no_pairs_and_equal_those_that_do(spark):
    rng = random.Random(9)
    some = lambda *values: rng.choice(values)
    products = [(k // 2 if k % 9 == 0 else k, some("a", "b", "c", None), some("X", " x", "y", None, "any"), some("OTHER", "other", "S", None, "all")) for k in range(60)]
    figs = [(k, some("a", "b", "d", None), some("x", "Y ", "z", None, "ANY"), some("OTHER", "s", "t", None, "all", "Other")) for k in range(9)]
    norm = lambda x: x.strip(" ").lower()
    agree = lambda a, b: a is None or b is None or norm(a) == norm(b)
    hits = [(p[0], f[0]) for p in products for f in figs if p[1] is not None and p[1] == f[1] and agree(p[2], f[2]) and (agree(p[3], f[3]) or "OTHER" in (p[3], f[3]))]
    got = detail.held_products(spark.createDataFrame(products, "product_id int, compared string, maker string, category string"), spark.createDataFrame(figs, "figure_id int, compared string, maker string, category string"))
    want = sorted((p, f) for p, f in hits if sum(p == q for q, _ in hits) == 1)
    assert want and rows(got, "product_id", "figure_id") == sorted(want, key=repr)
    # figures meet products as counts: every join is by name, maker and category
    assert all("maker" in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_keys_within_each_other_are_all_found(spark):
    rng = random.Random(4)
    keys = [rng.choice(["", " ", "  "]) * (rng.random() < 0.2) + " ".join(rng.sample(["sora", "riku", "al", "b", "kairi", "mi"], rng.randint(0, 3))) + " " * (rng.random() < 0.2) for _ in range(80)]
    left = spark.createDataFrame([(k, f"s{k % 3}", key) for k, key in enumerate([*keys[:40], None])], "i int, series string, key string")
    right = spark.createDataFrame([(k, f"s{k % 3}", key) for k, key in enumerate(keys[40:])], "j int, series string, k string")
    for within_series in (True, False):
        match = text.names_match(F.col("key"), F.col("k")) | text.same_character(F.col("key"), F.col("k"), within_series)
        want = rows(left.join(right, "series").filter(match), "i", "j")
        assert want and rows(characters.one_within_other(left, right, "series", "key", "k").filter(match), "i", "j") == want
    # a word that all share makes no pairs
    many = lambda side, key: spark.range(300).select(F.col("id").alias(side), F.lit("s").alias("series"), F.concat(F.lit("sora x"), "id").alias(key))
    assert characters.one_within_other(many("i", "key"), many("j", "k"), "series", "key", "k").count() == 300
