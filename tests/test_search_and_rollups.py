"""Search by runs of characters, medians of large keys, a run's log, changes computed anew, printings."""

import random
import re
from datetime import date, datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog, lifecycle, medians, refresh, rollup, run_log, search_index

WORDS = ["miku", "hatsune", "rem", "re:zero", "1/7", "1/12", "Épée", "日本語", "🙂🙂x", "aa", "ab", "b", "racing", "2024", "x"]


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(6))).lower() or None, " ".join(rng.choices(WORDS, k=2)) if k % 9 else None) for k in range(400)]
    return spark.createDataFrame(rows, "figure_id long, search_text string, name string").cache()


def test_search_finds_what_a_look_at_all_rows_finds(spark, catalogue, tmp_path):
    index = search_index.build(catalogue, str(tmp_path / "index"), "figure_id", [F.col("search_text"), F.lower("name")])
    for query in ["miku", "Hatsune MIKU", "1/7 rem", "aa ab", "é", "épée", "日本語 rem", "🙂🙂", "b", "", "nothing-here", "zero re", "2024 racing 1/12", "aa"]:
        found = search_index.search(index, catalogue, query)
        want = catalogue.filter(catalog.matches_query(query))
        assert sorted(r.figure_id for r in found.collect()) == sorted(r.figure_id for r in want.collect()), query


def test_a_search_reads_the_rarest_run_alone(spark, catalogue, tmp_path):
    index = search_index.build(catalogue, str(tmp_path / "index"), "figure_id", [F.col("search_text"), F.lower("name")])
    sizes = {r.run: r.n for r in index.sizes.collect()}
    rarest = min(search_index.token_runs("racing") + search_index.token_runs("miku"), key=lambda r: (sizes[r], r))
    plan = search_index.search(index, catalogue, "racing miku")._jdf.queryExecution().executedPlan().toString()
    assert f"(folder#" in plan and f"= {search_index.folder_of(rarest)})" in plan and f"EqualTo(run,{rarest})" in plan
    folders = {r.folder for r in index.postings.select("folder").distinct().collect()}
    assert len(folders) > 5


def test_postings_of_many_rows_are_one_row(spark, tmp_path):
    texts = ["the cat", "the 🙂🙂x", None, "t", "", "a" * 50, "the"]
    rows = spark.createDataFrame([(k, texts[k % 7], "the") for k in range(700)], "id string, a string, b string").coalesce(1)
    index = search_index.build(rows, str(tmp_path / "index"), "id", [F.col("a"), F.col("b")])
    want = {}
    for k in range(700):
        for t in (texts[k % 7] or "", "the"):
            for r in (t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)):
                want.setdefault(r, set()).add(str(k))
    got = {}
    for r in index.postings.collect():
        assert r.n == len(r.ids) and not got.setdefault(r.run, set()) & set(r.ids)
        got[r.run] |= set(r.ids)
    assert got == want and {r.run: r.n for r in index.sizes.collect()} == {r: len(ids) for r, ids in want.items()}
    assert index.postings.count() < sum(map(len, want.values())) / 4


def test_many_searches_at_once(spark, catalogue, tmp_path):
    index = search_index.build(catalogue, str(tmp_path / "index"), "figure_id", [F.col("search_text"), F.lower("name")])
    queries = [(1, ["miku"]), (2, ["rem", "zero"]), (3, ["aa"]), (4, ["never"]), (5, ["🙂🙂x", "ab"]), (6, []), (7, ["miku"])]
    got = search_index.searched(index, catalogue, spark.createDataFrame(queries, "query_id long, tokens array<string>"), "figure_id", [F.col("search_text"), F.lower("name")])
    want = [(q, r.figure_id) for q, tokens in queries if tokens for r in catalogue.collect() if all(t in (r.search_text or "") or t in (r.name or "").lower() for t in tokens)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def values(rng, n):
    return [rng.choice([None, 0.0, -0.0, 1.0, 1e300, -1e300, 5e-324, rng.uniform(-100, 100), rng.uniform(0, 1), float(rng.randrange(5))]) for _ in range(n)]


def test_medians_equal_plain_ones(spark):
    rng = random.Random(8)
    keys = {("hot", "x"): 4000, (None, "x"): 301, ("b", None): 2, ("c", "y"): 1, ("d", "y"): 999}
    rows = [(a, b, v) for (a, b), n in keys.items() for v in values(rng, n)] + [("none", "z", None)] * 3 + [("same", "z", 7.5)] * 50
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "a string, median string, n double")
    got = {(r["a"], r["median"]): (r["mid"], r["count"]) for r in medians.medians(frame, ["a", "median"], "n", "mid").withColumnRenamed("n", "count").collect()}
    for key in {(a, b) for a, b, _ in rows}:
        held = [v for a, b, v in rows if (a, b) == key and v is not None]
        assert got[key] == (pytest.approx(median(held), rel=1e-15) if held else None, len(held))
    assert medians.medians(frame.filter("false"), ["a"], "n").count() == 0
    whole = medians.medians(frame.withColumn("k", F.lit(1)), ["k"], "n").first()
    assert whole.median == frame.agg(F.median("n")).first()[0]


def test_ranges_keep_the_order(spark):
    rng = random.Random(1)
    held = sorted({v for v in values(rng, 3000) if v is not None} | {2.0**k for k in range(-300, 300)} | {-(2.0**k) for k in range(-300, 300)})
    got = [r.p for r in spark.createDataFrame([(v,) for v in held], "v double").coalesce(1).select(medians.range_of(F.col("v")).alias("p")).collect()]
    assert got == sorted(got) and len(set(got)) > 1200


def test_a_key_with_all_rows_is_spread_over_tasks(spark):
    rows = spark.range(40_000).select(F.lit("one").alias("k"), (F.exp(F.rand(3) * 8)).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = rows.select("k", F.col("v").cast("double").alias("v")).withColumn("part", medians.range_of(F.col("v")))
        tasks = frame.groupBy("k", "part").agg(F.count("*").alias("n")).groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()
        assert len(tasks) == 4 and max(r.n for r in tasks) < 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_run_log_counts_what_was_written(spark, tmp_path):
    clock = iter(datetime(2026, 1, 1) + timedelta(seconds=k) for k in range(20))
    log = run_log.RunLog(spark, lambda: next(clock))
    rows = spark.range(10).select("id", F.when(F.col("id") > 3, F.col("id")).alias("figure_id"))
    kept = log.write("a", lambda: rows, str(tmp_path / "a"), matched=F.col("figure_id").isNotNull(), none=F.lit(None).cast("boolean"))
    assert kept.count() == 10
    assert log.write("b", lambda: rows.withColumn("id", F.raise_error(F.lit("quota is used up")).cast("long")), str(tmp_path / "b")) is None
    assert log.write("c", lambda: 1 / 0, str(tmp_path / "c")) is None
    assert log.write("d", lambda: rows.limit(0), str(tmp_path / "d"), matched=F.col("id") > 0).count() == 0
    got = [(r.source, r.status, r.n_rows, r.counts, r.error) for r in log.rows().collect()]
    assert got == [("a", "SUCCESS", 10, {"matched": 6, "none": 0}, None), ("b", "ERROR", 0, {}, "quota is used up"), ("c", "ERROR", 0, {}, "division by zero"), ("d", "SUCCESS", 0, {"matched": 0}, None)]
    assert all(r.started_at < r.finished_at for r in log.rows().collect())


def test_what_changed_is_computed_anew_and_nothing_else(spark):
    rng = random.Random(6)
    now, start = datetime(2026, 5, 1), datetime(2026, 3, 1)
    sales = [(f"s{k}", rng.choice([1, 2, 3, 4, None]), rng.choice(["NEW_SEALED", "USED_COMPLETE"]), round(rng.uniform(5, 90), 2), start + timedelta(hours=rng.randrange(1400))) for k in range(300)]
    after = [(i, rng.choice([1, 5, None]) if k % 17 == 0 else f, c, a, t) for k, (i, f, c, a, t) in enumerate(sales) if k % 50]
    after += [("new", 7, "NEW_SEALED", 9.0, start)]
    schema = "external_id string, figure_id long, condition string, amount_usd double, sold_at timestamp_ntz"
    x, y = spark.createDataFrame(sales, schema), spark.createDataFrame(after, schema)
    figures = spark.createDataFrame([(k,) for k in range(1, 9)], "figure_id long")
    touched = refresh.touched(x, y, ["external_id"]).cache()
    plain = lambda rows: sorted(map(tuple, rows.collect()), key=repr)
    held = rollup.daily_sold(x.filter("figure_id IS NOT NULL"))
    got = refresh.snapshots(held, y.filter("figure_id IS NOT NULL"), touched)
    assert plain(got) == plain(rollup.daily_sold(y.filter("figure_id IS NOT NULL")).select(held.columns))
    stats = rollup.with_figure_stats(figures, x, now)
    assert plain(refresh.stats(stats, y, touched, now)) == plain(rollup.with_figure_stats(figures, y, now))
    assert plain(refresh.snapshots(held, x, touched.filter("false"))) == plain(held)
    # rows of what was not touched come from the held ones, whatever these say
    marked = held.withColumn("sample_size", F.lit(-1).cast("long"))
    keys = {(r.figure_id, r.day) for r in touched.collect()}
    assert all((r.sample_size == -1) == ((r.figure_id, r.day) not in keys) for r in refresh.snapshots(marked, y, touched).collect())
    asks = [(k % 4 + 1, "NEW_SEALED", 10.0 + k, k % 5 > 0, 0.9) for k in range(60)]
    a = spark.createDataFrame(asks, "figure_id long, condition string, amount_usd double, is_active boolean, match_score double")
    b = a.withColumn("is_active", F.col("is_active") & (F.col("figure_id") != 2))
    assert plain(refresh.ask_medians(rollup.ask_medians(figures, a), b, figures.filter("figure_id = 2"))) == plain(rollup.ask_medians(figures, b))


def folded(rows):
    """Printings of one figure by a loop."""
    runs = []
    for _, kind, label, at, price, currency, jan in sorted(rows, key=lambda r: r[0]):
        same = next((r for r in runs if r[0] == kind and at and r[2] and abs((r[2] - at).days) <= 92), None)
        if same is None:
            runs.append([kind, label, at, price, currency, jan])
            continue
        same[1], same[5] = same[1] or label, same[5] or jan
        if same[3] is None and price is not None:
            same[3], same[4] = price, currency
    runs.sort(key=lambda r: (r[2] is None, r[2] or date.min))
    return [(r[0], "Original" if i == 0 else r[1] or "Reissue", *r[2:]) for i, r in enumerate(runs)]


def test_printings_equal_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for figure in range(60):
        for k in range(rng.randrange(1, 9)):
            at = date(2024, 1, 1) + timedelta(days=rng.randrange(500)) if rng.random() < 0.85 else None
            rows.append((figure, k, rng.choice(["original", "reissue"]), rng.choice([None, "Second run"]), at, rng.choice([None, 10.0, 20.0]), rng.choice([None, "JPY", "EUR"]), rng.choice([None, "49"])))
    frame = spark.createDataFrame(rows, "figure_id long, printing_id long, kind string, label string, release_date date, price double, currency string, jan string").repartition(3)
    got = {}
    for r in lifecycle.folded_printings(frame).collect():
        got.setdefault(r.figure_id, []).append(tuple(r)[1:])
    for figure in range(60):
        assert sorted(got[figure], key=repr) == sorted(folded([r[1:] for r in rows if r[0] == figure]), key=repr)
    assert not re.search("FlatMapGroups|Python", lifecycle.folded_printings(frame)._jdf.queryExecution().optimizedPlan().toString())


def test_queries_of_the_same_tokens_read_each_text_once(spark, tmp_path):
    from shelfmark.operators import search_index

    docs = spark.createDataFrame([(k, "alpha beta" if k % 2 else "gamma the") for k in range(6)], "doc_id int, text string")
    index = search_index.build(docs, str(tmp_path / "i"), "doc_id", [docs.text])
    queries = spark.createDataFrame([(q, ["alpha"] if q < 3 else ["gamma", "the"] if q < 5 else ["delta"]) for q in range(6)], "query_id int, tokens array<string>")
    got = search_index.searched(index, docs, queries, "doc_id", [docs.text])
    assert sorted(map(tuple, got.collect())) == sorted((q, k) for q in range(5) for k in range(6) if (q < 3) == (k % 2 == 1))
    assert "collect_set" in got._jdf.queryExecution().optimizedPlan().toString()


def test_many_searches_find_their_texts_without_an_index(spark, tmp_path):
    rng = random.Random(8)
    words = ["aa", "aab", "baab", "日本語", "🙂🙂x", "the", "a-word-of-more-than-sixteen", "word-of-more-than-sixteen-letters"]
    rows = [(k, rng.choice([None, "", *words]), " ".join(rng.choices(words, k=rng.randrange(5)))) for k in range(300)]
    frame = spark.createDataFrame([*rows, (300, "baa", "b" * (3 * search_index.BLOCK) + "aab"), (301, "x" * (search_index.BLOCK - 2) + "日本語", None)], "id long, a string, b string")
    queries = [(q, rng.choices([*words, "aa", "ba", "never", "語🙂"], k=rng.randrange(4))) for q in range(120)]
    asked = spark.createDataFrame(queries, "query_id long, tokens array<string>")
    want = sorted((q, r.id) for q, tokens in queries if tokens for r in frame.collect() if all(t in (r.a or "") or t in (r.b or "") for t in tokens))
    index = search_index.build(frame, str(tmp_path / "index"), "id", [F.col("a"), F.col("b")])
    for of in (None, index):
        assert sorted(map(tuple, search_index.searched(of, frame, asked, "id", [F.col("a"), F.col("b")]).collect())) == want
    assert search_index.searched(None, frame, asked.filter("false"), "id", [F.col("a")]).count() == 0


def test_many_searches_read_beside_their_queries_few_texts_that_do_not_hold_them():
    """Words of a few syllables share their runs of three with most texts; what a text is checked for are the words that stand in it, and few others."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    syllables = [a + b for a in "bdgklmnrst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(400)]
    asked = [t.split()[0] for t in texts]
    keys = next(search_index.keyed(iter([pa.RecordBatch.from_arrays([pa.array([[a] for a in asked]), pa.array(asked)], names=["tokens", "asked"])]))).column("key").to_numpy().view(np.uint64)
    width = 12
    bits = np.zeros(search_index.PARTS << width, np.uint8)
    for place in search_index.places(width):
        bits[(keys >> np.uint64(58) << np.uint64(width)) | (keys >> np.uint64(place) & np.uint64((1 << width) - 1))] = 1
    marks = np.packbits(bits, bitorder="little")
    led = 0
    for t in texts:
        ((_, own),) = search_index.window_keys(search_index.points_of([t]), [12])
        at = search_index.marked(own, marks, marks != 0, width)
        assert {t[i : i + 12] for i in at} >= {a for a in asked if a in t}
        led += len(at)
    by_runs = sum(min(sum(r in t for t in texts) for r in search_index.token_runs(a)) for a in asked)
    assert led < 2 * sum(a in t for a in asked for t in texts) < by_runs / 10


def test_what_many_searches_ask_for_does_not_follow_runs_of_three(spark):
    from shelfmark.plans import mechanisms

    made = mechanisms.searched_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ids#" not in made and "MapInArrow" in made
