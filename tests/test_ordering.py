import random

from pyspark.sql import functions as F

from shelfmark.functions.ordering import numbered, running


def test_numbers_count_on_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 97).alias("place"), F.col("id").alias("part"))
    got = numbered(rows, F.col("place").desc(), F.col("part")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r.place, r.part) for r in got] == sorted(((i % 97, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


def test_running_totals(spark):
    rng = random.Random(3)
    held = [(k, rng.choice([1, 2, 5])) for k in range(3000)]
    rng.shuffle(held)
    got = {r.k: r.before for r in running(spark.createDataFrame(held, "k long, n long"), "n", F.col("k")).collect()}
    total = 0
    for k, n in sorted(held):
        assert got[k] == total
        total += n
    assert running(spark.createDataFrame([], "k long, n long"), "n", F.col("k")).count() == 0
