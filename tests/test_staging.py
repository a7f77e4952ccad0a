from pathlib import Path

from shelfmark.functions.staging import staged, temporary_tables


def tables(spark, name):
    return list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob(f"{name}-*"))


def test_tables_of_a_block_go_and_lasting_ones_stay(spark):
    with temporary_tables():
        with temporary_tables():
            rows = staged(spark.range(5), "inner")
            kept = staged(rows.filter("id > 2"), "outer", lasting=True)
            assert len(tables(spark, "inner")) == 1
        assert not tables(spark, "inner") and sorted(r.id for r in kept.collect()) == [3, 4]
        last = staged(kept, "whole", lasting=True)
    assert not tables(spark, "outer") and last.count() == 2
    assert staged(spark.range(3), "free").count() == 3 and len(tables(spark, "free")) == 1
