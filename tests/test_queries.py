"""Every query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from shelfmark.plans import composites, mechanisms, round_trips, rules  # noqa: F401  they add their queries
from shelfmark.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    if name not in ORACLES:
        assert rows
        return
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
