"""Every registered query of the engine against its SQL counterpart."""

from __future__ import annotations

import duckdb
import pytest

from keystrata.plans.oracles import SQL
from keystrata.plans.queries import NAMED

TABLES = "events orders customer documents pages".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, db, name):
    df = NAMED[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    expected = db.sql(SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
