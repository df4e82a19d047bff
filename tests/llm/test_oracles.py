"""Every corpus query that has SQL against it."""

from __future__ import annotations

import duckdb
import pytest

from keystrata.llm import queries

TABLES = "documents pages conversations labels".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, db, name):
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    expected = db.sql(queries.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=str)
