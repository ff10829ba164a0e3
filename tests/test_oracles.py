"""Every query with SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import verify
from cairnfield import queries as registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in verify.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf) / t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    got = verify.rows(df.columns, df.collect())
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == verify.rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
