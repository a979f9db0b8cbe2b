"""Every registered query with a SQL twin agrees with DuckDB on the smallest
test tables (the driver repeats this at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    r = con.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(r.columns)
    assert rows_of(df.columns, rows) == rows_of(r.columns, r.fetchall())


def test_every_query_has_a_builder():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["task", "metric", "value"]
    assert df.count() == 46
