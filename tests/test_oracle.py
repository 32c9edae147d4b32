"""Every registered query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registry
import oracle

SF = "/root/testdata/sf0.001"
TABLES = ("embeddings", "events", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    table = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(map(repr, table.itertuples(index=False, name=None)))


# The corpus queries have tests of their own.
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_values(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    assert rows(found) == rows(duck.sql(oracle.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(oracle.oracle_sql())))
def test_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert registry.entry(spark).columns == ["q_id", "vec_id", "score", "rk"]
