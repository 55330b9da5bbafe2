"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodeseek.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equal_to_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    got = sql.sql(registry.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLE_SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() >= 0
