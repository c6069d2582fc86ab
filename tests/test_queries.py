"""Every registered query of the library against DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from newslink import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.5g}"
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    result = duck.execute(ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == names
    assert got == sorted(tuple(plain(r[order.index(n)]) for n in names) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert {"date", "cluster_id", "id"} <= set(df.columns) and df.count() > 0
