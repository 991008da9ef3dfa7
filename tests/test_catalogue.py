"""Every query with SQL gives the SQL's rows."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    return sorted(pdf[cols].astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck, sf_dir):
    mine, other = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
