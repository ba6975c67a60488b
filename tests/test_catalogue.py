"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    clean = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted(map(str, (tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in clean.itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
