"""Every query with an SQL twin against DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e
from barwright.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 4) + 0.0 if isinstance(v, float) else v


def bag(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(v) for v in r)) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf_dir, duck, name):
    assert bag(QUERIES[name](spark, sf_dir).toPandas()) == bag(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    """Executed whole: every column of every row."""
    out = QUERIES[name](spark, sf_dir).toPandas()
    assert len(out) and list(out.columns)


def test_entry(spark):
    assert e.entry(spark).count() > 0 and set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
