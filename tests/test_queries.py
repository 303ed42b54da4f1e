"""Every registered query of the core runs; those with SQL give the same rows in DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from brujula.plans import registry

QUERIES = {n: f for m in registry.MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in registry.MODULES for n, s in m.SQL.items()}


def value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(value, v))
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 5)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return round(float(v), 5)
    return str(v)


def table_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([value(x) for x in r]) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in SQL:
        assert table_rows(got) == table_rows(duck.execute(SQL[name]).df())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
