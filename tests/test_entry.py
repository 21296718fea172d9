"""Driver contract and the DuckDB oracle for every registered query."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusmill.plans import catalog
from corpusmill.plans.fixtures import BASE_TABLES

from .conftest import SF_SMALL


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "total_samples" and len(df.collect()) == 1


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert len(catalog.QUERIES) == 67
    assert set(catalog.QUERIES) <= set(entry.queries())


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):  # numpy scalars
        v = v.item()
    return v if isinstance(v, (bool, int)) else str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", list(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, key):
    got = _rows(entry.queries()[key](spark, SF_SMALL).toPandas())
    want = _rows(duck.execute(entry.oracle_sql()[key]).df())
    assert got == want
