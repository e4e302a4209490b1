"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from glyspark import catalog

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind == "bool" or kind.startswith(("int", "float")):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    got, want = tidy(catalog.queries()[name](spark, DATA).toPandas()), tidy(db.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if float in (got[c].dtype, want[c].dtype):
            a, b = (pd.to_numeric(x[c], errors="coerce") for x in (got, want))
            assert np.allclose(a, b, rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


def test_entry_and_registration(spark):
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
