"""Every query of the analytics operators against its SQL, at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from gristmill.plans import proxy

SLOW = {"m5_search", "m6_nested", "m7_cross_validated", "a6_ablation"}


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    return tuple(x) if isinstance(x, list) else x


def canonical(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(proxy.queries()) - SLOW))
def test_query(name, spark, sf, duck):
    got = proxy.queries()[name](spark, sf).toPandas()
    if name in proxy.oracle_sql():
        want = duck.execute(proxy.oracle_sql()[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got) > 0
