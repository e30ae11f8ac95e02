"""Every query with an oracle gives the oracle's rows; column names and row counts included."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tideline import registry

registry.load_all()


def value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [value(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if v == int(v) else round(float(v), 5)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr([value(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in registry.TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, sf, duck, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_give_rows(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_every_query_is_documented():
    assert all((f.__doc__ or "").strip() for f in registry.QUERIES.values())
