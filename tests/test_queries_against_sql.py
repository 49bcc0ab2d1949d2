"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from veriloom.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist") and hasattr(v, "__len__"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int32", "int64", "float64", "float32", "int8"):
        return round(float(v), 8) + 0.0
    return v


def rows(frame, columns):
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_all_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
