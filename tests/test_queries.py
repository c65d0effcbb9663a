"""Every query with SQL gives what DuckDB gives; the others give rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def rows(df):
    df = df[sorted(df.columns)]
    clean = [tuple(None if pd.isna(v) else (float(v) if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)) for v in r) for r in df.itertuples(index=False)]
    return sorted(clean, key=lambda r: tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v or "") for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got) >= 1
        return
    want = connection(sf).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)), name


def test_entry(spark):
    assert os.path.isdir("/root/testdata/sf0.001") and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
