"""Every registered query with SQL of its own gives the same rows as that SQL."""

import os

import duckdb
import pandas as pd
import pytest

from seamark.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _plain(value):
    if pd.isna(value):
        return ""
    return f"{float(value):.6f}" if isinstance(value, (int, float, bool)) or hasattr(value, "dtype") else str(value)


def _rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in row) for row in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
