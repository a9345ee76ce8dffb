"""Every registered query gives the rows of its SQL on DuckDB, and some."""

import glob
import math
import os

import duckdb
import pytest

from kinfold.plans.queries import ORACLES, QUERIES


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    rows = want.fetchall()
    assert rows or name in ("coparent_check",)
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(rows, want.columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
