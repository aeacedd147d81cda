"""Registered queries against DuckDB at the smallest size."""

import math

import duckdb
import pytest

from tallyline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return repr(float(v))


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
