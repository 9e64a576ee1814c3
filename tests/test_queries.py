"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from mnemospark import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    rows = __spark_entry__.queries()[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(rows.columns)) for r in rows.collect())
    if name not in catalog.ORACLES:
        return
    r = oracle.sql(catalog.ORACLES[name])
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert sorted(r.columns) == sorted(rows.columns)
    assert got == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
