"""Each registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tallstrip.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
