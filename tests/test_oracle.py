"""Every query with SQL gives the SQL's rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

from graphloom import catalog as queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(float(r[i]), 5) + 0.0 if isinstance(r[i], float) else r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    want = tables.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
