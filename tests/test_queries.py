"""Every registered core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from cairn.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return round(float(value), 5)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    found = [tuple(r) for r in got.collect()]
    if name in SQL:
        want = duck.execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert rows(got.columns, found) == rows(names, want.fetchall())
    else:
        assert got.columns
