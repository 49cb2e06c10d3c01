"""Every registered query of the recordings engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tracesheaf.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted([text(r[c]) for c in order] for r in df.collect())
    theirs = sorted([text(v) for _, v in sorted(zip(columns, row))] for row in cur.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).columns == ["condition", "fov", "mean", "sem", "n"]
