"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from pulsegrid.plans import oracle, queries

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in order) for row in relation.fetchall()), key=str)
    assert len(got) == len(want)
    assert all(_same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_all_queries_have_sql_or_a_reason():
    assert set(QUERIES) == set(SQL)
