"""Every crawl query against its SQL twin in DuckDB, over the smallest whole tables."""

import os

import duckdb
import pytest

from dredge.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return sorted(repr(tuple(value(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = db.sql(sql)
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(got, df.columns) == plain(rows, want.columns)
