"""The corpus queries that SQL can say, against their twins in DuckDB, over the smallest whole tables."""

import os

import duckdb
import pytest

from dredge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    db = duckdb.connect()
    for table in os.listdir(SF):
        db.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
