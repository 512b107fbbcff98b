"""The queries that have SQL, against DuckDB."""

import os

import duckdb
import pytest

from tidewater.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
