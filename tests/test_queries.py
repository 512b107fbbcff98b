"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidewater import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        x = df[c]
        if str(x.dtype).startswith("datetime"):
            x = x.map(lambda v: None if pd.isna(v) else str(v).removesuffix(" 00:00:00")).astype(object)
        elif x.dtype == object or str(x.dtype) in ("str", "string", "boolean", "bool"):
            x = x.map(lambda v: None if v is None or v is pd.NA or v != v else str(v).removesuffix(" 00:00:00"))
        else:
            x = x.astype(float).round(8)
        out[c] = x
    return pd.DataFrame(out).sort_values(sorted(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want), "nothing to compare"
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=0, atol=1e-7)
