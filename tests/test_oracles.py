"""Every query that has an oracle against DuckDB on the smallest tables, and the others for rows."""

import os

import duckdb
import pytest

from corpusloom import plans

SF = "/root/testdata/sf0.001"


def rows_of(t):
    names = sorted(t.column_names)
    return sorted(map(repr, zip(*[t.column(n).to_pylist() for n in names]))) if t.num_rows else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toArrow()
    if name in plans.ORACLES:
        want = duck.execute(plans.ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got.column_names) > 0
