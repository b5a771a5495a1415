"""Every query of the suite against DuckDB on the smallest tables."""

import duckdb
import pytest

from haplospan.plans import suite

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, con, name):
    df = suite.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    if name not in suite.SQL:
        assert got
        return
    rel = con.sql(suite.SQL[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(repr(r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
