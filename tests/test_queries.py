"""The registered queries against their SQL in DuckDB, on the smallest table that has what they need."""

import duckdb
import pytest

import __spark_entry__ as entry
from shiftlab.plans.queries import REGISTRY

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted([tuple(None if x is None else round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    assert got
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        r = con.sql(sql)
        at = [r.columns.index(c) for c in columns]
        assert got == plain(tuple(x[i] for i in at) for x in r.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"cell_id", "y_idx", "x_idx", "t_idx", "dts"}
