"""Every registered query against its SQL on the small tables, and the entry points' shape."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_entry(spark):
    assert e.entry(spark).count() == 1


def test_sql_has_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(n for n in e.oracle_sql() if not n.startswith("op")))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = con.sql(e.oracle_sql()[name])
    at = [rows.columns.index(c) for c in cols]
    want = sorted(tuple(str(r[i]) for i in at) for r in rows.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want
