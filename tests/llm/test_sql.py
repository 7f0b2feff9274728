"""Registered queries of the subpackage against their SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from tidewater.llm import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = con.sql(queries.oracle_sql()[name])
    at = [rows.columns.index(c) for c in cols]
    want = sorted(tuple(str(r[i]) for i in at) for r in rows.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
