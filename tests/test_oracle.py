"""Every query with SQL gives the same rows as that SQL in another engine."""

import math
import os

import pytest

from slotwise.plans.registry import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = db.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
