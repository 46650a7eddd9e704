"""Every query with SQL against DuckDB on the smallest tables; every other query runs and has a schema."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from evidark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns
    if name not in catalog.oracle_sql():
        df.limit(5).collect()
        return
    want = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    a = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr)
    b = sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=repr)
    assert a == b
