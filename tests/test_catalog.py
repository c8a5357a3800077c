"""Every query against its SQL on the small tables, and the driver contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from duebook import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or isinstance(x, str):
        return x
    return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "as_tuple") else str(x)[:10]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    r = duck.execute(catalog.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall()), key=repr)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
