"""The queries of the core's training-data operators against their SQL."""

import os

import duckdb
import pytest

from quadloom.core_queries import ORACLES, QUERIES
from tests.test_reference_queries import plain


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, sql, name):
    got = QUERIES[name](spark, data)
    want = sql.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*names).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())
