import datetime
import decimal
import os

import duckdb
import pytest

from quadloom.reference_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    got = QUERIES[name](spark, data)
    want = sql.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_constant_predicates_read_few_columns(spark, data):
    plan = QUERIES["bgp_join"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # two links, and the names of all three tables, as any of them may be what the name belongs to
    assert plan.count("FileScan") == 5 and "c_acctbal" not in plan and "c_mktsegment" not in plan


def test_filters_reach_the_scan(spark, data):
    plan = QUERIES["graph_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "o_totalprice" not in plan
