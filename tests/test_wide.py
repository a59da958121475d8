from datetime import datetime

import duckdb
import pytest

from quadloom import core_queries
from quadloom.operators import wide as W

PROPS = "property_id long, record_id string, propertyuri string, propertyvalue string, recorded_at timestamp"
CATALOG = "attribute string, property_uri string, target_type string"
AT = datetime(2024, 1, 1)


def wide_of(spark, rows, catalog, extra=None):
    df = spark.createDataFrame(rows, PROPS)
    if extra:
        df = df.selectExpr("*", *extra)
    return W.stitch(df, spark.createDataFrame(catalog, CATALOG), {"p": "http://p/"})


def test_types_and_choice(spark):
    rows = [
        (1, "http://r/1", "p:n", "5", AT),
        (2, "<http://R/1>", "http://p/n", "6", datetime(2024, 2, 1)),
        (3, "http://r/1", "p:n", "bad", datetime(2024, 3, 1)),
        (4, "http://r/1", "p:flag", "TRUE", None),
        (5, "http://r/2", "p:other", "x", AT),
        (6, "http://r/3", None, "x", AT),
        (7, None, "p:n", "9", AT),
        (8, "http://r/3", "p:n", None, AT),
    ]
    wide, cols = wide_of(spark, rows * 3, [("n", "p:n", "int"), ("flag", "p:flag", "boolean"), (None, "p:x", "int"), ("odd", "p:x", "geometry")])
    assert cols == ["flag", "n"]
    assert dict(wide.dtypes)["n"] == "int" and dict(wide.dtypes)["flag"] == "boolean"
    got = {r.record_id: (r.n, r.flag) for r in wide.collect()}
    assert got == {"http://r/1": (6, True), "http://r/2": (None, None), "http://r/3": (None, None)}
    assert sorted(r.ordinal for r in wide.collect()) == [0, 1, 2]
    assert [tuple(r) for r in W.filled_cells(wide, cols).orderBy("attribute").collect()] == [("http://r/1", "flag"), ("http://r/1", "n")]


def test_empty_and_clashing_names(spark):
    wide, cols = wide_of(spark, [], [("n", "p:n", "int")])
    assert wide.count() == 0 and cols == ["n"]
    rows = [(1, "http://r/1", "p:n", "5", AT), (2, "http://r/1", "p:m", "x" * 100_000, AT), (3, "http://r/1", "p:e", "", AT)]
    extra = ["1 as attr", "2 as text", "3 as at", "4 as uri_", "5 as ordinal", "6 as ids"]
    wide, cols = wide_of(spark, rows, [("ordinal", "p:n", "bigint"), ("record_id", "p:m", "string"), ("e", "p:e", "string")], extra)
    assert cols == ["e", "ordinal_", "record_id_"]
    row = wide.collect()[0]
    assert row["ordinal_"] == 5 and len(row["record_id_"]) == 100_000 and row["e"] is None
    wide, cols = wide_of(spark, rows, [])
    assert cols == [] and wide.count() == 1 and W.filled_cells(wide, cols).count() == 0


def test_ranges_close_between_entities(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 5)
    rows = [(i, f"http://r/{i % 23:02}", f"p:a{i % 3}", str(i % 23), AT) for i in range(23 * 3 * 2)]
    wide, cols = wide_of(spark, rows, [(f"a{k}", f"p:a{k}", "int") for k in range(3)])
    got = wide.collect()
    assert len(got) == 23 and sorted(r.ordinal for r in got) == list(range(23))
    assert all(r["a0"] == int(r.record_id[-2:]) for r in got if r["a0"] is not None)
    assert {(r.record_id, c) for r in got for c in cols if r[c] is not None} == {(f"http://r/{i % 23:02}", f"a{i % 3}") for i in range(138)}


def test_one_entity_with_a_third_of_all_rows(spark):
    rows = [(i, "http://r/hot" if i % 3 == 0 else f"http://r/{i}", "p:n", str(i), AT) for i in range(6000)]
    wide, _ = wide_of(spark, rows, [("n", "p:n", "int")])
    assert wide.count() == 4001


def oracle(data, name):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    import os

    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return c.execute(core_queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(core_queries.ORACLES))
def test_queries_match_sql(spark, data, name):
    got = core_queries.QUERIES[name](spark, data)
    want = oracle(data, name)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
