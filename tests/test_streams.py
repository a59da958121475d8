import pytest
from pyspark.sql import functions as F

from quadloom.operators.streams import Stream


def stream(spark, n=10):
    return Stream.of(spark, [(i, f"v{i % 3}") for i in range(n)], "k int, v string")


def test_slices(spark):
    s = stream(spark)
    assert [r.k for r in s.slice(7, None, "k").to_list()] == [7, 8, 9]  # an offset without a limit gives the rest
    assert [r.k for r in s.slice(2, 3, "k").to_list()] == [2, 3, 4] and s.slice(20, 5, "k").count() == 0


def test_chunks(spark):
    for n in (0, 1, 10, 1000):
        rows = stream(spark, n).chunk(3, "k", "k").df.orderBy("chunk").collect()
        assert [x for r in rows for x in r["values"]] == list(range(n)) and all(len(r["values"]) == 3 for r in rows[:-1])
    ties = Stream.of(spark, [(i, 1) for i in range(10)], "k int, one int").chunk(4, "k", "one", "k").df
    assert sorted(len(r["values"]) for r in ties.collect()) == [2, 4, 4]


def test_track(spark):
    s, seen = stream(spark).track("seen_rows")
    assert len(s.to_list()) == 10 and seen.get["rows"] == 10


def test_paths_and_maps(spark):
    s = Stream.of(spark, [([["1", "x"], ["2"]],), (None,), ([[None]],)], "a array<array<string>>")
    assert sorted(r.value for r in s.path("a", kind="int").to_list()) == [1, 2]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        s.path("a", kind="int", lenient=False).to_list()
    pairs = Stream.of(spark, [("a", 1, 1), ("a", 2, 2), (None, 3, 3), ("b", None, 4)], "k string, v int, t int")
    assert {r.key: r.value for r in pairs.to_map("k", "v", "t").to_list()} == {"a": 2}
    assert {r.key: r["values"] for r in pairs.to_multimap("k", "v").to_list()} == {"a": [1, 2]}


def test_single_and_order(spark):
    s = stream(spark)
    assert s.filter(F.col("k") == 3).unique().v == "v0" and s.filter(F.lit(False)).unique() is None and s.unique(default="d") == "d"
    with pytest.raises(ValueError):
        s.unique()
    lists = Stream.of(spark, [(1, [5]), (2, []), (3, [2, 9])], "k int, a array<int>")
    assert [r.k for r in lists.sort_by_path("a").to_list()] == [3, 1, 2]
    assert s.concat(s).distinct().count() == 10 and s.concat(s).count() == 20
    assert s.transform(x=F.when(F.col("k") > 4, F.col("k"))).count() == 5
    assert sum(b.k for b in s.transform_batches(lambda it: it, "k int, v string").iterate()) == 45
