import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.functions.literals import lexical, read_as
from quadloom.functions.uris import namespace_map, normalize_uri

NS = {"ks": "http://ns.example/k#", "v": "http://v.example/"}
CASES = {
    "http://a.example/X": "http://a.example/X",
    "HTTP://A.Example/X": "http://a.example/X",
    "http://A.Example": "http://a.example",
    "http://A.Example#Frag": "http://a.example#Frag",
    "http://a.example?Q=A": "http://a.example?Q=A",
    " \t<http://a.example/x>\n": "http://a.example/x",
    " http://a.example/x": "http://a.example/x",
    "http://a.example/x\n": "http://a.example/x",
    "<ks:Foo>": "http://ns.example/k#Foo",
    "ks:a:b": "http://ns.example/k#a:b",
    "unknown:Foo": "unknown:Foo",
    "URN:isbn:X": "urn:isbn:X",
    "_:b12": "_:b12",
    "http://a.example/%41%5f%2d%7e": "http://a.example/A_-~",
    "http://a.example/%2F%c3%a9": "http://a.example/%2F%C3%A9",
    "http://a.example/100%": "http://a.example/100%",
    "http://a.example/%zz": "http://a.example/%zz",
    "HTTP://User@Host.example/P": "http://User@host.example/P",
    "": None,
    "  ": None,
    "<>": None,
    None: None,
}


def test_uris(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "raw string")
    got = {r[0]: r[1] for r in rows.select("raw", normalize_uri(F.col("raw"), NS)).collect()}
    assert got == CASES


def test_normal_form_is_stable(spark):
    once = spark.createDataFrame([(v,) for v in CASES.values()], "raw string")
    assert all(a == b for a, b in once.select("raw", normalize_uri(F.col("raw"), NS)).collect())


def test_namespace_map(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "b"), (None, "c"), ("d", None)], "prefix string, namespace_uri string")
    assert namespace_map(rows) == {"a": "b"}
    with pytest.raises(ValueError):
        namespace_map(spark.createDataFrame([("a", "x"), ("b", "x")], "prefix string, namespace_uri string"), limit=1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=20), min_size=1, max_size=30))
def test_any_text_is_accepted(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "raw string")
    assert rows.select(normalize_uri(F.col("raw"), NS)).count() == len(values)


LITERALS = [
    ("int", "7", 7), ("int", " +7\n", 7), ("int", "-0", 0), ("int", "2147483648", None), ("int", "7.0", None), ("int", "", None), ("int", "- 7", None),
    ("int", '"7"^^xsd:int', 7), ("int", '"7"', 7), ("int", '"7', None), ("bigint", "9223372036854775807", 2**63 - 1), ("bigint", "9223372036854775808", None),
    ("bigint", "7\n7", None), ("double", "1.", 1.0), ("double", ".5", 0.5), ("double", "1e-3", 0.001), ("double", "NaN", None), ("double", "1e+", None), ("double", "INF", None),
    ("double", "0.5d", None), ("boolean", "TRUE", True), ("boolean", "0", False), ("boolean", "yes", None), ("string", '""@en', None), ("string", ' "a"@en-GB ', "a"), ("string", "\t", None),
    ("string", "a", "a"), ("boolean", None, None),
]


def test_literals(spark):
    for kind in {k for k, _, _ in LITERALS}:
        cases = [(i, raw) for i, (k, raw, _) in enumerate(LITERALS) if k == kind]
        rows = spark.createDataFrame(cases, "i int, raw string").select("i", read_as(lexical(F.col("raw")), kind))
        for i, value in rows.collect():
            assert value == LITERALS[i][2], LITERALS[i]


def test_times(spark):
    good = ["2024-02-29", "2024-01-01T00:00:00Z", "2024-01-01 10:00", "2024-01-01T10:00:00.123+02:00", "1386837852000", '"2014-02-27"^^xsd:date', "2024-01-01T10:00:00-0530"]
    bad = ["2023-02-29", "2024-13-01", "0000-00-00", "2024-05-12T27:61:00Z", "yesterday", "2024", "138683785200", "2024-01-01T", "24-01-01", "2024-1-1", "--"]
    rows = spark.createDataFrame([(v,) for v in good + bad], "raw string").select("raw", read_as(lexical(F.col("raw")), "timestamp").isNotNull())
    assert {r[0] for r in rows.collect() if r[1]} == set(good)


def test_unknown_type():
    with pytest.raises(ValueError):
        read_as(None, "decimal")
