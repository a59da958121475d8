import itertools

import pytest
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.functions import paths as P
from quadloom.functions import terms as T
from quadloom.operators import records as R
from quadloom.operators.criteria import Criteria, combine

NS = {"k": "http://k#", "xsd": T.XSD}
L, N, U = T.literal_code, (lambda x: T.literal_code(str(x), T.XSD + ("integer" if isinstance(x, int) else "decimal"))), T.uri_code


def records(spark, rows):
    return spark.createDataFrame([(i, {NS["k"] + p: v for p, v in props.items()}) for i, props in rows], "id string, props map<string,array<string>>")


def one(spark, expression, props, nested=None, arguments=None):
    df = spark.createDataFrame([("r", {NS["k"] + p: v for p, v in props.items()}, nested)], "id string, props map<string,array<string>>, nested map<string,map<string,array<string>>>")
    c = P.Compiler(F.col("props"), F.col("nested"), F.col("id"))
    r = c.value(P.parse(expression, NS, arguments), None)
    return df.select(r.col.alias("x")).collect()[0][0], r.kind


BOOLS = [
    ("k:a = 1", True), ("k:a != 1", True), ("not(k:a = 1)", False), ("k:one != 1", False), ("k:none = 1", False), ("k:none != 1", False), ("k:a > 2 and k:a < 2", True),
    ("k:a >= 3 or false()", True), ("k:s = 'x'", True), ("k:s < 'y'", True), ("k:a < k:s", False), ("k:s < k:a", True), ("k:u = \\k:thing", True), ("k:a = $$", True),
    ("k:d > dateTime('2020-01-01T00:00:00')", True), ("k:mixed = 1.0", True), ("count(k:a) = 3", True), ("exists(k:none)", False), ("empty(k:none)", True),
    ("k:a[. > 2] = 3", True), ("k:a[. > 5] = 3", False), ("k:a[1] = 1", True), ("contains(k:s, 'x') and ends-with(k:s, 'x')", True), ("matches(k:s, '^x$')", True), ("boolean(k:flag)", False),
    ("k:bad + 1 = 2", False), ("1 div 0 = 1", False), ("k:a | k:one = 3", True), ("sequence(1, 2) = 2", True), ("index-of(k:a, 2) = 2", True), ("k:p/k:v >= 1007", True),
    ("k:p[k:c = 'John']/k:v = 1000", True), ("k:p[k:c = 'Mary']/k:v = 1000", False), ("./k:p[k:c = 'Steve']/k:v >= 1007", True),
]
PROPS = {
    "a": [N(1), N(2), N(3)], "one": [N(1)], "s": [L("x")], "u": [U(NS["k"] + "thing")], "d": [L("2021-05-05T00:00:00", T.XSD + "dateTime")],
    "mixed": [L("z"), N(1)], "flag": [L("false", T.XSD + "boolean")], "bad": [L("word")], "p": [U("n1")],
}
NESTED = {"n1": {NS["k"] + "c": [L("John"), L("Steve")], NS["k"] + "v": [N(1000), N(1007)]}}


@pytest.mark.parametrize("text,want", BOOLS)
def test_conditions(spark, text, want):
    df = spark.createDataFrame([("r", {NS["k"] + p: v for p, v in PROPS.items()}, NESTED)], "id string, props map<string,array<string>>, nested map<string,map<string,array<string>>>")
    test = P.condition(text, NS, [N(2)] if "$$" in text else None, nested="nested")
    assert df.select(test).collect()[0][0] is want


VALUES = [
    ("concat(k:s, '-', 1)", "x-1"), ("substring('12345', 2, 3)", "234"), ("substring('12345', 0, 3)", "12"), ("substring('12345', 1.5, 2.6)", "234"), ("substring('12345', -42)", "12345"),
    ("substring-before('a=b', '=')", "a"), ("substring-after('a=b', '=')", "b"), ("substring-after('ab', '=')", ""), ("normalize-space('  a  b ')", "a b"), ("translate('bar', 'abc', 'AB')", "BAr"),
    ("upper-case('aé')", "AÉ"), ("string-length('añb')", 3.0), ("round(2.5)", 3.0), ("round(-2.5)", -2.0), ("floor(-2.5)", -3.0), ("ceiling(2.1)", 3.0), ("abs(-3)", 3.0), ("power(2, 10)", 1024.0),
    ("7 mod 3", 1.0), ("7 div 2", 3.5), ("2 + 3 * 4 - 1", 13.0), ("sum(k:a)", 6.0), ("avg(k:a)", 2.0), ("number('x')", None), ("compare('a', 'b')", -1.0), ("year(k:d)", 2021.0), ("string(k:none)", ""),
    ("string-join(k:a, '+')", "1+2+3"), ("replace('abc', 'b', '_')", "a_c"), ("local-name(k:u)", "thing"), ("namespace-uri(k:u)", "http://k#"), ("escape-uri('a*b~c d/é')", "a%2Ab~c%20d%2F%C3%A9"),
]
SEQUENCES = [
    ("reverse(k:a)", [3, 2, 1]), ("subsequence(k:a, 2)", [2, 3]), ("subsequence(k:a, 2, 1)", [2]), ("remove(k:a, 2)", [1, 3]), ("insert-before(k:a, 2, 9)", [1, 9, 2, 3]), ("distinct-values(sequence(1, 1, 2))", [1, 2]),
    ("max(k:a)", [3]), ("min(k:a)", [1]), ("max(k:none)", []), ("k:a[position() = last()]", [3]), ("tokenize('1 2', ' ')", ["1", "2"]),
]


@pytest.mark.parametrize("text,want", VALUES)
def test_values(spark, text, want):
    assert one(spark, text, PROPS)[0] == want


@pytest.mark.parametrize("text,want", SEQUENCES)
def test_sequences(spark, text, want):
    got, kind = one(spark, text, PROPS)
    assert kind == "seq" and [t.split(T.SEP)[1] for t in got] == [str(w) for w in want]


def test_path_syntax():
    tree = P.parse("with q: <http://q#> : q:a = 1 and <http://z>/q:b > 2", {})
    assert P.properties_of(tree) == {"http://q#a", "http://z"}
    for bad in ("k:a =", "nope:a", "k:a = $$", "unknown(1)", "k:a ]", "//k:a", "#"):
        with pytest.raises((P.PathError, IndexError)):
            P.Compiler(None).value(P.parse(bad, NS), None)
    with pytest.raises(P.PathError):
        P.parse("k:a = 1", NS, ["x"])


SIZES = ([], [N(5)], [N(1), N(9)])


@pytest.mark.parametrize("kind", ["overwrite", "update", "init", "union", "min", "max"])
def test_criteria(spark, kind):
    pairs = list(itertools.product(SIZES, SIZES)) + [(None, [N(5)]), ([N(5)], None), (None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r[0]: r[1] for r in df.select("i", combine(kind, F.col("a"), F.col("b"))).collect()}
    num = lambda t: float(t.split(T.SEP)[1])
    for i, (a, b) in enumerate(pairs):
        a, b = a or [], b or []
        both = list(dict.fromkeys(a + b))
        want = {"overwrite": b, "update": b or a, "init": a or b, "union": both, "min": [min(both, key=num)] if both else [], "max": [max(both, key=num)] if both else []}[kind]
        assert got[i] == want


def test_criteria_text():
    c = Criteria.parse("union k:a, k:b min <http://x> overwrite *", NS)
    assert c.specific == (("http://k#a", "union"), ("http://k#b", "union"), ("http://x", "min")) and c.default == "overwrite"
    assert Criteria.parse(str(c)) == c
    for bad in ("", "k:a", "nothing *"):
        with pytest.raises(ValueError):
            Criteria.parse(bad, NS)


def test_merge_only_touches_what_is_new(spark):
    old = records(spark, [("1", {"a": [N(1)], "b": [N(1)]}), ("2", {"a": [N(7)]})])
    new = records(spark, [("1", {"a": [N(2)]}), ("3", {"c": [N(1)]}), ("2", {"a": [N(7)]})])
    merged, status = R.merge(old, new, Criteria.parse("union k:a", NS))
    got = {r.id: {k[len(NS["k"]) :]: sorted(v) for k, v in r.props.items()} for r in merged.collect()}
    assert got == {"1": {"a": [N(1), N(2)], "b": [N(1)]}, "2": {"a": [N(7)]}, "3": {}}
    assert {r.id: r.status for r in status.collect()} == {"1": R.MODIFIED, "2": R.UNMODIFIED, "3": R.CREATED}
    same, status = R.merge(old, new, None)
    assert same.count() == 2 and {r.status for r in status.collect()} == {R.UNMODIFIED}


def test_accessors_and_hash(spark):
    r = records(spark, [("1", {"a": [N(1), N(2)], "b": [L("true", T.XSD + "boolean")], "c": [L("x")]})])
    a, b, c, z = (NS["k"] + x for x in "abcz")
    row = r.select(R.unique(c), R.unique(a, F.lit("d")), R.unique(z), R.is_true(b), R.is_true(z), F.size(R.get(a))).collect()[0]
    assert tuple(row) == (L("x"), "d", None, True, False, 2)
    for failing in (R.unique(a), R.is_true(c)):
        with pytest.raises(Exception, match="several|boolean"):
            r.select(failing).collect()
    other = records(spark, [("9", {"c": [L("x")], "b": [L("true", T.XSD + "boolean")], "a": [N(2), N(1)], "e": []})])
    assert r.select(R.content_hash(F.col("props"))).collect() == other.select(R.content_hash(F.col("props"))).collect()
    assert R.clear(r).select(F.size("props")).collect()[0][0] == 0 and R.project(r, []).select(F.size("props")).collect()[0][0] == 0
    assert len(r.select(R.object_hash(F.col("id"))).collect()[0][0]) == 16


def test_empty_stores(spark):
    none = records(spark, [])
    new = records(spark, [("1", {"a": [N(1)]})])
    assert R.create(none, new)[0].count() == 1 and R.merge(none, none, Criteria.parse("union *"))[0].count() == 0
    assert R.delete(none, F.lit(True))[0].count() == 0 and R.from_long(R.to_long(none)).count() == 0


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", NS)
    e.create("resource", records(spark, [("a", {"n": [N(1)]}), ("b", {"n": [N(2)]})]))
    assert {r.status for r in e.create("resource", records(spark, [("a", {})])).collect()} == {R.EXISTS}
    assert e.count("resource") == 2 and e.count("resource", "k:n > 1") == 1
    assert [r.status for r in e.merge("resource", records(spark, [("a", {"n": [N(5)]})]), "max *").collect()] == [R.MODIFIED]
    e.update("resource", "k:n = 5", {NS["k"] + "m": [L("hot")]})
    assert [r.id for r in e.retrieve("resource", "k:m = 'hot'", props=[NS["k"] + "n"]).collect()] == ["a"]
    e.create("mention", records(spark, [("a#1", {"of": [U("a")]}), ("c#1", {"of": [U("c")]})]))
    e.link("resource", "mention", NS["k"] + "has", NS["k"] + "of")
    assert {r.id for r in e.retrieve("resource", "exists(k:has)").collect()} == {"a", "c"}
    assert e.match("mention", "resource", NS["k"] + "of").count() == 2
    q = spark.createDataFrame([(U("a"), U("http://k#p"), U("b"), None)], "s string, p string, o string, g string")
    e.add(q)
    e.add(q)
    assert e.sparql("SELECT ?x { ?x k:p ?y }").count() == 1
    e.remove(q)
    assert e.quads.read().count() == 0
    e.upload("resource", spark.createDataFrame([("a.txt", bytearray(b"1 < 2"))], "name string, content binary"))
    assert bytes(e.download("a.txt", "text/html").collect()[0].content) == b"<pre>1 &lt; 2</pre>"
    assert e.download("a.txt", "image/png").count() == 0 and e.download("zzz").count() == 0
    e.dump(["resource", "mention"], f"file://{tmp_path}/dump")
    assert spark.read.text(f"file://{tmp_path}/dump").count() > 5
    assert {r.status for r in e.delete("resource", ids=["a", "zz"]).collect()} == {R.DELETED, R.MISSING}
    e.delete("resource")
    assert e.count("resource") == 0 and e._records("resource").purge() > 3
    e.close()
    with pytest.raises(RuntimeError):
        e.count("resource")


def test_strict_values_and_names(spark):
    from quadloom.functions import paths

    rows = spark.createDataFrame([("1", {"http://v#n": ["L" + T.XSD + "integer" + T.SEP + "4"], "http://v#t": ["L" + T.SEP + "word"], "http://v#m": ["L" + T.SEP + "1", "L" + T.SEP + "2"]})], "id string, props map<string,array<string>>")
    ns = {"v": "http://v#"}
    value = lambda text, kind, **o: rows.select(paths.evaluate(text, kind, ns, **o)).collect()[0][0]
    assert value("v:n + 1", "double", strict=True) == 5 and value("v:n", "bigint") == 4 and value("v:none", "double", strict=True) is None
    assert value("v:t", "double") is None and value("v:m", "string") is None and value("v:t + 1", "double") is None
    for text, kind in (("v:t", "double"), ("v:m", "string"), ("v:t + 1", "double")):
        with pytest.raises(Exception, match="no single|not a number"):
            value(text, kind, strict=True)
    assert value("with x: <http://v#>, y: <http://w#>: x:n > 3 and not(y:n)", "boolean") is True
    with pytest.raises(paths.PathError):
        value("with x: <http://v#>, y : x:n", "boolean")
    assert value("v:t[. = 'word']/..", "boolean") is True and value("v:t[. = 'other']/..", "boolean") is False
    with pytest.raises(paths.PathError):
        value("../v:t", "boolean")


def test_requests_and_clients(spark, tmp_path):
    from quadloom.engine import Engine
    from quadloom.operators import workload as W

    e = Engine(spark, f"file://{tmp_path}", {"v": "http://v#"})
    e.create("resource", spark.createDataFrame([(str(i), {"http://v#n": ["L" + T.XSD + "integer" + T.SEP + str(i)]}) for i in range(9)], "id string, props map<string,array<string>>"))
    e.add(spark.createDataFrame([("Ua", "Uhttp://v#p", "Ub", None)], "s string, p string, o string, g string"))
    ask = W.requests(e)
    assert ask["lookup"]({"kind": "resource", "id": "3"}).count() == 1 and ask["lookupall"]({"kind": "resource", "ids": ["3", "5", "z"]}).count() == 2
    assert ask["count"]({"kind": "resource", "condition": "v:n > 5"}).collect()[0][0] == 3 and ask["retrieve"]({"kind": "resource", "limit": 2}).count() == 2
    assert ask["sparql"]({"query": "SELECT ?o { <${s}> v:p ?o }", "s": "a"}).count() == 1
    trace = W.run_mixes(spark, {"q": lambda p: spark.range(2), "r": lambda p: spark.range(3)}, [], mixes=6, clients=3)
    assert trace.count() == 12 and trace.select("mix").distinct().count() == 6


def test_records_in_a_database(spark):
    from quadloom.operators import records as R
    from quadloom.sources.jdbc import read_records, write_records

    rows = spark.createDataFrame([("a", {"p": ["Ux", "Uy"], "q": ["Uz"]}), ("b", {"p": ["Ux"]})], "id string, props map<string,array<string>>")
    url = "jdbc:derby:memory:quadloom;create=true"
    write_records(rows, url, "records")
    assert {r.id: r.props for r in read_records(spark, url, "records").collect()} == {r.id: r.props for r in rows.collect()}
    one = read_records(spark, url, "records", ids=["a"], props=["q"])
    assert [(r.id, r.props) for r in one.collect()] == [("a", {"q": ["Uz"]})]
    assert "PushedFilters" in one._jdf.queryExecution().executedPlan().toString()
    write_records(R.columns_view(rows.select("id"), F.col("id"), {"n": F.array(F.lit("U1"))}), url, "records", mode="append")
    assert read_records(spark, url, "records").where("id = 'b'").collect()[0].props == {"n": ["U1"], "p": ["Ux"]}
