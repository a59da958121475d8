import pytest

from quadloom.functions import terms as T
from quadloom.plans.compiler import Dataset
from quadloom.plans.parser import SparqlError, parse
from quadloom.sources import quads as Q

E = "http://e/"
NS = {"": E, "xsd": T.XSD}


def term(x):
    if x is None or isinstance(x, str) and x[:1] in "BL@":
        return x
    if isinstance(x, bool):
        return T.literal_code(str(x).lower(), T.XSD + "boolean")
    if isinstance(x, (int, float)):
        return T.literal_code(str(x), T.XSD + ("integer" if isinstance(x, int) else "double"))
    return T.uri_code(E + x) if not x.startswith("'") else T.literal_code(x[1:])


def dataset(spark, *rows, **options):
    return Dataset(spark.createDataFrame([tuple(map(term, (*r, *[None] * (4 - len(r))))) for r in rows], "s string, p string, o string, g string"), **options)


def show(code):
    if code is None:
        return None
    if code[0] == "U":
        return code[1:].removeprefix(E)
    return code.split(T.SEP, 1)[1] if code[0] == "L" else "_:"


def ask(data, text, **options):
    df = data.query(text, NS, **options)
    return sorted((tuple(show(v) for v in r) for r in df.collect()), key=str)


CYCLE = [("n1", "to", "n2"), ("n2", "to", "n3"), ("n3", "to", "n1"), ("n4", "to", "n5")]


def test_paths_on_cycles(spark):
    d = dataset(spark, *CYCLE)
    assert len(ask(d, "SELECT ?a ?b { ?a :to+ ?b }")) == 10
    assert len(ask(d, "SELECT ?a ?b { ?a :to* ?b }")) == 12
    assert ask(d, "SELECT ?b { :n4 :to* ?b }") == [("n4",), ("n5",)]
    assert ask(d, "SELECT ?b { :nowhere :to* ?b }") == [("nowhere",)]
    assert ask(d, "SELECT ?a { ?a :to+ :n1 }") == [("n1",), ("n2",), ("n3",)]
    assert ask(d, "SELECT ?a { ?a (:to/:to)+ :n1 }") == [("n1",), ("n2",), ("n3",)]
    assert ask(d, "SELECT ?b { :n1 ^:to ?b }") == [("n3",)]
    assert ask(d, "SELECT ?b { :n1 (:to|^:to) ?b }") == [("n2",), ("n3",)]
    assert ask(d, "SELECT ?b { :n5 !(:from|^:from) ?b }") == [("n4",)]
    assert ask(d, "SELECT ?b { :n5 :to? ?b }") == [("n5",)]


def test_optional_then_join(spark):
    d = dataset(spark, ("a", "p", "x"), ("b", "p", "y"), ("a", "q", "z1"), ("k1", "r", "z1"), ("k2", "r", "z2"))
    got = ask(d, "SELECT ?s ?v ?k { ?s :p ?o OPTIONAL { ?s :q ?v } ?k :r ?v }")
    assert got == [("a", "z1", "k1"), ("b", "z1", "k1"), ("b", "z2", "k2")]


def test_optional_filter_sees_the_left_side(spark):
    d = dataset(spark, ("a", "n", 1), ("b", "n", 5), ("a", "m", 3), ("b", "m", 3))
    assert ask(d, "SELECT ?s ?m { ?s :n ?n OPTIONAL { ?s :m ?m FILTER(?m > ?n) } }") == [("a", "3"), ("b", None)]


def test_minus(spark):
    d = dataset(spark, ("a", "p", "x"), ("b", "p", "y"), ("a", "q", "z"))
    assert ask(d, "SELECT ?s { ?s :p ?o MINUS { ?s :q ?v } }") == [("b",)]
    assert len(ask(d, "SELECT ?s { ?s :p ?o MINUS { ?t :q ?v } }")) == 2
    assert len(ask(d, "SELECT ?s { ?s :p ?o MINUS { VALUES (?s ?z) { (UNDEF 1) } } }")) == 2


def test_graphs_and_merge(spark):
    rows = [("a", "p", "x", term("g1")), ("a", "p", "x", term("g2")), ("b", "p", "y", term("g2")), ("c", "p", "z")]
    d = dataset(spark, *[r if len(r) == 3 else (*r[:3], r[3][1:].removeprefix(E)) for r in rows])
    assert len(ask(d, "SELECT ?s { ?s :p ?o }")) == 3
    assert ask(d, "SELECT ?g { GRAPH ?g { :a :p ?o } }") == [("g1",), ("g2",)]
    assert ask(d, "SELECT ?s FROM :g1 FROM :g2 { ?s :p ?o }") == [("a",), ("b",)]
    assert ask(d, "SELECT ?s FROM NAMED :g2 { GRAPH ?g { ?s :p ?o } }") == [("a",), ("b",)]
    assert ask(d, "SELECT ?o { GRAPH ?g { :a :p+ ?o } }") == [("x",), ("x",)]


def test_unknown_values_are_errors_not_failures(spark):
    d = dataset(spark, ("a", "n", 1), ("b", "n", "'word"), ("c", "n", 2.5), ("d", "n", "x"))
    assert ask(d, "SELECT ?s { ?s :n ?n FILTER(?n > 0) }") == [("a",), ("c",)]
    assert ask(d, "SELECT ?s { ?s :n ?n FILTER(!(?n > 0)) }") == []
    assert ask(d, "SELECT ?s ?x { ?s :n ?n BIND(?n + 1 AS ?x) }") == [("a", "2"), ("b", None), ("c", "3.5"), ("d", None)]
    assert ask(d, "SELECT ?s { ?s :n ?n FILTER(?n / 0 > 1 || true) }") == [("a",), ("b",), ("c",), ("d",)]


def test_aggregates(spark):
    d = dataset(spark, ("a", "n", 1), ("a", "n", 2), ("b", "n", 2), ("b", "n", "'x"))
    assert ask(d, "SELECT (COUNT(*) AS ?c) (SUM(?n) AS ?t) { ?s :m ?n }") == [("0", "0")]
    assert ask(d, "SELECT ?s (SUM(?n) AS ?t) (COUNT(DISTINCT ?n) AS ?c) { ?s :n ?n } GROUP BY ?s") == [("a", "3", "2"), ("b", None, "2")]
    assert ask(d, "SELECT ?s (MAX(?n) AS ?m) (MIN(?n) AS ?l) { ?s :n ?n } GROUP BY ?s ORDER BY ?s") == [("a", "2", "1"), ("b", "2", "x")]
    assert ask(d, "SELECT ?s { ?s :n ?n } GROUP BY ?s HAVING(SUM(?n) > 2)") == [("a",)]
    assert ask(d, "SELECT (COUNT(?s) + 1 AS ?c) { ?s :n ?n }") == [("5",)]
    assert ask(d, "SELECT ?k (COUNT(*) AS ?c) { ?s :n ?n } GROUP BY (STRLEN(STR(?s)) AS ?k)") == [("10", "4")]


def test_order_of_mixed_terms(spark):
    d = dataset(spark, ("s", "v", "u"), ("s", "v", 10), ("s", "v", 9.5), ("s", "v", "'b"), ("s", "v", "'a"), ("s", "v", True), ("s", "v", "Bx"))
    rows = [show(r[0]) for r in d.query("SELECT ?v { :s :v ?v } ORDER BY ?v", NS).collect()]
    assert rows == ["true", "a", "b", "9.5", "10", "_:", "u"]


def test_forms(spark):
    d = dataset(spark, ("a", "p", "Bx"), ("Bx", "q", "'v"), ("Bx", "r", "By"), ("By", "q", "'w"), ("c", "p", "d"))
    assert len(ask(d, "DESCRIBE :a")) == 4
    assert len(ask(d, "DESCRIBE ?s { ?s :p :d }")) == 1
    assert [r[0] for r in d.query("ASK { :a :p ?x }", NS).collect()] == [True]
    assert [r[0] for r in d.query("ASK { :a :zzz ?x }", NS).collect()] == [False]
    assert ask(d, "CONSTRUCT { ?o :of ?s } WHERE { ?s :q ?o }") == []
    assert len(ask(d, "CONSTRUCT { ?s :has [ :val ?o ] } WHERE { ?s :q ?o }")) == 4
    assert len(ask(d, "CONSTRUCT WHERE { ?s :q ?o }")) == 2


def test_bindings_functions_and_repeated_variables(spark):
    d = dataset(spark, ("a", "p", "a"), ("a", "p", "b"), functions={"http://f/twice": lambda x: T.literal(__import__("pyspark.sql.functions", fromlist=["concat"]).concat(T.lexical_form(x), T.lexical_form(x)))})
    assert ask(d, "SELECT ?s { ?s :p ?s }") == [("a",)]
    assert ask(d, "SELECT ?o { ?s :p ?o }", bindings={"s": term("a"), "o": term("b")}) == [("b",)]
    assert len(ask(d, "SELECT ?s { ?s :p ?o }", bindings={"o": term("b")})) == 1
    assert ask(d, "SELECT ?x { :a :p :b BIND(<http://f/twice>('ab') AS ?x) }") == [("abab",)]


def test_language_and_datatype_functions(spark):
    d = dataset(spark, ("a", "l", T.literal_code("colour", lang="en-GB")), ("b", "l", T.literal_code("kleur", lang="nl")), ("c", "l", "'plain"))
    assert ask(d, "SELECT ?s { ?s :l ?x FILTER(LANGMATCHES(LANG(?x), 'EN')) }") == [("a",)]
    assert ask(d, "SELECT ?s { ?s :l ?x FILTER(LANG(?x) = '') }") == [("c",)]
    assert ask(d, "SELECT ?s { ?s :l ?x FILTER(?x = 'kleur'@nl) }") == [("b",)]
    assert ask(d, "SELECT ?y { VALUES ?x { '2011-01-10T14:45:13.815-05:00'^^xsd:dateTime } BIND(CONCAT(TZ(?x), ' ', STR(TIMEZONE(?x))) AS ?y) }") == [("-05:00 -PT5H",)]
    assert ask(d, "SELECT ?y { VALUES ?x { '5' } BIND(xsd:integer(?x) + 1 AS ?y) }") == [("6",)]


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x { ?x :p }", "SELECT ?x { ?x nope:p ?y }", "SELECT ?x { SERVICE <http://s> { ?x ?p ?o } }", "SELECT ?x { ?x ?p ?o } LIMIT x", "INSERT DATA { }", "SELECT ?x { ?x ?p 'open }"])
def test_bad_texts(text):
    with pytest.raises((SparqlError, ValueError)):
        parse(text, NS)


def test_syntax_forms():
    q = parse('PREFIX p: <http://p/> SELECT * { ?s a p:C ; p:a "x"@en, 1.5e3 . [] p:b ( 1 2 ) . # note\n FILTER(?s NOT IN (p:x)) }')
    assert q.select is None and len(q.body.body.triples) == 8


def test_quads_text_round_trip(spark):
    codes = [("Ua:s", "Ua:p", T.literal_code('a "quoted"\n\t\\ line')), ("Bb", "Ua:p", T.literal_code("x", lang="en")), ("Ua:s", "Ua:p", T.literal_code("1", T.XSD + "integer")), ("Ua:s", "Ua:p", "Bz")]
    q = spark.createDataFrame([(*c, g) for c in codes for g in (None, "Ua:g")], "s string, p string, o string, g string")
    lines = Q.to_nquads(q)
    extra = spark.createDataFrame([("# comment",), ("",), ("<a:s> <a:p> .",), ("nonsense",)], "value string")
    assert sorted(map(str, Q.parse_nquads(lines.unionByName(extra)).collect())) == sorted(map(str, q.collect()))
    assert Q.deskolemize(Q.skolemize(q)).exceptAll(q).count() == 0
    assert Q.remove_quads(q, q.where("g is null")).count() == 4 and Q.add_quads(q, q).count() == 8


def test_path_over_repeated_lines(spark, data):
    from quadloom.reference_queries import QUERIES

    lines = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    got = QUERIES["path_seq_set"](spark, data)
    assert got.count() == got.distinct().count() == lines.distinct().count() < lines.count()


def test_closures_over_all_users(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from quadloom.graph_queries import next_users
    from quadloom.reference_queries import QUERIES

    rng, start = random.Random(1), datetime(2024, 1, 1)
    users = [rng.randrange(12) for _ in range(20)] + list(range(200, 205))  # a part with cycles, then a chain beyond 97
    users.insert(5, 1)
    rows = [(i, start + timedelta(seconds=i // 3), u) for i, u in enumerate(users)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    edges = set(zip(users, users[1:]))
    assert {tuple(r) for r in next_users(spark.read.parquet(f"{tmp_path}/events.parquet")).collect()} == edges
    plus = set(edges)
    while more := {(a, d) for a, b in plus for c, d in edges if b == c} - plus:
        plus |= more
    got = {n: sorted(tuple(r) for r in QUERIES[n](spark, str(tmp_path)).collect()) for n in ("path_plus_users", "path_star_users", "path_plus_from_users")}
    assert got["path_plus_users"] == sorted(plus)
    assert got["path_star_users"] == sorted(plus | {(u, u) for u in users})
    assert got["path_plus_from_users"] == sorted((b,) for a, b in plus if a == 1)


def test_distinct_keeps_the_order(spark):
    d = dataset(spark, *[(f"s{i}", "v", i % 7) for i in range(60)])
    assert [show(r[0]) for r in d.query("SELECT DISTINCT ?v { ?s :v ?v } ORDER BY DESC(?v) LIMIT 3", NS).collect()] == ["6", "5", "4"]
    assert [show(r[0]) for r in d.query("SELECT DISTINCT ?v { ?s :v ?v } ORDER BY ?v OFFSET 2 LIMIT 3", NS).collect()] == ["2", "3", "4"]
    assert [show(r[0]) for r in d.query("SELECT DISTINCT ?v { ?s :v ?v } ORDER BY (0 - ?v) LIMIT 2", NS).collect()] == ["6", "5"]


def test_from_and_from_named(spark):
    d = dataset(spark, ("a", "p", "x", "g1"), ("b", "p", "y", "g2"), ("c", "p", "z"))
    assert ask(d, "SELECT ?s FROM :g1 { ?s :p ?o }") == [("a",)]
    assert ask(d, "SELECT ?s ?g FROM :g1 { GRAPH ?g { ?s :p ?o } }") == []
    assert ask(d, "SELECT ?s FROM NAMED :g1 { ?s :p ?o }") == []
    assert ask(d, "SELECT ?s ?g FROM NAMED :g1 { GRAPH ?g { ?s :p ?o } }") == [("a", "g1")]
    assert ask(d, "SELECT ?s ?t FROM :g1 FROM NAMED :g2 { ?s :p ?o GRAPH ?g { ?t :p ?x } }") == [("a", "b")]


def value(spark, expression, **options):
    got = ask(dataset(spark, ("a", "p", "b"), **options), f"SELECT ?x {{ BIND({expression} AS ?x) }}")
    return got[0][0]


@pytest.mark.parametrize(
    "expression,want",
    [
        ("9007199254740993 = 9007199254740992", "false"),
        ("9007199254740993 + 1", "9007199254740994"),
        ("0.1 + 0.2", "0.3"),
        ("STR(DATATYPE(1.5))", T.XSD + "decimal"),
        ("STR(DATATYPE(4/2))", T.XSD + "decimal"),
        ("STR(DATATYPE(1 + 1))", T.XSD + "integer"),
        ("STR(DATATYPE(1 + 1.5))", T.XSD + "decimal"),
        ("STR(DATATYPE(1.5 * 1e0))", T.XSD + "double"),
        ("STR(DATATYPE('1'^^xsd:float + 1.5))", T.XSD + "float"),
        ("1 / 4", "0.25"),
        ("1 / 3", "0.333333333333333333"),
        ("1 / 0", None),
        ("3000000000 * 3000000000", "9000000000000000000"),
        ("-(2.50)", "-2.5"),
        ("2.50", "2.50"),
        ("ROUND(2.5)", "3"),
        ("CEIL(-1.5)", "-1"),
        ("xsd:integer('7')", "7"),
        ("xsd:integer('7.5')", None),
        ("xsd:integer(7.9)", "7"),
        ("xsd:decimal('0.10')", "0.1"),
        ("HOURS('2015-01-01T00:30:00+02:00'^^xsd:dateTime)", "0"),
        ("YEAR('2015-01-01T00:30:00+02:00'^^xsd:dateTime)", "2015"),
        ("SECONDS('2015-01-01T00:30:05.125Z'^^xsd:dateTime)", "5.125"),
        ("MONTH('2015-03-01'^^xsd:date)", "3"),
        ("YEAR('word')", None),
        ("'2015-01-01T00:30:00+02:00'^^xsd:dateTime = '2014-12-31T22:30:00Z'^^xsd:dateTime", "true"),
        ("SUBSTR('hello', 0, 3)", "he"),
        ("SUBSTR('hello', 2)", "ello"),
        ("SUBSTR('hello', 2, 100)", "ello"),
        ("SUBSTR('hello', -5, 3)", ""),
        ("SUBSTR('hello', 1.5, 2.6)", "ell"),
        ("LANG(UCASE('a'@en))", "en"),
        ("LANG(STRBEFORE('abc'@en, 'c'))", "en"),
        ("LANG(STRBEFORE('abc'@en, 'x'))", ""),
        ("LANG(CONCAT('a'@en, 'b'@en))", "en"),
        ("LANG(CONCAT('a'@en, 'b'@nl))", ""),
        ("LANG(REPLACE('abc'@en, 'b', 'x'))", "en"),
        ("REGEX('a.c', 'A.C', 'qi')", "true"),
        ("REGEX('abc', 'a.c', 'q')", "false"),
        ("UCASE(5)", None),
        ("'5' = 5", None),
        ("IF(1.0 = 1, 'same', 'other')", "same"),
    ],
)
def test_values(spark, expression, want):
    assert value(spark, expression) == want


def test_unknown_flags_are_refused(spark):
    with pytest.raises(SparqlError):
        value(spark, "REGEX('a', 'a', 'g')")


def test_exact_aggregates(spark):
    d = dataset(spark, ("a", "n", 9007199254740993), ("b", "n", 9007199254740993), ("c", "n", 1))
    assert ask(d, "SELECT (SUM(?n) AS ?t) (SUM(DISTINCT ?n) AS ?u) { ?s :n ?n }") == [("18014398509481987", "9007199254740994")]
    assert ask(d, "SELECT (MAX(?n) AS ?t) (COUNT(DISTINCT ?n) AS ?u) { ?s :n ?n }") == [("9007199254740993", "2")]
    d = dataset(spark, ("a", "n", 1), ("b", "n", 2))
    assert ask(d, "SELECT (AVG(?n) AS ?t) (DATATYPE(AVG(?n)) AS ?u) { ?s :n ?n }") == [("1.5", T.XSD + "decimal")]
    assert ask(d, "SELECT (AVG(?n) AS ?t) { ?s :none ?n }") == [("0",)]


LOOSE = [("a", "p", "x"), ("b", "p", "y"), ("c", "p", "z"), ("a", "q", "k1"), ("b", "q", "k2"), ("k1", "r", "w1"), ("k3", "r", "w3"), ("a", "t", "w1")]


def test_loose_variables(spark):
    d = dataset(spark, *LOOSE)
    chain = "?s :p ?o OPTIONAL { ?s :q ?v }"
    assert ask(d, f"SELECT ?s ?v ?w {{ {chain} OPTIONAL {{ ?v :r ?w }} }}") == [("a", "k1", "w1"), ("b", "k2", None), ("c", "k1", "w1"), ("c", "k3", "w3")]
    assert ask(d, f"SELECT ?s ?v ?w {{ {chain} OPTIONAL {{ ?v :r ?w FILTER(?s = :a || ?w = :w3) }} }}") == [("a", "k1", "w1"), ("b", "k2", None), ("c", "k3", "w3")]
    assert ask(d, f"SELECT ?s {{ {chain} MINUS {{ ?v :r ?w }} }}") == [("b",), ("c",)]
    assert ask(d, f"SELECT ?s {{ {chain} FILTER EXISTS {{ ?v :r ?w }} }}") == [("a",), ("c",)]
    assert ask(d, f"SELECT ?s {{ {chain} FILTER NOT EXISTS {{ ?v :r ?w }} }}") == [("b",)]
    assert ask(d, f"SELECT ?s {{ {chain} FILTER(!EXISTS {{ ?v :r ?w }} || ?s = :a) }}") == [("a",), ("b",)]
    assert ask(d, "SELECT ?s ?v { ?s :p ?o OPTIONAL { { ?s :q ?v } UNION { ?s :zzz ?u } } MINUS { VALUES (?v ?u) { (:k1 UNDEF) (UNDEF :none) } } }") == [("b", "k2"), ("c", None)]
    # the right side may leave it open, too
    assert ask(d, "SELECT ?v ?w { VALUES ?v { :k1 :k9 } OPTIONAL { VALUES (?v ?w) { (:k1 1) (UNDEF 2) } } }") == [("k1", "1"), ("k1", "2"), ("k9", "2")]
    assert ask(d, "SELECT ?v { VALUES ?v { :k1 :k9 } MINUS { VALUES (?v ?w) { (:k1 1) (UNDEF 2) } } }") == [("k9",)]


def test_exists_sees_the_outside_in_inner_groups(spark):
    d = dataset(spark, ("a", "n", 1), ("b", "n", 5), ("a", "m", 3), ("b", "m", 3), ("c", "n", 9))
    assert ask(d, "SELECT ?s { ?s :n ?n FILTER EXISTS { ?s :m ?m FILTER(?m > ?n) } }") == [("a",)]
    assert ask(d, "SELECT ?s { ?s :n ?n FILTER EXISTS { { ?s :m ?m FILTER(?m > ?n) } } }") == [("a",)]
    assert ask(d, "SELECT ?s { ?s :n ?n FILTER EXISTS { { ?s :m ?m FILTER(?m > ?n) } UNION { ?s :n ?k FILTER(?k = ?n && ?n > 8) } } }") == [("a",), ("c",)]
    assert ask(d, "SELECT ?s { ?s :n ?n FILTER NOT EXISTS { { ?s :m ?m FILTER(?m > ?n) } } }") == [("b",), ("c",)]
    assert ask(d, "SELECT ?s { ?s :n ?n FILTER(?n > 8 || EXISTS { { ?s :m ?m FILTER(?m < ?n) } }) }") == [("b",), ("c",)]


def test_split_variables_have_keys(spark):
    """Where a variable may be open, the rows that bind it are joined by key; only rows that don't bind it meet all."""
    d = dataset(spark, *LOOSE)
    plan = d.query("SELECT ?s ?v ?w { ?s :p ?o OPTIONAL { ?s :q ?v } OPTIONAL { ?v :r ?w . ?s :t ?w } }", NS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    plan = d.query("SELECT ?s { ?s :p ?o OPTIONAL { ?s :q ?v } MINUS { ?v :r ?w } }", NS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_rewritten_names(spark):
    """Queries and results speak of one name space, the quads of another."""
    d = dataset(spark, ("a", "p", "b", "g"), ("b", "p", "c", "g"), ("c", "q", "'lit", "g"))
    mirror = Dataset(d.quads, rewrite=("http://m/", E))
    names = {"": "http://m/"}
    rows = lambda text, **o: sorted(tuple(x and x[1:] if x and x[0] == "U" else show(x) for x in r) for r in mirror.query(text, names, **o).collect())
    assert rows("SELECT ?s ?o { ?s :p ?o }") == [("http://m/a", "http://m/b"), ("http://m/b", "http://m/c")]
    assert rows("SELECT ?o { :a :p+ ?o }") == [("http://m/b",), ("http://m/c",)]
    assert rows("SELECT ?o FROM :g { VALUES ?s { :c } ?s !(:p|^:p) ?o FILTER(?s != :a) }") == [("lit",)]
    assert rows("SELECT ?o { ?s :p ?o }", bindings={"s": "Uhttp://m/a"}) == [("http://m/b",)]
    assert [r[0] for r in mirror.query("ASK { GRAPH :g { :a :p ?x } }", names).collect()] == [True]
    assert ask(d, "SELECT ?s { ?s :q ?o }") == [("c",)]
