import random

from pyspark.sql import functions as F

from quadloom.operators import mentions as M

SPANS = "doc string, owner string, begin int, end int"


def test_spans_of_terms(spark):
    words = spark.createDataFrame([("d", "w1", 0, 3, 1), ("d", "w2", 4, 5, 1), ("d", "w3", 10, 2, 2)], "doc string, word string, offset int, length int, sent int")
    terms = spark.createDataFrame([("d", "t1", "w1"), ("d", "t2", "w2"), ("d", "t2", "w3")], "doc string, term string, word string")
    owners = spark.createDataFrame([("d", "e1", "t1"), ("d", "e1", "t2"), ("d", "e2", "t1"), ("d", "e3", "zz")], "doc string, owner string, term string")
    got = {r.owner: (r.begin, r.end, r.sent) for r in M.spans(owners, terms, words).collect()}
    assert got == {"e1": (0, 12, 1), "e2": (0, 3, 1)}


def test_containment_is_exact(spark):
    rng = random.Random(1)
    make = lambda n: [(f"d{rng.randrange(2)}", str(i), b := rng.randrange(2000), b + rng.randrange(1, 600)) for i in range(n)]
    inner, outer = make(60), make(60)
    want = {}
    for d, o, b, e in inner:
        hits = [((x, y) != (b, e), x - y, x, t) for c, t, x, y in outer if c == d and x >= b and y <= e]
        if hits:
            want[d, o] = min(hits)[3]
    got = {(r.doc, r.owner): r.target for r in M.contained(spark.createDataFrame(inner, SPANS), spark.createDataFrame(outer, SPANS)).collect()}
    assert got == want and len(want) > 10


def test_merging_of_mentions(spark):
    rows = [
        ("d", 0, 4, 1, "a", ["object"], {"x": "1"}),
        ("d", 0, 4, 2, "b", ["object", "person"], {"y": "2"}),
        ("d", 0, 4, 3, "c", ["event"], {}),
        ("d", 5, 9, 1, "a", ["event"], {"x": "1"}),
        ("d", 5, 9, 2, "b", ["participation", "event"], None),
        ("d", 20, 21, 1, "a", ["object"], {}),
        ("d", 20, 21, 2, "b", ["event"], {"z": "9"}),
    ]
    df = spark.createDataFrame(rows, "doc string, begin int, end int, step int, owner string, types array<string>, props map<string,string>")
    got = {r.begin: (r.types, r.props, r.refused, r.mention) for r in M.merge_mentions(df.unionByName(df.limit(0))).collect()}
    assert got[0] == (["object", "person"], {"x": "1", "y": "2"}, 1, "d#char=0,4")
    assert got[5] == (["event"], {"x": "1"}, 1, "d#char=5,9")
    assert got[20][0] == ["event"] and got[20][2] == 0


def test_references(spark):
    rows = [
        ("d", "e", "r1", "http://es.dbpedia.org/resource/A", 0.9, 0), ("d", "e", "r1", "http://dbpedia.org/resource/B", 0.2, 1), ("d", "e", "r1", "http://en.dbpedia.org/resource/C", 0.4, 2),
        ("d", "e", "r1", "http://dbpedia.org/resource/D", 0.4, 3), ("d", "f", "own", "http://x.org/1", None, 5), ("d", "f", "r1", "http://dbpedia.org/resource/B", 1.0, 1), ("d", "g", "r1", None, 1.0, 1),
    ]
    df = spark.createDataFrame(rows, "doc string, owner string, resource string, reference string, confidence double, position int")
    assert {r.owner: r.reference[-1] for r in M.best_reference(df, "own").collect()} == {"e": "C", "f": "1"}
    assert {r.owner: r.reference[-1] for r in M.best_reference(df).collect()} == {"e": "C", "f": "B"}


def test_coreference_times_and_links(spark):
    sets = spark.createDataFrame([("d", "c1", None, "s1", 0, 4), ("d", "c1", None, "s2", 10, 14), ("d", "c2", "event", "s3", 20, 24), ("d", "c3", None, "s4", 30, 31)], "doc string, set_id string, kind string, owner string, begin int, end int")
    accepted = spark.createDataFrame([("d", "m1", 0, 4, ["object", "person"])], "doc string, owner string, begin int, end int, types array<string>")
    got = {r.owner: r.types for r in M.coreference(sets, accepted).collect()}
    assert got == {"s2": ["object", "person"], "s3": ["event"]}
    times = spark.createDataFrame([("d", "t", 1, 5, "DATE", "2014"), ("d", "u", None, None, "TIME", "x")], "doc string, owner string, begin int, end int, kind string, value string")
    assert [r.types for r in M.timex(times).collect()] == [["time", "timex3_date"]]
    mentions = spark.createDataFrame([("d", 0, 4, "m1"), ("d", 10, 14, "m2")], "doc string, begin int, end int, mention string")
    links = spark.createDataFrame([("d", "causal", 10, 14, 0, 4), ("d", "causal", 10, 14, 99, 100)], "doc string, kind string, from_begin int, from_end int, to_begin int, to_end int")
    assert [tuple(r) for r in M.link_mentions(links, mentions).collect()] == [("d", "causal", "m2", "m1", 0, 14)]
    roles = spark.createDataFrame([("d", "r1", "p1", "A0", 0, 6), ("d", "r2", "p1", "A1", 50, 60)], "doc string, owner string, predicate string, role string, begin int, end int")
    preds = spark.createDataFrame([("d", "p1", "ev1")], "doc string, owner string, mention string")
    assert [tuple(r) for r in M.participations(roles, preds, accepted).collect()] == [("d", "ev1", "m1", "A0")]
    assert {r.type: r.n for r in M.statistics(accepted).collect()} == {"object": 1, "person": 1}


def test_columns(spark):
    row = spark.range(1).select(M.anchor(F.lit("abcdef"), F.lit(1), F.lit(3)), M.entity_class(F.lit("GPE")), M.entity_class(F.lit("zzz")), M.compatible(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))), M.event_class(F.lit("VBD"))).collect()[0]
    assert tuple(row) == ("bc", "location", None, True, "verb")


def test_visible_spans(spark):
    rows = [("d", "a", 0, 5), ("d", "b", 3, 8), ("d", "c", 5, 6), ("d", "e", 6, 6), ("d", None, None, 4), ("x", "q", 2, 9)]
    assert {r.owner for r in M.visible_spans(spark.createDataFrame(rows, SPANS)).collect()} == {"a", "c", "q"}


def test_hidden_links(spark):
    from quadloom.operators import analytics as A

    q = spark.createDataFrame([("Ue", "Udenotes", "Um1", "Ug"), ("Ue", "Udenotes", "Um1", "Uother"), ("Ue", "Udenotes", "Um2", None), ("Ue", "Ux", "Um3", None)], "s string, p string, o string, g string")
    assert [tuple(r) for r in A.mention_entities(q, "Udenotes", "Ug").collect()] == [("Um2", "Ue")]
    assert {r.kind: r.n for r in A.describe_terms(q).collect()} == {"uri": 4}
