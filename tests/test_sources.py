import bz2
import gzip
import lzma


from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.functions import texts as X
from quadloom.operators import workload as W
from quadloom.sources import files as FS
from quadloom.sources import quads as Q
from quadloom.sources import results as RS
from quadloom.sources.store import QUADS, Store

TERMS = ["Uhttp://a/x", "Bb1", T.literal_code('q "x", y\nz<&>'), T.literal_code("é", lang="en"), T.literal_code("1", T.XSD + "integer"), None]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(b"one"))
    (tmp_path / "b.txt.xz").write_bytes(lzma.compress(b"two"))
    (tmp_path / "c.txt.bz2").write_bytes(bz2.compress(b"three"))
    (tmp_path / "d.txt").write_bytes(b"four")
    (tmp_path / "e.gz").write_bytes(b"damaged")
    found = FS.read_files(spark, f"file://{tmp_path}")
    assert {r.name: (r.size, r.mime) for r in found.collect()}["d.txt"] == (4, "text/plain")
    assert {r.name: bytes(r.content) for r in FS.decompress(found).collect()} == {"a.txt": b"one", "b.txt": b"two", "c.txt": b"three", "d.txt": b"four"}
    store, status = FS.add_files(found.select("name", "content", "size", "md5", "mime"), found.select("name", "content").unionByName(spark.createDataFrame([("n", bytearray(b""))], "name string, content binary")))
    assert store.count() == 6 and {r.status for r in status.where("name = 'n'").collect()} == {"OK_CREATED"} and status.where("status like 'ERROR%'").count() == 5
    store, status = FS.remove_files(store, spark.createDataFrame([("n",), ("zz",)], "name string"))
    assert store.count() == 5 and {r.name: r.status for r in status.collect()} == {"n": "OK_DELETED", "zz": "ERROR_OBJECT_NOT_FOUND"}
    assert [r[0] for r in spark.range(1).select(FS.compressible(F.lit("image/png"))).collect()] == [False]


def test_quads_from_packed_files(spark, tmp_path):
    line = '<http://a> <http://p> "x"@en <http://g> .\n'
    (tmp_path / "q.nq.gz").write_bytes(gzip.compress(line.encode() * 3))
    assert RS.read_rdf(spark, f"file://{tmp_path}/q.nq.gz").distinct().count() == 1
    q = spark.createDataFrame([("Ua:s", "Ua:p", t, "Ua:g") for t in TERMS if t], QUADS)
    RS.write_rdf(q, f"file://{tmp_path}/out", compression="gzip")
    assert RS.read_rdf(spark, f"file://{tmp_path}/out").exceptAll(q).count() == 0


def test_results(spark, tmp_path):
    s = spark.createDataFrame([(a, b) for a in TERMS for b in (None, "Ua:b")], "x string, y string")
    RS.to_json_lines(s).write.text(f"file://{tmp_path}/json")
    assert RS.read_bindings(spark, f"file://{tmp_path}/json", ["x", "y"]).exceptAll(s).count() == 0
    one = s.where(F.col("x") == TERMS[2]).where("y is null")
    assert RS.to_csv(one).collect()[0][0] == '"q ""x"", y\nz<&>",'
    assert RS.to_tsv(one).collect()[0][0] == '"q \\"x\\", y\\nz<&>"\t'
    assert RS.to_xml(one).collect()[0][0] == '<result><binding name="x"><literal>q &quot;x&quot;, y\nz&lt;&amp;&gt;</literal></binding></result>'


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", QUADS)
    assert store.read().count() == 0 and store.version() is None
    store.write(spark.createDataFrame([("Ua", "Ub", "Uc", None)], QUADS), sort_by="s")
    first = store.version()
    store.change(lambda old: Q.add_quads(old, spark.createDataFrame([("Ud", "Ub", "Uc", None)], QUADS)))
    assert store.read().count() == 2 and store.version() != first
    store.reset()
    assert store.read().count() == 0 and store.purge() == 2


def test_parameters(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("?event\t?year\ne1\t2001\nbroken\ne2\t2002\n")
    got = FS.read_parameters(spark, f"file://{tmp_path}/p.tsv")
    assert sorted(map(tuple, got.collect())) == [("e1", "2001"), ("e2", "2002")]
    FS.write_parameters(got, f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out", sep="\t", header=True).columns == ["?event", "?year"]


XML = """<NAF><nafHeader/><text><wf id="w1" offset="0" length="4" sent="1">Anna</wf><wf id="w2" offset="5" length="4" sent="1">left</wf></text>
<terms><term id="t1" lemma="Anna" pos="R"><span><target id="w1"/></span></term><term id="t2" lemma="leave" pos="V"><span><target id="w2"/></span></term></terms>
<entities><entity id="e1" type="PERSON"><references><span><target id="t1"/></span></references><externalReferences><externalRef resource="spotlight" reference="http://dbpedia.org/resource/Anna" confidence="0.7"/></externalReferences></entity></entities>
<timeExpressions><timex3 id="tx0" type="DATE" value="2014"/><timex3 id="tx1" type="DATE" value="2015"><span><target id="w2"/></span></timex3></timeExpressions></NAF>"""


def test_annotated_xml(spark, tmp_path):
    from quadloom.operators import mentions as M

    (tmp_path / "d1.naf").write_text(XML)
    t = FS.read_annotations(spark, f"file://{tmp_path}/*.naf")
    assert t["words"].count() == 2 and t["terms"].count() == 2 and t["times"].count() == 2
    spans = M.spans(t["entities"], t["terms"], t["words"]).collect()
    assert [(r.doc, r.owner, r.begin, r.end) for r in spans] == [("d1.naf", "e1.0", 0, 4)]
    assert M.best_reference(t["references"]).collect()[0].reference.endswith("Anna")
    got = {r.mention: (r.types, r.props) for r in M.extract(t).collect()}
    assert got == {
        "d1.naf#char=0,4": (["object", "person"], {"refersTo": "http://dbpedia.org/resource/Anna"}),
        "d1.naf#char=5,9": (["time", "timex3_date"], {"value": "2015"}),
    }


def test_changes_rewrite_the_parts_they_touch(spark, tmp_path):
    from quadloom.functions import paths
    from quadloom.operators import records as R
    from quadloom.sources.store import RecordStore

    store = RecordStore(spark, f"file://{tmp_path}/r", parts=8)
    df = spark.range(200).selectExpr("cast(id as string) as id", "id % 3 as a", "cast(id as string) as b", "array() as c")
    store.write(R.from_columns(df, F.col("id"), {"http://p/a": "a", "http://p/b": "b"}))
    before = store._manifest(store.version())["folders"]
    assert len(before) == 8 and store.read().count() == 200

    plan = R.retrieve(store.read(), [paths.condition("p:a = 1", {"p": "http://p/"})])._jdf.queryExecution().executedPlan().toString()
    counted = R.retrieve(store.read(), [paths.condition("p:a = 1", {"p": "http://p/"})]).agg(F.count(F.lit(1)))
    assert counted.collect()[0][0] == 67
    read = counted._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].split("\n")[0]
    assert "c0" in read and "c1" not in read and "id" not in read, plan

    one = spark.createDataFrame([("7", {"http://p/new": ["Ux"]})], "id string, props map<string,array<string>>")
    store.change(lambda old: R.present(old).where("id <> '7'").unionByName(one), keys=one)
    after = store._manifest(store.version())["folders"]
    assert sum(before[n] != after[n] for n in before) == 1 and store.read().count() == 200
    assert R.present(store.read(one)).where("id = '7'").collect()[0].props == {"http://p/new": ["Ux"]}
    assert store.read(one).count() < 60
    store.change(lambda old: R.present(old).where("id <> '9'"), where=F.col("id") == "9")
    assert store.read().count() == 199 and store.purge() == 2 and store.read().count() == 199
    store.change(lambda old: old.limit(0), where=F.lit(False))
    assert store.read().count() == 199


LAYERS = """<NAF xml:lang="en"><nafHeader><fileDesc title="T" creationtime="2015-01-02" filename="f.txt"/><public publicId="p1" uri="http://d/1"/>
<linguisticProcessors layer="terms"><lp name="tagger" version="1"/></linguisticProcessors><linguisticProcessors layer="srl"><lp name="roles" version="2"/></linguisticProcessors></nafHeader>
<text><wf id="w1" offset="0" length="4" sent="1">Anna</wf><wf id="w2" offset="5" length="6" sent="1">bought</wf><wf id="w3" offset="12" length="3" sent="1">Acme</wf><wf id="w4" offset="16" length="9" sent="1">yesterday</wf>
<wf id="w5" offset="26" length="3" sent="2">She</wf><wf id="w6" offset="30" length="6" sent="2">smiled</wf></text>
<terms>""" + "".join(f'<term id="t{i}" lemma="{l}" pos="{p}"><span><target id="w{i}"/></span></term>' for i, (l, p) in enumerate([("Anna", "R"), ("buy", "V"), ("Acme", "R"), ("yesterday", "A"), ("she", "Q"), ("smile", "V")], 1)) + """</terms>
<entities><entity id="e1" type="PERSON"><references><span><target id="t1"/></span></references></entity><entity id="e2" type="ORG"><references><span><target id="t3"/></span></references></entity></entities>
<coreferences><coref id="co1"><span><target id="t1"/></span><span><target id="t5"/></span></coref><coref id="co2" type="event"><span><target id="t6"/></span></coref></coreferences>
<timeExpressions><timex3 id="tmx0" type="DATE" value="2015-01-02"/><timex3 id="tmx1" type="DATE" value="2015-01-01"><span><target id="w4"/></span></timex3></timeExpressions>
<factualities><factuality id="f1"><span><target id="t2"/></span><factVal resource="factbank" value="CT+"/></factuality></factualities>
<srl><predicate id="pr1"><externalReferences><externalRef resource="EventType" reference="contextual"/><externalRef resource="VerbNet" reference="get-13.5.1"/></externalReferences><span><target id="t2"/></span>
<role id="r1" semRole="A0"><span><target id="t1"/></span></role><role id="r2" semRole="A1"><span><target id="t3"/></span></role><role id="r3" semRole="AM-TMP"><span><target id="t4"/></span></role>
<role id="r4" semRole="A2"><span><target id="t5"/><target id="t6"/></span></role></predicate>
<predicate id="pr2"><externalReferences/><span><target id="t6"/></span></predicate></srl>
<temporalRelations><tlink id="l1" from="pr1" to="tmx0" fromType="event" toType="timex" relType="BEFORE"/><tlink id="l2" from="pr1" to="pr2" fromType="event" toType="event" relType="BEFORE"/>
<predicateAnchor id="a1" anchorTime="tmx1"><span><target id="pr1"/></span></predicateAnchor></temporalRelations>
<causalRelations><clink id="c1" from="pr1" to="pr2"/></causalRelations></NAF>"""


def test_extraction_of_all_layers(spark, tmp_path):
    from quadloom.operators import mentions as M

    (tmp_path / "d.naf").write_text(LAYERS)
    t = FS.read_annotations(spark, f"file://{tmp_path}/*.naf")
    assert {n: df.count() for n, df in t.items()} == {
        "headers": 1, "processors": 2, "words": 6, "terms": 6, "entities": 2, "references": 0, "coreferences": 3, "times": 2, "factualities": 1, "predicates": 2, "predicate_references": 3,
        "anchors": 1, "roles": 5, "links": 3,
    }
    got = {r.mention.removeprefix("d.naf#char="): (sorted(r.types), r.props) for r in M.extract(t).collect()}
    at = lambda x: "d.naf#char=" + x
    assert got["0,4"] == (["object", "person"], {}) and got["12,15"] == (["object", "organization"], {})
    assert got["26,29"] == (["object", "person"], {"coreference": "co1"})
    assert got["16,25"] == (["time", "timex3_date"], {"value": "2015-01-01"})
    assert got["5,11"] == (["event"], {"factBank": "CT+", "pred": "buy", "pos": "verb", "eventClass": "other", "verbnetRef": "get-13.5.1", "anchorTime": at("16,25"), "tlinkToTmx0": "BEFORE"})
    assert got["30,36"] == (["event"], {"coreference": "co2", "pred": "smile", "pos": "verb", "eventClass": "other"})
    assert got["0,11"] == (["participation", "relation"], {"source": at("5,11"), "target": at("0,4"), "role": "A0"})
    assert got["5,15"][1]["role"] == "A1" and got["5,25"] == (["relation", "tlink"], {"source": at("5,11"), "target": at("16,25")})
    assert got["5,36"][0] == ["clink", "relation"] and got["5,36"][1]["source"] == at("5,11") and got["5,36"][1]["target"] == at("30,36")
    assert len(got) == 10 and {r.type: r.n for r in M.statistics(M.extract(t)).collect()}["event"] == 2
    rows = {(r.property, r.value) for r in M.document_resources(t["headers"]).collect()}
    assert {("created", "2015-01-02"), ("layer", "srl"), ("layer", "terms"), ("identifier", "d.naf")} <= rows


def test_utilities(spark):
    row = spark.range(1).select(
        X.is_valid_iri(F.lit("http://a/b%20c")), X.is_valid_iri(F.lit("a b")), X.clean_iri(F.lit("http://a/b c%é")), X.clean_iri(F.lit("rel")), X.prefix_of(F.lit("http://a/b"), {"a": "http://a/", "h": "http://"}),
        X.language_uri(F.lit("en-GB")), X.language_code(F.lit("http://lexvo.org/id/iso639-3/nld")), X.normalize_values(F.array(F.array(F.lit("a"), F.lit(None)), F.lit(None), F.array(F.lit("a"), F.lit("b")))),
    ).collect()[0]
    assert tuple(row) == (True, False, "http://a/b%20c%25%c3%a9", None, "a", "http://lexvo.org/id/iso639-3/eng", "nl", ["a", "b"])
    terms = spark.createDataFrame([(t,) for t in TERMS if t], "t string")
    back = terms.select("t", X.parse_value(X.print_value(F.col("t"), {"p": "http://a/"}), {"p": "http://a/"}).alias("b"))
    assert all(r.t == r.b for r in back.collect())
    assert spark.range(1).select(X.convert(F.lit(T.literal_code("x")), "int", F.lit(-1)), X.convert(F.lit(T.literal_code("7")), "int")).collect()[0] == (-1, 7)


def test_workload(spark):
    assert W.fill("a ${x} b", {"x": "1"}) == "a 1 b"
    seen = []
    trace = W.run_mixes(spark, {"q1": lambda p: seen.append(p) or spark.range(3), "q2": lambda p: 1 / 0}, [{"x": 1}], mixes=3, warmup=1)
    assert trace.count() == 6 and len(seen) == 4 and {r.error for r in trace.where("query = 'q2'").collect()} == {"ZeroDivisionError"}
    rates = {r["query"]: r for r in W.rates(trace, 2.0).collect()}
    assert rates["q1"].n == 3 and rates["q1"].rate > 0
    a = spark.createDataFrame([(i, i % 3) for i in range(9)], "x int, k int")
    b = spark.createDataFrame([(k, f"n{k}") for k in range(2)], "k int, n string")
    assert W.sample_joined([a, b], 4, seed=7).collect() == W.sample_joined([a.repartition(3), b], 4, seed=7).collect()


def test_streaming(spark, tmp_path, data):
    from quadloom.functions.uris import namespace_map
    from quadloom.operators.criteria import Criteria
    from quadloom.sources.store import RECORDS
    from quadloom.streaming import ingest

    source = spark.read.parquet(f"{data}/statements.parquet")
    stored = source.withColumn("asserted_at", F.col("asserted_at").cast("timestamp"))
    stored.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(stored.schema).parquet(f"{tmp_path}/in")
    q = ingest.first_deliveries(live, late="1000 days").writeStream.format("memory").queryName("first").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("first").count() == source.select("statement_id").distinct().count()
    ns = namespace_map(spark.read.parquet(f"{data}/prefixes.parquet"))
    w = ingest.windowed_predicates(live, ns, window="30 days").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("windows").agg(F.sum("n")).collect()[0][0] == source.where("predicate is not null").count()
    recs = source.where("subject is not null and object is not null").limit(20).groupBy("subject").agg(F.collect_set(T.literal(F.col("object"))).alias("v"))
    recs.select(F.col("subject").alias("id"), F.create_map(F.lit("p"), F.col("v")).alias("props")).write.parquet(f"{tmp_path}/rec")
    store = Store(spark, f"file://{tmp_path}/store", RECORDS)
    feed = spark.readStream.schema(RECORDS).parquet(f"{tmp_path}/rec")
    m = ingest.merge_records(feed, store, Criteria.parse("union *"), f"{tmp_path}/cp")
    m.processAllAvailable()
    m.stop()
    assert store.read().count() == recs.count()




TURTLE = """@prefix e: <http://e/> . PREFIX x: <http://x#>
e:s a e:T ; e:p "v"@en , 1.5 , [ e:q ( 1 e:o ) ] . # note
_:b e:r _:b .
@base <http://base/> .
<rel> e:p <#f>, true .
"""


def test_turtle(spark, tmp_path):
    from quadloom.sources import turtle

    rows = turtle.parse_turtle(TURTLE)
    assert len(rows) == 12 and ("Uhttp://base/rel", "Uhttp://e/p", "Uhttp://base/#f", None) in rows
    trig = turtle.parse_turtle("@prefix e: <http://e/> . e:g { e:a e:b e:c . e:d e:e e:f } GRAPH e:h { e:a e:b e:c } e:x e:y e:z .")
    assert sorted(r[3] or "" for r in trig) == ["", "Uhttp://e/g", "Uhttp://e/g", "Uhttp://e/h"]
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "b.ttl").write_text(TURTLE)
    (tmp_path / "bad.ttl").write_text("e:s e:p")
    (tmp_path / "c.rj").write_text('{"_:n": {"http://e/p": [{"type": "literal", "value": "w", "lang": "nl"}, {"type": "uri", "value": "http://e/o"}]}}')
    (tmp_path / "note.txt").write_text("nothing")
    got = turtle.read_documents(spark, f"file://{tmp_path}")
    assert got.groupBy("file").count().where("file = 'a.ttl'").collect()[0][1] == 12 and got.where("file = 'c.rj'").count() == 2 and got.where("file = 'bad.ttl'").count() == 0
    assert got.where("s like 'B%'").select("s").distinct().count() == 2 * 4 + 1
    q = got.where("file = 'a.ttl'").select("s", "p", "o", "g")
    turtle.write_turtle(q, {"e": "http://e/"}, f"file://{tmp_path}/out")
    text = "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect())
    assert sorted(r[:3] for r in turtle.parse_turtle(text)) == sorted((r.s, r.p, r.o) for r in q.collect())


def test_places_for_arguments():
    import pytest

    from quadloom.plans.parser import SparqlError, parse

    with pytest.raises(SparqlError):
        parse("SELECT ?x { ?x ?p $$ }", {})
    assert parse("SELECT ?x { ?x ?p $$ }", {}, ["Ua"]).body.triples[0].o.code == "Ua"


def test_headers_and_factuality(spark):
    from quadloom.operators import mentions as M

    heads = spark.createDataFrame([("d", "http://d", "2014", None, ["terms", None]), ("x", None, None, None, None)], "doc string, uri string, created string, language string, layers array<string>")
    got = {(r.id, r.property): r.value for r in M.document_resources(heads).collect()}
    assert got["http://d", "annotatedWith"] == "http://d.naf" and got["http://d.naf", "layer"] == "terms" and len(got) == 5
    values = spark.createDataFrame([("d", "e", "certainty", "CERTAIN"), ("d", "e", "polarity", "POS"), ("d", "z", "tense", "PAST")], "doc string, owner string, resource string, value string")
    events = spark.createDataFrame([("d", "e", "m1")], "doc string, owner string, mention string")
    assert [tuple(r) for r in M.factuality(values, events).collect()] == [("m1", "CERTAIN", "POS", None)]
