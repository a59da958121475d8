"""Queries over records, dataflow steps, analyses, mentions and utilities, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import paths, terms as T, texts
from .operators import analytics, criteria, mentions, records, workload
from .operators.streams import Stream
from .reference_queries import query
from .runtime import table
from .sources import files, quads as Q, results
from .star import NS, V, decode, node, quads

def _orders(spark, d):
    """Orders as records: the customer as a link, the total, and the set of return flags of the lines."""
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    o = table(spark, d, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.withColumn("flags", F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda x: T.literal(x)))
    cols = {V + "by": node("customer", "o_custkey"), V + "total": "o_totalprice", V + "status": "o_orderstatus", V + "flag": "flags"}
    return records.columns_of(o, F.col("o_orderkey"), cols)


def _plain(array, sep=","):
    return F.array_join(F.array_sort(F.transform(array, T.lexical_form)), sep)


_FLAGS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, (SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS flags FROM orders"


@query("rec_project", f"SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(flags, '') AS flags, 1 + (flags IS NOT NULL)::INT AS props FROM ({_FLAGS})")
def rec_project(spark, d):
    kept = records.project(_orders(spark, d), [V + "flag", V + "status"])
    return kept.select("id", _plain(records.get(V + "flag")).alias("flags"), F.size("props").alias("props"))


@query("rec_filter_any", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R'))")
def rec_filter_any(spark, d):
    return records.retrieve(_orders(spark, d), [records.with_any(V + "flag", [T.literal_code("A"), T.literal_code("R")])]).select("id")


@query("rec_ids", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (1, 2, 3, 99999999)")
def rec_ids(spark, d):
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("99999999",)], "id string")
    return records.retrieve(_orders(spark, d), ids=ids).select("id", _plain(records.get(V + "status")).alias("status"))


@query("rec_page", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 7 OFFSET 20")
def rec_page(spark, d):
    return records.retrieve(_orders(spark, d), offset=20, limit=7).select("id")


@query("rec_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def rec_count(spark, d):
    test = paths.condition("v:total > 150000 and v:status = 'F'", NS)
    return records.retrieve(_orders(spark, d), [test]).agg(F.count(F.lit(1)).alias("n"))


@query("path_differs", f"SELECT CAST(o_orderkey AS VARCHAR) AS id FROM ({_FLAGS}) WHERE flags IS NOT NULL AND flags <> 'N'")
def path_differs(spark, d):
    """``!=`` holds when some value differs."""
    return _orders(spark, d).where(paths.condition("v:flag != 'N'", NS)).select("id")


@query("path_arguments", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 7 OR o_totalprice * 2 > 800000")
def path_arguments(spark, d):
    test = paths.condition("v:by = $$ or v:total * 2 > $$", NS, [T.uri_code(NS["d"] + "customer/7"), T.literal_code("800000", T.XSD + "integer")])
    return _orders(spark, d).where(test).select("id")


@query("path_nested", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 40)")
def path_nested(spark, d):
    """A step through nested records with a predicate: the lines of an order."""
    line = F.create_map(F.lit(V + "flag"), F.array(T.literal(F.col("l_returnflag"))), F.lit(V + "quantity"), F.array(T.literal(F.col("l_quantity"), T.XSD + "double")))
    lineitem = table(spark, d, "lineitem")
    ident = F.xxhash64(*lineitem.columns).cast("string")  # line numbers repeat in an order
    rows = lineitem.select("l_orderkey", ident.alias("line"), line.alias("p")).dropDuplicates(["line"])
    lines = rows.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("line", "p"))).alias("nested"), F.collect_list(T.uri(F.col("line"))).alias("lines"))
    recs = lines.select(F.col("l_orderkey").cast("string").alias("id"), F.create_map(F.lit(V + "line"), F.col("lines")).alias("props"), "nested")
    return recs.where(paths.condition("./v:line[v:flag = 'R' and v:quantity >= 40]", NS, nested="nested")).select("id")


@query(
    "path_functions",
    """SELECT CAST(n_nationkey AS VARCHAR) AS id, concat(n_name, '!') AS a, upper(n_name) AS b, substr(n_name, 2, 3) AS c, CASE WHEN strpos(n_name, 'A') > 0 THEN substr(n_name, 1, strpos(n_name, 'A') - 1) ELSE '' END AS d,
    CASE WHEN strpos(n_name, 'A') > 0 THEN substr(n_name, strpos(n_name, 'A') + 1) ELSE '' END AS e, CAST(length(n_name) AS DOUBLE) AS f, translate(n_name, 'AEI', 'xy') AS g, floor(n_nationkey / 4.0 + 0.5) AS h,
    CAST(n_nationkey % 4 AS DOUBLE) AS i, starts_with(n_name, 'A') AS j, contains(n_name, 'A') AS k FROM nation""",
)
def path_functions(spark, d):
    r = records.from_columns(table(spark, d, "nation"), F.col("n_nationkey"), {V + "name": "n_name", V + "key": "n_nationkey"})
    c = paths.Compiler(F.col("props"))
    text = lambda e: paths.as_str(c.value(paths.parse(e, NS), None))
    num = lambda e: paths.as_num(c.value(paths.parse(e, NS), None))
    bool_ = lambda e: c.boolean(paths.parse(e, NS))
    return r.select(
        "id", text("concat(v:name, '!')").alias("a"), text("upper-case(v:name)").alias("b"), text("substring(v:name, 2, 3)").alias("c"), text("substring-before(v:name, 'A')").alias("d"),
        text("substring-after(v:name, 'A')").alias("e"), num("string-length(v:name)").alias("f"), text("translate(v:name, 'AEI', 'xy')").alias("g"), num("round(v:key div 4)").alias("h"),
        num("v:key mod 4").alias("i"), bool_("starts-with(v:name, 'A')").alias("j"), bool_("contains(v:name, 'A')").alias("k"),
    )


@query("path_aggregates", "SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(count(*) AS DOUBLE) AS n, sum(q) AS s, max(q) AS high, min(q) AS low FROM (SELECT DISTINCT l_orderkey, l_quantity AS q FROM lineitem) GROUP BY 1")
def path_aggregates(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.lit(V + "q").alias("property"), T.literal(F.col("l_quantity"), T.XSD + "double").alias("value"))
    r, c = records.from_long(rows), paths.Compiler(F.col("props"))
    num = lambda e, n: paths.as_num(c.value(paths.parse(e, NS), None)).alias(n)
    return r.select("id", num("count(v:q)", "n"), num("sum(v:q)", "s"), num("max(v:q)", "high"), num("min(v:q)", "low"))


def _halves(spark, d):
    """The years of a customer's orders before and from 1995 on, as two sets of records."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.lit(V + "year").alias("property"), T.literal(F.year("o_orderdate"), T.XSD + "integer").alias("value"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    return records.from_long(o.where("even")), records.from_long(o.where("not even"))


_HALVES = """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS id, list_sort(list_distinct(list(year(o_orderdate)) FILTER (o_orderkey % 2 = 0))) AS a, list_sort(list_distinct(list(year(o_orderdate)) FILTER (o_orderkey % 2 = 1))) AS b FROM orders GROUP BY 1),
    m AS (SELECT id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM o)"""
_MERGED = {
    "overwrite": "CASE WHEN len(b) > 0 THEN b ELSE a END",
    "update": "CASE WHEN len(b) > 0 THEN b ELSE a END",
    "init": "CASE WHEN len(a) > 0 THEN a ELSE b END",
    "union": "list_sort(list_distinct(list_concat(a, b)))",
    "min": "CASE WHEN len(b) > 0 THEN [list_min(list_concat(a, b))] ELSE a END",
    "max": "CASE WHEN len(b) > 0 THEN [list_max(list_concat(a, b))] ELSE a END",
}


def _criteria_query(kind: str) -> None:
    @query(f"crit_{kind}", f"{_HALVES} SELECT id, array_to_string({_MERGED[kind]}, ',') AS years FROM m")
    def run(spark, d):
        old, new = _halves(spark, d)
        merged, _ = records.merge(old, new, criteria.Criteria.parse(f"{kind} *"))
        return merged.select("id", _plain(records.get(V + "year")).alias("years"))


for _kind in _MERGED:
    _criteria_query(_kind)


@query("crit_compose", f"{_HALVES} SELECT id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS years, CASE WHEN len(b) > 0 THEN 'new' ELSE 'old' END AS side FROM m")
def crit_compose(spark, d):
    old, new = _halves(spark, d)
    mark = lambda r, x: r.withColumn("props", F.map_concat("props", F.create_map(F.lit(V + "side"), F.array(F.lit(T.literal_code(x))))))
    merged, _ = records.merge(mark(old, "old"), mark(new, "new"), criteria.Criteria.parse("union v:year overwrite *", NS))
    return merged.select("id", _plain(records.get(V + "year")).alias("years"), _plain(records.get(V + "side")).alias("side"))


def _customers(spark, d):
    return records.from_columns(table(spark, d, "customer"), F.col("c_custkey"), {V + "name": "c_name", V + "segment": "c_mktsegment"})


@query("create_conflict", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ERROR_OBJECT_ALREADY_EXISTS' ELSE 'OK_CREATED' END AS status FROM customer")
def create_conflict(spark, d):
    r = _customers(spark, d)
    return records.create(r.where("cast(id as bigint) % 3 = 0"), r)[1]


@query(
    "merge_status",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 1 THEN 'OK_CREATED' WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' THEN 'OK_MODIFIED' ELSE 'OK_UNMODIFIED' END AS status FROM customer",
)
def merge_status(spark, d):
    r = _customers(spark, d)
    old = r.where("cast(id as bigint) % 3 <> 1")
    new = r.withColumn("props", F.when(F.col("id").cast("bigint") % 3 == 0, F.map_concat(records_without(V + "segment"), F.create_map(F.lit(V + "segment"), F.array(F.lit(T.literal_code("BUILDING")))))).otherwise(F.col("props")))
    return records.merge(old, new, criteria.Criteria.parse("overwrite *"))[1]


def records_without(prop):
    return F.map_filter("props", lambda k, v: k != prop)


@query("update_cond", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'X' ELSE c_mktsegment END AS segment FROM customer")
def update_cond(spark, d):
    out, _ = records.update(_customers(spark, d), paths.condition("v:segment = 'BUILDING'", NS), {V + "segment": [T.literal_code("X")]}, criteria.Criteria.parse("overwrite *"))
    return out.select("id", _plain(records.get(V + "segment")).alias("segment"))


@query("delete_cond", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment <> 'BUILDING'")
def delete_cond(spark, d):
    return records.delete(_customers(spark, d), paths.condition("v:segment = 'BUILDING'", NS))[0].select("id")


@query("delete_status", "SELECT CAST(k AS VARCHAR) AS id, CASE WHEN c_custkey IS NULL THEN 'ERROR_OBJECT_NOT_FOUND' ELSE 'OK_DELETED' END AS status FROM (SELECT unnest([1, 2, 3, -5]) AS k) LEFT JOIN customer ON c_custkey = k")
def delete_status(spark, d):
    return records.delete_ids(_customers(spark, d), spark.createDataFrame([("1",), ("2",), ("3",), ("-5",)], "id string"))[1]


@query("inverse_links", "SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(count(*) AS INT) AS orders FROM orders GROUP BY 1 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 0 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def inverse_links(spark, d):
    """Customers with links to their orders; customers that are missing (the odd ones) become stubs."""
    orders = records.from_columns(table(spark, d, "orders"), F.col("o_orderkey"), {V + "by": T.uri(F.col("o_custkey"))})
    linked = records.link_inverses(_customers(spark, d).where("cast(id as bigint) % 2 = 0"), orders, V + "has", V + "by", V + "Customer")
    return linked.select("id", F.size(records.get(V + "has")).alias("orders"))


@query("record_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, true AS same FROM customer")
def record_round_trip(spark, d):
    """Records to quads and back have the same content."""
    r = _customers(spark, d)
    typed = r.withColumn("props", F.map_concat("props", F.create_map(F.lit(records.RDF_TYPE), F.array(F.lit(T.uri_code(V + "Customer"))))))
    back = records.decode(records.encode(typed), [V + "Customer"]).select("id", records.content_hash(F.col("props")).alias("h"))
    return typed.join(back, "id").select("id", _plain(records.get(V + "name")).alias("name"), (records.content_hash(F.col("props")) == F.col("h")).alias("same"))


@query("record_match", "SELECT CAST(o_orderkey AS VARCHAR) AS left_id, CAST(o_custkey AS VARCHAR) AS right_id FROM orders")
def record_match(spark, d):
    orders = records.from_columns(table(spark, d, "orders"), F.col("o_orderkey"), {V + "by": T.uri(F.col("o_custkey"))})
    return records.match(orders, _customers(spark, d), V + "by")


# dataflow


@query("st_concat", "SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM mix_targets) GROUP BY 1")
def st_concat(spark, d):
    return Stream(table(spark, d, "documents").select("source")).concat(Stream(table(spark, d, "mix_targets").select("source"))).df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("st_filter_transform", "SELECT doc_id, n_chars * 2 AS twice FROM documents WHERE lang = 'en'")
def st_filter_transform(spark, d):
    return Stream(table(spark, d, "documents")).filter(F.col("lang") == "en").transform(doc_id=F.col("doc_id"), twice=F.col("n_chars") * 2).df


@query("st_distinct", "SELECT DISTINCT lang, source FROM documents")
def st_distinct(spark, d):
    return Stream(table(spark, d, "documents").select("lang", "source")).distinct().df


@query("st_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10 OFFSET 5")
def st_slice(spark, d):
    return Stream(table(spark, d, "documents").select("doc_id")).slice(5, 10, "doc_id").df


@query("st_chunk", "SELECT CAST(floor((rn - 1) / 64) AS BIGINT) AS chunk, CAST(count(*) AS INT) AS n, min(doc_id) AS first FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1")
def st_chunk(spark, d):
    out = Stream(table(spark, d, "documents").select("doc_id")).chunk(64, "doc_id", "doc_id").df
    return out.select("chunk", F.size("values").alias("n"), F.get("values", F.lit(0)).alias("first"))


@query("st_path", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def st_path(spark, d):
    e = table(spark, d, "events").select(F.from_json("props", "k string").alias("p"))
    return Stream(e).path("p", "k", kind="bigint").df


@query("st_sort_path", "SELECT event_id FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) ORDER BY k NULLS LAST, event_id LIMIT 20")
def st_sort_path(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k string").alias("p"))
    return Stream(e).sort_by_path("p", "k", kind="bigint", ties="event_id").df.limit(20).select("event_id")


@query("path_strict", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice * 2 AS twice, CAST(NULL AS DOUBLE) AS flag FROM orders")
def path_strict(spark, d):
    """A typed value that is one, and a text that is no number where the reader is lenient."""
    strict = paths.evaluate("with x: <http://example.org/vocab#> : x:total * 2", "double", strict=True)
    return _orders(spark, d).select("id", strict.alias("twice"), paths.evaluate("v:status", "double", NS).alias("flag"))


@query("path_parent", f"SELECT CAST(o_orderkey AS VARCHAR) AS id FROM ({_FLAGS}) WHERE flags LIKE '%R%'")
def path_parent(spark, d):
    """A step back up: the order of a flag."""
    return _orders(spark, d).where(paths.condition("v:flag[. = 'R']/..", NS)).select("id")


@query("st_to_map", "SELECT CAST(user_id AS BIGINT) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def st_to_map(spark, d):
    return Stream(table(spark, d, "events")).to_map("user_id", "event_type", "event_id").df


@query("st_multimap", "SELECT event_type AS key, CAST(count(*) AS INT) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def st_multimap(spark, d):
    return Stream(table(spark, d, "events")).to_multimap("event_type", "value").df.select("key", F.size("values").alias("n"))


# analyses: a user is an entity, an event a mention in the document of its type


def _links(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("entity"), F.concat_ws("#", "event_type", "event_id").alias("mention"))


@query("ent_describe", "SELECT 'http://example.org/nation/' || n_nationkey AS s, 'http://example.org/vocab#inRegion' AS p, 'http://example.org/region/2' AS o FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'http://example.org/region/2', 'http://example.org/vocab#name', r_name FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'http://example.org/region/2', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/vocab#Region'")
def ent_describe(spark, d):
    return decode(analytics.describe_entity(quads(spark, d, "nation", "region"), T.uri_code(NS["d"] + "region/2")))


@query("ent_describe_count", "SELECT count(*) + 2 AS n FROM nation WHERE n_regionkey = 2")
def ent_describe_count(spark, d):
    return analytics.count_described(quads(spark, d, "nation", "region"), T.uri_code(NS["d"] + "region/2"))


@query("graph_triples", """SELECT 'http://example.org/order/' || o_orderkey AS s, p FROM orders CROSS JOIN (VALUES ('http://example.org/vocab#by'), ('http://example.org/vocab#status'), ('http://example.org/vocab#total'), ('http://example.org/vocab#date'),
    ('http://example.org/vocab#priority'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type')) t(p) WHERE o_orderstatus = 'P'""")  # fmt: skip
def graph_triples(spark, d):
    return decode(analytics.graph_triples(quads(spark, d, "orders"), T.uri_code(NS["d"] + "status/P")).select("s", "p"))


@query("ent_counts", "SELECT user_id AS entity, count(*) AS mentions, count(DISTINCT event_type) AS resources FROM events GROUP BY 1")
def ent_counts(spark, d):
    return analytics.entity_counts(_links(spark, d))


@query("ent_mentions", "SELECT event_type || '#' || event_id AS mention, event_type AS resource FROM events WHERE user_id = 7")
def ent_mentions(spark, d):
    return analytics.entity_mentions(_links(spark, d), 7)


@query("ent_resources", "SELECT event_type AS resource, count(*) AS mentions FROM events WHERE user_id = 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def ent_resources(spark, d):
    return analytics.entity_resources(_links(spark, d), 7, 3)


@query("doc_mentions", "SELECT event_type || '#' || event_id AS mention, CAST(event_id % 50 AS INT) AS begin, CASE WHEN event_id % 3 = 0 THEN 2147483647 ELSE CAST(event_id % 50 + 5 AS INT) END AS \"end\", CAST(1 AS INT) AS entities FROM events WHERE event_type = 'error'")
def doc_mentions(spark, d):
    m = table(spark, d, "events").where("event_type = 'error'").select(F.concat_ws("#", "event_type", "event_id").alias("mention"), (F.col("event_id") % 50).cast("int").alias("begin"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 50 + 5).cast("int")).alias("end"))
    return analytics.resource_mentions(m, _links(spark, d)).select("mention", "begin", "end", F.size("entities").alias("entities"))


def _long(spark, d):
    return records.to_long(_customers(spark, d))


@query("prop_occurrences", "SELECT 'http://example.org/vocab#name' AS property, count(*) AS n FROM customer UNION ALL SELECT 'http://example.org/vocab#segment', count(*) FROM customer")
def prop_occurrences(spark, d):
    return analytics.property_occurrences(_long(spark, d))


@query("value_occurrences", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def value_occurrences(spark, d):
    return analytics.value_occurrences(_long(spark, d), V + "segment").withColumn("value", T.lexical_form(F.col("value")))


@query("prop_value_agg", "SELECT p AS property, v AS value, count(*) AS n, min(CAST(c_custkey AS VARCHAR)) AS example FROM (SELECT c_custkey, 'http://example.org/vocab#name' AS p, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'http://example.org/vocab#segment', c_mktsegment FROM customer) GROUP BY 1, 2")
def prop_value_agg(spark, d):
    return analytics.property_values(_long(spark, d)).withColumn("value", T.lexical_form(F.col("value")))


@query("with_property", "SELECT id, total FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'MACHINERY') ORDER BY id LIMIT 10")
def with_property(spark, d):
    return analytics.with_property(_long(spark, d), V + "segment", T.literal_code("MACHINERY"), 10)


@query("record_table", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def record_table(spark, d):
    out = analytics.record_table(_long(spark, d), [V + "name", V + "segment"])
    return out.select("id", T.lexical_form(F.col(f"`{V}name`")).alias("name"), T.lexical_form(F.col(f"`{V}segment`")).alias("segment"))


@query("mention_category", "SELECT CASE WHEN event_type = 'error' THEN 'problem' WHEN value > 50 THEN 'large' ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1")
def mention_category(spark, d):
    c = analytics.category(("problem", F.col("event_type") == "error"), ("large", F.col("value") > 50))
    return table(spark, d, "events").groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "latency_stats",
    """SELECT event_type, count(*) AS n, min(value) AS low, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, max(value) AS high,
    round(exp(avg(CASE WHEN value > 0 THEN ln(value) END)), 6) AS geometric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(sum(value), 2) AS total, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def latency_stats(spark, d):
    s = analytics.latency_statistics(table(spark, d, "events"), "event_type", "value")
    return s.withColumns({c: F.round(c, 6) for c in ("geometric", "mean", "deviation", "share")}).withColumn("total", F.round("total", 2))


# mentions


def _spans(spark, d, kind):
    e = table(spark, d, "events").where(F.col("event_type") == kind)
    begin = (F.col("event_id") % 997).cast("int")
    return e.select(F.col("user_id").cast("string").alias("doc"), F.col("event_id").cast("string").alias("owner"), begin.alias("begin"), (begin + 3 + (F.col("user_id") % 11)).cast("int").alias("end"))


@query(
    "span_contains",
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS doc, CAST(event_id AS VARCHAR) AS owner, event_id % 997 AS b, event_id % 997 + 3 + user_id % 11 AS e, event_type FROM events)
    SELECT doc, owner, target FROM (SELECT x.doc, x.owner, y.owner AS target, row_number() OVER (PARTITION BY x.doc, x.owner ORDER BY (x.b = y.b AND x.e = y.e) DESC, y.b - y.e, y.b, y.owner) AS rn
    FROM s x JOIN s y ON x.doc = y.doc AND x.event_type = 'view' AND y.event_type = 'error' AND y.b >= x.b AND y.e <= x.e) WHERE rn = 1""",
)
def span_contains(spark, d):
    return mentions.contained(_spans(spark, d, "view"), _spans(spark, d, "error"))


@query(
    "best_confidence",
    """SELECT CAST(user_id AS VARCHAR) AS doc, CAST(user_id % 5 AS VARCHAR) AS owner, arg_min(event_type || event_id, (CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END, -value, event_id)) AS reference FROM events GROUP BY 1, 2""",
)
def best_confidence(spark, d):
    host = F.when(F.col("event_id") % 2 == 0, "http://en.dbpedia.example/").otherwise("http://nl.dbpedia.example/")
    refs = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("doc"), (F.col("user_id") % 5).cast("string").alias("owner"), F.lit("x").alias("resource"),
        F.concat(host, "event_type", F.col("event_id").cast("string")).alias("reference"), F.col("value").alias("confidence"), F.col("event_id").alias("position"),
    )
    best = mentions.best_reference(refs)
    return best.withColumn("reference", F.regexp_replace("reference", "^http://.*/", ""))


@query(
    "mention_merge",
    """SELECT doc, begin, CAST(count(*) AS INT) AS n, min(kind) AS kind, CAST(count(*) FILTER (event_type <> kind) AS INT) AS refused FROM (SELECT CAST(user_id AS VARCHAR) AS doc, CAST(event_id % 997 AS INT) AS begin,
    event_type, first_value(event_type) OVER (PARTITION BY user_id, event_id % 997 ORDER BY CAST(event_id AS VARCHAR)) AS kind FROM events) GROUP BY 1, 2""",
)
def mention_merge(spark, d):
    """Candidates of one span and type become one mention, those of another type are refused, whatever their number."""
    e = table(spark, d, "events")
    c = e.select(F.col("user_id").cast("string").alias("doc"), (F.col("event_id") % 997).cast("int").alias("begin"), (F.col("event_id") % 997 + 4).cast("int").alias("end"), F.lit(1).alias("step"), F.col("event_id").cast("string").alias("owner"), F.array(F.lit("object"), F.col("event_type")).alias("types"), F.create_map(F.col("event_type"), F.lit("1")).alias("props"))
    merged = mentions.merge_mentions(c)
    counts = c.groupBy("doc", "begin", "end").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return merged.join(counts, ["doc", "begin", "end"]).select("doc", "begin", "n", F.get("types", F.lit(1)).alias("kind"), F.col("refused").cast("int").alias("refused"))


@query(
    "to_process",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS doc FROM events WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) WHERE last = 'error')",
)
def to_process(spark, d):
    """All users but those whose last event is an error."""
    e = table(spark, d, "events").withColumn("doc", F.col("user_id").cast("string"))
    last = e.groupBy("doc").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return mentions.to_process(e, last.where("last = 'error'"))


# quads, files, results, utilities


@query("uri_rewrite", "SELECT CAST(n_nationkey AS BIGINT) AS n, replace('http://example.org/region/' || n_regionkey, 'http://example.org/', 'https://mirror.example/') AS o FROM nation")
def uri_rewrite(spark, d):
    out = Q.rewrite_uris(quads(spark, d, "nation"), NS["d"], "https://mirror.example/").where(F.col("p") == "Uhttps://mirror.example/vocab#inRegion")
    return decode(out.select(F.col("s").alias("n"), "o"), n="key")


@query("quad_get", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation WHERE n_regionkey = 1")
def quad_get(spark, d):
    out = Q.get_quads(quads(spark, d, "nation"), p=T.uri_code(V + "inRegion"), o=T.uri_code(NS["d"] + "region/1"))
    return decode(out.select(F.col("s").alias("n")), n="key")


@query("quad_add_remove", "SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region")
def quad_add_remove(spark, d):
    names = T.uri_code(V + "name")
    a, b = quads(spark, d, "nation").where(F.col("p") == names), quads(spark, d, "region").where(F.col("p") == names)
    gone = quads(spark, d, "nation").where((F.col("p") == V + "x") | (F.col("p") == T.uri_code(V + "inRegion")) & (F.col("o") == T.uri_code(NS["d"] + "region/2"))).select("s")
    old = a.join(gone, "s", "left_semi")
    out = Q.remove_quads(Q.add_quads(Q.add_quads(a, b), b), old.select(*"spog"))
    return decode(out.select(F.col("s").alias("n"), F.col("o").alias("name")), n="key")


@query("nquads_round_trip", "SELECT 'http://example.org/order/' || o_orderkey AS s, o_orderpriority AS o, 'http://example.org/status/' || o_orderstatus AS g FROM orders")
def nquads_round_trip(spark, d):
    q = quads(spark, d, "orders").where(F.col("p") == T.uri_code(V + "priority"))
    return decode(Q.parse_nquads(Q.to_nquads(q)).select("s", "o", "g"))


@query("result_csv", "SELECT 'http://example.org/part/' || p_partkey || ',' || p_name AS value FROM part")
def result_csv(spark, d):
    q = quads(spark, d, "part").where(F.col("p") == T.uri_code(V + "name"))
    return results.to_csv(q.select("s", "o"))


@query("file_upload", "SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS md5, 'text/plain' AS mime FROM documents")
def file_upload(spark, d):
    new = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    store = spark.createDataFrame([("1.txt", bytearray(b"x"), 1, "", "")], "name string, content binary, size bigint, md5 string, mime string").where("false")
    return files.upload(store, new).select("name", "size", "md5", "mime")


@query("turtle_values", "SELECT p_partkey AS p, 'v:brand' AS name, '\"' || p_brand || '\"' AS text, true AS same FROM part")
def turtle_values(spark, d):
    q = quads(spark, d, "part").where(F.col("p") == T.uri_code(V + "brand"))
    out = q.select(F.col("s").alias("p"), texts.print_value(F.col("p"), NS).alias("name"), texts.print_value(F.col("o")).alias("text"), (texts.parse_value(texts.print_value(F.col("o"))) == F.col("o")).alias("same"))
    return out.withColumn("p", F.substring_index(T.lexical_form(F.col("p")), "/", -1).cast("bigint"))


@query("convert_values", "SELECT property_id, coalesce(CASE WHEN regexp_matches(propertyvalue, '^\\s*[+-]?[0-9]+\\s*$') THEN try_cast(regexp_replace(propertyvalue, '\\s', '', 'g') AS BIGINT) END, -1) AS n FROM record_properties WHERE propertyvalue IS NOT NULL")
def convert_values(spark, d):
    """Every property value as a whole number, -1 where it is none."""
    rows = table(spark, d, "record_properties").where("propertyvalue is not null")
    return rows.select("property_id", texts.convert(T.literal(F.trim("propertyvalue")), "bigint", F.lit(-1)).alias("n"))


@query("content_hashes", """SELECT CAST(c_custkey AS VARCHAR) AS id, md5('[{"key":"http://example.org/vocab#segment","value":["L\\u0001' || c_mktsegment || '"]}]') AS hash FROM customer""")
def content_hashes(spark, d):
    r = records.project(_customers(spark, d), [V + "segment"])
    return r.select("id", records.content_hash(F.col("props")).alias("hash"))


@query("joined_sample", "SELECT CAST(least(50, count(*)) AS BIGINT) AS n, CAST(least(50, count(*)) AS BIGINT) AS real FROM nation JOIN customer ON c_nationkey = n_nationkey")
def joined_sample(spark, d):
    """A sample of joined parameters: 50 different rows that all occur in the join."""
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    s = workload.sample_joined([a, b], 50)
    real = s.join(a.join(b, "k"), ["k", "n_name", "c_custkey"], "left_semi")
    return s.agg(F.count(F.lit(1)).alias("n")).crossJoin(real.agg(F.count(F.lit(1)).alias("real")))
