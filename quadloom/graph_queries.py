"""Graph queries, written as query text, over quads of the star-schema tables."""

from __future__ import annotations

from .plans.compiler import Dataset
from .reference_queries import query
from .star import NS, decode, form, quads


def _run(tables: str, text: str, unique: bool = True, **kinds: str):
    def run(spark, d):
        return decode(Dataset(quads(spark, d, *tables.split()), unique=unique).query(text, NS), **kinds)

    return run


def graph_query(name: str, tables: str, text: str, sql: str, unique: bool = True, **kinds: str) -> None:
    query(name, sql)(_run(tables, text, unique, **kinds))


graph_query("bgp_scan", "nation", "SELECT ?n ?name { ?n a v:Nation ; v:name ?name }", "SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS name FROM nation", n="key")
graph_query(
    "bgp_join", "customer nation region", "SELECT ?c ?region { ?c v:inNation ?n . ?n v:inRegion ?r . ?r v:name ?region }",
    "SELECT c_custkey AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", c="key",
)
graph_query(
    "region_counts", "nation region", "SELECT ?name (COUNT(?n) AS ?c) { ?n v:inRegion ?r . ?r v:name ?name } GROUP BY ?name",
    "SELECT r_name AS name, CAST(count(*) AS BIGINT) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1", c="bigint",
)
graph_query(
    "cross_product", "region", "SELECT ?a ?b { ?x v:name ?a . ?y v:name ?b }", "SELECT x.r_name AS a, y.r_name AS b FROM region x CROSS JOIN region y",
)
graph_query(
    "optional", "customer orders", "SELECT ?c ?o { ?c v:segment ?s OPTIONAL { ?o v:by ?c ; v:total ?t FILTER(?t > 300000) } }",
    "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000", c="key", o="key",
)
graph_query(
    "union_bag", "customer supplier", "SELECT ?n { { ?x a v:Customer ; v:inNation ?n } UNION { ?x a v:Supplier ; v:inNation ?n } }",
    "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier", n="key",
)
graph_query(
    "minus", "customer orders", "SELECT ?c { ?c v:segment ?s MINUS { ?o v:by ?c ; v:total ?t FILTER(?t > 400000) } }",
    "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", c="key",
)
graph_query(
    "minus_disjoint", "region nation", "SELECT ?r { ?r a v:Region MINUS { ?n a v:Nation } }", "SELECT CAST(r_regionkey AS BIGINT) AS r FROM region", r="key",
)
graph_query(
    "filter", "orders", "SELECT ?o ?t { ?o v:total ?t FILTER(?t > 200000 && ?t < 250000) }",
    "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice > 200000 AND o_totalprice < 250000", o="key", t="double",
)
graph_query(
    "exists", "orders lineitem", "SELECT ?o { ?o v:total ?t FILTER EXISTS { ?l v:of ?o ; v:quantity ?q FILTER(?q > 45) } }",
    "SELECT o_orderkey AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)", o="key",
)
graph_query(
    "not_exists", "orders lineitem", "SELECT ?o { ?o v:total ?t FILTER NOT EXISTS { ?l v:of ?o ; v:quantity ?q FILTER(?q > 45) } }",
    "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)", o="key",
)
graph_query(
    "exists_or", "customer orders", "SELECT ?c { ?c v:balance ?b FILTER(?b > 9000 || EXISTS { ?o v:by ?c ; v:total ?t FILTER(?t > 400000) }) }",
    "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", c="key",
)
graph_query(
    "exists_outer_filter", "customer orders", "SELECT ?c { ?c v:balance ?b FILTER EXISTS { ?o v:by ?c ; v:total ?t FILTER(?t > ?b * 40) } }",
    "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)", c="key",
)
graph_query(
    "bind", "part", "SELECT ?p ?half { ?p v:size ?s BIND(?s * 2 + 1 AS ?half) }", "SELECT p_partkey AS p, CAST(p_size * 2 + 1 AS BIGINT) AS half FROM part", p="key", half="bigint",
)
graph_query(
    "values_undef", "nation", "SELECT ?n ?name ?x { ?n v:name ?name VALUES (?name ?x) { ('NATION_1' 1) (UNDEF 2) } }",
    "SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS name, CAST(x AS BIGINT) AS x FROM nation JOIN (VALUES ('NATION_1', 1), (NULL, 2)) t(k, x) ON k IS NULL OR k = n_name", n="key", x="bigint",
)
graph_query("distinct", "customer", "SELECT DISTINCT ?s { ?c v:segment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer")
graph_query(
    "group_having", "orders", "SELECT ?c (COUNT(*) AS ?n) (MAX(?t) AS ?most) { ?o v:by ?c ; v:total ?t } GROUP BY ?c HAVING(COUNT(*) > 12)",
    "SELECT o_custkey AS c, CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1 HAVING count(*) > 12", c="key", n="bigint", most="double",
)
graph_query(
    "topk", "orders", "SELECT ?o ?t { ?o v:total ?t } ORDER BY DESC(?t) ?o LIMIT 20",
    "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, 'U' || o_orderkey LIMIT 20", o="key", t="double",
)
graph_query(
    "offset_limit", "part", "SELECT ?p ?n { ?p v:name ?n } ORDER BY ?n ?p LIMIT 15 OFFSET 30",
    "SELECT p_partkey AS p, p_name AS n FROM part ORDER BY p_name, CAST(p_partkey AS VARCHAR) LIMIT 15 OFFSET 30", p="key",
)
graph_query(
    "subquery", "orders", "SELECT ?c ?o { { SELECT ?c (MAX(?t) AS ?m) { ?x v:by ?c ; v:total ?t } GROUP BY ?c } ?o v:by ?c ; v:total ?m }",
    "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN (SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders GROUP BY 1) ON k = o_custkey AND m = o_totalprice", c="key", o="key",
)
graph_query(
    "graph_filter", "orders", "SELECT ?o { GRAPH <http://example.org/status/F> { ?o v:priority ?p } }", "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'", o="key",
)
graph_query(
    "graph_variable", "orders", "SELECT ?g (COUNT(?o) AS ?n) { GRAPH ?g { ?o v:by ?c } } GROUP BY ?g",
    "SELECT 'http://example.org/status/' || o_orderstatus AS g, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1", n="bigint",
)
graph_query(
    "from_graph", "orders", "SELECT ?o FROM <http://example.org/status/O> FROM <http://example.org/status/P> { ?o v:by ?c }", "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus IN ('O', 'P')", o="key",
)
graph_query(
    "path_seq", "lineitem orders customer", "SELECT ?l ?n { ?l v:of/v:by/v:inNation ?n }",
    "SELECT 'http://example.org/line/' || l_orderkey || '-' || l_linenumber AS l, CAST(c_nationkey AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", n="key",
)
# lines repeat their keys: path_seq has a solution for each row, path_seq_set for each triple of the set
graph_query(
    "path_seq_set", "lineitem orders customer", "SELECT ?l ?n { ?l v:of/v:by/v:inNation ?n }",
    "SELECT DISTINCT 'http://example.org/line/' || l_orderkey || '-' || l_linenumber AS l, CAST(c_nationkey AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    unique=False, n="key",
)
graph_query(
    "path_alt", "part", "SELECT ?p ?x { ?p v:brand|v:kind ?x }", "SELECT p_partkey AS p, p_brand AS x FROM part UNION ALL SELECT p_partkey, p_type FROM part", p="key",
)
graph_query(
    "path_inverse", "orders", "SELECT ?c ?o { ?c ^v:by ?o }", "SELECT o_custkey AS c, o_orderkey AS o FROM orders", c="key", o="key",
)
graph_query(
    "path_opt", "nation region", "SELECT ?x { <http://example.org/nation/3> v:inRegion? ?x }",
    "SELECT 'http://example.org/region/' || n_regionkey AS x FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://example.org/nation/3'",
)
graph_query(
    "path_neg", "nation", "SELECT ?n ?x { ?n !(rdf:type|v:inRegion) ?x }", "SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS x FROM nation", n="key",
)
graph_query(
    "construct", "nation region", "CONSTRUCT { ?r v:has ?n } WHERE { ?n v:inRegion ?r }",
    "SELECT 'http://example.org/region/' || n_regionkey AS s, 'http://example.org/vocab#has' AS p, 'http://example.org/nation/' || n_nationkey AS o FROM nation",
)
graph_query(
    "describe", "nation region", "DESCRIBE <http://example.org/region/1>",
    """SELECT 'http://example.org/region/1' AS s, 'http://example.org/vocab#name' AS p, r_name AS o FROM region WHERE r_regionkey = 1
    UNION ALL SELECT 'http://example.org/region/1', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/vocab#Region'
    UNION ALL SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/vocab#inRegion', 'http://example.org/region/1' FROM nation WHERE n_regionkey = 1""",
)
graph_query(
    "agg_all", "orders customer",
    """SELECT ?s (COUNT(?o) AS ?n) (COUNT(DISTINCT ?c) AS ?customers) (MIN(?t) AS ?low) (MAX(?t) AS ?high) (ROUND(AVG(?t)) AS ?mean) (ROUND(SUM(?t)) AS ?sum)
    { ?o v:by ?c ; v:total ?t . ?c v:segment ?s } GROUP BY ?s""",
    """SELECT c_mktsegment AS s, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high,
    floor(avg(o_totalprice) + 0.5) AS mean, floor(sum(o_totalprice) + 0.5) AS sum FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
    n="bigint", customers="bigint", low="double", high="double", mean="double", sum="double",
)
graph_query(
    "group_concat", "nation", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=', ') AS ?names) { ?x v:inRegion ?r ; v:name ?n } GROUP BY ?r",
    "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1", r="key",
)
graph_query(
    "str_fns", "part",
    """SELECT ?p ?up ?low ?len ?sub ?before ?after ?enc ?cat { ?p v:kind ?k ; v:brand ?b BIND(UCASE(?k) AS ?up) BIND(LCASE(?k) AS ?low) BIND(STRLEN(?k) AS ?len)
    BIND(SUBSTR(?k, 2, 3) AS ?sub) BIND(STRBEFORE(?k, ' ') AS ?before) BIND(STRAFTER(?k, ' ') AS ?after) BIND(ENCODE_FOR_URI(?k) AS ?enc) BIND(CONCAT(?b, '/', ?k) AS ?cat) }""",
    """SELECT p_partkey AS p, upper(p_type) AS up, lower(p_type) AS low, length(p_type) AS len, substr(p_type, 2, 3) AS sub,
    CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, 1, strpos(p_type, ' ') - 1) ELSE '' END AS before, CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, strpos(p_type, ' ') + 1) ELSE '' END AS after,
    replace(replace(p_type, '#', '%23'), ' ', '%20') AS enc, p_brand || '/' || p_type AS cat FROM part""",
    p="key", len="bigint",
)
graph_query(
    "num_fns", "customer", "SELECT ?c ?a ?up ?down ?near { ?c v:balance ?b BIND(ABS(?b) AS ?a) BIND(CEIL(?b) AS ?up) BIND(FLOOR(?b) AS ?down) BIND(ROUND(?b) AS ?near) }",
    "SELECT c_custkey AS c, abs(c_acctbal) AS a, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, floor(c_acctbal + 0.5) AS near FROM customer",
    c="key", a="double", up="double", down="double", near="double",
)
graph_query(
    "date_fns", "orders", "SELECT ?o ?y ?m ?d ?h { ?o v:date ?x BIND(YEAR(?x) AS ?y) BIND(MONTH(?x) AS ?m) BIND(DAY(?x) AS ?d) BIND(HOURS(?x) AS ?h) }",
    "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h FROM orders",
    o="key", y="bigint", m="bigint", d="bigint", h="bigint",
)
graph_query(
    "hash_fns", "nation", "SELECT ?n ?m ?s { ?n v:name ?x BIND(MD5(?x) AS ?m) BIND(SHA256(?x) AS ?s) }",
    "SELECT CAST(n_nationkey AS BIGINT) AS n, md5(n_name) AS m, sha256(n_name) AS s FROM nation", n="key",
)
graph_query(
    "regex", "part", "SELECT ?p ?r { ?p v:kind ?k FILTER REGEX(?k, '^[a-m].*[a-r]$', 'i') BIND(REPLACE(?k, '[aeiou]', '_') AS ?r) }",
    "SELECT p_partkey AS p, regexp_replace(p_type, '[aeiou]', '_', 'g') AS r FROM part WHERE regexp_matches(p_type, '^[a-m].*[a-r]$', 'i')", p="key",
)
graph_query(
    "conditional", "orders", "SELECT ?o ?k { ?o v:total ?t ; v:priority ?p BIND(IF(?t > 200000, 'large', COALESCE(?missing, ?p)) AS ?k) }",
    "SELECT o_orderkey AS o, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE o_orderpriority END AS k FROM orders", o="key",
)
graph_query(
    "in_list", "orders", "SELECT ?o { ?o v:status ?s ; v:priority ?p FILTER(?s IN ('F', 'P') && ?p NOT IN ('1-URGENT')) }",
    "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')", o="key",
)
graph_query(
    "term_tests", "nation", "SELECT ?n ?p ?kind { ?n ?p ?x FILTER(isIRI(?n)) BIND(IF(isLiteral(?x), STR(DATATYPE(?x)), 'node') AS ?kind) }",
    """SELECT CAST(n_nationkey AS BIGINT) AS n, p, kind FROM nation CROSS JOIN (VALUES ('http://example.org/vocab#name', 'http://www.w3.org/2001/XMLSchema#string'),
    ('http://example.org/vocab#inRegion', 'node'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'node')) t(p, kind)""", n="key",
)


graph_query(
    "report_optional", "customer orders nation", """SELECT ?n (COUNT(DISTINCT ?c) AS ?customers) (COUNT(?o) AS ?large) { ?c a v:Customer ; v:inNation ?n OPTIONAL { ?o v:by ?c ; v:total ?t FILTER(?t > 350000) } }
    GROUP BY ?n ORDER BY DESC(?large) ?n LIMIT 10""",
    """SELECT * FROM (SELECT CAST(c_nationkey AS BIGINT) AS n, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS large FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000
    GROUP BY 1) ORDER BY large DESC, CAST(n AS VARCHAR) LIMIT 10""", n="key", customers="bigint", large="bigint",
)
graph_query(
    "parameter_query", "customer orders", """SELECT ?c ?first ?year { { SELECT ?c (MIN(?d) AS ?first) (SAMPLE(?s) AS ?seg) { ?o v:by ?c ; v:date ?d . ?c v:segment ?s } GROUP BY ?c }
    FILTER EXISTS { ?x v:by ?c ; v:status 'F' } BIND(YEAR(?first) AS ?year) FILTER(?seg = 'BUILDING') }""",
    """SELECT o_custkey AS c, min(o_orderdate) AS first, CAST(year(min(o_orderdate)) AS BIGINT) AS year FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'
    AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""", c="key", first="timestamp_ntz", year="bigint",
)
graph_query(
    "concat_under_optional", "customer orders nation", """SELECT ?n ?list { ?n a v:Nation OPTIONAL { SELECT ?n (GROUP_CONCAT(DISTINCT ?s; SEPARATOR='|') AS ?list) { ?c v:inNation ?n ; v:segment ?s ; v:balance ?b FILTER(?b < -900) } GROUP BY ?n }
    FILTER NOT EXISTS { ?k v:inNation ?n ; v:balance ?x FILTER(?x > 9990) } }""",
    """SELECT CAST(n_nationkey AS BIGINT) AS n, list FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS list FROM customer WHERE c_acctbal < -900 GROUP BY 1) ON c_nationkey = n_nationkey
    WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990)""", n="key",
)


# solutions modifiers and datasets
graph_query(
    "distinct_topk", "orders", "SELECT DISTINCT ?c { ?o v:by ?c } ORDER BY DESC(?c) LIMIT 25 OFFSET 5",
    "SELECT c FROM (SELECT DISTINCT o_custkey AS c FROM orders) ORDER BY 'U' || c DESC LIMIT 25 OFFSET 5", c="key",
)
graph_query(
    "distinct_by_hidden_key", "orders", "SELECT DISTINCT ?c { ?o v:by ?c ; v:total ?t } ORDER BY DESC(?t) ?c LIMIT 25",
    "SELECT o_custkey AS c FROM orders GROUP BY 1 ORDER BY max(o_totalprice) DESC, 'U' || o_custkey LIMIT 25", c="key",
)
graph_query(
    "from_named", "orders", """SELECT ?o ?g FROM <http://example.org/status/O> FROM NAMED <http://example.org/status/F> { { ?o v:by ?c } UNION { GRAPH ?g { ?o v:by ?c } } }""",
    "SELECT o_orderkey AS o, CASE WHEN o_orderstatus = 'F' THEN 'http://example.org/status/F' END AS g FROM orders WHERE o_orderstatus IN ('O', 'F')", o="key",
)
graph_query(
    "from_hides_named", "orders", "SELECT ?o ?g FROM <http://example.org/status/O> { ?o v:by ?c OPTIONAL { GRAPH ?g { ?o v:by ?c } } }",
    "SELECT o_orderkey AS o, CAST(NULL AS VARCHAR) AS g FROM orders WHERE o_orderstatus = 'O'", o="key",
)
graph_query(
    "named_hides_default", "orders", "SELECT ?o FROM NAMED <http://example.org/status/F> { { ?o v:by ?c } UNION { GRAPH ?g { ?o v:priority ?p } } }",
    "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'", o="key",
)
# loose variables
graph_query(
    "optional_chain", "nation region", """SELECT ?n ?r ?name { ?n a v:Nation OPTIONAL { ?n v:inRegion ?r . ?r v:name ?x FILTER(?x < 'B') } OPTIONAL { ?r a v:Region ; v:name ?name } }""",
    """SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(b.r_regionkey AS BIGINT) AS r, b.r_name AS name FROM nation LEFT JOIN region a ON n_regionkey = a.r_regionkey AND a.r_name < 'B'
    LEFT JOIN region b ON a.r_regionkey IS NULL OR a.r_regionkey = b.r_regionkey""", n="key", r="key",
)
graph_query(
    "optional_minus", "nation region", """SELECT ?n { ?n a v:Nation OPTIONAL { ?n v:inRegion ?r . ?r v:name ?x FILTER(?x < 'B') } MINUS { ?r v:name 'ASIA' } MINUS { ?r v:name 'AFRICA' } }""",
    "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('AFRICA', 'ASIA')", n="key",
)
graph_query(
    "optional_exists", "customer orders", """SELECT ?c ?o { ?c v:balance ?b OPTIONAL { ?o v:by ?c ; v:total ?t FILTER(?t > 450000) } FILTER EXISTS { ?o v:status 'F' } }""",
    """SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000
    WHERE o_orderkey IS NULL AND (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 0 OR o_orderstatus = 'F'""", c="key", o="key",
)
graph_query(
    "exists_nested_outer", "customer orders", """SELECT ?c { ?c v:balance ?b FILTER EXISTS { { ?o v:by ?c ; v:total ?t FILTER(?t > ?b * 60) } UNION { ?o v:by ?c ; v:priority '1-URGENT' ; v:total ?t FILTER(?t < ?b) } } }""",
    """SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_totalprice > c_acctbal * 60 OR o_orderpriority = '1-URGENT' AND o_totalprice < c_acctbal))""", c="key",
)
# typed numbers, dates as written, language tags
graph_query(
    "exact_integers", "part", """SELECT ?p ?big ?product ?same ?kind { ?p v:size ?s BIND(?s + 9007199254740992 AS ?big) BIND(?s * 300000000000000001 AS ?product)
    BIND((?s + 9007199254740992) = 9007199254740993 AS ?same) BIND(STR(DATATYPE(?big)) AS ?kind) }""",
    """SELECT p_partkey AS p, p_size + 9007199254740992 AS big, CAST(CAST(p_size AS HUGEINT) * 300000000000000001 AS VARCHAR) AS product, CASE WHEN p_size = 1 THEN 'true' ELSE 'false' END AS same,
    'http://www.w3.org/2001/XMLSchema#integer' AS kind FROM part""", p="key", big="bigint",
)
graph_query(
    "exact_decimals", "part", """SELECT ?p ?tenth ?quarter ?kind ?mixed { ?p v:size ?s BIND(STR(?s * 0.1 + 0.2) AS ?tenth) BIND(STR(?s / 4) AS ?quarter) BIND(STR(DATATYPE(?s / 4)) AS ?kind)
    BIND(STR(DATATYPE(?s * 1.5e0)) AS ?mixed) }""",
    """SELECT p_partkey AS p, regexp_replace(printf('%.1f', (p_size + 2) / 10.0), '[.]0$', '') AS tenth,
    regexp_replace(printf('%.2f', p_size / 4.0), '[.]?0+$', '') AS quarter, 'http://www.w3.org/2001/XMLSchema#decimal' AS kind, 'http://www.w3.org/2001/XMLSchema#double' AS mixed FROM part""", p="key",
)
graph_query(
    "exact_aggregates", "part", """SELECT ?b ?sum ?kind ?mean { { SELECT ?b (SUM(?s + 9007199254740992) AS ?sum) (AVG(?s) AS ?a) { ?p v:brand ?b ; v:size ?s } GROUP BY ?b } BIND(STR(DATATYPE(?a)) AS ?kind) BIND(xsd:double(?a) AS ?mean) }""",
    """SELECT p_brand AS b, CAST(sum(CAST(p_size AS HUGEINT) + 9007199254740992) AS BIGINT) AS sum, 'http://www.w3.org/2001/XMLSchema#decimal' AS kind, avg(p_size) AS mean FROM part GROUP BY 1""",
    sum="bigint", mean="double",
)
graph_query(
    "dates_as_written", "orders", """SELECT ?o ?y ?d ?h ?s ?z { ?o v:date ?t BIND(STRDT(CONCAT(SUBSTR(STR(?t), 1, 10), 'T00:30:15.25+02:00'), xsd:dateTime) AS ?x)
    BIND(YEAR(?x) AS ?y) BIND(DAY(?x) AS ?d) BIND(HOURS(?x) AS ?h) BIND(STR(SECONDS(?x)) AS ?s) BIND(TZ(?x) AS ?z) }""",
    "SELECT o_orderkey AS o, year(o_orderdate) AS y, day(o_orderdate) AS d, CAST(0 AS BIGINT) AS h, '15.25' AS s, '+02:00' AS z FROM orders", o="key", y="bigint", d="bigint", h="bigint",
)
graph_query(
    "language_tags", "nation", """SELECT ?n ?up ?tag ?part ?rest ?both { ?n v:name ?name BIND(STRLANG(?name, 'en') AS ?x) BIND(UCASE(?x) AS ?u) BIND(STR(?u) AS ?up) BIND(CONCAT(LANG(?u), LANG(SUBSTR(?x, 2)), LANG(STRAFTER(?x, '_')), LANG(STRAFTER(?x, '#'))) AS ?tag)
    BIND(STR(SUBSTR(?x, 0, 3)) AS ?part) BIND(LANG(REPLACE(?x, 'N', 'M')) AS ?rest) BIND(LANG(CONCAT(?x, ?u)) AS ?both) }""",
    "SELECT CAST(n_nationkey AS BIGINT) AS n, upper(n_name) AS up, CASE WHEN strpos(n_name, '_') > 0 THEN 'enenen' ELSE 'enen' END AS tag, substr(n_name, 1, 2) AS part, 'en' AS rest, 'en' AS both FROM nation", n="key",
)
graph_query(
    "regex_plain", "part", "SELECT ?p { ?p v:brand ?b FILTER REGEX(?b, 'D#1', 'qi') FILTER(!REGEX(?b, '.#', 'q')) }", "SELECT p_partkey AS p FROM part WHERE lower(p_brand) LIKE '%d#1%'", p="key",
)


@query("sparql_arguments", "SELECT o_orderkey AS o FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def sparql_arguments(spark, d):
    from .functions import terms as T

    text, given = "SELECT ?o { ?o v:by $$ ; v:total ?t FILTER(?t > $$) }", [T.uri_code(NS["d"] + "customer/7"), T.literal_code("1000", T.XSD + "integer")]
    return decode(Dataset(quads(spark, d, "orders"), unique=True).query(text, NS, arguments=given), o="key")


@query("ask", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS ask")
def ask(spark, d):
    return Dataset(quads(spark, d, "orders"), unique=True).query("ASK { ?o v:total ?t FILTER(?t > 100000) }", NS)


_ACTOR = "http://ns.veldmark.example/happenings/hasActor"
#: The links of who takes part in what, cycles included, as the statements have them.
_LINKS = f"""WITH RECURSIVE e AS (SELECT DISTINCT subject AS a, object AS b FROM statements WHERE predicate = '{_ACTOR}' AND object_kind = 'uri' AND NOT starts_with(subject, '_:') AND object IS NOT NULL),
    c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)"""


def _over_statements(text: str, bindings=dict, **kinds: str):
    def run(spark, d):
        from .runtime import table
        from .sources.tables import statement_quads

        return decode(Dataset(statement_quads(table(spark, d, "statements").where("subject is not null and predicate is not null and object is not null"))).query(text, NS, bindings()), **kinds)

    return run


query("path_plus", _LINKS + " SELECT a, b FROM c")(_over_statements(f"SELECT ?a ?b {{ ?a <{_ACTOR}>+ ?b FILTER(isIRI(?a)) }}"))
query("path_star", _LINKS + " SELECT a, b FROM (SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e)")(
    _over_statements(f"SELECT ?a ?b {{ ?a <{_ACTOR}>* ?b FILTER EXISTS {{ {{ ?a <{_ACTOR}> ?x }} UNION {{ ?y <{_ACTOR}> ?a }} }} FILTER(isIRI(?a)) }}")
)
query("path_plus_from", _LINKS + " SELECT b FROM c WHERE a = (SELECT min(a) FROM e)")(
    lambda spark, d: _over_statements(f"SELECT ?b {{ ?a <{_ACTOR}>+ ?b }}", lambda: {"a": _first_actor(spark, d)})(spark, d)
)


def _first_actor(spark, d) -> str:
    from .runtime import table

    links = table(spark, d, "statements").where(f"predicate = '{_ACTOR}' and object_kind = 'uri' and object is not null and not startswith(subject, '_:')")
    return "U" + (links.agg({"subject": "min"}).first()[0] or "http://example.org/none")


def next_users(events):
    """(a, b): distinct pairs of users of whom b has the event next after one of a, by ts and event_id, over all events.

    Events are cut into ranges; the last event of each meets the first of the range after it, so no task has them all.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .runtime import materialize

    e = events.where("user_id is not null and event_id is not null").select("ts", "event_id", "user_id")
    e = materialize(e.repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()), "ranges")
    order = F.struct("ts", "event_id")
    firsts = e.groupBy("part").agg(F.min_by("user_id", order).alias("first"))  # a row for each range
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    w = Window.partitionBy("part").orderBy("ts", "event_id")
    paired = e.withColumn("b", F.lead("user_id").over(w)).join(F.broadcast(after), "part")
    return paired.select(F.col("user_id").alias("a"), F.coalesce("b", "after").alias("b")).where("b is not null").distinct()


def _user_quads(spark, d):
    from pyspark.sql import functions as F

    from .functions import terms as T
    from .runtime import table

    iri = lambda c: F.concat(F.lit("Uhttp://example.org/user/"), F.col(c).cast("string"))
    return next_users(table(spark, d, "events")).select(iri("a").alias("s"), F.lit(T.uri_code(NS["v"] + "next")).alias("p"), iri("b").alias("o"), F.lit(None).cast("string").alias("g"))


_CLOSURE_USERS = """WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT user_id AS a, lead(user_id) OVER (ORDER BY ts NULLS FIRST, event_id) AS b FROM events
    WHERE user_id IS NOT NULL AND event_id IS NOT NULL) WHERE b IS NOT NULL), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)"""


@query("path_plus_users", _CLOSURE_USERS + " SELECT a, b FROM c")
def path_plus_users(spark, d):
    return Dataset(_user_quads(spark, d), unique=True).query("SELECT ?a ?b { ?a v:next+ ?b }", NS, forms={"a": form("key"), "b": form("key")})


@query("path_star_users", _CLOSURE_USERS + " SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e")
def path_star_users(spark, d):
    return Dataset(_user_quads(spark, d), unique=True).query("SELECT ?a ?b { ?a v:next* ?b }", NS, forms={"a": form("key"), "b": form("key")})


@query("path_plus_from_users", _CLOSURE_USERS + " SELECT b FROM c WHERE a = 1")
def path_plus_from_users(spark, d):
    return decode(Dataset(_user_quads(spark, d), unique=True).query("SELECT ?b { <http://example.org/user/1> v:next+ ?b }", NS), b="key")


@query("statement_types", """WITH t AS (SELECT DISTINCT object AS type, subject FROM statements WHERE predicate = 'http://ns.veldmark.example/triples#type' AND object_kind = 'uri' AND subject IS NOT NULL)
    SELECT type, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1""")  # fmt: skip
def statement_types(spark, d):
    """How many subjects each type has, over the statements as they are stored."""
    from pyspark.sql import functions as F

    from .runtime import table
    from .sources.tables import statement_quads

    q = statement_quads(table(spark, d, "statements"))
    out = Dataset(q).query("SELECT ?type (COUNT(?s) AS ?n) { ?s <http://ns.veldmark.example/triples#type> ?type FILTER(isIRI(?type)) } GROUP BY ?type", NS)
    return decode(out, n="bigint").where(F.col("type").isNotNull())
