"""Queries p1 to p4 over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.uris import namespace_map
from .operators.balanced import key_results
from .operators.orphans import orphan_counts, orphans
from .operators.shred import VALUE_MEMBERS, adjacency, member_table, nested_records, property_table, record_links, record_paths, record_table
from .operators.wide import filled_cells, stitch
from .runtime import table


def _names(spark: SparkSession, d: str) -> dict[str, str]:
    return namespace_map(table(spark, d, "prefixes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wide, columns = stitch(table(spark, d, "record_properties"), table(spark, d, "attribute_catalog"), _names(spark, d))
    return filled_cells(wide, columns)


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    wide, _ = stitch(table(spark, d, "record_properties"), table(spark, d, "attribute_catalog"), _names(spark, d))
    stamps = [c for c, t in wide.dtypes if t == "timestamp"]
    return wide.drop("ordinal").withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans(table(spark, d, "statements"), table(spark, d, "plainidentifiers"), table(spark, d, "shared_terms"), _names(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("statement_id", "ref_field", "orphan_kind")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_records(table(spark, d, "raw_records"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """Records by path; ``record_table`` also has their nodes."""
    records = record_table(adjacency(table(spark, d, "raw_records")))
    return records.select("record_no", "node_path", "parent_path", "parent_property", "parent_value", "id")


def p3_properties(spark: SparkSession, d: str) -> DataFrame:
    """Property values, with the path of their record in place of its node."""
    nodes = adjacency(table(spark, d, "raw_records"))
    rows = property_table(nodes, record_paths(record_links(nodes)))
    child = F.concat_ws("/", F.nullif("record_path", F.lit("")), F.concat_ws(".", "property", "value"))
    return rows.select(
        "record_no", "record_path", "property", "value", "property_uri", "kind", "scalar", F.when(F.col("child_record").isNotNull(), child).alias("child_path"),
        *(f"value_{m}" for m in VALUE_MEMBERS),
    )


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return member_table(adjacency(table(spark, d, "raw_records")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return key_results(table(spark, d, "statements"), _names(spark, d), share=0.02, subjects=False).select("key_field", "key_value")


def p4_results(spark: SparkSession, d: str) -> DataFrame:
    return key_results(table(spark, d, "statements"), _names(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_wide, p2_found, p2_report, p3_found, p3_records, p3_properties, p3_members, p4_found, p4_results)
}


def _norm(table_name: str, columns: dict[str, str], keep: str) -> str:
    """SQL of a subquery with the named columns normalised: prefix join, decoding, lower-case scheme and host."""
    strip = lambda c: f"regexp_replace(regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '^<(.*)>$', '\\1', 's'), '^\\s+|\\s+$', '', 'g')"
    parts, joins = [], []
    for i, (out, source) in enumerate(columns.items()):
        bare = strip(source)
        joins.append(f"left join prefixes x{i} on x{i}.prefix = regexp_extract({bare}, '^([^:/?#\\s]*):', 1)")
        full = f"url_decode(coalesce(x{i}.namespace_uri || substr({bare}, strpos({bare}, ':') + 1), {bare}))"
        low = f"lower(regexp_extract({full}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'))"
        parts.append(f"nullif(case when {low} <> '' then {low} || substr({full}, length({low}) + 1) else {full} end, '') as {out}")
    return f"(select {keep}, {', '.join(parts)} from {table_name} b {' '.join(joins)})"


_CELLS = (
    "props as (select n.record_id, c.attribute, c.target_type, b_at as seen_at, nullif(regexp_replace(case when regexp_matches(t, '^\".*\"(@[A-Za-z0-9-]+|\\^\\^\\S+)?$', 's') "
    "then regexp_extract(t, '^\"(.*)\"(@[A-Za-z0-9-]+|\\^\\^\\S+)?$', 1, 's') else t end, '^\\s+|\\s+$', '', 'g'), '') as v from "
    "(select *, regexp_replace(raw_value, '^\\s+|\\s+$', '', 'g') as t from "
    + _norm("record_properties", {"record_id": "b.record_id", "uri": "b.propertyuri"}, "b.propertyvalue as raw_value, b.recorded_at as b_at")
    + ") n join attribute_catalog c on c.property_uri = n.uri where n.record_id is not null), "
    "cells as (select *, case target_type when 'string' then v is not null when 'bigint' then regexp_matches(v, '^[+-]?[0-9]+$') and try_cast(v as bigint) is not null "
    "when 'int' then regexp_matches(v, '^[+-]?[0-9]+$') and try_cast(v as int) is not null when 'double' then regexp_matches(v, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
    "when 'boolean' then lower(v) in ('true', 'false', '1', '0') "
    "when 'timestamp' then regexp_matches(v, '^[0-9]{13}$') or (regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$') "
    "and try_cast(v as timestamptz) is not null) end as ok from props)"
)

_REFS = (
    "refs as (select distinct statement_id, ref_field, key, asserted_at from (select statement_id, 'subject' as ref_field, s as key, asserted_at from st "
    "union all select statement_id, 'object', o, asserted_at from st where object_kind = 'uri') where key is not null and statement_id is not null)"
)
_ORPHANS = (
    "with st as (select *, u as o from " + _norm("statements", {"s": "b.subject", "u": "b.object"}, "b.*") + "), "
    + _REFS
    + ", reg as (select * from " + _norm("plainidentifiers", {"key": "b.identifier"}, "b.registered_at, b.deleted_at, b.rec_type") + " where registered_at is not null and key is not null), "
    "shared as (select distinct key from " + _norm("shared_terms", {"key": "b.identifier"}, "b.label") + "), "
    "firsts as (select key, min(registered_at) as first, min(rec_type) as rec_type from reg group by 1), "
    "live as (select distinct r.statement_id, r.ref_field, r.asserted_at from refs r join reg on reg.key = r.key where reg.registered_at <= r.asserted_at and (reg.deleted_at is null or reg.deleted_at > r.asserted_at)), "
    "found as (select statement_id, ref_field, arg_min(key, asserted_at) as key, min(asserted_at) as first_seen, "
    "arg_min(case when f.first is null then 'missing' when r.asserted_at < f.first then 'later' else 'deleted' end, r.asserted_at) as orphan_kind, arg_min(f.rec_type, r.asserted_at) as rec_type "
    "from refs r left join firsts f using (key) anti join live l using (statement_id, ref_field, asserted_at) where r.key not in (select key from shared) and (f.first is null or r.asserted_at is not null) group by 1, 2) "
)
#: Start of SQL over ``st``, each statement once by its first delivery.
STATEMENTS_ONCE = (
    "with st as (select statement_id, s, p, case when object_kind = 'uri' then u else object end as o, asserted_at from "
    + _norm("statements", {"s": "b.subject", "p": "b.predicate", "u": "b.object"}, "b.statement_id, b.object_kind, b.object, b.asserted_at, b.loaded_at")
    + " qualify row_number() over (partition by statement_id order by loaded_at nulls first) = 1) "
)
_FOUND4 = (
    " from (select 'predicate' as key_field, p as key_value, s, asserted_at from st union all select 'object', o, s, asserted_at from st) where key_value is not null group by 1, 2"
)

#: The attributes of the catalog and the SQL that reads a value as each one's type.
_STAMP = "case when regexp_matches(v, '^[0-9]{13}$') then make_timestamp(cast(v as bigint) * 1000) else cast(cast(v as timestamptz) as timestamp) end"
_ATTRIBUTES = {
    "title": "v", "description": "v", "rights": "v", "section": "v", "language_code": "v", "issued": _STAMP, "modified": _STAMP,
    "file_size": "cast(v as bigint)", "char_count": "cast(v as bigint)", "page_count": "cast(v as int)", "layer_count": "cast(v as int)",
    "confidence": "cast(v as double)", "relevance": "cast(v as double)", "is_public": "lower(v) in ('true', '1')", "is_crystallized": "lower(v) in ('true', '1')",
}
_WIDE = (
    f"with {_CELLS}, picked as (select record_id, attribute, v from cells where ok qualify row_number() over (partition by record_id, attribute order by seen_at desc nulls last, v desc) = 1), "
    "ids as (select distinct record_id from " + _norm("record_properties", {"record_id": "b.record_id"}, "b.property_id") + " where record_id is not null) "
    "select record_id, " + ", ".join(f"(select {sql} from picked p where p.record_id = ids.record_id and p.attribute = '{a}') as {a}" for a, sql in _ATTRIBUTES.items()) + " from ids"
)

_PROPERTIES = "case when json_type(rec -> 'properties') = 'ARRAY' then cast(rec -> 'properties' as json[]) else [rec -> 'properties'] end"
_VALUES = """
    select record_no, node_path, p, v, val, case when json_type(val) = 'VARCHAR' and starts_with(ltrim(val ->> '$'), '{') and json_valid(val ->> '$')
    and json_exists(val ->> '$', '$.properties') then cast(val ->> '$' as json) else val end as child from (
    select record_no, node_path, p, unnest(vals) as val, generate_subscripts(vals, 1) as v from (
    select record_no, node_path, p, case when json_type(one) = 'ARRAY' then cast(one as json[]) else [one] end as vals from (
    select record_no, node_path, p, coalesce(prop -> 'propertyValue', prop -> 'property_value') as one from (
    select record_no, node_path, unnest(props) as prop, generate_subscripts(props, 1) as p from (
    select record_no, node_path, @PROPERTIES as props from r where json_exists(rec, '$.properties')))) where one is not null))
""".replace("@PROPERTIES", _PROPERTIES)
#: SQL over ``r``, all records with their paths, from the readable deliveries loaded last.
_NESTED = """
    with recursive best as (select record_no, arg_max(record_fields, (loaded_at, record_fields)) as f from raw_records
    where record_fields is not null and json_valid(record_fields) and json_type(try_cast(record_fields as json)) = 'OBJECT' group by 1),
    r as (select record_no, '' as node_path, cast(null as varchar) as parent_path, cast(null as int) as p, cast(null as int) as v, cast(f as json) as rec from best
    union all select record_no, case when node_path = '' then '' else node_path || '/' end || (p - 1) || '.' || (v - 1), node_path, cast(p - 1 as int), cast(v - 1 as int), child from (@VALUES)
    where json_type(child) = 'OBJECT' and json_exists(child, '$.properties'))
""".replace("@VALUES", _VALUES)


def _scalar(x: str) -> str:
    """SQL of a scalar JSON value as text."""
    return f"case when json_type({x}) not in ('OBJECT', 'ARRAY', 'NULL') then {x} ->> '$' end"


def _named(x: str, names: tuple[str, ...]) -> str:
    """A scalar, or of an object the first of its members ``names`` that is one."""
    inner = ", ".join(_scalar(f"({x} -> '{n}')") for n in names)
    return f"case when json_type({x}) = 'OBJECT' then coalesce({inner}, null) else {_scalar(x)} end"


_RECORDS = f"select record_no, node_path, parent_path, p as parent_property, v as parent_value, {_named("(rec -> 'id')", ('identifier',))} as id from r"
_MEMBERS = ", ".join(f"{_named(f"(child -> '{m}')", ('identifier', 'id', 'label'))} as value_{m}" for m in VALUE_MEMBERS)
_PROPERTY_ROWS = f"""
    , held as (select record_no, node_path, unnest(props) as prop, generate_subscripts(props, 1) as p from (select record_no, node_path, {_PROPERTIES} as props from r where json_exists(rec, '$.properties'))),
    vals as ({_VALUES})
    select record_no, node_path as record_path, cast(p - 1 as int) as property, cast(v - 1 as int) as value, coalesce(prop ->> 'propertyURI', prop ->> 'property_uri', prop ->> 'propertyUri') as property_uri,
    case json_type(child) when 'OBJECT' then case when json_exists(child, '$.properties') then 'record' else 'object' end when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean'
    when 'NULL' then 'null' else case when child is not null then 'number' when v is not null then 'null' end end as kind, {_scalar("child")} as scalar,
    case when json_type(child) = 'OBJECT' and json_exists(child, '$.properties') then case when node_path = '' then '' else node_path || '/' end || (p - 1) || '.' || (v - 1) end as child_path,
    {_MEMBERS} from held left join vals using (record_no, node_path, p) where json_type(prop) = 'OBJECT'
"""

ORACLES: dict[str, str] = {
    "p1_wide": _WIDE,
    "p3_found": " ".join((_NESTED + "select record_no, parent_path, node_path from r where parent_path is not null").split()),
    "p3_records": " ".join((_NESTED + _RECORDS).split()),
    "p3_properties": " ".join((_NESTED + _PROPERTY_ROWS).split()),
    "p1_found": f"with {_CELLS} select distinct record_id, attribute from cells where ok",
    "p2_found": _ORPHANS + "select statement_id, ref_field, orphan_kind from found",
    "p2_report": _ORPHANS + "select ref_field, rec_type, cast(coalesce(year(first_seen) * 100 + month(first_seen), 0) as int) as period, orphan_kind, count(*) as n from found group by 1, 2, 3, 4",
    "p4_found": STATEMENTS_ONCE + "select key_field, key_value" + _FOUND4 + " having count(*) >= 0.02 * (select count(*) from st)",
    "p4_results": STATEMENTS_ONCE + "select key_field, key_value, count(*) as n, count(distinct s) as subjects, min(asserted_at) as first_at, max(asserted_at) as last_at" + _FOUND4,
}
