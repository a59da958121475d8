"""Records (id, props) and what is done with them: making, selecting, changing, hashing, turning into quads.

``props`` maps a property IRI to an array of terms without duplicates. Changes return the changed table and an outcome per
record (id, status), computed in one plan; nothing is done record by record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.paths import empty
from ..sources.quads import term_of
from .criteria import Criteria

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
CREATED, MODIFIED, UNMODIFIED, DELETED = "OK_CREATED", "OK_MODIFIED", "OK_UNMODIFIED", "OK_DELETED"
EXISTS, MISSING = "ERROR_OBJECT_ALREADY_EXISTS", "ERROR_OBJECT_NOT_FOUND"


def columns_view(df: DataFrame, ident: Column, columns: dict[str, Column]) -> DataFrame:
    """Records whose properties are arrays of terms in columns; a property without a value maps to null.

    Catalyst sees through the map: a condition on a property reads its column and no others. ``retrieve`` and ``project``
    leave out properties that are null, as do all readers of single properties.
    """
    pairs = [x for p, c in columns.items() for x in (F.lit(p), F.when(F.size(c) > 0, c))]
    return df.select(ident.cast("string").alias("id"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")).alias("props"))


def present(records: DataFrame) -> DataFrame:
    """Records without properties that are null."""
    return records.withColumn("props", F.map_filter("props", lambda k, v: v.isNotNull()))


def _terms(df: DataFrame, source: str | Column) -> Column:
    """The array of terms that a column stands for."""
    kind = dict(df.dtypes)[source] if isinstance(source, str) else ""
    if kind.startswith("array"):
        return F.array_distinct(F.filter(source, lambda x: x.isNotNull()))
    col = term_of(df, source) if isinstance(source, str) else source
    return F.when(col.isNotNull(), F.array(col))


def columns_of(df: DataFrame, ident: Column, columns: dict[str, str | Column]) -> DataFrame:
    """Records of a table: a property per entry, its column a value, a term, or an array of terms (see ``columns_view``)."""
    return columns_view(df, ident, {p: _terms(df, source) for p, source in columns.items()})


def from_columns(df: DataFrame, ident: Column, columns: dict[str, str | Column]) -> DataFrame:
    """Records of a table as in ``columns_of``, nulls left out."""
    return present(columns_of(df, ident, columns))


def from_long(rows: DataFrame) -> DataFrame:
    """Records of (id, property, value) rows, values being terms; nulls are left out."""
    good = rows.where("id is not null and property is not null and value is not null")
    lists = good.groupBy("id", "property").agg(F.sort_array(F.collect_set("value")).alias("v"))
    return lists.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "v")))).alias("props"))


def to_long(records: DataFrame) -> DataFrame:
    """(id, property, value) rows."""
    return records.select("id", F.explode("props").alias("property", "values")).select("id", "property", F.explode("values").alias("value"))


def get(prop: str) -> Column:
    """Values of a property, an empty array where it has none."""
    return F.coalesce(F.col("props")[prop], empty())


def unique(prop: str, default: Column | None = None) -> Column:
    """The single value of a property; several are an error unless there is a default, which then counts."""
    many = F.raise_error(F.lit(f"several values of {prop}")).cast("string") if default is None else default
    none = F.lit(None).cast("string") if default is None else default
    return F.when(F.size(get(prop)) > 1, many).when(F.size(get(prop)) == 0, none).otherwise(F.get(get(prop), F.lit(0)))


def is_true(prop: str) -> Column:
    """The boolean of a property; false without a value, an error where it has several or is no boolean."""
    value = unique(prop)
    return F.when(value.isNull(), False).when(T.boolean_of(value).isNull(), F.raise_error(F.lit(f"{prop} is not boolean")).cast("boolean")).otherwise(T.boolean_of(value))


def project(records: DataFrame, props: list[str] | None) -> DataFrame:
    """Keep the listed properties (the id always stays); None keeps all."""
    if props is None:
        return present(records)
    return records.withColumn("props", F.map_filter("props", lambda k, v: v.isNotNull() & k.isin(props) if props else F.lit(False)))


def clear(records: DataFrame, props: list[str] | None = None) -> DataFrame:
    """Drop the listed properties; none listed drops all."""
    return records.withColumn("props", F.map_filter("props", lambda k, v: v.isNotNull() & ~k.isin(props) if props else F.lit(False)))


def with_any(prop: str, terms: list[str]) -> Column:
    """Some value of the property is among ``terms``."""
    return F.arrays_overlap(get(prop), F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)


def retrieve(records: DataFrame, conditions: list[Column] = (), ids: DataFrame | list[str] | None = None, props: list[str] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filter by all conditions and ids, then project; paging is in the order of ids. Ids that don't exist give nothing."""
    out = reduce(lambda df, c: df.where(c), conditions, records)
    if isinstance(ids, DataFrame):
        out = out.join(ids.select("id").distinct(), "id", "left_semi")
    elif ids is not None:
        out = out.where(F.col("id").isin(list(ids)))
    if offset or limit is not None:
        out = out.orderBy("id")
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
    return project(out, props)


def _sorted(props: Column) -> Column:
    """One form per content: entries by property, values sorted, empty properties gone."""
    entries = F.filter(F.map_entries(props), lambda e: F.size(e["value"]) > 0)
    return F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.array_sort(F.array_distinct(e["value"])).alias("value"))))


def content_hash(props: Column) -> Column:
    """MD5 of the content, whatever the order of properties and values."""
    return F.md5(F.to_json(_sorted(props)))


def object_hash(text: Column) -> Column:
    """A short id made of an MD5."""
    return F.substring(F.translate(F.base64(F.unhex(F.md5(text))), "+/=", "-_"), 1, 16)


def create(store: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add records; those whose id exists are refused."""
    fresh = new.dropDuplicates(["id"])
    ids = store.select("id").distinct()
    status = fresh.select("id").join(ids.withColumn("had", F.lit(True)), "id", "left").select("id", F.when(F.col("had"), EXISTS).otherwise(CREATED).alias("status"))
    return store.select("id", "props").unionByName(fresh.join(ids, "id", "left_anti").select("id", "props")), status


def merge(store: DataFrame, new: DataFrame, criteria: Criteria | None) -> tuple[DataFrame, DataFrame]:
    """Upsert: properties of the new record are merged into the old ones; without criteria nothing changes."""
    fresh = new.groupBy("id").agg(F.max_by("props", content_hash(F.col("props"))).alias("new"))
    if criteria is None:
        return store.select("id", "props"), fresh.select("id", F.lit(UNMODIFIED).alias("status"))
    none = F.create_map().cast("map<string,array<string>>")
    both = store.select("id", F.col("props").alias("old")).join(fresh, "id", "full")
    merged = F.map_zip_with(F.coalesce("old", none), F.coalesce("new", none), criteria.merge)
    both = both.withColumn("props", F.map_filter(merged, lambda k, v: F.size(v) > 0))
    status = F.when(F.col("old").isNull(), CREATED).when(content_hash(F.col("old")) == content_hash(F.col("props")), UNMODIFIED).otherwise(MODIFIED)
    return both.select("id", "props"), both.where("new is not null").select("id", status.alias("status"))


def update(store: DataFrame, condition: Column, patch: dict[str, list[str]], criteria: Criteria) -> tuple[DataFrame, DataFrame]:
    """Merge one patch into every record that fits the condition."""
    given = F.map_from_entries(F.array(*[F.struct(F.lit(p).alias("key"), (F.array(*[F.lit(t) for t in v]) if v else empty()).alias("value")) for p, v in sorted(patch.items())]))
    changed = F.map_filter(F.map_zip_with("props", given, criteria.merge), lambda k, v: F.size(v) > 0)
    hit = F.coalesce(condition, F.lit(False))
    both = store.withColumn("hit_", hit).withColumn("after_", F.when(F.col("hit_"), changed).otherwise(F.col("props")))
    status = F.when(content_hash(F.col("props")) == content_hash(F.col("after_")), UNMODIFIED).otherwise(MODIFIED)
    return both.select("id", F.col("after_").alias("props")), both.where("hit_").select("id", status.alias("status"))


def delete(store: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Remove the records that fit the condition."""
    hit = F.coalesce(condition, F.lit(False))
    return store.where(~hit).select("id", "props"), store.where(hit).select("id", F.lit(DELETED).alias("status"))


def delete_ids(store: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    status = gone.join(store.select("id", F.lit(DELETED).alias("s")), "id", "left").select("id", F.coalesce("s", F.lit(MISSING)).alias("status"))
    return store.join(gone, "id", "left_anti").select("id", "props"), status


def link_inverses(resources: DataFrame, mentions: DataFrame, has: str, of: str, stub_type: str | None = None) -> DataFrame:
    """Resources whose ``has`` values are those mentions that point to them by ``of``; missing resources become stubs.

    A mention may point to one resource only: the smallest counts.
    """
    points = mentions.select("id", F.get(F.array_sort(get(of)), F.lit(0)).alias("to")).where("to is not null")
    lists = points.groupBy(T.lexical_form(F.col("to")).alias("id")).agg(F.sort_array(F.collect_set(T.uri(F.col("id")))).alias("m"))
    none = F.create_map().cast("map<string,array<string>>")
    stub = F.create_map(F.lit(RDF_TYPE), F.array(F.lit(T.uri_code(stub_type)))) if stub_type else none
    both = resources.select("id", "props").join(lists, "id", "full")
    own = F.map_filter(F.coalesce("props", stub), lambda k, v: k != has)
    added = F.when(F.col("m").isNotNull(), F.create_map(F.lit(has), F.col("m"))).otherwise(none)
    return both.select("id", F.map_concat(own, added).alias("props"))


def encode(records: DataFrame, types: list[str] = ()) -> DataFrame:
    """Quads of records, without graph; ``types`` are added as rdf:type."""
    long = to_long(records).select(T.uri(F.col("id")).alias("s"), T.uri(F.col("property")).alias("p"), F.col("value").alias("o"))
    for t in types:
        long = long.unionByName(records.select(T.uri(F.col("id")).alias("s"), F.lit(T.uri_code(RDF_TYPE)).alias("p"), F.lit(T.uri_code(t)).alias("o")))
    return long.distinct().withColumn("g", F.lit(None).cast("string"))


def decode(quads: DataFrame, types: list[str]) -> DataFrame:
    """Records of the subjects that have one of ``types``; other nodes stay references."""
    roots = quads.where((F.col("p") == T.uri_code(RDF_TYPE)) & F.col("o").isin([T.uri_code(t) for t in types])).select("s").distinct()
    rows = quads.join(roots, "s", "left_semi").select(F.substring("s", 2, 1 << 20).alias("id"), T.lexical_form(F.col("p")).alias("property"), F.col("o").alias("value"))
    return from_long(rows)


def match(left: DataFrame, right: DataFrame, link: str) -> DataFrame:
    """(left_id, right_id) of records that ``link`` values of the left point to on the right."""
    points = to_long(left).where(F.col("property") == link).select(F.col("id").alias("left_id"), T.lexical_form(F.col("value")).alias("right_id"))
    return points.join(right.select(F.col("id").alias("right_id")), "right_id", "left_semi").distinct()
