"""Nested JSON records into related flat tables, by adjacency-table shredding.

A record's JSON becomes rows of one adjacency table: node, parent, label, ordinal and scalar. Entity tables are made from
it by joining object nodes with their scalar children and pivoting these into columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, release

_ADJACENCY = (
    "record_no bigint, node int, parent int, label string, ordinal int, kind string, scalar string, "
    "record int, property int, value int"
)
#: Members of a value object that become columns of the property table (fixed names of the record format).
VALUE_MEMBERS = ("identifier", "label", "language", "timestamp", "timezone", "context", "subject", "predicate", "object", "id")


class _Number(str):
    pass


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None) -> object:
    """The JSON value of ``text``; ValueError unless it is valid JSON (NaN and Infinity aren't)."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=_Number, parse_float=_Number)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def is_record_text(text: str | None) -> bool:
    try:
        return isinstance(parse(text), dict)
    except ValueError:
        return False


def _role(name: str) -> str:
    return name.replace("_", "").replace("-", "").lower()


def _as_record(value: object) -> object:
    """The object meant by a property value: JSON text of a record counts as the record."""
    if isinstance(value, str) and not isinstance(value, _Number) and value.lstrip()[:1] == "{":
        try:
            inner = parse(value)
        except ValueError:
            return value
        if isinstance(inner, dict) and "properties" in inner:
            return inner
    return value


def adjacency_of(record_no: int, root: dict) -> list[tuple]:
    """Rows (record_no, node, parent, label, ordinal, kind, scalar, record, property, value); the root is node 0.

    Kinds: record, property, object, array, string, number, boolean, null. The ordinal of a property or of a property value
    is its position from 0, alone or not. ``record``, ``property`` and ``value`` say below which property value of which
    record a node lies; only ``member_table`` needs them.
    """
    rows: list[tuple] = []
    stack: list[tuple] = [(root, None, None, 0, "record", None, None, None)]
    while stack:
        value, parent, label, ordinal, role, record, prop, at = stack.pop()
        node = len(rows)
        if role == "record":
            rows.append((record_no, node, parent, label, ordinal, "record", None, record, prop, at))
            for i, (name, x) in enumerate(value.items()):
                if name == "properties":
                    for p, one in enumerate(x if isinstance(x, list) else [x]):
                        if isinstance(one, dict):
                            stack.append((one, node, name, p, "property", node, p, None))
                        else:
                            stack.append((one, node, name, p, "plain", node, p, None))
                else:
                    stack.append((x, node, name, i, "plain", node, None, None))
        elif role == "property":
            rows.append((record_no, node, parent, label, ordinal, "property", None, record, prop, None))
            for i, (name, x) in enumerate(value.items()):
                if _role(name) != "propertyvalue":
                    stack.append((x, node, "propertyURI" if _role(name) == "propertyuri" else name, i, "plain", record, prop, None))
                    continue
                for v, one in enumerate(x if isinstance(x, list) else [x]):
                    one = _as_record(one)
                    if isinstance(one, dict) and "properties" in one:
                        stack.append((one, node, "propertyValue", v, "record", record, prop, v))
                    else:
                        stack.append((one, node, "propertyValue", v, "plain", record, prop, v))
        elif isinstance(value, dict):
            rows.append((record_no, node, parent, label, ordinal, "object", None, record, prop, at))
            stack.extend((x, node, name, i, "plain", record, prop, at) for i, (name, x) in enumerate(value.items()))
        elif isinstance(value, list):
            rows.append((record_no, node, parent, label, ordinal, "array", None, record, prop, at))
            stack.extend((x, node, label, i, "plain", record, prop, at) for i, x in enumerate(value))
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, _Number) else "string"
            text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
            rows.append((record_no, node, parent, label, ordinal, kind, text, record, prop, at))
    return rows


def current_deliveries(raw: DataFrame) -> DataFrame:
    """(record_no, record_fields): of the readable deliveries of a record the one loaded last (ties: the greatest text).

    Chosen by an aggregation that combines before the shuffle, so many deliveries of one record burden no task.
    """

    @F.pandas_udf("boolean")
    def readable(texts):  # noqa: ANN001, ANN202
        return texts.map(is_record_text)

    good = raw.where(F.col("record_no").isNotNull() & F.col("record_fields").isNotNull()).select("record_no", "record_fields", "loaded_at")
    return (
        good.where(readable("record_fields"))
        .groupBy("record_no")
        .agg(F.max(F.struct("loaded_at", "record_fields"))["record_fields"].alias("record_fields"))
    )


def adjacency(raw: DataFrame) -> DataFrame:
    """The adjacency table of all records (see ``adjacency_of``), written once.

    Null and unreadable texts, texts that are no JSON object, and rows without a record_no yield nothing.
    """
    schema = pa.schema(
        [("record_no", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("record", pa.int32()), ("property", pa.int32()), ("value", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for no, text in zip(batch.column("record_no").to_pylist(), batch.column("record_fields").to_pylist()):
                rows.extend(adjacency_of(no, parse(text)))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return materialize(current_deliveries(raw).mapInArrow(run, _ADJACENCY), "adjacency")


def record_links(nodes: DataFrame) -> DataFrame:
    """(record_no, node, parent_record, parent_property, parent_value): of nested records, by way of the property between."""
    holders = nodes.where("kind = 'property'").select(
        "record_no", F.col("node").alias("holder"), F.col("parent").alias("parent_record"), F.col("ordinal").alias("parent_property")
    )
    nested = nodes.where("kind = 'record' and parent is not null").select(
        "record_no", "node", F.col("parent").alias("holder"), F.col("ordinal").alias("parent_value")
    )
    return nested.join(holders, ["record_no", "holder"]).select("record_no", "node", "parent_record", "parent_property", "parent_value")


def record_paths(links: DataFrame) -> DataFrame:
    """(record_no, node, parent_record, parent_property, parent_value, node_path, parent_path) of ``record_links``.

    Each row knows its path from some record above it. Rows take over the path of that record, which reaches twice as far
    up each time, until all paths begin at the root (node 0): a join per doubling of the depth.
    """
    step = F.concat_ws(".", "parent_property", "parent_value")
    rows = materialize(links.select("*", F.nullif("parent_record", F.lit(0)).alias("up"), step.alias("node_path")), "paths")
    while rows.where("up is not null").take(1):
        above = rows.select("record_no", F.col("node").alias("up"), F.col("up").alias("next_up"), F.col("node_path").alias("path_above"))
        moved = rows.where("up is not null").join(above, ["record_no", "up"])
        longer = moved.select(*links.columns, F.col("next_up").alias("up"), F.concat_ws("/", "path_above", "node_path").alias("node_path"))
        before, rows = rows, materialize(rows.where("up is null").unionByName(longer), "paths")
        release(before)
    return rows.drop("up").withColumn("parent_path", F.regexp_replace("node_path", r"/?[^/]*$", ""))


def record_table(nodes: DataFrame) -> DataFrame:
    """(record_no, node, parent_record, parent_property, parent_value, node_path, parent_path, id): one row per record.

    ``id`` comes from the scalar child ``id``, or from its member ``identifier``; the root has null parent columns and the
    empty path.
    """
    scalar = nodes.where(F.col("scalar").isNotNull())
    own = scalar.where("label = 'id'").select("record_no", F.col("parent").alias("node"), F.col("scalar").alias("plain_id"))
    boxes = nodes.where("label = 'id' and kind = 'object'").select("record_no", F.col("node").alias("box"), F.col("parent").alias("node"))
    inner = scalar.where("label = 'identifier'").select("record_no", F.col("parent").alias("box"), F.col("scalar").alias("boxed_id"))
    ids = (
        own.withColumn("boxed_id", F.lit(None).cast("string"))
        .unionByName(boxes.join(inner, ["record_no", "box"]).select("record_no", "node", F.lit(None).cast("string").alias("plain_id"), "boxed_id"))
        .groupBy("record_no", "node")
        .agg(F.coalesce(F.min("plain_id"), F.min("boxed_id")).alias("id"))
    )
    roots = nodes.where("kind = 'record' and parent is null").select("record_no", "node", F.lit("").alias("node_path"))
    located = record_paths(record_links(nodes)).unionByName(roots, allowMissingColumns=True)
    return located.join(ids, ["record_no", "node"], "left").select(
        "record_no", "node", "parent_record", "parent_property", "parent_value", "node_path", "parent_path", "id"
    )


def value_members(nodes: DataFrame) -> DataFrame:
    """(record_no, value_node, value_identifier, ...): the scalar children of objects, pivoted.

    Where a member is an object itself (the subject of a statement, say), its own identifier, id or label stands for it.
    """
    named = nodes.where(F.col("scalar").isNotNull() & F.col("label").isin(*VALUE_MEMBERS)).select("record_no", F.col("parent").alias("value_node"), "label", "scalar")
    boxes = nodes.where(F.col("label").isin(*VALUE_MEMBERS) & (F.col("kind") == "object")).select(
        "record_no", F.col("parent").alias("value_node"), "label", F.col("node").alias("box")
    )
    rank = F.when(F.col("label") == "identifier", 1).when(F.col("label") == "id", 2).otherwise(3)
    naming = named.where("label in ('identifier', 'id', 'label')").select("record_no", F.col("value_node").alias("box"), F.struct(rank, "scalar").alias("best"))
    of_box = boxes.join(naming, ["record_no", "box"]).groupBy("record_no", "value_node", "label").agg(F.min("best")["scalar"].alias("scalar"))
    members = named.unionByName(of_box).groupBy("record_no", "value_node").pivot("label", list(VALUE_MEMBERS)).agg(F.min("scalar"))
    return members.select("record_no", "value_node", *[F.col(m).alias(f"value_{m}") for m in VALUE_MEMBERS])


def property_table(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(record_no, record, property, value, property_uri, kind, scalar, value_node, child_record, members of value objects).

    One row per property value; a property without a value, or with an empty array, has one row of null ``value``.
    ``record`` points to ``record_table.node``; ``child_record`` to the nested record that is the value, if it is one. With
    ``paths`` (``record_paths``) there is the ``record_path``, too. The columns of members hold what ``value_members`` has of
    the value; ``member_table`` has all that is below ``value_node``. Only values that are objects meet their members.
    """
    props = nodes.where("kind = 'property'").select(
        "record_no", F.col("node").alias("holder"), F.col("parent").alias("record"), F.col("ordinal").alias("property")
    )
    more = []
    if paths is not None:
        props, more = props.join(paths.select("record_no", F.col("node").alias("record"), F.col("node_path").alias("record_path")), ["record_no", "record"], "left"), ["record_path"]
        props = props.withColumn("record_path", F.coalesce("record_path", F.lit("")))
    uris = nodes.where("label = 'propertyURI'").groupBy("record_no", F.col("parent").alias("holder")).agg(F.min("scalar").alias("property_uri"))
    values = nodes.where("label = 'propertyValue'").select(
        "record_no", F.col("parent").alias("holder"), F.col("node").alias("value_node"), F.col("ordinal").alias("value"), "kind", "scalar"
    )
    objects = values.where("kind in ('object', 'record')").join(value_members(nodes), ["record_no", "value_node"], "left")
    values = values.where("kind not in ('object', 'record')").unionByName(objects, allowMissingColumns=True)
    return (
        props.join(uris, ["record_no", "holder"], "left")
        .join(values, ["record_no", "holder"], "left")
        .select(
            "record_no", "record", *more, "property", "value", "property_uri", "kind", "scalar", "value_node",
            F.when(F.col("kind") == "record", F.col("value_node")).alias("child_record"),
            *(f"value_{m}" for m in VALUE_MEMBERS),
        )
    )


def member_table(nodes: DataFrame) -> DataFrame:
    """(record_no, record, property, value, node, parent, label, ordinal, kind, scalar): one row per member, however deep.

    Members are all nodes but records, properties and property values: those below a value object or array, with any name,
    and the other members of properties and records. ``parent`` is the ``value_node`` of ``property_table``, the node of
    another member, of a property (``property`` is set, ``value`` is null) or of a record. Elements of an array have the
    label of the array.
    """
    members = nodes.where("kind not in ('record', 'property')")
    maybe_value = (F.col("label") == "propertyValue") & F.col("value").isNotNull()  # or below one, with the same label
    holders = nodes.where("kind = 'property'").select("record_no", F.col("node").alias("parent"))
    inner = members.where(maybe_value).join(holders, ["record_no", "parent"], "left_anti")
    members = members.where(~F.coalesce(maybe_value, F.lit(False))).unionByName(inner)
    return members.select("record_no", "record", "property", "value", "node", "parent", "label", "ordinal", "kind", "scalar")


def nested_records(raw: DataFrame) -> DataFrame:
    """(record_no, parent_path, node_path) of the records nested in others."""
    return record_table(adjacency(raw)).where(F.col("parent_record").isNotNull()).select("record_no", "parent_path", "node_path")
