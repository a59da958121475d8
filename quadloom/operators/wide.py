"""Attribute-value rows into one typed row per entity, by positional stitching.

Rows become cells, at most one per entity and attribute (aggregated before the shuffle, so an entity that holds a third
of all rows costs no task more than its share). Entities get global ordinals; each attribute is written as a typed column
aligned to ranges of ordinals; the wide table is put together by position, without a join or a shuffle per attribute.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import TYPES, lexical, read_as
from ..functions.uris import normalize_uri
from ..runtime import materialize

#: Entities, and bytes, after which a range of ordinals is closed.
RANGE_ROWS, RANGE_BYTES = 4096, 32 << 20
_SLOT = {"string": "s", "timestamp": "t", "bigint": "l", "int": "i", "double": "d", "boolean": "o"}


@dataclass(frozen=True)
class Attribute:
    name: str
    uri: str
    kind: str


def read_catalog(catalog: DataFrame, namespaces: dict[str, str], limit: int = 10_000) -> list[Attribute]:
    """The catalog, a fixed table of at most ``limit`` rows. Rows with a null or an unknown type are left out."""
    rows = (
        catalog.select("attribute", normalize_uri(F.col("property_uri"), namespaces).alias("uri"), F.lower(F.trim("target_type")).alias("kind"))
        .where(F.col("attribute").isNotNull() & F.col("uri").isNotNull() & F.col("kind").isin(*TYPES))
        .distinct()
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"more than {limit} attributes")
    return sorted((Attribute(*r) for r in rows), key=lambda a: (a.name, a.uri, a.kind))


def cells(rows: DataFrame, attributes: list[Attribute], namespaces: dict[str, str]) -> DataFrame:
    """(record_id, attr, text): the readable value of each cell; attr -1 where a record has a row that fills none.

    Of several readable values the one recorded last counts, of these the greatest text.
    """
    spark = rows.sparkSession
    names = sorted({a.name for a in attributes})
    listed = [(a.uri, names.index(a.name), a.kind) for a in attributes]
    known = spark.createDataFrame(listed, "uri_ string, attr int, kind_ string")
    text = lexical(F.col("propertyvalue"))
    readable = F.lit(False)
    for kind in sorted({a.kind for a in attributes}):
        readable = F.when(F.col("kind_") == kind, read_as(F.col("text"), kind).isNotNull()).otherwise(readable)
    return (
        rows.select(
            F.explode(F.array(normalize_uri(F.col("record_id"), namespaces))).alias("record_id"),
            normalize_uri(F.col("propertyuri"), namespaces).alias("uri_"),
            text.alias("text"),
            F.col("recorded_at").alias("at"),
        )
        .where(F.col("record_id").isNotNull())
        .join(F.broadcast(known), "uri_", "left")
        .withColumn("attr", F.when(F.coalesce(readable, F.lit(False)), F.col("attr")).otherwise(-1))
        .withColumn("text", F.when(F.col("attr") >= 0, F.col("text")))
        .groupBy("record_id", "attr")
        .agg(F.max(F.struct("at", "text"))["text"].alias("text"))
    )


def stitch(rows: DataFrame, catalog: DataFrame, namespaces: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """The wide table (ordinal, record_id, one typed column per attribute) and the names of its attribute columns.

    ``rows`` needs record_id, propertyuri, propertyvalue and recorded_at; other columns are not read. Rows without an id
    belong to no entity and are left out. An entity of which no value can be read has a row of nulls. Repeated rows change
    nothing. Empty input gives an empty table. A catalog may name several properties for an attribute; where its rows for one
    attribute differ in type, those with the type of the property that sorts first count. An attribute named like our own columns gets a ``_`` at its end.
    """
    attributes = read_catalog(catalog, namespaces)
    kinds: dict[str, str] = {}
    for a in attributes:
        kinds.setdefault(a.name, a.kind)
    attributes = [a for a in attributes if kinds[a.name] == a.kind]
    names = sorted(kinds)
    columns: list[str] = []
    for name in names:
        while name.lower() in {"ordinal", "record_id", *(c.lower() for c in columns)}:
            name += "_"
        columns.append(name)

    flat = cells(rows, attributes, namespaces)
    typed = {}
    for kind in sorted(set(kinds.values())):
        of_kind = [i for i, n in enumerate(names) if kinds[n] == kind]
        typed[kind] = F.when(F.col("attr").isin(of_kind), read_as(F.col("text"), kind)).alias(_SLOT[kind])
    flat = flat.select("record_id", "attr", *typed.values()).repartition("record_id").sortWithinPartitions("record_id", "attr")
    slots = [(i, _SLOT[kinds[n]]) for i, n in enumerate(names)]

    def columns_of(table: pa.Table, part: int, first: int) -> pa.RecordBatch:
        ids = table.column("record_id").combine_chunks()
        new = np.ones(len(ids), dtype=bool)
        new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        at = np.cumsum(new) - 1
        n = int(at[-1]) + 1
        attr = table.column("attr").to_numpy()
        one = pa.array([0, n], pa.int32())
        arrays = [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int32())]
        arrays.append(pa.ListArray.from_arrays(one, ids.filter(pa.array(new))))
        for index, slot in slots:
            where = np.flatnonzero(attr == index)
            pick = np.full(n, -1, dtype=np.int64)
            pick[at[where]] = where
            values = table.column(slot).combine_chunks().take(pa.array(pick, mask=pick < 0))
            arrays.append(pa.ListArray.from_arrays(one, values))
        return pa.RecordBatch.from_arrays(arrays, names=["part", "first", "n", "ids", *(f"a{i}" for i, _ in slots)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, rows_, bytes_ = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows_, bytes_ = rows_ + batch.num_rows, bytes_ + batch.nbytes
            if rows_ < RANGE_ROWS and bytes_ < RANGE_BYTES:
                continue
            table = pa.Table.from_batches(held)
            ids = table.column("record_id")
            whole = table.num_rows - int(pc.sum(pc.equal(ids, ids[-1])).as_py())
            if whole:  # the last entity may go on in the next batch
                yield (out := columns_of(table.slice(0, whole), part, first))
                first += out.column("n")[0].as_py()
            held = table.slice(whole).to_batches()
            rows_, bytes_ = table.num_rows - whole, 0
        if held:
            yield columns_of(pa.Table.from_batches(held), part, first)

    schema = "part int, first bigint, n int, ids array<string>" + "".join(f", a{i} array<{kinds[n]}>" for i, n in enumerate(names))
    ranges = materialize(flat.mapInArrow(run, schema), "wide")
    sizes = ranges.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a number per task
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["n"]
    start = ranges.sparkSession.createDataFrame(offsets, "part int, offset_ bigint")
    zipped = F.arrays_zip("ids", *(f"a{i}" for i, _ in slots))
    wide = (
        ranges.join(F.broadcast(start), "part")
        .select((F.col("offset_") + F.col("first")).alias("base"), F.posexplode(zipped).alias("at", "row"))
        .select(
            (F.col("base") + F.col("at")).alias("ordinal"),
            F.col("row.ids").alias("record_id"),
            *(F.col(f"row.a{i}").alias(columns[i]) for i, _ in slots),
        )
    )
    return wide, columns


def filled_cells(wide: DataFrame, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """(record_id, attribute) of each cell of the wide table that is not null."""
    marks = [F.when(F.col(f"`{c}`").isNotNull(), F.lit(n)) for c, n in zip(columns, names or columns)]
    if not marks:
        return wide.select("record_id", F.lit("").alias("attribute")).limit(0)
    return wide.select("record_id", F.explode(F.array_compact(F.array(*marks))).alias("attribute"))
