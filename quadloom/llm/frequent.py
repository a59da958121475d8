"""The most frequent values of a column in bounded memory, by a heavy-light split.

Each task keeps buckets of exact counters for hot values. A value that finds its bucket full votes against the bucket's
weakest value and, once it has enough votes, evicts it; counts that are evicted or find no place fall into a compact
count-min array. Partitions merge bucket by bucket, a few at a time; what loses its place there falls into the array too.
Memory depends on the number of buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.balanced import even_rows, first_deliveries
from ..operators.blocks import block_of, codes_of, map_blocks, ranks, word_hashes
from ..runtime import materialize

BUCKETS, PLACES, VOTES = 4096, 4, 8
#: Rows and width of the count-min array.
ROWS, WIDTH = 3, 1 << 16
#: Buckets, and stretches of the array, that are merged together; sketches that meet in one merge; blocks of a sketch.
GROUPS, STRETCHES, FAN_IN, PER_SKETCH = 16, 16, 64, 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def cells(hashes: np.ndarray, width: int) -> np.ndarray:
    """Where values of these hashes count in each row of an array of ``width``."""
    with np.errstate(over="ignore"):
        return ((hashes[None, :] * _ODD[:, None]) >> np.uint64(33)).astype(np.int64) % width


class Sketch:
    """Heavy buckets and light array of one column. Values are told apart by 64-bit hashes."""

    def __init__(self, buckets: int | None = None, width: int | None = None) -> None:
        self.buckets, self.width = buckets or BUCKETS, width or WIDTH
        self.hashes = np.zeros((self.buckets, PLACES), np.uint64)
        self.counts = np.zeros((self.buckets, PLACES), np.int64)  # since the value came in; 0 where a place is free
        self.values = np.full((self.buckets, PLACES), None, object)
        self.against = np.zeros(self.buckets, np.int64)
        self.light = np.zeros((ROWS, self.width), np.int64)

    @property
    def heavy(self) -> dict[int, dict[str, int]]:
        held = np.flatnonzero(self.counts.any(1))
        return {int(b): {v: int(n) for v, n in zip(self.values[b], self.counts[b]) if n} for b in held}

    def fall(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        for row, at in zip(self.light, cells(hashes, self.width)):
            np.add.at(row, at, counts)

    def add(self, value: str, count: int) -> None:
        self.add_all(np.array([value], object), word_hashes(pa.array([value])), np.array([count]))

    def add_all(self, values: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Add different values; of the values of a bucket the first comes first, all buckets at a time."""
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        turn = ranks(bucket[order])
        for at in np.split(order[np.argsort(turn, kind="stable")], np.cumsum(np.bincount(turn))[:-1]) if len(order) else []:
            self._turn(bucket[at], values[at], hashes[at], counts[at])

    def _turn(self, b: np.ndarray, values: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        free = self.counts[b] == 0
        same = ~free & (self.hashes[b] == hashes[:, None])
        known, room = same.any(1), free.any(1)
        self.counts[b[known], same[known].argmax(1)] += counts[known]
        new = ~known & room
        self._put(b[new], free[new].argmax(1), values[new], hashes[new], counts[new])
        full = ~known & ~room
        b, values, hashes, counts = b[full], values[full], hashes[full], counts[full]
        weakest = self.counts[b].argmin(1)
        votes = self.against[b] + counts
        wins = votes >= VOTES * self.counts[b, weakest]
        self.fall(np.where(wins, self.hashes[b, weakest], hashes), np.where(wins, self.counts[b, weakest], counts))
        self._put(b[wins], weakest[wins], values[wins], hashes[wins], counts[wins])
        self.against[b] = np.where(wins, 0, votes)

    def _put(self, b: np.ndarray, place: np.ndarray, values: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.values[b, place], self.hashes[b, place], self.counts[b, place] = values, hashes, counts

    def recombine(self, values: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Put together what sketches hold in the same buckets; what has no place falls into the light array."""
        different, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.zeros(len(different), np.int64)
        np.add.at(sums, at, counts)
        bucket = (different % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((different, -sums, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = ranks(bucket[order])
        keep = place < PLACES
        self._put(bucket[keep], place[keep], values[first][keep], different[keep], sums[keep])
        self.fall(different[~keep], sums[~keep])


_SCHEMA = "field string, part int, kind string, at int, value string, hash bigint, n bigint, data binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _emit(field: str, part: int, sketch: Sketch) -> Iterator[pa.RecordBatch]:
    """The buckets of a sketch as rows, by groups of buckets, and its light array by stretches."""
    b, place = np.nonzero(sketch.counts)
    if len(b):
        values, hashes = pa.array(sketch.values[b, place], pa.string()), pa.array(sketch.hashes[b, place].view(np.int64))
        yield _batch(field, part, "heavy", b * GROUPS // sketch.buckets, values, hashes, sketch.counts[b, place], pa.nulls(len(b), pa.binary()))
    step = -(-sketch.width // STRETCHES)
    at = [i for i in range(STRETCHES) if sketch.light[:, i * step : (i + 1) * step].any()]
    if at:
        data = pa.array([np.ascontiguousarray(sketch.light[:, i * step : (i + 1) * step]).tobytes() for i in at], pa.binary())
        yield _batch(field, part, "light", np.array(at), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64()), np.zeros(len(at), np.int64), data)


def _batch(field: str, part: int, kind: str, at: np.ndarray, values: pa.Array, hashes: pa.Array, n: np.ndarray, data: pa.Array) -> pa.RecordBatch:
    size = len(at)
    columns = [pa.array([field] * size), pa.array(np.full(size, part, np.int32)), pa.array([kind] * size), pa.array(at.astype(np.int32)), values, hashes, pa.array(n), data]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _split(fields: list[str], parts: int, buckets: int, width: int):
    """One sketch per field of all blocks of a task."""

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        sketches = {f: Sketch(buckets, width) for f in fields}
        part = 0
        for table in tables:
            part = int(table.column("block")[0].as_py()) % parts
            table = table.take(pa.array(first_deliveries(table)))
            for field in fields:
                codes, words = codes_of(table.column(field))
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                order = np.argsort(-counts, kind="stable")
                sketches[field].add_all(words.to_numpy(zero_copy_only=False).astype(object)[order], word_hashes(words)[order], counts[order])
        for field in fields:
            yield from _emit(field, part, sketches[field])

    return run


def _merge(buckets: int, width: int):
    """One group of buckets, or one stretch of a light array, of the sketches that meet."""

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            field, part = table.column("field")[0].as_py(), int(table.column("part")[0].as_py()) // FAN_IN
            is_heavy = _is_heavy(table)
            heavy, light = table.filter(pa.array(is_heavy)), table.filter(pa.array(~is_heavy))
            sketch = Sketch(buckets, width)
            if heavy.num_rows:
                values, hashes, n = (heavy.column(c).combine_chunks() for c in ("value", "hash", "n"))
                sketch.recombine(values.to_numpy(zero_copy_only=False).astype(object), hashes.to_numpy().view(np.uint64), n.to_numpy())
            step = -(-width // STRETCHES)
            for at, data in zip(light.column("at").to_pylist(), light.column("data").to_pylist()):
                sketch.light[:, at * step : (at + 1) * step] += np.frombuffer(data, np.int64).reshape(ROWS, -1)
            yield from _emit(field, part, sketch)

    return run


def _is_heavy(table: pa.Table) -> np.ndarray:
    codes, kinds = codes_of(table.column("kind"))
    return np.array([k == "heavy" for k in kinds.to_pylist()], bool)[codes]


def sketch_rows(rows: DataFrame, blocks: int, fields: tuple[str, ...], buckets: int, width: int) -> DataFrame:
    """The merged sketch of each field as rows: heavy (value, count), at most PLACES in a bucket, and light (stretch, counts)."""
    parts = max(1, -(-blocks // PER_SKETCH))
    out = map_blocks(rows.select("id", "seen", "block", *fields), "block", blocks, _split(list(fields), parts, buckets, width), _SCHEMA, PER_SKETCH)
    units = len(fields) * (GROUPS + STRETCHES)
    place = F.lit(0)
    for i, f in enumerate(fields):
        place = F.when(F.col("field") == f, i).otherwise(place)
    unit = place * (GROUPS + STRETCHES) + F.when(F.col("kind") == "heavy", F.col("at")).otherwise(F.col("at") + GROUPS)
    merge = lambda df, groups, number: map_blocks(df.withColumn("block", number.cast("int")), "block", groups * units, _merge(buckets, width), _SCHEMA, 2)
    while True:
        groups = -(-parts // FAN_IN)
        out, parts = merge(out, groups, F.floor(F.col("part") / FAN_IN) * units + unit), groups
        if parts == 1:
            break
    # what fell out of the buckets in the last merges joins the array
    out = materialize(out, "sketch")
    return out.where("kind = 'heavy'").unionByName(materialize(merge(out.where("kind = 'light'"), 1, unit), "light"))


def frequent_values(
    statements: DataFrame, namespaces: dict[str, str], share: float, fields: tuple[str, ...] = ("object", "subject"), slack: float = 0.05,
    buckets: int | None = None, width: int | None = None,
) -> DataFrame:
    """(item_field, item, estimate, n): values that at least ``share`` of the statements have, with approximate and exact counts.

    Candidates are the values whose estimate reaches ``share`` less ``slack`` of it; there are at most a few times 1 / share,
    and only they are counted exactly. A value that is in no bucket has at most the count of its light cells: where some
    cell reaches the threshold, all values that fall into such cells are candidates as well, so none is missed. Each
    statement_id counts once (a row without an id by itself), nulls are no values. Empty input gives no rows.
    """
    spark = statements.sparkSession
    buckets, width = buckets or BUCKETS, width or WIDTH
    keyed, blocks, total = even_rows(statements, namespaces)
    keyed = keyed.withColumnRenamed("member", "subject") if "subject" in fields else keyed
    least = share * total
    if not total:
        return spark.createDataFrame([], "item_field string, item string, estimate bigint, n bigint")
    rows = sketch_rows(keyed, blocks, fields, buckets, width)
    lights = {f: np.zeros((ROWS, width), np.int64) for f in fields}
    step = -(-width // STRETCHES)
    for r in rows.where("kind = 'light'").select("field", "at", "data").toLocalIterator():  # one array a field
        lights[r[0]][:, r[1] * step : (r[1] + 1) * step] += np.frombuffer(r[2], np.int64).reshape(ROWS, -1)
    near = least * (1 - slack)
    most = max(int(a.max()) for a in lights.values())
    listed = []
    for field, value, hash_, n in rows.where("kind = 'heavy'").where(F.col("n") >= F.lit(near - most)).select("field", "value", "hash", "n").toLocalIterator():
        at = cells(np.array([hash_]).view(np.uint64), width)[:, 0]
        estimate = n + int(lights[field][np.arange(ROWS), at].min())  # never less than the true count
        if estimate >= near:
            listed.append((field, value, estimate))
    long = keyed.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields))).alias("x")).select(
        "id", F.col("x.f").alias("item_field"), F.col("x.v").alias("item")
    ).where("item is not null")
    marks = F.broadcast(spark.createDataFrame(listed, "item_field string, item string, estimate bigint"))  # at most buckets x places a field
    hits = long.join(marks, ["item_field", "item"])
    if any(all((lights[f][i] >= least).any() for i in range(ROWS)) for f in fields):
        hits = hits.unionByName(_from_light(long, lights, least, {f: [v for g, v, _ in listed if g == f] for f in fields}))
    by_id = hits.where("id is not null").groupBy("item_field", "item", "id").agg(F.max("estimate").alias("estimate"))
    bare = hits.where("id is null").select(*by_id.columns)
    counted = by_id.unionByName(bare).groupBy("item_field", "item").agg(F.max("estimate").alias("estimate"), F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= F.lit(least))


def _from_light(long: DataFrame, lights: dict[str, np.ndarray], least: float, listed: dict[str, list[str]]) -> DataFrame:
    """Rows of values that no bucket lists although all their light cells reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, fields = codes_of(batch.column("item_field"))
            for f, field in enumerate(fields.to_pylist()):
                part = batch.filter(pa.array(kinds == f))
                codes, words = codes_of(part.column("item"))
                light = lights[field]
                estimates = light[np.arange(ROWS)[:, None], cells(word_hashes(words), light.shape[1])].min(0)
                known = np.isin(words.to_numpy(zero_copy_only=False).astype(object), np.array(listed[field], object)) if listed[field] else np.zeros(len(words), bool)
                keep = ((estimates >= least) & ~known)[codes]
                out = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(estimates[codes][keep])], names=[*out.schema.names, "estimate"])

    return long.mapInArrow(run, "id bigint, item_field string, item string, estimate bigint")
