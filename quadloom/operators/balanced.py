"""Per-key results in balanced time, by dense accumulator arrays.

Rows are cut into even splits by a hash that has nothing to do with the keys. Within a split, keys are dictionary-encoded
and measures are scattered into arrays with a slot per code. A split sends on blocks of these arrays, each with its part of
the dictionary, so a key with a third of all rows costs a reducer one slot per split; reducers add the arrays up in two
steps, the first over a few splits each. Subjects travel as codes beside them and are counted where equal ones meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.uris import normalize_uri
from .blocks import BLOCK_ROWS, block_count, block_of, codes_of, map_blocks, word_hashes

_NONE_LOW, _NONE_HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: One row per split, field and target block: a part of the dictionary, and either accumulators with a slot per key (n,
#: members, low, high), or for each subject of a key its code in the dictionary and 128 bits that stand for the subject.
_ARRAYS = (
    "field string, block int, keys array<string>, n array<bigint>, members array<bigint>, low array<bigint>, high array<bigint>, "
    "codes array<int>, first array<bigint>, second array<bigint>"
)
#: Splits whose arrays are added up together before they go to the block of their keys.
FAN_IN = 16
_SECOND = "second subject h"  # 16 characters that choose the second hash


def statement_keys(statements: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """(id, seen, predicate, object, member, at): normalised keys, with the subject as member. Times are microseconds."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return statements.select(
        F.col("statement_id").alias("id"),
        micros("loaded_at").alias("seen"),
        normalize_uri(F.col("predicate"), namespaces).alias("predicate"),
        F.when(F.col("object_kind") == "uri", normalize_uri(F.col("object"), namespaces)).otherwise(F.col("object")).alias("object"),
        normalize_uri(F.col("subject"), namespaces).alias("member"),
        micros("asserted_at").alias("at"),
    )


def even_rows(statements: DataFrame, namespaces: dict[str, str]) -> tuple[DataFrame, int, int]:
    """The rows of ``statement_keys`` with a ``block`` of even size, the number of blocks, and that of statements (counted once by id).

    Blocks are a hash of the id, so that repeated deliveries meet in one. Where an id is delivered more often than a block
    holds rows, ids are reduced to their first delivery beforehand, by an aggregation that combines before the shuffle. Rows
    without an id are spread by their position.
    """
    rows = statement_keys(statements, namespaces)
    counts = statements.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n"))
    null = F.col("statement_id").isNull()
    n, ids, bare, most = counts.agg(
        F.sum("n"), F.count("statement_id"), F.sum(F.when(null, F.col("n"))), F.max(F.when(~null, F.col("n")))
    ).first()
    if (most or 0) > BLOCK_ROWS:
        names = [c for c in rows.columns if c != "id"]
        first = rows.where("id is not null").groupBy("id").agg(F.min(F.struct(*names)).alias("r"))
        rows = rows.where("id is null").unionByName(first.select("id", *[F.col(f"r.{c}").alias(c) for c in names]))
    blocks = block_count(n or 0)
    block = block_of(blocks, F.coalesce(F.col("id"), F.monotonically_increasing_id()))
    return rows.withColumn("block", block), blocks, ids + (bare or 0)


def first_deliveries(table: pa.Table) -> np.ndarray:
    """Row numbers of the first delivery of each id of a block, by time of loading; rows without an id all stay."""
    ids = table.column("id").combine_chunks()
    seen = table.column("seen").combine_chunks().fill_null(_NONE_LOW).to_numpy()
    missing = np.asarray(ids.is_null())
    number = ids.fill_null(0).to_numpy()
    order = np.lexsort((np.arange(len(number)), seen, number, missing))
    ordered, nulls = number[order], missing[order]
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (ordered[1:] != ordered[:-1]) | nulls[1:]
    return np.sort(order[keep])


def _scatter(codes: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lows, highs = np.full(size, _NONE_LOW), np.full(size, _NONE_HIGH)
    np.minimum.at(lows, codes, low)
    np.maximum.at(highs, codes, high)
    return lows, highs


def _add(codes: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, codes, values)
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return x ^ (x >> np.uint64(31))


def _rows(field: str, block: np.ndarray, lists: dict[str, pa.ListArray]) -> pa.RecordBatch:
    kinds = {"keys": pa.string(), "codes": pa.int32()}
    names = ("keys", "n", "members", "low", "high", "codes", "first", "second")
    columns = [lists.get(c, pa.nulls(len(block), pa.list_(kinds.get(c, pa.int64())))) for c in names]
    fields = pa.array([field] * len(block), pa.string())
    return pa.RecordBatch.from_arrays([fields, pa.array(block.astype(np.int32)), *columns], names=["field", "block", *names])


def _accumulators(field: str, target: np.ndarray, keys: pa.Array, n: np.ndarray, members: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Arrays with a slot per key, cut by the block that each key goes to."""
    order = np.argsort(target, kind="stable")
    blocks, starts = np.unique(target[order], return_index=True)
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    values = {"keys": keys.take(pa.array(order))} | {c: pa.array(v[order]) for c, v in (("n", n), ("members", members), ("low", low), ("high", high))}
    return _rows(field, blocks, {c: pa.ListArray.from_arrays(offsets, v) for c, v in values.items()})


def _subjects(field: str, target: np.ndarray, key: np.ndarray, keys: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """Subjects of keys as codes, cut by the block in which a key's equal subjects meet; each block has its own dictionary."""
    used, at = np.unique(target * len(keys) + key, return_inverse=True)
    blocks, starts = np.unique(used // len(keys), return_index=True)
    order = np.argsort(at, kind="stable")
    group = np.searchsorted(blocks, target[order])
    ends = np.searchsorted(group, np.arange(len(blocks) + 1)).astype(np.int32)
    dictionary = pa.ListArray.from_arrays(pa.array(np.append(starts, len(used)).astype(np.int32)), keys.take(pa.array(used % len(keys))))
    codes = (at[order] - starts[group]).astype(np.int32)
    lists = {c: pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for c, v in (("codes", codes), ("first", first[order].view(np.int64)), ("second", second[order].view(np.int64)))}
    return _rows(field, blocks, {"keys": dictionary, **lists})


def _split(fields: list[str], blocks: int, spread: int, subjects: bool):
    """Of each split: arrays of accumulators per field, and the different subjects of its keys."""

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            group = int(table.column("block")[0].as_py()) // FAN_IN
            table = table.take(pa.array(first_deliveries(table)))
            if subjects:
                member, members = codes_of(table.column("member"))
                first, second = word_hashes(members), word_hashes(members, _SECOND)
            at = table.column("at").combine_chunks()
            low, high = at.fill_null(_NONE_LOW).to_numpy(), at.fill_null(_NONE_HIGH).to_numpy()
            for field in fields:
                key, keys = codes_of(table.column(field))
                rows = np.flatnonzero(key >= 0)
                if not len(rows):
                    continue
                key, names = key[rows], word_hashes(keys)
                home = (names % np.uint64(blocks)).astype(np.int64)
                n = np.bincount(key, minlength=len(keys)).astype(np.int64)
                yield _accumulators(field, (home + group * 7919) % spread, keys, n, np.zeros(len(keys), np.int64), *_scatter(key, len(keys), low[rows], high[rows]))
                if subjects:
                    mine = member[rows]
                    pair = np.unique(key[mine >= 0] * max(1, len(members)) + mine[mine >= 0])
                    k, m = pair // max(1, len(members)), pair % max(1, len(members))
                    if len(pair):
                        yield _subjects(field, (_mix(names[k], first[m]) % np.uint64(spread)).astype(np.int64), k, keys, first[m], second[m])

    return run


def _sum_up(table: pa.Table) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(field, keys, n, members, low, high) of a block of rows: arrays added up, subjects counted."""
    kinds, fields = codes_of(table.column("field"))
    for f, field in enumerate(fields.to_pylist()):
        mine = table.filter(pa.array(kinds == f)).combine_chunks()
        lists = mine.column("keys").combine_chunks()
        slot, keys = codes_of(lists.flatten())
        sizes = lists.value_lengths().to_numpy()
        counted = np.asarray(mine.column("codes").combine_chunks().is_valid())
        flat = lambda c: mine.column(c).combine_chunks().flatten().to_numpy()  # noqa: E731, B023
        sums = slot[np.repeat(~counted, sizes)]
        n, members = (_add(sums, len(keys), flat(c)) for c in ("n", "members"))
        low, high = _scatter(sums, len(keys), flat("low"), flat("high"))
        if counted.any():
            firsts = np.cumsum(sizes) - sizes
            lengths = mine.column("codes").combine_chunks().value_lengths().fill_null(0).to_numpy()
            code = slot[flat("codes") + np.repeat(firsts, lengths)]
            first, second = flat("first"), flat("second")
            order = np.lexsort((second, first, code))
            code, first, second = code[order], first[order], second[order]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            members = members + np.bincount(code[new], minlength=len(keys))
        yield field, keys, n, members, low, high


def _reduce(blocks: int):
    """Arrays of a few splits into one, sent to the block of their keys."""

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for field, keys, *sums in _sum_up(table):
                yield _accumulators(field, (word_hashes(keys) % np.uint64(blocks)).astype(np.int64), keys, *sums)

    return run


def _results(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        for field, keys, *sums in _sum_up(table):
            yield pa.RecordBatch.from_arrays(
                [pa.array([field]).take(pa.array(np.zeros(len(keys), np.int64))), keys, *map(pa.array, sums)], names=["field", "key", "n", "members", "low", "high"]
            )


def key_results(
    statements: DataFrame, namespaces: dict[str, str], fields: tuple[str, ...] = ("predicate", "object"), share: float | None = None, subjects: bool = True
) -> DataFrame:
    """(key_field, key_value, n, subjects, first_at, last_at) for every value of ``fields``, or those with ``share`` of the statements.

    Each statement_id counts once, by its first delivery; a row without an id counts by itself. Null keys are left out,
    null subjects are not counted, and a key asserted at no known time has null times. URIs are compared in normal form,
    literals exactly. Subjects are told apart by 128 bits. Without ``subjects`` that column is left out, and none travel.
    Empty input gives no rows.
    """
    split, splits, total = even_rows(statements, namespaces)
    if not subjects:
        split = split.drop("member")
    blocks = block_count(total)
    spread = 2 * blocks
    parts = map_blocks(split, "block", splits, _split(list(fields), blocks, spread, subjects), _ARRAYS)
    reduced = map_blocks(parts, "block", spread, _reduce(blocks), _ARRAYS)
    whole = map_blocks(reduced, "block", blocks, _results, "field string, key string, n bigint, members bigint, low bigint, high bigint")
    if share is not None:
        whole = whole.where(F.col("n") >= F.lit(share * total))
    time = lambda c, none: F.when(F.col(c) != none, F.timestamp_micros(F.col(c)).cast("timestamp_ntz"))
    return whole.select(
        F.col("field").alias("key_field"),
        F.col("key").alias("key_value"),
        "n",
        *([F.col("members").alias("subjects")] if subjects else []),
        time("low", int(_NONE_LOW)).alias("first_at"),
        time("high", int(_NONE_HIGH)).alias("last_at"),
    )
