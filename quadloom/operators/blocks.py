"""Even work units: rows hashed into blocks of bounded size, handed to numpy block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one block holds on average; a task works through its blocks one after the other.
BLOCK_ROWS = 131_072
#: Tasks of a shuffle into blocks, at most.
MOST_TASKS = 20_000


def block_count(rows: int, per_block: int = BLOCK_ROWS) -> int:
    return max(1, -(-rows // per_block))


def block_of(count: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def codes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense codes (-1 for null) and the dictionary they point into."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    encoded = column.dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def word_hashes(words: pa.Array, key: str = "0123456789123456") -> np.ndarray:
    """A 64-bit number per word, the same in every process; ``key`` (16 characters) chooses the function."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), hash_key=key, categorize=False)


def ranks(sorted_ids: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal ids."""
    if not len(sorted_ids):
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    return np.arange(len(sorted_ids)) - np.repeat(starts, np.diff(np.append(starts, len(sorted_ids))))


def blocks_in(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by the integer ``column`` into one table per value, holding one block at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(column).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if current is not None and ids[start] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = ids[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def map_blocks(
    df: DataFrame, block: str, count: int, fn: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str, per_task: int = 1
) -> DataFrame:
    """Shuffle ``df`` by its integer column ``block`` (0 to ``count`` - 1) and give ``fn`` each task's blocks, one table each.

    The number of tasks follows from the number of blocks, so a task reads as much at every size; blocks go to tasks by
    number and not by hash, so none gets more than its share.
    """
    tasks = min(MOST_TASKS, max(1, -(-count // per_task)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(blocks_in(batches, block))

    spread = df.repartitionById(tasks, F.pmod(F.col(block), F.lit(tasks)).cast("int"))
    return (spread if tasks == count else spread.sortWithinPartitions(block)).mapInArrow(run, schema)
