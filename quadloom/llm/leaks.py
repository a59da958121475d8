"""Evaluation texts inside a corpus, by a prefix-filtered set join and exact verification.

Items and documents are sets of five-word shingles. The shingles of an item are ordered by how rare they are in the whole
corpus; a document that holds enough of an item must hold one of the item's rarest shingles (its prefix), so only these are
joined: a shingle outside of all prefixes, such as those of a question that many items ask, makes no pair. Bounds on length,
on the number of shared shingles and on position drop pairs that cannot hold enough; what is left is verified word by word
over windows of the item's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .words import Numbered, words_of

#: Words of a shingle; words of the shortest run that counts; share of an item's words that must be there.
SHINGLE, RUN, SHARE = 5, 8, 0.5
#: One changed word in so many.
CHANGED = 10
#: Words of all items together up to which their index is sent to every task.
INDEX_WORDS = 1_000_000


def shingle_hashes(ids: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit number per run of ``n`` word numbers; 0 where a word is unknown (-1)."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    known = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = ids[k : k + len(out)]
            known &= part >= 0
            out = (out ^ (part + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    out[out == 0] = 1
    out[~known] = 0
    return out


@dataclass
class Index:
    """Items as word numbers, and where each of their shingles stands; ``mine`` lists the entries item by item."""

    item_ids: list[int]
    numbers: dict[str, int]
    items: list[np.ndarray]
    keys: np.ndarray
    starts: np.ndarray
    of_item: np.ndarray
    positions: np.ndarray
    mine: np.ndarray
    bounds: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> Index:
        numbers: dict[str, int] = {}
        items = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(text)], np.int64) for _, text in rows]
        hashes = [shingle_hashes(i) for i in items]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes]) if hashes else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        keys, starts = np.unique(flat[order], return_index=True)
        sizes = np.cumsum([0, *map(len, hashes)])
        return cls([i for i, _ in rows], numbers, items, keys, np.append(starts, len(flat)), owner[order], place[order], np.argsort(order), sizes)

    def shingle_of(self) -> np.ndarray:
        """The shingle of each entry."""
        return np.repeat(np.arange(len(self.keys)), np.diff(self.starts))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are shingles of some item, and which shingle each is."""
        if not len(self.keys) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        return hit, at[hit]


def covered(same: np.ndarray) -> np.ndarray:
    """Which words of a diagonal lie in runs of at least RUN words with at most one in CHANGED changed.

    Runs begin and end with words that are not changed.
    """
    n = len(same)
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - CHANGED))])
    final = np.where(np.concatenate([[False], same]), sums, -CHANGED * (n + 1))
    best = np.maximum.accumulate(final[::-1])[::-1]  # from each place on; falls
    starts = np.flatnonzero(same)
    # the last end whose sum is not below the sum at the start
    ends = np.searchsorted(-best, -sums[starts], side="right") - 1
    good = ends - starts >= RUN
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts[good], 1)
    np.add.at(marks, ends[good], -1)
    return np.cumsum(marks[:n]) > 0


def held(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray) -> int:
    """Words of the item that the document holds in runs; ``diagonals`` are the offsets of shared shingles."""
    seen = np.zeros(len(item), bool)
    for d in diagonals:
        low, high = max(0, -d), min(len(item), len(doc) - d)
        if high - low < RUN:
            continue
        seen[low:high] |= covered(item[low:high] == doc[low + d : high + d])
    return int(seen.sum())


def _windows(words: int) -> list[tuple[int, int]]:
    """(length, least): a run of a covered length lies in a window of this length with so many shared shingles at least.

    A run of L words has at most c = L // CHANGED changed ones, each of which breaks SHINGLE shingles, so it has at least
    L - (SHINGLE - 1) - c * SHINGLE whole ones, and one in any case. Short runs have their own window; long ones share that
    of the longest run of their class, with what the shortest needs.
    """
    out, low = [], RUN
    while low <= words:
        high = low if low < 4 * CHANGED else min(words, low + low // 10)
        need = min(n - (SHINGLE - 1) - n // CHANGED * SHINGLE for n in range(low, min(high, low + CHANGED) + 1))
        out.append((high, max(1, need)))
        low = high + 1
    return out


def coverable(shared: np.ndarray, words: int) -> int:
    """Words of an item, at most, that runs can cover whose whole shingles are all among ``shared`` (a flag per position)."""
    sums = np.concatenate([[0], np.cumsum(shared)])
    marks = np.zeros(words + 1, np.int64)
    for length, least in _windows(words):
        starts = np.arange(words - length + 1)
        good = starts[sums[starts + length - SHINGLE + 1] - sums[starts] >= least]
        np.add.at(marks, good, 1)
        np.add.at(marks, good + length, -1)
    return int((np.cumsum(marks[:words]) > 0).sum())


def prefix_shingles(index: Index, frequency: np.ndarray) -> np.ndarray:
    """Whether each (shingle, item) entry of the index is in the prefix of its item.

    Shingles are ordered by the pairs they would make, documents times items. The commonest are left out as long as no
    document that shares nothing but these can hold enough of the item.
    """
    inside = np.ones(len(index.of_item), bool)
    pairs = (frequency * np.diff(index.starts))[index.shingle_of()]
    for i, words in enumerate(index.items):
        mine = index.mine[index.bounds[i] : index.bounds[i + 1]]  # by position
        need = int(np.ceil(len(words) * SHARE))
        order = np.lexsort((np.arange(len(mine)), -pairs[mine]))
        low, high = 0, len(mine)
        while low < high:  # so many of the commonest can be spared
            mid = (low + high + 1) // 2
            shared = np.zeros(len(mine), bool)
            shared[order[:mid]] = True
            low, high = (mid, high) if coverable(shared, len(words)) < need else (low, mid - 1)
        inside[mine[order[:low]]] = False
    return inside


@dataclass
class Prefix:
    """The entries of the prefixes only, by shingle."""

    starts: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, index: Index, inside: np.ndarray) -> Prefix:
        entries = np.flatnonzero(inside)
        return cls(np.searchsorted(index.shingle_of()[entries], np.arange(len(index.keys) + 1)), entries)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all numbers from ``low`` to before ``high`` of each row."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _expanded(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _ranges(starts[which], starts[which + 1])


def least_shared(words: np.ndarray) -> np.ndarray:
    """Shingles at least that a document shares with an item of so many words when it holds enough of it.

    What runs cover, some of them cover so that no place is in more than two; a run has at most CHANGED words for each of
    its whole shingles. So no shared shingle accounts for more than 2 x CHANGED words.
    """
    return np.ceil(np.ceil(words * SHARE) / (2 * CHANGED)).astype(np.int64)


def candidates(index: Index, prefix: Prefix, doc: np.ndarray, shingles: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (document, item) that share a shingle of the item's prefix and whose document is long enough."""
    row, place = _expanded(prefix.starts, shingles)
    pair = np.unique(doc[row] * len(index.items) + index.of_item[prefix.entries[place]])
    d, i = pair // len(index.items), pair % len(index.items)
    sizes = np.array([len(x) for x in index.items], np.int64)
    keep = lengths[d] >= np.ceil(sizes[i] * SHARE)
    return d[keep], i[keep]


def pairs_in(index: Index, prefix: Prefix, starts: np.ndarray, hits: np.ndarray, shingles: np.ndarray, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, words held, words of the item) for the pairs of a batch where enough is held.

    ``hits`` and ``shingles`` hold, for each shared shingle, the position in its document and which shingle it is, one
    document after the other as ``starts`` tells; ``texts`` has the words of each document.
    """
    size, of_entry = len(index.items), index.shingle_of()
    sizes = np.array([len(x) for x in index.items], np.int64)
    d, i = candidates(index, prefix, np.repeat(np.arange(len(texts)), np.diff(starts)), shingles, np.array([len(t) for t in texts]))
    pair, hit = _expanded(starts, d)
    entries, wanted = of_entry * size + index.of_item, shingles[hit] * size + i[pair]  # ascending, as entries are
    low, high = np.searchsorted(entries, wanted), np.searchsorted(entries, wanted, side="right")
    at, entry = _ranges(low, high)
    pair, hit = pair[at], hit[at]
    shared = np.bincount(np.unique(pair * (len(entries) + 1) + entry) // (len(entries) + 1), minlength=len(d))
    ends = np.searchsorted(pair, np.arange(len(d) + 1))
    for k in np.flatnonzero(shared >= least_shared(sizes[i])).tolist():
        mine = slice(ends[k], ends[k + 1])
        words, ids = index.items[i[k]], texts[d[k]]
        need = int(np.ceil(len(words) * SHARE))
        offset = np.unique(hits[hit[mine]] - index.positions[entry[mine]])
        reach = np.minimum(len(words), len(ids) - offset) - np.maximum(0, -offset)
        if int(reach.sum()) < need:  # its windows are too far at the edge to hold enough
            continue
        found = held(words, ids, offset)
        if found >= need:
            yield int(d[k]), int(i[k]), found, len(words)


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks whose words fit the index bound."""
    held_, size = [], 0
    for r in items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"]) // 2 + 1  # never fewer than its words
        if held_ and size + n > most:
            yield held_
            held_, size = [], 0
        held_.append((r["item_id"], r["text"]))
        size += n
    if held_:
        yield held_


def leaked_items(documents: DataFrame, items: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, item_id, words_held, item_words): documents that hold at least SHARE of an item's words.

    Words count that lie in runs of RUN or more with at most one changed word in CHANGED. Items are taken in blocks that fit
    ``index_words``; every document is read whole and tested against all of them. Null ids and texts, and items without a
    word, match nothing; repeated rows give one row per pair, with the most words held. Empty tables give no rows.
    """
    spark = documents.sparkSession
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, words_held int, item_words int")
    for rows in _blocks(items, index_words):
        out = out.unionByName(_leaked(documents, rows))
    return out.groupBy("doc_id", "item_id").agg(F.max("words_held").alias("words_held"), F.max("item_words").alias("item_words"))


def _leaked(documents: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    spark = documents.sparkSession
    index = Index.build(rows)
    if not len(index.keys):
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, words_held int, item_words int")
    sent = spark.sparkContext.broadcast(index)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        number = Numbered(index.numbers)
        for batch in batches:
            docs, words, hits, shingles = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array(number(text), np.int64)
                hit, shingle = index.find(shingle_hashes(ids))
                if len(hit):
                    docs.append(doc)
                    words.append(ids.astype(np.int32))
                    hits.append(hit.astype(np.int32))
                    shingles.append(shingle.astype(np.int32))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), *(pa.array(x, lists) for x in (words, hits, shingles))], names=["doc_id", "words", "hits", "shingles"]
            )

    known = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    found = materialize(known.mapInArrow(shingled, "doc_id bigint, words array<int>, hits array<int>, shingles array<int>"), "shingles")
    frequency = np.zeros(len(index.keys), np.int64)  # documents per shingle of the items, over the whole corpus
    counts = found.select(F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    for s, n in counts.toLocalIterator():
        frequency[s] = n
    prefix = spark.sparkContext.broadcast(Prefix.of(index, prefix_shingles(index, frequency)))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, inside = sent.value, prefix.value
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, words, starts = batch.column("doc_id"), batch.column("words"), batch.column("shingles").offsets.to_numpy()
            hits, shingles = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("hits", "shingles"))
            flat, cuts = words.flatten().to_numpy().astype(np.int64), words.offsets.to_numpy()
            texts = np.split(flat, cuts[1:-1] - cuts[0])
            pairs = pairs_in(index, inside, starts - starts[0], hits, shingles, texts)
            out = [(docs[d].as_py(), index.item_ids[i], n, size) for d, i, n, size in pairs]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                names=["doc_id", "item_id", "words_held", "item_words"],
            )

    return found.mapInArrow(verified, "doc_id bigint, item_id bigint, words_held int, item_words int")
