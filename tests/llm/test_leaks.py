import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("quadloom.llm")

from quadloom.llm import leaks as L  # noqa: E402
from quadloom.llm.words import words_of  # noqa: E402

DOCS, ITEMS = "doc_id long, text string", "item_id long, suite string, text string"
VOCABULARY = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]


def marked(same):
    """Words in some run of RUN or more with at most one in CHANGED changed that starts and ends unchanged, by trying all runs."""
    out = np.zeros(len(same), bool)
    for a in range(len(same)):
        for b in range(a + L.RUN, len(same) + 1):
            if same[a] and same[b - 1] and 10 * (b - a - sum(same[a:b])) <= b - a:
                out[a:b] = True
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 19).map(lambda x: x > 0), max_size=80))
def test_covered(same):
    same = np.array(same, bool)
    assert (L.covered(same) == marked(same)).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 14).map(lambda x: x > 0), max_size=150))
def test_shared_shingles_bound_what_is_covered(same):
    same = np.array(same, bool)
    shared = np.array([same[k : k + L.SHINGLE].all() for k in range(max(0, len(same) - L.SHINGLE + 1))], bool)
    assert L.covered(same).sum() <= L.coverable(shared, len(same))


def test_common_shingles_are_in_no_prefix():
    """A question that all items ask makes no pairs, however many items ask it."""
    rng = random.Random(3)
    question = " ".join(rng.choice(VOCABULARY) for _ in range(20))
    rows = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(70)) + " " + question) for i in range(50)]
    index = L.Index.build(rows)
    inside = L.prefix_shingles(index, np.full(len(index.keys), 7))
    shared = np.diff(index.starts) > 40
    assert shared.sum() == 16 and not inside[shared[index.shingle_of()]].any()
    hit = np.flatnonzero(shared)
    assert not len(L.candidates(index, L.Prefix.of(index, inside), np.zeros(len(hit), np.int64), hit, np.array([500]))[0])


def brute(docs, items):
    """All pairs, all offsets, no filter."""
    out = set()
    for d, text in docs:
        doc = words_of(text)
        for i, _, other in items:
            item = words_of(other)
            seen = np.zeros(len(item), bool)
            for offset in range(-len(item), len(doc)):
                low, high = max(0, -offset), min(len(item), len(doc) - offset)
                if high - low >= L.RUN:
                    seen[low:high] |= marked(np.array([item[k] == doc[k + offset] for k in range(low, high)]))
            if d is not None and i is not None and len(item) and seen.sum() * 2 >= len(item):
                out.add((d, i))
    return out


def cases():
    rng = random.Random(5)
    words = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(i, "s", " ".join(words(n))) for i, n in enumerate((40, 60, 80, 12, 8))] + [(9, None, None), (None, "s", "a b c"), (10, "s", "")]
    docs = []
    for i, (_, _, text) in enumerate(items[:5]):
        item = text.split()
        n = len(item)
        changed = [w if k % 10 != 5 else "changed" for k, w in enumerate(item)]
        many = [w if k % 5 != 2 else "changed" for k, w in enumerate(item)]
        docs += [
            words(30) + item + words(20),
            item[: n // 2],
            item[: n // 2 - 1],
            item[: n // 2 - 3] + words(9),
            changed,
            many,
            words(5) + item[: n // 4] + words(9) + item[n // 2 : n // 2 + n // 4 + 1],
            item[n // 2 :] + words(3) + item[: n // 2],
            [w for k, w in enumerate(item) if k % 12 != 11],
        ]
    docs = [(i, " ".join(d).upper()) for i, d in enumerate(docs)] + [(900, None), (901, ""), (None, items[0][2]), (902, "<p>" + items[0][2] + "</p>"), (0, "other text")]
    return docs, items


@pytest.mark.parametrize("index_words", [L.INDEX_WORDS, 60])
def test_pairs_match_brute_force(spark, index_words):
    docs, items = cases()
    d = spark.createDataFrame(docs * 2, DOCS).selectExpr("*", "1 as words", "2 as hits", "3 as item_id")
    out = L.leaked_items(d, spark.createDataFrame(items * 2, ITEMS), index_words).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert got == brute(docs, items) and len(out) == len(got) and len(got) > 20


def test_the_prefix_loses_nothing(spark, data):
    """On real texts the result is the same with every shingle as a candidate."""
    d, i = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    with_prefix = {(r.doc_id, r.item_id): r.words_held for r in L.leaked_items(d, i).collect()}
    rows = [(r.item_id, r.text) for r in i.collect()]
    index = L.Index.build(rows)
    every = {}
    number = L.Numbered(index.numbers)
    for r in d.collect():
        ids = np.array(number(r.text), np.int64)
        hits, shingles = index.find(L.shingle_hashes(ids))
        for item in {int(index.of_item[k]) for s in shingles for k in range(index.starts[s], index.starts[s + 1])}:
            offsets = {int(h - index.positions[k]) for h, s in zip(hits, shingles) for k in range(index.starts[s], index.starts[s + 1]) if index.of_item[k] == item}
            n = L.held(index.items[item], ids, np.array(sorted(offsets)))
            if n >= L.SHARE * len(index.items[item]):
                every[r.doc_id, index.item_ids[item]] = n
    assert with_prefix == every


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], ITEMS)
    assert L.leaked_items(docs, items).count() == 0
    assert L.leaked_items(docs.limit(0), spark.createDataFrame([(1, "s", "a b c d e f g h i")], ITEMS)).count() == 0
    assert L.leaked_items(docs, spark.createDataFrame([(1, "s", "a b"), (2, "s", " ")], ITEMS)).count() == 0


def test_a_very_long_text(spark):
    docs, items = cases()
    long = " ".join(VOCABULARY * 3000) + " " + items[2][2]
    out = L.leaked_items(spark.createDataFrame([(1, long)], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in out} >= {(1, 2)}
