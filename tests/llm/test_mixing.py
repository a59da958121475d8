import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("quadloom.llm")

from quadloom.llm import mixing as M  # noqa: E402

DOCS, TARGETS = "doc_id long, text string, source string", "source string, target_share double, max_repeats int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), max_size=60), st.integers(0, 2**31))
def test_flight_keeps_its_sums(units, seed):
    p, t = np.array([u[0] for u in units], float), np.array([u[1] for u in units], float)
    out = M.flight(p, t, np.random.default_rng(seed))
    assert ((out >= 0) & (out <= 1)).all()
    assert sum(M.SETTLED < x < 1 - M.SETTLED for x in out) <= 2
    assert abs(out.sum() - p.sum()) < 1e-5 and abs((out * t).sum() - (p * t).sum()) < 1e-2


def test_each_unit_keeps_its_chance():
    t = np.array([3.0, 5, 8, 13, 21, 34, 2, 2])
    p = np.array([0.3, 0.3, 0.3, 0.3, 0.7, 0.7, 0.5, 0.9])
    runs = [M.landing(M.flight(p, t, rng), rng) for rng in map(np.random.default_rng, range(4000))]
    assert np.abs(np.mean(runs, 0) - p).max() < 0.04
    assert set(np.unique(runs)) <= {0.0, 1.0}


def docs_of(n=3000):
    rng = np.random.default_rng(2)
    words = ["court", "market", "goal", "science", "music"]
    sources = ["Big ", "big", "small", "none", None, "outside"]
    out = []
    for i in range(n):
        source = "BIG" if i % 3 == 0 else sources[int(rng.integers(len(sources)))]
        out.append((i, " ".join(rng.choice(words, int(rng.integers(0, 60)))), source))
    return out + [(None, "no id", "big"), (n + 1, None, "small"), (n + 2, "", "small")]


def test_report_and_draw(spark, monkeypatch):
    monkeypatch.setattr(M, "FLIGHT", 64)  # several levels
    targets = [(" Big", 0.2, 1), ("big", 0.9, 9), ("small", 0.15, 2), ("none", 0.5, 1), ("void", 0.05, 3), ("zero", None, None), (None, 0.1, 1)]
    d = spark.createDataFrame(docs_of(), DOCS).selectExpr("*", "1 as label", "2 as tokens", "3 as p", "4 as block")
    draw, report = M.mix(d, spark.createDataFrame(targets, TARGETS))
    rows = {r.source: r for r in report.collect()}
    total = sum(r[0] for r in M.with_tokens(d).select("tokens").collect())
    assert set(rows) == {" Big", "small", "none", "void", "zero"}
    assert not rows["none"].reachable and not rows["void"].reachable and rows[" Big"].reachable and rows["zero"].reachable
    assert rows["void"].documents == 0 and rows["zero"].drawn_tokens == 0
    for name in (" Big", "small"):
        assert abs(rows[name].drawn_tokens - rows[name].target_share * total) <= 120
    assert rows["none"].drawn_tokens == rows["none"].source_tokens
    drawn = draw.collect()
    repeats = {" Big": 1, "small": 2, "none": 1}
    assert all(1 <= r.copies <= repeats[r.source] for r in drawn) and len({r.doc_id for r in drawn}) == len(drawn)
    assert abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9
    again = M.mix(d.repartition(7), spark.createDataFrame(targets, TARGETS))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn))  # the partitioning changes nothing


def test_empty(spark):
    none, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 0.5, 1)], TARGETS)
    draw, report = M.mix(none, targets)
    assert draw.count() == 0 and [(r.source, r.drawn_tokens) for r in report.collect()] == [("a", 0)]
    draw, report = M.mix(spark.createDataFrame([(1, "x", "a")], DOCS), targets.limit(0))
    assert draw.count() == 0 and report.count() == 0


def test_tokens(spark):
    texts = [(1, "Hello world, 2024!", "a"), (2, None, "a"), (3, "", None), (4, "é" * 50_000, "a"), (5, "<|endoftext|>", "a")]
    got = {r.doc_id: r.tokens for r in M.with_tokens(spark.createDataFrame(texts, DOCS)).collect()}
    assert got[2] == got[3] == 0 and got[5] > 1
    other = pytest.importorskip("tokenizers").Tokenizer.from_file(M.TOKENIZER.replace(".tiktoken", ".json"))  # the same vocabulary
    other.encode_special_tokens = True
    assert all(got[i] == len(other.encode(t, add_special_tokens=False).ids) for i, t, _ in texts if t)
