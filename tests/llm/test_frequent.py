from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

pytest.importorskip("quadloom.llm")

from quadloom.llm import frequent as Q  # noqa: E402
from quadloom.operators import balanced as B  # noqa: E402

SCHEMA = "statement_id long, subject string, predicate string, object string, object_kind string, asserted_at timestamp_ntz, loaded_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def make(n=3000):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        obj = "http://o/hot" if i % 3 == 0 else f"http://o/{rng.integers(400)}"
        kind = "uri"
        if i % 11 == 0:
            obj, kind = ("Unknown" if i % 2 else "unknown"), "literal"
        row = [i, f"http://s/{rng.integers(200)}", f"http://p/{rng.integers(3)}", obj, kind, T0 + timedelta(minutes=int(rng.integers(10**5))), T0]
        if i % 50 == 0:
            row[1] = None
        if i % 70 == 0:
            row[2], row[3] = None, None
        if i % 90 == 0:
            row[5] = None
        out.append(tuple(row))
    out += [(*r[:6], T0 + timedelta(days=1)) for r in out[:500]]
    out += [(None, "http://s/1", "http://p/0", "http://o/hot", "uri", T0, None)] * 3
    out += [(10**6, "http://s/9", "http://p/1", "<HTTP://O/9>", "uri", T0, T0)] * 200
    return out


def exact(rows, share):
    seen, counts = set(), Counter()
    for i, s, _, o, _, _, _ in rows:
        if i is not None and i in seen:
            continue
        seen.add(i)
        counts["object", "http://o/9" if o == "<HTTP://O/9>" else o] += 1
        counts["subject", s] += 1
    total = len({r[0] for r in rows if r[0] is not None}) + sum(r[0] is None for r in rows)
    return {k: n for k, n in counts.items() if k[1] is not None and n >= share * total}


@pytest.mark.parametrize("buckets,width", [(4096, 1 << 16), (4, 64)])
def test_frequent_values(spark, monkeypatch, buckets, width):
    """Small sketches lose values to the light array; the result stays complete."""
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    monkeypatch.setattr(Q, "WIDTH", width)
    monkeypatch.setattr(B, "block_count", lambda n: max(1, -(-n // 500)))
    rows = make()
    out = Q.frequent_values(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as item"), {}, 0.01).collect()
    assert {(r.item_field, r.item): r.n for r in out} == exact(rows, 0.01)
    assert all(r.estimate >= r.n for r in out)


def test_sketch_bounds():
    s, rng = Q.Sketch(), np.random.default_rng(1)
    truth = Counter()
    for v in rng.zipf(1.3, 20_000):
        truth[str(v)] += 1
        s.add(str(v), 1)
    assert sum(len(b) for b in s.heavy.values()) <= Q.BUCKETS * Q.PLACES
    held = {v: c for b in s.heavy.values() for v, c in b.items()}
    for v, n in truth.most_common(50):
        assert v in held and held[v] <= n
    assert sum(held.values()) + s.light[0].sum() == 20_000


def test_empty(spark):
    assert Q.frequent_values(spark.createDataFrame([], SCHEMA), {}, 0.1).count() == 0


def test_merged_sketches_keep_all_counts(spark, monkeypatch):
    """Merging in several steps and stretches loses no count."""
    monkeypatch.setattr(Q, "PER_SKETCH", 1)
    monkeypatch.setattr(Q, "FAN_IN", 2)
    monkeypatch.setattr(B, "block_count", lambda n: 7)
    rows = make()
    keyed, blocks, total = B.even_rows(spark.createDataFrame(rows, SCHEMA), {})
    got = Q.sketch_rows(keyed.withColumnRenamed("member", "subject"), blocks, ("object", "subject"), 8, 64).collect()
    for field in ("object", "subject"):
        mine = [r for r in got if r.field == field]
        light = sum(int(np.frombuffer(r.data, np.int64).reshape(Q.ROWS, -1)[0].sum()) for r in mine if r.kind == "light")
        nulls = len({r[0] for r in rows if r[3 if field == "object" else 1] is None})
        assert sum(r.n for r in mine if r.kind == "heavy") + light == total - nulls
        assert len({r.value for r in mine if r.kind == "heavy"}) <= 8 * Q.PLACES
