from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from quadloom.operators import balanced as B

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


def brute(rows):
    seen, out = set(), defaultdict(lambda: [0, set(), None, None])
    for i, s, p, o, kind, at, _ in rows:
        if i is not None and i in seen:
            continue
        seen.add(i)
        if o == "<HTTP://O/9>":
            o = "http://o/9"
        for f, k in (("predicate", p), ("object", o)):
            if k is None:
                continue
            x = out[f, k]
            x[0] += 1
            if s is not None:
                x[1].add(s)
            if at is not None:
                x[2] = at if x[2] is None else min(x[2], at)
                x[3] = at if x[3] is None else max(x[3], at)
    return {k: (v[0], len(v[1]), v[2], v[3]) for k, v in out.items()}


@pytest.mark.parametrize("block_rows", [131_072, 100])
def test_key_results(spark, monkeypatch, block_rows):
    monkeypatch.setattr(B, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(B, "block_count", lambda n: max(1, -(-n // block_rows)))
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as key", "3 as id")
    got = {(r.key_field, r.key_value): (r.n, r.subjects, r.first_at, r.last_at) for r in B.key_results(df, {}).collect()}
    assert got == brute(rows)


def test_share(spark):
    rows = make()
    total = len({r[0] for r in rows if r[0] is not None}) + 3
    got = {(r.key_field, r.key_value) for r in B.key_results(spark.createDataFrame(rows, SCHEMA), {}, share=0.02).collect()}
    assert got == {k for k, v in brute(rows).items() if v[0] >= 0.02 * total}


def test_empty(spark):
    assert B.key_results(spark.createDataFrame([], SCHEMA), {}).count() == 0
