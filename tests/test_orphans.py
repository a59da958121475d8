from datetime import datetime, timedelta

import pytest

from quadloom.operators import orphans as O

STATEMENTS = "statement_id long, subject string, object string, object_kind string, asserted_at timestamp_ntz"
REGISTRY = "identifier string, rec_type string, registered_at timestamp_ntz, deleted_at timestamp_ntz"
SHARED = "identifier string, term_kind string, label string"
D = lambda n: datetime(2024, 1, 1) + timedelta(days=n)


def found(spark, statements, registry, shared=(), **options):
    out = O.orphans(spark.createDataFrame(statements, STATEMENTS), spark.createDataFrame(registry, REGISTRY), spark.createDataFrame(list(shared), SHARED), {"p": "http://p/"}, **options)
    return {(r.statement_id, r.ref_field): r.orphan_kind for r in out.collect()}


def brute(statements, registry, shared):
    terms = {}
    for k, _, since, until in registry:
        if k and since:
            terms.setdefault(k, []).append((since, until))
    out = {}
    for i, s, o, kind, at in statements:
        for field, key in (("subject", s), ("object", o if kind == "uri" else None)):
            if key is None or key in shared or i is None:
                continue
            if key not in terms:
                out[i, field] = "missing"
            elif at is None or any(a <= at and (b is None or at < b) for a, b in terms[key]):
                continue
            else:
                out[i, field] = "later" if at < min(a for a, _ in terms[key]) else "deleted"
    return out


CASES = [
    (1, "http://k/a", "http://k/none", "uri", D(5)),
    (2, "http://k/a", "text", "literal", D(0)),
    (3, "http://k/a", None, None, D(20)),
    (4, "http://k/a", "http://k/s", "uri", D(40)),
    (5, None, "http://k/a", "uri", D(10)),
    (6, "http://k/a", "http://k/a", "uri", None),
    (7, "http://k/none", None, None, None),
    (None, "http://k/none", None, None, D(1)),
    (8, "_:b1", None, None, D(1)),
    (9, "http://k/nodate", None, None, D(1)),
]
TERMS = [("http://k/a", "entity", D(2), D(10)), ("http://k/a", "entity", D(2), D(10)), ("http://k/a", None, D(30), None), (None, "entity", D(0), None), ("http://k/nodate", "entity", None, None)]
SHARED_TERMS = [("http://k/s", "class", "s"), (None, None, None)]


def test_kinds(spark):
    got = found(spark, CASES * 2, TERMS, SHARED_TERMS)
    assert got == brute(CASES, TERMS, {"http://k/s"})
    assert got[1, "object"] == "missing" and got[2, "subject"] == "later" and got[3, "subject"] == "deleted" and got[5, "object"] == "deleted"
    assert (6, "subject") not in got and got[7, "subject"] == "missing" and got[8, "subject"] == "missing"


def test_spellings(spark):
    assert found(spark, [(1, "<HTTP://P/%61>", "p:a ", "uri", D(1))], [("p:a", "entity", D(0), None)]) == {}


@pytest.mark.parametrize("least,limit", [(O.HEAVY_LEAST, O.TERMS_LIMIT), (3, 1000), (3, 2), (1000, 1)])
def test_splits_agree(spark, monkeypatch, least, limit):
    """Heavy keys by broadcast and keys with many terms by day give what brute force gives."""
    monkeypatch.setattr(O, "HEAVY_LEAST", least)
    import random

    rng = random.Random(4)
    keys = [f"http://k/{i}" for i in range(12)]
    terms = [(rng.choice(keys[:9]), "entity", a := D(rng.randrange(60)) + timedelta(hours=rng.randrange(24)), None if rng.random() < 0.1 else a + timedelta(hours=rng.randrange(1, 300))) for _ in range(40)]
    rows = []
    for i in range(600):
        key = keys[0] if i % 3 == 0 else rng.choice(keys)
        rows.append((i, key, rng.choice(keys), "uri", D(rng.randrange(90)) + timedelta(hours=rng.randrange(24))))
    assert found(spark, rows, terms, heavy_share=1 / 200, terms_limit=limit) == brute(rows, terms, set())


def test_empty_tables(spark):
    assert found(spark, [], TERMS) == {}
    assert found(spark, [(1, "http://k/a", None, None, D(1))], []) == {(1, "subject"): "missing"}


def test_report(spark):
    out = O.orphans(spark.createDataFrame(CASES, STATEMENTS).selectExpr("*", "1 as key", "2 as period", "3 as at"), spark.createDataFrame(TERMS, REGISTRY), spark.createDataFrame(SHARED_TERMS, SHARED), {})
    report = {(r.ref_field, r.rec_type, r.period, r.orphan_kind): r.n for r in O.orphan_counts(out).collect()}
    assert report["subject", "entity", 202401, "later"] == 1 and report["object", "entity", 202401, "deleted"] == 1
    assert sum(report.values()) == len(brute(CASES, TERMS, {"http://k/s"}))
