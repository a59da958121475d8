import os
import random
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("quadloom.llm")

from quadloom.llm import subjects as S  # noqa: E402

DOCS, AREAS, LABELS = "doc_id long, text string, lang string", "subject string, covers string", "doc_id long, subject string, annotator string"
WORDS = {"law": "court judge verdict appeal lawyer statute".split(), "sport": "goal match striker league referee coach".split()}


def made(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        mix = rng.choice([["law"], ["sport"], ["law", "sport"]])
        lines = [f"In the end the {rng.choice(WORDS[s])} saw the {rng.choice(WORDS[s])} and the {rng.choice(WORDS[s])} again." for s in mix for _ in range(4)]
        lines += ["This page was seen by many people in the end."] * 3
        rng.shuffle(lines)
        docs.append((i, " ".join(lines), rng.choice(["en", "EN", "en-GB", None])))
        truth[i] = set(mix)
        if i % 4 == 0:
            labels += [(i, f" {s.upper()} ", None) for s in mix]
    return docs, labels, truth


def found(spark, docs, labels, areas=(("law", ""), ("sport", ""))):
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as term", "2 as label", "3 as language")
    out = S.subject_shares(d, spark.createDataFrame(list(areas), AREAS), spark.createDataFrame(labels, LABELS)).collect()
    got = defaultdict(set)
    for r in out:
        if r.share >= S.SHARE:
            got[r.doc_id].add(r.subject)
    return got


def test_two_subjects(spark):
    docs, labels, truth = made()
    extra = [(900, None, "en"), (901, "", "en"), (None, docs[0][1], "en"), (902, "This page was seen by many people in the end.", "en"), (903, "404", None)]
    got = found(spark, docs + extra, labels + labels[:5] + [(1, "none", "x"), (None, "law", "x"), (2, None, "x"), (3, "geometry", "x")])
    assert sum(got[i] == truth[i] for i in truth) >= 0.99 * len(truth)
    assert not {900, 901, 902, 903, None} & set(got)


def test_empty(spark):
    docs, labels, _ = made(40)
    assert not found(spark, [], labels)
    assert not found(spark, docs, [])
    assert not found(spark, docs, labels, areas=())
    assert not found(spark, [(1, None, None), (2, "", None)], labels)


def test_mixture_updates_explain_the_counts():
    rng = np.random.default_rng(0)
    h = rng.random((3, 20))
    h /= h.sum(1, keepdims=True)
    row, term = np.repeat(np.arange(5), 8), np.concatenate([rng.choice(20, 8, replace=False) for _ in range(5)])
    n = rng.integers(1, 5, 40).astype(float)
    mix, part = S.mixtures(h, row, term, n, 5)
    assert np.allclose(mix.sum(1), 1, atol=1e-4) and np.allclose(part.sum(1), n, rtol=1e-3)


def test_sentences():
    text = "One two. Three\nfour!\n\nFive six\n== Head 7 ==\nseven; eight. nine"
    assert [len(s) for s in S.sentences(text)] == [2, 2, 2, 4]
    assert S.sentences(None) == S.sentences("12 34") == []


def test_held_out_labels(spark, data):
    """Fitted on half of the hand labels, the other half is found again as far as its noise allows."""
    folder = os.path.join(os.path.dirname(data), "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no larger tables")
    docs, areas, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "subject_areas", "subject_labels"))
    seen, hidden = labels.where("xxhash64(doc_id) % 2 = 0"), labels.where("xxhash64(doc_id) % 2 <> 0")
    got, want = defaultdict(set), defaultdict(set)
    for r in S.subject_shares(docs, areas, seen).where(f"share >= {S.SHARE}").collect():
        got[r.doc_id].add(r.subject)
    for r in hidden.collect():
        want[r.doc_id].add(r.subject.strip().lower())
    right = sum(got[i] == want[i] - {"none"} for i in want)
    assert right >= 0.8 * len(want), (right, len(want))


def test_terms():
    assert S.terms_of("Internationally") == S.terms_of("international") == ["intern"] and S.terms_of("Été") == ["ete"]
    assert S.terms_of("日本語") == ["日本", "本語"]


def test_rare_terms_and_languages_count(spark):
    """A language of a few documents, in letters without case, is told by its labels like any other."""
    docs, labels, truth = made()
    rare = {"law": "דין שופט משפט פסק תביעה", "sport": "שער משחק ליגה מאמן קבוצה"}
    for k in range(12):
        s = "law" if k % 2 else "sport"
        docs.append((1000 + k, ". ".join(" ".join(random.Random(k * 7 + j).sample(rare[s].split(), 4)) for j in range(5)), "he"))
        truth[1000 + k] = {s}
        if k < 6:
            labels.append((1000 + k, s, None))
    got = found(spark, docs, labels)
    assert all(got[i] == truth[i] for i in range(1000, 1012))


def test_sums_add_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    whole, rows = np.zeros((3, 2 * S.STRETCH + 5)), []
    for part in range(7):
        sums = np.where(rng.random(whole.shape) < 0.01, rng.integers(1, 9, whole.shape), 0).astype(float)
        whole += sums
        rows += [tuple(r.values()) for r in S._sum_rows(sums, part).to_pylist()]
    assert np.array_equal(S.added_up(spark.createDataFrame(rows, S._SUMS), 7, whole.shape), whole)


def test_mixtures_are_taken_on():
    """Updates go on from where they were: twice three steps are six steps."""
    rng = np.random.default_rng(5)
    like, row, n = rng.random((3, 12)).astype(np.float32), np.repeat([0, 2], 6), np.ones(12, np.float32)
    half, _, _ = S.split_counts(like, row, n, 3, steps=3)
    assert np.allclose(S.split_counts(like, row, n, 3, half, 3)[0], S.split_counts(like, row, n, 3, steps=6)[0], atol=1e-5)
    assert np.allclose(half[:, 1], 1 / 3)
