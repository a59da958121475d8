"""Closures between all pairs: cycles, blocks of edges, graphs, and as many pairs as there can be."""

import random
import threading

import pytest

from quadloom.functions import terms as T
from quadloom.operators import closures
from quadloom.plans.compiler import Dataset
from quadloom.star import NS, form


def brute(edges):
    found = set(edges)
    while more := {(a, d, g) for a, b, g in found for c, d, h in edges if b == c and g == h} - found:
        found |= more
    return found


def graph(seed, nodes, count):
    rng = random.Random(seed)
    return {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", f"g{rng.randrange(2)}") for _ in range(count)}


def pairs(spark, edges, named, **forms):
    keep = ["s", "o", "g"] if named else ["s", "o"]
    table = spark.createDataFrame(sorted(edges), "s string, o string, g string").select(*keep).distinct()
    return sorted(tuple(r) for r in closures.all_pairs(closures.materialize(table, "edges"), keep, **forms).collect())


@pytest.mark.parametrize("block", [1_000_000, 12, 1])  # in one task, in blocks, and too few a block to contract anything
@pytest.mark.parametrize("count", [20, 60])
def test_pairs_of_graphs(spark, monkeypatch, block, count):
    monkeypatch.setattr(closures, "BLOCK_EDGES", block)
    monkeypatch.setattr(closures, "LIST_MEMBERS", 3)
    edges = graph(count, 20, count) | {("loop", "loop", "g0"), ("loop", "end", "g0")} | {(f"c{i}", f"c{i + 1}", "g1") for i in range(9)}
    assert pairs(spark, edges, True) == sorted(brute(edges))
    merged = {(a, b, "") for a, b, _ in edges}
    assert pairs(spark, merged, False) == sorted((a, b) for a, b, _ in brute(merged))


def test_pairs_of_nothing(spark):
    assert pairs(spark, set(), False) == []


def test_blocks_contract(spark, monkeypatch):
    monkeypatch.setattr(closures, "BLOCK_EDGES", 400)
    edges = closures.materialize(spark.createDataFrame([(f"{a}", f"{b}") for a in range(40) for b in range(40)], "s string, o string"), "edges")
    found = closures.contracted(edges, ["s", "o"])
    assert found.where("list >= 0").select("o").distinct().count() == 1 and found.where("list < 0").count() == 1


def test_forms_of_closures(spark):
    iri = lambda i: T.uri_code(f"{NS['d']}user/{i}")
    quads = spark.createDataFrame([(iri(a), T.uri_code(NS["v"] + "next"), iri(b), None) for a, b in ((1, 2), (2, 1), (2, 3), (3, 4))], "s string, p string, o string, g string")
    data = Dataset(quads, unique=True)
    plus = {(a, b) for a in (1, 2) for b in (1, 2, 3, 4)} | {(3, 4)}
    forms = {"a": form("key"), "b": form("key")}
    ask = lambda text: sorted(tuple(r) for r in data.query(text, NS, forms=forms).collect())
    assert ask("SELECT ?a ?b { ?a v:next+ ?b }") == sorted(plus)
    assert ask("SELECT ?b ?a { ?a v:next+ ?b }") == sorted((b, a) for a, b in plus)
    assert ask("SELECT ?a ?b { ?a v:next* ?b }") == sorted(plus | {(i, i) for i in range(1, 5)})
    assert ask("SELECT ?a ?b { ?a v:next+ ?b } ORDER BY ?a ?b LIMIT 2") == sorted(plus)[:2]
    assert ask("SELECT ?a { ?a v:next+ ?a }") == [(1,), (2,)]
    assert ask("SELECT DISTINCT ?a { ?a v:next+ ?b }") == [(1,), (2,), (3,)]


def test_nearly_all_pairs(spark):
    """Each of 1,500 nodes reaches each by many ways; comparing pairs by the nodes between them would make billions of rows."""
    rng = random.Random(3)
    walk = [f"n{i}" for i in range(1500)] + [f"n{rng.randrange(1500)}" for _ in range(45_000)] + ["n0", "last"]
    edges = closures.materialize(spark.createDataFrame(sorted(set(zip(walk, walk[1:]))), "s string, o string"), "edges")
    quads = edges.selectExpr("'U' || s AS s", "'Unext' AS p", "'U' || o AS o", "cast(null AS string) AS g")
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        found = Dataset(quads, unique=True).query("SELECT ?a ?b { ?a <next>+ ?b }")
        assert found.count() == 1500 * 1501 and found.where("b = 'Ulast'").count() == 1500
    finally:
        late.cancel()


@pytest.mark.parametrize("block", [1_000_000, 12, 1])
def test_loops_of_all_nodes(spark, monkeypatch, block):
    monkeypatch.setattr(closures, "BLOCK_EDGES", block)
    edges = graph(5, 20, 25) | {("loop", "loop", "g0"), ("loop", "end", "g0")}
    nodes = {(n, g) for a, b, g in edges for n in (a, b)} | {("apart", "g0"), ("apart", "g2"), ("end", "g1")}
    loops = spark.createDataFrame([(n, n, g) for n, g in nodes], "s string, o string, g string")
    assert pairs(spark, edges, True, loops=loops) == sorted(brute(edges) | {(n, n, g) for n, g in nodes})


def test_star_compares_no_pairs(spark):
    """Pairs of a node with itself are told by components: no aggregate stands above the lists that are exploded."""
    quads = spark.createDataFrame([("Ua", "Unext", "Ub", None), ("Ub", "Unext", "Ua", None), ("Ub", "Unext", "Uc", None), ("Ux", "Uother", "Uy", None)], "s string, p string, o string, g string")
    found = Dataset(quads, unique=True).query("SELECT ?a ?b { ?a <next>* ?b }")
    assert sorted((a[1:] + b[1:]) for a, b in found.collect()) == ["aa", "ab", "ac", "ba", "bb", "bc", "cc", "xx", "yy"]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")
    assert len(above) > 2 and "Aggregate" not in above[0]
