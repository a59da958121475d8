"""All pairs of a graph joined by one or more edges.

Nodes that reach each other reach the same, so they are contracted first; pairs are found between what is left, which has no
cycles, and those of the members are made last, from lists of members, without a comparison between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, release

#: Edges that one task contracts, held in memory.
BLOCK_EDGES = 1_000_000
#: Members in one list; pairs of lists are the units of the result.
LIST_MEMBERS = 512
#: Pairs that one task of the result makes on average.
TASK_PAIRS = 2_000_000
_OUT_ROWS = 65_536


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the number of its component, in which all nodes reach each other (Tarjan, without recursion)."""
    order = np.argsort(src, kind="stable")
    heads = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    to = dst[order].tolist()
    at, number, low, component = heads[:-1], [0] * n, [0] * n, [-1] * n
    open_nodes: list[int] = []
    count = found = 0
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        open_nodes.append(root)
        trail = [root]
        while trail:
            v = trail[-1]
            i = at[v]
            if i < heads[v + 1]:
                at[v] = i + 1
                w = to[i]
                if not number[w]:
                    count += 1
                    number[w] = low[w] = count
                    open_nodes.append(w)
                    trail.append(w)
                elif component[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
                continue
            trail.pop()
            if trail and low[v] < low[trail[-1]]:
                low[trail[-1]] = low[v]
            if low[v] == number[v]:
                w = -1
                while w != v:
                    w = open_nodes.pop()
                    component[w] = found
                found += 1
    return np.array(component, np.int64)


def _contraction(named: bool, last: bool):
    """Contracts the edges of a task. ``last``: gives members in numbered lists, and the edges between components (list -1);
    else fewer edges with the same closure: from each member to one of its component and back, and those between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict = {}
        ends: tuple[list, list] = ([], [])
        for batch in batches:
            for column, held in zip(("s", "o"), ends):
                keys = batch.column(column).to_pylist()
                if named:
                    keys = zip(keys, batch.column("g").to_pylist())
                held.append(np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64))
        if not numbers:
            return
        n, nodes = len(numbers), list(numbers)
        src, dst = (np.concatenate(x) for x in ends)
        component = strong_components(n, src, dst)
        by_component = np.argsort(component, kind="stable")
        starts = np.searchsorted(component[by_component], np.arange(component.max() + 1))
        chief = by_component[starts]
        own = chief[component]
        a, b = own[src], own[dst]
        alone = np.bincount(component, minlength=len(chief)) == 1
        between = np.unique(np.stack([a, b], 1)[(a != b) | alone[component[src]]], axis=0)  # a node alone has a pair with itself only by an edge
        members = by_component[by_component != own[by_component]]
        if last:
            place = np.arange(n) - starts[component[by_component]]
            round_trip = chief[~alone]
            parts = [
                (place // LIST_MEMBERS, by_component, own[by_component]),
                (np.full(len(between), -1), between[:, 0], between[:, 1]),
                (np.full(len(round_trip), -1), round_trip, round_trip),
            ]
        else:
            parts = [(np.full(len(x), -1), x, y) for x, y in ((members, own[members]), (own[members], members), (between[:, 0], between[:, 1]))]
        for lists, x, y in parts:
            for i in range(0, len(x), _OUT_ROWS):
                left, right = ([nodes[k] for k in z[i : i + _OUT_ROWS].tolist()] for z in (x, y))
                cols = [pa.array(lists[i : i + _OUT_ROWS], pa.int32())]
                if named:
                    cols += [pa.array([k[0] for k in z], pa.string()) for z in (left, right)] + [pa.array([k[1] for k in left], pa.string())]
                else:
                    cols += [pa.array(z, pa.string()) for z in (left, right)]
                yield pa.RecordBatch.from_arrays(cols, ["list", "s", "o"] + ["g"] * named)

    return run


def contracted(edges: DataFrame, keep: list[str]) -> DataFrame | None:
    """Rows (list, s, o[, g]): members s of the component of o in lists numbered from 0, and at -1 the edges between components.

    Edges that are too many for one task are contracted in blocks, round by round. None where blocks no longer get much smaller.
    """
    named = len(keep) > 2
    schema = "list int, s string, o string" + ", g string" * named
    count, held = edges.count(), None
    while count > BLOCK_EDGES:
        parts = -(-count // BLOCK_EDGES)
        fewer = materialize(edges.repartition(parts, *keep).mapInArrow(_contraction(named, False), schema).select(*keep).distinct(), "contracted")
        if held is not None:
            release(held)
        edges = held = fewer
        before, count = count, fewer.count()
        if count > BLOCK_EDGES and count > 0.9 * before:
            release(held)
            return None
    out = materialize(edges.coalesce(1).mapInArrow(_contraction(named, True), schema), "components")
    if held is not None:
        release(held)
    return out


def _joined(first: DataFrame, second: DataFrame, keep: list[str]) -> DataFrame:
    second = second.withColumnRenamed("s", "mid").withColumnRenamed("o", "end")
    return first.withColumnRenamed("o", "mid").join(second, ["mid"] + keep[2:]).select("s", F.col("end").alias("o"), *keep[2:]).distinct()


def acyclic_pairs(edges: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs joined by one or more edges of a graph without cycles.

    After k rounds, ``seen`` has the pairs with a path of at most 2^k edges and ``exact`` those with one of just 2^k; the
    next lengths are one of these and then any known.
    """
    seen = exact = edges
    while exact.take(1):
        grown = materialize(seen.unionByName(_joined(exact, seen, keep)).distinct(), "closure")
        twice = materialize(_joined(exact, exact, keep), "closure")
        for old in (seen, exact):
            release(old)
        seen, exact = grown, twice
    return seen


def rounds(edges: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs joined by one or more edges of any graph: the newest pairs by all known, without those seen before."""
    seen = frontier = edges
    while True:
        fresh = materialize(_joined(frontier, seen, keep).join(seen, keep, "left_anti"), "closure")
        if not fresh.take(1):
            return seen
        grown = materialize(seen.unionByName(fresh), "closure")
        for old in (seen, frontier):
            release(old)
        seen, frontier = grown, fresh


def all_pairs(edges: DataFrame, keep: list[str], loops: DataFrame | None = None, forms: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Distinct pairs joined by one or more of the distinct ``edges`` (s, o[, g], written), within each g.

    With distinct ``loops``, pairs of a node with itself that has all nodes of the edges at least, these are pairs too.
    ``forms`` are functions of s and of o whose values the result has in their place; they are computed once a member.
    """
    form = lambda name, c: forms[name](c) if forms and name in forms else c
    found = contracted(edges, keep)
    formed = lambda df: df.select(*[form(c, F.col(c)).alias(c) for c in keep])
    if found is None:
        pairs = rounds(edges, keep)
        return formed(pairs if loops is None else pairs.unionByName(loops).distinct())
    graph = keep[2:]
    links = found.where("list < 0").select(*keep)
    # with loops, each component reaches itself, also one of a single node
    themselves = links.where("s = o") if loops is None else found.where("list >= 0").select(F.col("o").alias("s"), "o", *graph).distinct()
    reached = acyclic_pairs(links.where("s != o"), keep).unionByName(themselves)
    lists = found.where("list >= 0").groupBy("o", "list", *graph).agg(F.collect_list("s").alias("members"))
    sources = lists.select(F.col("o").alias("s"), F.transform("members", lambda m: form("s", m)).alias("sources"), *graph)
    targets = lists.select("o", F.transform("members", lambda m: form("o", m)).alias("targets"), *graph)
    units = materialize(reached.join(sources, ["s"] + graph).join(targets, ["o"] + graph).select("sources", "targets", *graph), "units")
    pairs = units.agg(F.sum(F.size("sources").cast("bigint") * F.size("targets"))).first()[0] or 0
    spread = units.repartition(max(1, -(-pairs // TASK_PAIRS)))
    out = spread.select(F.explode("sources").alias("s"), "targets", *graph).select("s", F.explode("targets").alias("o"), *graph)
    if loops is None:
        return out
    return out.unionByName(formed(loops.join(found.where("list >= 0").select("s", *graph), ["s"] + graph, "left_anti").select(*keep)))
