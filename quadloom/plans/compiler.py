"""Algebra to DataFrames.

A solution sequence is a DataFrame with one term column per variable; unbound is null. For each variable the compiler knows
whether it is bound in every row: shared variables that are become equi-join keys, others are matched as compatible.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators.closures import all_pairs
from ..runtime import materialize
from .algebra import Bgp, Call, Extend, Filter, Graph, Join, LeftJoin, Minus, Path, Query, Term, Triple, Union, Values, Var, with_terms
from .expressions import Evaluator, as_number, as_str, quotient
from .parser import SparqlError, is_aggregate, parse


@dataclass
class Solutions:
    df: DataFrame
    vars: dict[str, bool]  # name -> bound in every row

    def col(self, name: str) -> Column | None:
        return F.col(f"`{name}`") if name in self.vars else None


class Dataset:
    """Quads (s, p, o, g), all terms but ``g``, which may be null. The default graph is the merge of all graphs.

    ``unique`` tells that no triple is in two graphs, which spares a deduplication. With ``rewrite`` (outside, inside), IRIs
    that begin with ``outside`` in queries and results begin with ``inside`` in the quads.
    """

    def __init__(self, quads: DataFrame, unique: bool = False, functions: dict[str, Callable] | None = None, rewrite: tuple[str, str] | None = None) -> None:
        self.quads, self.unique, self.functions, self.rewrite = quads, unique, functions or {}, rewrite
        self.spark: SparkSession = quads.sparkSession

    def query(self, text: str, namespaces: dict[str, str] | None = None, bindings: dict[str, str] | None = None, arguments: list[str] | None = None, forms: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
        """Solutions of a SELECT, triples of a CONSTRUCT or DESCRIBE, one boolean of an ASK.

        ``bindings`` pre-binds variables; ``arguments`` are terms for the ``$$`` places of the text, one for each. ``forms``
        are functions of the terms of some variables of a SELECT, whose values it gives in place of the terms.
        """
        q = parse(text, namespaces, arguments)
        formed = lambda df: df.select(*[(forms or {}).get(c, lambda x: x)(F.col(f"`{c}`")).alias(c) for c in df.columns]) if forms else df
        if self.rewrite is None:
            compiler = Compiler(self, bindings or {})
            out = compiler.closed(q, forms) if forms else None
            return formed(compiler.run(q)) if out is None else out
        outside, inside = ("U" + x for x in self.rewrite)
        swap = lambda code: inside + code[len(outside) :] if code.startswith(outside) else code
        out = Compiler(self, {k: swap(v) for k, v in (bindings or {}).items()}).run(with_terms(q, swap))
        back = lambda c: F.when(F.col(f"`{c}`").startswith(inside), F.concat(F.lit(outside), F.col(f"`{c}`").substr(F.lit(len(inside) + 1), F.length(f"`{c}`")))).otherwise(F.col(f"`{c}`")).alias(c)
        return formed(out.select(*[back(c) if kind == "string" else F.col(f"`{c}`") for c, kind in out.dtypes]))


def _conjuncts(e: object) -> list:
    return _conjuncts(e.args[0]) + _conjuncts(e.args[1]) if isinstance(e, Call) and e.op == "&&" else [e]


def _variables(e: object) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set() if e.op == "EXISTS" else {v for a in e.args for v in _variables(a)}
    return set()


class Compiler:
    def __init__(self, data: Dataset, bindings: dict[str, str]) -> None:
        self.data, self.spark, self.bindings = data, data.spark, bindings
        self.quads, self.unique = data.quads, data.unique
        self.named: DataFrame = data.quads
        self.outer: Solutions | None = None  # what the conditions inside of an EXISTS can see of the outside
        self.count = 0
        self.forms: dict[str, Callable[[Column], Column]] = {}  # of the ends of the path that is compiled next

    def temp(self) -> str:
        self.count += 1
        return f".t{self.count}"

    # forms
    def run(self, q: Query) -> DataFrame:
        if q.form == "select":
            return self.select(q).df
        if q.form == "ask":
            found = self.select(q).df.limit(1)
            return found.agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.form == "construct":
            return self.construct(q.template, self.select(q))
        return self.describe(q)

    def closed(self, q: Query, forms: dict[str, Callable[[Column], Column]]) -> DataFrame | None:
        """The solutions of a query that is one closure between two variables, each term formed once and not in every pair; None for others."""
        t = q.body.triples[0] if isinstance(q.body, Bgp) and len(q.body.triples) == 1 else None
        if t is None or not isinstance(t.p, Path) or t.p.op not in ("plus", "star") or q != Query("select", q.body, q.select, graphs=q.graphs, named=q.named):
            return None
        ends = [n.name for n in (t.s, t.o) if isinstance(n, Var) and n.name not in self.bindings]
        shown = [v for v, e in q.select or [] if e == Var(v)]
        if len(shown) != len(q.select or []) or len(set(ends)) != 2 or sorted(shown) != sorted(ends):
            return None
        self.dataset(q)
        self.forms = {place: forms[v] for place, v in zip("so", ends) if v in forms}
        return self.pattern(q.body, None).df.select(*[F.col(f"`{v}`") for v in shown])

    def dataset(self, q: Query) -> None:
        """FROM makes the default graph, FROM NAMED the graphs to choose from; with one of them the other is empty."""
        if q.graphs or q.named:
            g = F.col("g")
            self.quads = self.data.quads.where(g.isin(q.graphs) if q.graphs else F.lit(False))
            self.named = self.data.quads.where(g.isin(q.named) if q.named else F.lit(False))

    def select(self, q: Query) -> Solutions:
        self.dataset(q)
        s = self.pattern(q.body, None)
        if q.values:
            s = self.join(s, self.values(q.values))
        aggregated = q.grouped or any(is_aggregate(e) for _, e in q.select or []) or any(map(is_aggregate, q.having))
        replaced: dict[int, str] = {}
        if aggregated:
            s, replaced = self.aggregate(q, s)
        ev = self.evaluator(s, replaced)
        for h in q.having:
            s = Solutions(s.df.where(ev.boolean(h)), s.vars)
        out = q.select
        if out is None or q.form != "select":
            out = [(v, Var(v)) for v in s.vars if not v.startswith(".")]
        for name, e in out:
            if not (isinstance(e, Var) and e.name == name):
                s = Solutions(s.df.withColumn(name, self.evaluator(s, replaced).term(e)), s.vars | {name: False})
        names = list(dict.fromkeys(n for n, _ in out))
        shown = [s.col(n).alias(n) if n in s.vars else F.lit(self.bindings.get(n)).cast("string").alias(n) for n in names]
        if not q.order:
            df = s.df.select(*shown)
            df = df.distinct() if q.distinct else df
        else:
            ev = self.evaluator(s, replaced)
            marks = [self.temp() for _ in q.order]
            df = s.df.select(*shown, *[T.order_key(ev.term(e)).alias(m) for m, (e, _) in zip(marks, q.order)])
            if q.distinct:  # equal solutions have the place of the first of them
                df = df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*[(F.min if up else F.max)(F.col(f"`{m}`")).alias(m) for m, (_, up) in zip(marks, q.order)])
            df = df.orderBy(*[F.col(f"`{m}`").asc() if up else F.col(f"`{m}`").desc() for m, (_, up) in zip(marks, q.order)]).drop(*marks)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, {n: s.vars.get(n, False) for n in names})

    def aggregate(self, q: Query, s: Solutions) -> tuple[Solutions, dict[int, str]]:
        for name, e in q.group:
            if not (isinstance(e, Var) and e.name == name):
                s = Solutions(s.df.withColumn(name, self.evaluator(s).term(e)), s.vars | {name: False})
        calls: list[Call] = []

        def gather(e: object) -> None:
            if isinstance(e, Call):
                if e.op in ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"):
                    calls.append(e)
                elif e.op != "EXISTS":
                    for a in e.args:
                        gather(a)

        for e in [e for _, e in q.select or []] + q.having + [e for e, _ in q.order]:
            gather(e)
        keys = [n for n, _ in q.group]
        ev = self.evaluator(s)
        aggs, replaced = [], {}
        for call in calls:
            name = self.temp()
            replaced[id(call)] = name
            aggs.append(self.aggregate_column(call, ev, s).alias(name))
        known = [k for k in keys if k in s.vars]
        grouped = s.df.groupBy(*[s.col(k) for k in known])
        df = grouped.agg(*aggs) if aggs else s.df.select(*[s.col(k) for k in known]).distinct()
        for k in keys:
            if k not in s.vars:
                df = df.withColumn(k, F.lit(None).cast("string"))
        kept = {k: s.vars.get(k, False) for k in keys}
        return Solutions(df, kept | {n: False for n in replaced.values()}), replaced

    def aggregate_column(self, call: Call, ev: Evaluator, s: Solutions) -> Column:
        integer = lambda c: T.literal(c, T.XSD + "integer")
        if call.op == "COUNT" and not call.args:
            rows = F.struct(*[s.col(v) for v in s.vars]) if call.distinct and s.vars else F.lit(1)
            return integer(F.count_distinct(rows) if call.distinct else F.count(rows))
        v = ev.value(call.args[0])
        term = ev.term(call.args[0])
        if call.op == "COUNT":
            return integer(F.count_distinct(term) if call.distinct else F.count(term))
        if call.op in ("MIN", "MAX"):
            pick = F.min_by if call.op == "MIN" else F.max_by
            return pick(term, F.when(term.isNotNull(), T.order_key(term)))
        if call.op == "SAMPLE":
            return F.min(term)
        if call.op == "GROUP_CONCAT":
            sep = " " if call.extra is None else call.extra
            gathered = F.collect_set(as_str(v)) if call.distinct else F.collect_list(as_str(v))
            return T.literal(F.array_join(F.sort_array(gathered), sep))
        num = as_number(v)
        failed = F.count(F.when(term.isNotNull() & num.col.isNull(), 1)) > 0
        level = F.coalesce(F.max(num.level), F.lit(0))
        if call.distinct:
            n, exact, rough = F.count_distinct(num.col), F.sum_distinct(num.exact), F.sum_distinct(num.col)
        else:
            n, exact, rough = F.count(num.col), F.try_sum(num.exact), F.sum(num.col)
        if call.op == "AVG":
            exact, rough = quotient(exact.try_cast(T.DECIMAL), n.cast(T.DECIMAL)), F.try_divide(rough, n)
            level = F.when(n > 0, F.greatest(level, F.lit(1))).otherwise(0)
        zero = F.lit(0).cast(T.DECIMAL)
        exact = F.when(n == 0, zero).otherwise(exact.try_cast(T.DECIMAL))
        return F.when(~failed, T.number_literal(exact, rough, level))

    def construct(self, template: list[Triple], s: Solutions) -> DataFrame:
        parts = []
        df = s.df
        hidden = {n.name for t in template for n in (t.s, t.p, t.o) if isinstance(n, Var) and n.name.startswith(".") and n.name not in s.vars}
        if hidden:
            row = F.md5(F.concat_ws("\x02", *[F.coalesce(s.col(v), F.lit("")) for v in s.vars]))
            for h in sorted(hidden):
                df = df.withColumn(h, F.concat(F.lit("B"), row, F.lit(h.replace(".", "_").replace(":", "_"))))
        for t in template:
            cols = [F.lit(n.code) if isinstance(n, Term) else F.col(f"`{n.name}`") if n.name in s.vars or n.name in hidden else F.lit(None).cast("string") for n in (t.s, t.p, t.o)]
            parts.append(df.select(*[c.alias(n) for c, n in zip(cols, "spo")]).where("s is not null and p is not null and o is not null").where(~T.is_literal(F.col("s")) & T.is_uri(F.col("p"))))
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def describe(self, q: Query) -> DataFrame:
        """Triples with a described node as subject or object, and those of the blank nodes they lead to."""
        s = self.select(q)
        nodes = None
        wanted = q.describe or [Var(v) for v in s.vars]
        for n in wanted:
            part = self.spark.createDataFrame([(n.code,)], "n string") if isinstance(n, Term) else s.df.select(s.col(n.name).alias("n")).where("n is not null")
            nodes = part if nodes is None else nodes.unionByName(part)
        triples = self.triples()
        seen = materialize(nodes.distinct(), "described")
        out = triples.join(seen, F.col("s") == F.col("n"), "left_semi").unionByName(triples.join(seen, F.col("o") == F.col("n"), "left_semi")).distinct()
        frontier = seen
        while True:
            reached = triples.join(frontier, F.col("s") == F.col("n"), "left_semi").where(T.is_bnode(F.col("o"))).select(F.col("o").alias("n")).distinct()
            frontier = materialize(reached.join(seen, "n", "left_anti"), "described")
            if not frontier.take(1):
                return out.unionByName(triples.join(seen, F.col("s") == F.col("n"), "left_semi")).distinct()
            seen = seen.unionByName(frontier)

    # patterns
    def triples(self) -> DataFrame:
        t = self.quads.select("s", "p", "o")
        return t if self.unique else t.distinct()

    def evaluator(self, s: Solutions, replaced: dict[int, str] | None = None) -> Evaluator:
        ev = Evaluator(lambda n: self.known(s, n), None, self.data.functions)
        if replaced:
            plain = ev.value
            ev.value = lambda e: plain(Var(replaced[id(e)])) if id(e) in replaced else plain(e)
        return ev

    def pattern(self, node: object, graph: Term | Var | None) -> Solutions:
        if isinstance(node, Bgp):
            return self.bgp(node.triples, graph)
        if isinstance(node, Query):
            inner = Compiler(self.data, self.bindings)
            inner.quads, inner.unique, inner.named = self.quads, self.unique, self.named
            return inner.select(node)
        if isinstance(node, Join):
            return self.join(self.pattern(node.left, graph), self.pattern(node.right, graph))
        if isinstance(node, LeftJoin):
            return self.left_join(self.pattern(node.left, graph), self.pattern(node.right, graph), node.on)
        if isinstance(node, Union):
            return self.union(self.pattern(node.left, graph), self.pattern(node.right, graph))
        if isinstance(node, Minus):
            return self.minus(self.pattern(node.left, graph), self.pattern(node.right, graph))
        if isinstance(node, Filter):
            return self.filter(self.pattern(node.body, graph), node.condition, graph)
        if isinstance(node, Extend):
            s = self.seeing(self.pattern(node.body, graph), _variables(node.expr))
            return Solutions(s.df.withColumn(node.var, self.evaluator(s).term(node.expr)), s.vars | {node.var: isinstance(node.expr, Term)})
        if isinstance(node, Values):
            return self.values(node)
        if isinstance(node, Graph):
            return self.pattern(node.body, node.name)
        raise SparqlError(f"unknown pattern {node!r}")

    def values(self, v: Values) -> Solutions:
        if not v.names:
            return Solutions(self.spark.range(len(v.rows)).select(), {})
        df = self.spark.createDataFrame(v.rows, ", ".join(f"`{n}` string" for n in v.names))
        return Solutions(df, {n: all(r[i] is not None for r in v.rows) for i, n in enumerate(v.names)})

    def bgp(self, triples: list[Triple], graph: Term | Var | None) -> Solutions:
        rest = list(triples)
        if not rest:
            return self.values(Values([], [[]]))

        def names(t: Triple) -> set[str]:
            return {n.name for n in (t.s, t.p, t.o) if isinstance(n, Var)}

        def weight(t: Triple) -> tuple:
            return (isinstance(t.p, Path), -sum(isinstance(n, Term) for n in (t.s, t.o)), -isinstance(t.p, Term))

        first = min(rest, key=weight)
        rest.remove(first)
        s, seen = self.triple(first, graph), names(first)
        while rest:  # keep the joins connected where the pattern is
            near = [t for t in rest if names(t) & seen] or rest
            t = min(near, key=weight)
            rest.remove(t)
            s, seen = self.join(s, self.triple(t, graph)), seen | names(t)
        return s

    def triple(self, t: Triple, graph: Term | Var | None) -> Solutions:
        def node(n):
            return Term(self.bindings[n.name]) if isinstance(n, Var) and n.name in self.bindings else n

        s, p, o = node(t.s), t.p if isinstance(t.p, Path) else node(t.p), node(t.o)
        if isinstance(p, Path):
            edges = self.path(p, graph, s, o)
            return self.matched(edges, {"s": s, "o": o}, graph)
        if graph is None:
            source = self.quads
            wanted = {"s": s, "p": p, "o": o}
            constant = [n for n, x in wanted.items() if isinstance(x, Term)]
            out = self.matched(source, wanted, None)
            # the default graph merges graphs: a triple counts once
            if self.unique:
                return out
            filtered = source
            for n in constant:
                filtered = filtered.where(F.col(n) == F.lit(wanted[n].code))
            return self.matched(filtered.select("s", "p", "o").distinct(), {n: x for n, x in wanted.items() if n not in constant}, None)
        return self.matched(self.named.where("g is not null"), {"s": s, "p": p, "o": o, "g": node(graph)}, None)

    def matched(self, df: DataFrame, wanted: dict, graph: Term | Var | None) -> Solutions:
        if graph is not None and "g" in df.columns:
            wanted = wanted | {"g": graph}
        first: dict[str, str] = {}
        for name, n in wanted.items():
            if isinstance(n, Term):
                df = df.where(F.col(name) == F.lit(n.code))
            elif n.name in first:
                df = df.where(F.col(name) == F.col(first[n.name]))
            else:
                first[n.name] = name
        return Solutions(df.select(*[F.col(c).alias(v) for v, c in first.items()]), {v: True for v in first})

    def renamed(self, b: Solutions, shared: list[str]) -> tuple[DataFrame, dict[str, str]]:
        new = {v: self.temp() for v in shared}
        return b.df.select(*[b.col(v).alias(new.get(v, v)) for v in b.vars]), new

    def matching(self, a: Solutions, b: Solutions, shared: list[str], new: dict[str, str]) -> Column | None:
        on = None
        for v in shared:
            x, y = F.col(f"`{v}`"), F.col(f"`{new[v]}`")
            one = x == y
            if not a.vars[v]:
                one = one | x.isNull()
            if not b.vars[v]:
                one = one | y.isNull()
            on = one if on is None else on & one
        return on

    def join(self, a: Solutions, b: Solutions) -> Solutions:
        shared = [v for v in a.vars if v in b.vars]
        if not shared:
            if not a.vars or not b.vars:  # the unit, or nothing
                return Solutions(a.df.join(b.df), a.vars | b.vars)
            return Solutions(a.df.crossJoin(b.df), a.vars | b.vars)
        if all(a.vars[v] and b.vars[v] for v in shared):
            return Solutions(a.df.join(b.df, shared), a.vars | b.vars)
        loose = [v for v in shared if not (a.vars[v] and b.vars[v])]
        if len(loose) < len(shared):  # some variable is a key: the others are tested on its matches
            right, new = self.renamed(b, shared)
            df = a.df.join(right, self.matching(a, b, shared, new))
            return self.merged(a, b, df, shared, new)
        v = loose[0]  # rows that bind it meet by equality, rows that don't meet all
        parts = []
        both = lambda s, bound: Solutions(s.df.where(s.col(v).isNotNull() if bound else s.col(v).isNull()), s.vars | {v: bound})
        parts.append(self.join(both(a, True), both(b, True)))
        drop = lambda s: Solutions(s.df.drop(v), {k: x for k, x in s.vars.items() if k != v})
        if not a.vars[v]:
            parts.append(self.join(drop(both(a, False)), b))
        if not b.vars[v]:
            parts.append(self.join(both(a, True), drop(both(b, False))))
        out = parts[0]
        for p in parts[1:]:
            out = self.union(out, p)
        return Solutions(out.df, out.vars | {v: a.vars[v] or b.vars[v]})

    def merged(self, a: Solutions, b: Solutions, df: DataFrame, shared: list[str], new: dict[str, str]) -> Solutions:
        cols = [F.coalesce(F.col(f"`{v}`"), F.col(f"`{new[v]}`")).alias(v) if v in new else F.col(f"`{v}`") for v in a.vars]
        cols += [F.col(f"`{v}`") for v in b.vars if v not in a.vars]
        return Solutions(df.select(*cols), {v: a.vars.get(v, False) or b.vars.get(v, False) for v in (*a.vars, *b.vars)})

    def split(self, s: Solutions, v: str) -> tuple[Solutions, Solutions]:
        """The rows that bind ``v``, and the others without that variable."""
        bound = Solutions(s.df.where(s.col(v).isNotNull()), s.vars | {v: True})
        return bound, Solutions(s.df.where(s.col(v).isNull()).drop(v), {k: x for k, x in s.vars.items() if k != v})

    def left_join(self, a: Solutions, b: Solutions, on: object) -> Solutions:
        """Rows of ``a`` with what of ``b`` is compatible, or alone.

        Where no shared variable is bound on both sides in every row, the rows that bind one are told from those that don't,
        so that each part has a key to join by.
        """
        if on is not None:
            a = self.seeing(a, _variables(on) - set(b.vars))
        shared = [v for v in a.vars if v in b.vars]
        if shared and not any(a.vars[v] and b.vars[v] for v in shared):
            v = shared[0]
            if not a.vars[v]:
                bound, free = self.split(a, v)
                out = self.union(self.left_join(bound, b, on), self.left_join(free, b, on))
            else:
                met = self.join(a, b)
                if on is not None:
                    met = Solutions(met.df.where(self.evaluator(met).boolean(on)), met.vars)
                out = self.union(met, self.semi(a, b, shared, [] if on is None else [on], "left_anti"))
            return Solutions(out.df, {v: a.vars.get(v, False) for v in out.vars})
        right, new = self.renamed(b, shared)
        condition = self.matching(a, b, shared, new)
        if on is not None:
            both = Solutions(a.df, a.vars | {v: False for v in b.vars})
            test = self.evaluator(both).boolean(on)
            condition = test if condition is None else condition & test
        df = a.df.join(right, F.lit(True) if condition is None else condition, "left")
        out = self.merged(a, b, df, shared, new)
        return Solutions(out.df, {v: a.vars.get(v, False) for v in out.vars})

    def semi(self, a: Solutions, b: Solutions, shared: list[str], late: list, how: str) -> Solutions:
        """The rows of ``a`` that are (left_semi) or are not (left_anti) compatible with a row of ``b`` in the variables ``shared``.

        ``late`` are conditions on both. Loose variables are split as in ``left_join``.
        """
        if not shared or any(a.vars[v] and b.vars[v] for v in shared):
            asked = {v for c in late for v in _variables(c)} & set(b.vars)
            right, new = self.renamed(Solutions(b.df, {v: b.vars[v] for v in b.vars if v in asked or v in shared}), [*shared, *sorted(asked - set(shared))])
            condition = self.matching(a, b, shared, new)
            both = {v: F.coalesce(a.col(v), F.col(f"`{new[v]}`")) if v in a.vars else F.col(f"`{new[v]}`") for v in asked}
            for c in late:
                ev = Evaluator(lambda n: both[n] if n in both else self.known(a, n), None, self.data.functions)
                condition = ev.boolean(c) if condition is None else condition & ev.boolean(c)
            if condition is None:  # any row will do
                return Solutions(a.df.join(right.limit(1), F.lit(True), how), a.vars)
            return Solutions(a.df.join(right, condition, how), a.vars)
        v, rest = shared[0], shared[1:]
        if not a.vars[v]:
            bound, free = (Solutions(a.df.where(test), a.vars | {v: x}) for test, x in ((a.col(v).isNotNull(), True), (a.col(v).isNull(), False)))
            kept = [self.semi(bound, b, shared, late, how), self.semi(free, b, rest, late, how)]
        else:
            bound, free = (Solutions(b.df.where(test), b.vars | {v: x}) for test, x in ((b.col(v).isNotNull(), True), (b.col(v).isNull(), False)))
            missed = self.semi(a, bound, shared, late, "left_anti")
            if how == "left_anti":
                return self.semi(missed, free, rest, late, how)
            kept = [self.semi(a, bound, shared, late, how), self.semi(missed, free, rest, late, how)]
        return Solutions(kept[0].df.unionByName(kept[1].df), a.vars)

    def known(self, s: Solutions, name: str) -> Column | None:
        return s.col(name) if name in s.vars else F.lit(self.bindings[name]) if name in self.bindings else None

    def seeing(self, s: Solutions, names: set[str]) -> Solutions:
        """``s`` with the variables of ``names`` that only the outside of an EXISTS binds."""
        if self.outer is None:
            return s
        missing = sorted(v for v in names if v not in s.vars and v in self.outer.vars)
        if not missing:
            return s
        keys = [v for v in self.outer.vars if v in s.vars] + missing
        seen = self.outer.df.select(*[self.outer.col(v) for v in keys]).distinct()
        return self.join(s, Solutions(seen, {v: self.outer.vars[v] for v in keys}))

    def union(self, a: Solutions, b: Solutions) -> Solutions:
        names = [*a.vars, *(v for v in b.vars if v not in a.vars)]
        pick = lambda s: s.df.select(*[s.col(v) if v in s.vars else F.lit(None).cast("string").alias(v) for v in names])
        return Solutions(pick(a).unionByName(pick(b)), {v: a.vars.get(v, False) and b.vars.get(v, False) for v in names})

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        """Rows of ``a`` that no compatible row of ``b`` shares a bound variable with."""
        shared = [v for v in a.vars if v in b.vars]
        right = Solutions(b.df.select(*[b.col(v) for v in shared]).distinct(), {v: b.vars[v] for v in shared})
        return self.removed(a, right, shared)

    def removed(self, a: Solutions, b: Solutions, shared: list[str]) -> Solutions:
        if not shared:
            return a
        if any(a.vars[v] and b.vars[v] for v in shared):
            return self.semi(a, b, shared, [], "left_anti")
        v, rest = shared[0], shared[1:]
        if not a.vars[v]:
            bound, free = (Solutions(a.df.where(test), a.vars | {v: x}) for test, x in ((a.col(v).isNotNull(), True), (a.col(v).isNull(), False)))
            return Solutions(self.removed(bound, b, shared).df.unionByName(self.removed(free, b, rest).df), a.vars)
        bound, free = self.split(b, v)
        return self.removed(self.semi(a, bound, shared, [], "left_anti"), free, rest)

    def filter(self, s: Solutions, condition: object, graph: Term | Var | None) -> Solutions:
        for c in _conjuncts(condition):
            negated = isinstance(c, Call) and c.op == "!" and isinstance(c.args[0], Call) and c.args[0].op == "EXISTS"
            if negated or isinstance(c, Call) and c.op == "EXISTS":
                s = self.exists(s, (c.args[0] if negated else c).args[0], graph, "left_anti" if negated else "left_semi")
            else:
                s = self.test(s, c, graph)
        return s

    def inside(self, s: Solutions, body: object, graph: Term | Var | None) -> tuple[Solutions, list]:
        """The solutions of the pattern of an EXISTS, and the conditions on it that only the outside can settle."""
        inner, on = body, []
        if isinstance(body, Filter):  # conditions may use variables of the outside
            inner, on = body.body, _conjuncts(body.condition)
        before, self.outer = self.outer, s if self.outer is None else self.join(self.outer, s) if set(s.vars) & set(self.outer.vars) else s
        b = self.pattern(inner, graph)
        late = [c for c in on if not _variables(c) <= set(b.vars)]
        for c in on:
            if c not in late:
                b = self.filter(b, c, graph)
        self.outer = before
        return b, late

    def exists(self, s: Solutions, body: object, graph: Term | Var | None, how: str) -> Solutions:
        b, late = self.inside(s, body, graph)
        return self.semi(s, b, [v for v in s.vars if v in b.vars], late, how)

    def test(self, s: Solutions, condition: object, graph: Term | Var | None) -> Solutions:
        """A filter; EXISTS inside of it becomes a mark on the rows first, by the variables that it asks for."""
        marks: dict[int, str] = {}
        s = self.seeing(s, _variables(condition))
        df = s.df

        def mark(e: object) -> None:
            nonlocal df
            if isinstance(e, Call):
                if e.op == "EXISTS":
                    row, flag = self.temp(), self.temp()
                    b, late = self.inside(s, e.args[0], graph)
                    asked = set(b.vars) | {v for c in late for v in _variables(c)}
                    keys = [v for v in s.vars if v in asked]
                    known = Solutions(s.df.select(*[s.col(k) for k in keys]).distinct(), {k: s.vars[k] for k in keys})
                    hit = self.semi(known, b, [v for v in keys if v in b.vars], late, "left_semi")
                    found = hit.df.select(*[F.col(f"`{k}`").alias(f"{row}{k}") for k in keys]).withColumn(flag, F.lit(True))
                    on = F.lit(True)
                    for k in keys:
                        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`{row}{k}`"))
                    df = df.join(found if keys else found.limit(1), on, "left").drop(*[f"{row}{k}" for k in keys])
                    marks[id(e.args[0])] = flag
                else:
                    for a in e.args:
                        mark(a)

        mark(condition)
        ev = self.evaluator(s)
        ev.exists = lambda body: F.coalesce(F.col(f"`{marks[id(body)]}`"), F.lit(False))
        return Solutions(df.where(ev.boolean(condition)).drop(*marks.values()), s.vars)

    # paths
    def path(self, p: Path, graph: Term | Var | None, s: object = None, o: object = None) -> DataFrame:
        """(s, o[, g]) pairs. ``*`` and ``+`` give distinct pairs, the rest keeps duplicates."""
        keep = ["s", "o"] + (["g"] if graph is not None else [])
        forms, self.forms = self.forms, {}
        base = self.named.where("g is not null") if graph is not None else self.triples()
        if p.op == "link":
            return base.where(F.col("p") == F.lit(p.parts[0])).select(*keep)
        if p.op == "inverse":
            return self.swapped(self.path(p.parts[0], graph, o, s), keep)
        if p.op == "alt":
            out = self.path(p.parts[0], graph, s, o)
            for part in p.parts[1:]:
                out = out.unionByName(self.path(part, graph, s, o))
            return out
        if p.op == "seq":
            out = self.path(p.parts[0], graph, s)
            for part in p.parts[1:]:
                step = self.path(part, graph).withColumnRenamed("s", "mid").withColumnRenamed("o", "end")
                out = out.withColumnRenamed("o", "mid").join(step, ["mid"] + keep[2:]).select("s", F.col("end").alias("o"), *keep[2:])
            return out
        if p.op == "not":
            ahead = [c for c, back in p.parts if not back]
            behind = [c for c, back in p.parts if back]
            parts = []
            if ahead or not behind:
                parts.append(base.where(~F.col("p").isin(ahead)).select(*keep))
            if behind:
                parts.append(self.swapped(base.where(~F.col("p").isin(behind)).select(*keep), keep))
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        edges = self.path(p.parts[0], graph).distinct()
        if p.op == "opt":
            return edges.unionByName(self.identity(base, keep, s, o)).distinct()
        return self.closure(edges, keep, s, o, self.identity(base, keep, s, o) if p.op == "star" else None, forms)

    def swapped(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(F.col("o").alias("s"), F.col("s").alias("o"), *keep[2:])

    def identity(self, base: DataFrame, keep: list[str], s: object, o: object) -> DataFrame:
        """Paths of length zero: every node to itself, constants of the query too."""
        nodes = base.select(F.col("s").alias("n"), *keep[2:]).unionByName(base.select(F.col("o").alias("n"), *keep[2:]))
        if len(keep) == 2:
            for n in (s, o):
                if isinstance(n, Term):
                    nodes = nodes.unionByName(self.spark.createDataFrame([(n.code,)], "n string"))
        return nodes.distinct().select(F.col("n").alias("s"), F.col("n").alias("o"), *keep[2:])

    def closure(self, edges: DataFrame, keep: list[str], s: object, o: object, loops: DataFrame | None = None, forms: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
        """Pairs joined by one or more edges, and ``loops``; only what a constant end can reach, where there is one.

        From a constant, each round extends the newest pairs and drops those seen before, so cycles end. Rounds are written to
        the shared folder.
        """
        if not isinstance(s, Term) and isinstance(o, Term):
            return self.swapped(self.closure(self.swapped(edges, keep), keep, o, None, loops), keep)
        edges = materialize(edges, "edges")
        if not isinstance(s, Term):
            return all_pairs(edges, keep, loops, forms)
        seen = frontier = edges.where(F.col("s") == F.lit(s.code))
        step = edges.withColumnRenamed("s", "mid").withColumnRenamed("o", "end")
        while True:
            longer = frontier.withColumnRenamed("o", "mid").join(step, ["mid"] + keep[2:]).select("s", F.col("end").alias("o"), *keep[2:]).distinct()
            fresh = materialize(longer.join(seen, keep, "left_anti"), "closure")
            if not fresh.take(1):
                return seen if loops is None else seen.unionByName(loops).distinct()
            seen, frontier = seen.unionByName(fresh), fresh
