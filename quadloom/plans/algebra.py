"""Nodes of the graph-query algebra."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    """A constant, as the string that stands for it in columns."""

    code: str


Node = Var | Term


@dataclass(frozen=True)
class Path:
    """op: link, inverse, seq, alt, opt, star, plus or not (negated set; parts are (code, inverted))."""

    op: str
    parts: tuple = ()


@dataclass
class Triple:
    s: Node
    p: Node | Path
    o: Node


@dataclass
class Bgp:
    triples: list[Triple]


@dataclass
class Graph:
    name: Node
    body: object


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    on: object = None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    body: object
    condition: object


@dataclass
class Extend:
    body: object
    var: str
    expr: object


@dataclass
class Values:
    names: list[str]
    rows: list[list[str | None]]


@dataclass
class Call:
    """An expression: operator or function name, and arguments (Call, Var, Term, or a pattern for exists)."""

    op: str
    args: list
    distinct: bool = False
    extra: object = None


@dataclass
class Query:
    form: str
    body: object
    select: list[tuple[str, object]] | None = None  # None: all variables
    distinct: bool = False
    group: list[tuple[str, object]] = field(default_factory=list)
    grouped: bool = False
    having: list = field(default_factory=list)
    order: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list[Triple] = field(default_factory=list)
    describe: list[Node] = field(default_factory=list)
    graphs: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)
    values: Values | None = None


UNIT = Values([], [[]])


def with_terms(node: object, swap: Callable[[str], str]) -> object:
    """A copy of a query or of a part of it in which every constant is ``swap`` of its code."""
    if isinstance(node, Term):
        return Term(swap(node.code))
    if isinstance(node, Path):
        codes = lambda x: swap(x) if isinstance(x, str) else (swap(x[0]), x[1]) if isinstance(x, tuple) else with_terms(x, swap)
        return Path(node.op, tuple(map(codes, node.parts)))
    if isinstance(node, Values):
        return Values(node.names, [[None if c is None else swap(c) for c in row] for row in node.rows])
    if isinstance(node, (list, tuple)):
        return type(node)(with_terms(x, swap) for x in node)
    if is_dataclass(node) and not isinstance(node, Var):
        own = {f.name: getattr(node, f.name) for f in fields(node)}
        changed = {k: list(map(swap, v)) if k in ("graphs", "named") else with_terms(v, swap) for k, v in own.items()}
        return type(node)(**changed)
    return node
