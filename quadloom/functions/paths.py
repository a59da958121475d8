"""Path expressions over records, compiled to columns.

A record is a map ``props`` of property IRI to an array of terms; nested records are in a map ``nested`` of id to props. A
path yields a sequence of terms; comparisons between sequences hold when some pair compares so (an empty one compares to
nothing), by the total order of terms. Lenient evaluation turns errors into empty sequences, null or false.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T
from .uris import let

_TOKEN = re.compile(
    r"""(?x)\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<slot>\$\$)|(?P<uri>\\?<[^>]*>)
    |(?P<name>\\?[A-Za-z_][\w.-]*(?::(?!:)[A-Za-z_][\w.-]*)?)|(?P<op>!=|<=|>=|//|\.\.|[()\[\],|/=<>+*.-]))"""
)


class PathError(ValueError):
    """The text is not a path expression we know."""


@dataclass
class Node:
    op: str
    args: list = field(default_factory=list)
    value: object = None


class _Parser:
    def __init__(self, text: str, namespaces: dict[str, str], arguments: list) -> None:
        self.names, self.arguments, self.used = dict(namespaces), arguments, 0
        if m := re.match(r"\s*with\s+(.*?)>\s*:\s*(?=\S)", text, re.S):
            for prefix, iri in re.findall(r"([\w.-]+):\s*<([^>]*)>", text[: m.end()]):
                self.names[prefix] = iri
            text = text[m.end() :]
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        while pos < len(text.rstrip()):
            m = _TOKEN.match(text, pos)
            if not m:
                raise PathError(f"cannot read {text[pos : pos + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self, *words: str) -> bool:
        kind, text = self.tokens[self.at]
        return kind in ("op", "name") and text in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise PathError(f"{word!r} expected before {self.tokens[self.at][1]!r}")

    def whole(self) -> Node:
        node = self.level(0)
        if self.tokens[self.at][0] != "end":
            raise PathError(f"unexpected {self.tokens[self.at][1]!r}")
        if self.used != len(self.arguments):
            raise PathError(f"{self.used} places for {len(self.arguments)} arguments")
        return node

    _levels = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def level(self, n: int) -> Node:
        if n == len(self._levels):
            return self.unary()
        left = self.level(n + 1)
        while op := self.take(*self._levels[n]):
            left = Node(op, [left, self.level(n + 1)])
        return left

    def unary(self) -> Node:
        if self.take("-"):
            return Node("neg", [self.unary()])
        left = self.path()
        while self.take("|"):
            left = Node("|", [left, self.path()])
        return left

    def iri(self, text: str) -> str:
        text = text.lstrip("\\")
        if text.startswith("<"):
            return text[1:-1]
        prefix, _, local = text.partition(":")
        if not local or prefix not in self.names:
            raise PathError(f"unknown name {text}")
        return self.names[prefix] + local

    def path(self) -> Node:
        kind, text = self.tokens[self.at]
        ahead = self.tokens[self.at + 1][1]
        if kind == "text":
            self.at += 1
            return Node("const", value=T.literal_code(text[1:-1]))
        if kind == "number":
            self.at += 1
            return Node("const", value=T.literal_code(text, T.XSD + ("decimal" if "." in text else "integer")))
        if kind == "slot":
            if self.used >= len(self.arguments):
                raise PathError("more places than arguments")
            self.at += 1
            self.used += 1
            given = self.arguments[self.used - 1]
            return Node("const" if isinstance(given, str) else "consts", value=given)
        if text.startswith("\\"):
            self.at += 1
            return Node("const", value=T.uri_code(self.iri(text)))
        if kind == "name" and ahead == "(":
            base = self.function()
        elif self.take("("):
            base = self.level(0)
            self.need(")")
        else:
            base = Node("self")
            if self.take("..") or self.take("//"):
                raise PathError("only child steps are known")
            if not self.take(".") and not self.peek("/", "["):
                base = self.step(base)
        while True:
            if self.take("/"):
                base = self.step(base)
            elif self.take("["):
                base = Node("filter", [base, self.level(0)])
                self.need("]")
            else:
                return base

    def step(self, base: Node) -> Node:
        if self.take(".."):
            return _parent(base)
        kind, text = self.tokens[self.at]
        if self.take("*"):
            return Node("any", [base])
        if kind not in ("name", "uri"):
            raise PathError(f"step expected before {text!r}")
        self.at += 1
        return Node("child", [base], self.iri(text))

    def function(self) -> Node:
        name = self.tokens[self.at][1]
        self.at += 1
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.level(0))
            self.take(",")
        return Node("call", args, name)


_WITH, _MAPPING = re.compile(r"\s*with\s+"), re.compile(r"\s*([\w-]+)\s*:\s*<([^>]*)>\s*([,:])")


def _own_names(text: str) -> tuple[dict[str, str], str]:
    """The names of a leading ``with p: <uri>, q: <uri> :`` and the text after it."""
    names: dict[str, str] = {}
    m = _WITH.match(text)
    if not m or not _MAPPING.match(text, m.end()):
        return names, text
    at = m.end()
    while True:
        m = _MAPPING.match(text, at)
        if not m:
            raise PathError("a name of the with clause is not understood")
        names[m[1]], at = m[2], m.end()
        if m[3] == ":":
            return names, text[at:]


def parse(text: str, namespaces: dict[str, str] | None = None, arguments: list | None = None) -> Node:
    """Syntax tree of a path expression. ``$$`` places take ``arguments`` (terms, or lists of terms) in turn.

    Names of a ``with`` clause before the expression come on top of ``namespaces``.
    """
    names, rest = _own_names(text)
    return _Parser(rest, (namespaces or {}) | names, arguments or []).whole()


def _parent(node: Node) -> Node:
    """The step ``..``: what has the children that ``node`` stands for."""
    own = lambda n: Node(n.op, [Node("self")], n.value)
    if node.op in ("child", "any"):
        return Node("filter", [node.args[0], own(node)])
    if node.op == "filter" and node.args[0].op in ("child", "any"):
        return Node("filter", [node.args[0].args[0], Node("filter", [own(node.args[0]), node.args[1]])])
    raise PathError("a parent step follows a child step")


def properties_of(node: Node) -> set[str]:
    """Properties of the record itself that the expression reads."""
    if node.op == "child" and node.args[0].op == "self":
        return {node.value}
    if node.op == "filter":
        return properties_of(node.args[0])
    return {p for a in node.args for p in properties_of(a)}


def compare_key(t: Column) -> Column:
    """Equal for terms that are equal in the total order: numbers by value, times by instant."""
    key = T.order_key(t)
    group = key["col1"]
    return F.struct(group.alias("g"), key["col2"].alias("b"), key["col3"].alias("n"), key["col4"].alias("t"), F.when(~group.isin(1, 3, 4), F.coalesce(T.tag(t), F.lit(""))).alias("m"), F.when(~group.isin(1, 3, 4), F.substring_index(t, T.SEP, -1)).alias("x"))


@dataclass
class Result:
    """kind: seq, bool, num or str. ``literal`` is the text of a constant, for functions that need one, ``code`` its term."""

    kind: str
    col: Column
    literal: str | None = None
    code: str | None = None


def empty() -> Column:
    return F.array().cast("array<string>")


def as_seq(r: Result) -> Column:
    if r.kind == "seq":
        return r.col
    term = {"bool": lambda c: T.literal(c, T.XSD + "boolean"), "num": lambda c: T.number_term(c, c == F.floor(c)), "str": T.literal}[r.kind](r.col)
    return F.when(term.isNull(), empty()).otherwise(F.array(term))


def first_of(r: Result) -> Column:
    return F.get(as_seq(r), F.lit(0))


def as_bool(r: Result) -> Column:
    """Sequences are true when they hold something but a single false."""
    if r.kind == "bool":
        return r.col
    if r.kind == "num":
        return (r.col != 0) & ~F.isnan(r.col)
    if r.kind == "str":
        return r.col != ""
    single = lambda s: (F.size(s) == 1) & F.coalesce(~T.boolean_of(F.get(s, F.lit(0))), F.lit(False))
    return let(r.col, lambda s: (F.size(s) > 0) & ~single(s))


def as_num(r: Result) -> Column:
    if r.kind == "num":
        return r.col
    if r.kind == "bool":
        return r.col.cast("double")
    return (r.col if r.kind == "str" else T.lexical_form(first_of(r))).try_cast("double")


def as_str(r: Result) -> Column:
    if r.kind == "str":
        return r.col
    if r.kind == "bool":
        return r.col.cast("string")
    if r.kind == "num":
        return F.when(r.col == F.floor(r.col), r.col.try_cast("bigint").cast("string")).otherwise(r.col.cast("string"))
    return F.coalesce(T.lexical_form(first_of(r)), F.lit(""))


def _time(r: Result) -> Column:
    return F.coalesce(T.time_of(first_of(r)), as_str(r).try_cast("timestamp"))


def _substring(s: Column, start: Column, length: Column | None) -> Column:
    """XPath substring: positions from 1, start and length rounded, what lies before the first character is cut off."""
    begin = F.floor(start + 0.5)
    end = F.char_length(s) + 1 if length is None else begin + F.floor(length + 0.5)
    low = F.greatest(begin, F.lit(1)).cast("int")
    size = F.greatest(F.least(end, F.char_length(s) + 1) - low, F.lit(0)).cast("int")
    return F.when(begin.isNull() | end.isNull(), "").otherwise(s.substr(low, size))


def _split_at(s: Column, part: Column, after: bool) -> Column:
    at = F.position(part, s)
    piece = s.substr(at + F.length(part), F.length(s)) if after else s.substr(F.lit(1), at - 1)
    return F.when(at > 0, piece).otherwise("")


def _iri_part(t: Column, local: bool) -> Column:
    return F.regexp_extract(T.lexical_form(t), r"^(.*[#/:])([^#/:]*)$", 2 if local else 1)


def _numbers(seq: Column) -> Column:
    return F.filter(F.transform(seq, lambda t: T.lexical_form(t).try_cast("double")), lambda x: x.isNotNull())


def _extreme(seq: Column, top: bool) -> Column:
    ordered = F.array_sort(F.transform(seq, lambda t: F.struct(compare_key(t).alias("k"), t.alias("t"))))
    return F.get(ordered, F.size(ordered) - 1 if top else F.lit(0))["t"]


def _one(col: Column) -> Column:
    return F.when(col.isNull(), empty()).otherwise(F.array(col))


def _function(name: str, a: list[Result]) -> Result:
    n = len(a)
    strings = {
        "concat": lambda: F.concat(*[as_str(x) for x in a]),
        "normalize-space": lambda: F.trim(F.regexp_replace(as_str(a[0]), r"\s+", " ")),
        "string": lambda: as_str(a[0]),
        "lower-case": lambda: F.lower(as_str(a[0])),
        "upper-case": lambda: F.upper(as_str(a[0])),
        "substring": lambda: _substring(as_str(a[0]), as_num(a[1]), as_num(a[2]) if n > 2 else None),
        "substring-before": lambda: _split_at(as_str(a[0]), as_str(a[1]), False),
        "substring-after": lambda: _split_at(as_str(a[0]), as_str(a[1]), True),
        "string-join": lambda: F.array_join(F.transform(as_seq(a[0]), T.lexical_form), _text(a[1])),
        "replace": lambda: F.regexp_replace(as_str(a[0]), as_str(a[1]), as_str(a[2])),
        "name": lambda: T.lexical_form(first_of(a[0])),
        "local-name": lambda: _iri_part(first_of(a[0]), True),
        "namespace-uri": lambda: _iri_part(first_of(a[0]), False),
        "lang": lambda: T.lang_of(first_of(a[0])),
        "translate": lambda: F.translate(as_str(a[0]), _text(a[1]), _text(a[2])),
        "escape-uri": lambda: F.replace(F.replace(F.replace(F.url_encode(as_str(a[0])), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")),
        "timezone": lambda: F.regexp_extract(as_str(a[0]), r"(Z|[+-]\d{2}:\d{2})$", 1),
    }
    numbers = {
        "number": lambda: as_num(a[0]),
        "ceiling": lambda: F.ceil(as_num(a[0])),
        "floor": lambda: F.floor(as_num(a[0])),
        "round": lambda: F.floor(as_num(a[0]) + 0.5),
        "abs": lambda: F.abs(as_num(a[0])),
        "power": lambda: F.pow(as_num(a[0]), as_num(a[1])),
        "string-length": lambda: F.char_length(as_str(a[0])),
        "count": lambda: F.size(as_seq(a[0])),
        "sum": lambda: F.aggregate(_numbers(as_seq(a[0])), F.lit(0.0), lambda x, y: x + y),
        "avg": lambda: F.aggregate(_numbers(as_seq(a[0])), F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(_numbers(as_seq(a[0]))), F.lit(0)),
        "compare": lambda: F.when(as_str(a[0]) < as_str(a[1]), -1).when(as_str(a[0]) > as_str(a[1]), 1).otherwise(0),
        "year": lambda: F.year(_time(a[0])),
        "month": lambda: F.month(_time(a[0])),
        "day": lambda: F.dayofmonth(_time(a[0])),
        "hours": lambda: F.hour(_time(a[0])),
        "minutes": lambda: F.minute(_time(a[0])),
        "seconds": lambda: F.second(_time(a[0])),
    }
    booleans = {
        "boolean": lambda: as_bool(a[0]),
        "true": lambda: F.lit(True),
        "false": lambda: F.lit(False),
        "not": lambda: ~as_bool(a[0]),
        "contains": lambda: F.contains(as_str(a[0]), as_str(a[1])),
        "starts-with": lambda: F.startswith(as_str(a[0]), as_str(a[1])),
        "ends-with": lambda: F.endswith(as_str(a[0]), as_str(a[1])),
        "matches": lambda: F.regexp_like(as_str(a[0]), as_str(a[1])),
        "exists": lambda: F.size(as_seq(a[0])) > 0,
        "empty": lambda: F.size(as_seq(a[0])) == 0,
    }
    sequences = {
        "uri": lambda: F.array(T.uri(as_str(a[0]))),
        "str": lambda: F.array(T.literal(as_str(a[0]))),
        "strdt": lambda: F.array(F.concat(F.lit("L"), as_str(a[1]), F.lit(T.SEP), as_str(a[0]))),
        "strlang": lambda: F.array(T.literal(as_str(a[0]), lang=as_str(a[1]))),
        "dateTime": lambda: F.when(_time(a[0]).isNull(), empty()).otherwise(F.array(T.literal(F.date_format(_time(a[0]), "yyyy-MM-dd'T'HH:mm:ss.SSS"), T.XSD + "dateTime"))),
        "current-dateTime": lambda: F.array(T.literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS"), T.XSD + "dateTime")),
        "sequence": lambda: F.flatten(F.array(*[as_seq(x) for x in a])) if a else empty(),
        "tokenize": lambda: F.transform(F.split(as_str(a[0]), _text(a[1])), lambda x: T.literal(x)),
        "subsequence": lambda: F.slice(as_seq(a[0]), F.greatest(F.floor(as_num(a[1]) + 0.5), F.lit(1)).cast("int"), (F.floor(as_num(a[2]) + 0.5).cast("int") if n > 2 else F.greatest(F.size(as_seq(a[0])), F.lit(1)))),
        "index-of": lambda: F.transform(F.filter(F.transform(as_seq(a[0]), lambda t, i: F.when(compare_key(t) == compare_key(first_of(a[1])), i + 1)), lambda x: x.isNotNull()), lambda x: T.literal(x, T.XSD + "integer")),
        "insert-before": lambda: F.flatten(F.array(F.filter(as_seq(a[0]), lambda t, i: i + 1 < as_num(a[1])), as_seq(a[2]), F.filter(as_seq(a[0]), lambda t, i: i + 1 >= as_num(a[1])))),
        "remove": lambda: F.filter(as_seq(a[0]), lambda t, i: i + 1 != as_num(a[1])),
        "reverse": lambda: F.reverse(as_seq(a[0])),
        "distinct-values": lambda: F.array_distinct(as_seq(a[0])),
        "max": lambda: _one(_extreme(as_seq(a[0]), True)),
        "min": lambda: _one(_extreme(as_seq(a[0]), False)),
    }
    for kind, table in (("str", strings), ("num", numbers), ("bool", booleans), ("seq", sequences)):
        if name in table:
            col = table[name]()
            return Result(kind, col.cast("double") if kind == "num" else col)
    raise PathError(f"unknown function {name}")


def _text(r: Result) -> str:
    if r.literal is None:
        raise PathError("a constant text is needed here")
    return r.literal


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


def _compare_with(f: Callable[[Column, Column], Column], t: Column, code: str) -> Column:
    """A term against a constant: numbers and plain strings by value at once, all else by the keys of the total order."""
    full = f(compare_key(t), compare_key(F.lit(code)))
    tag, _, lex = code[1:].partition(T.SEP)
    if code[0] == "L" and tag in T.NUMERIC:
        try:
            return F.coalesce(f(T.number_of(t), F.lit(float(lex))), full)
        except ValueError:
            return full
    if code[0] == "L" and not tag:
        plain = "L" + T.SEP
        return F.when(t.startswith(plain), f(t.substr(F.lit(3), F.length(t)), F.lit(lex))).otherwise(full)
    return full


class Compiler:
    """Compiles path expressions against the columns ``props`` and ``nested`` (null or absent: no nested records)."""

    def __init__(self, props: Column, nested: Column | None = None, ident: Column | None = None, strict: bool = False) -> None:
        self.props, self.nested, self.ident, self.strict = props, nested, ident, strict

    def boolean(self, node: Node) -> Column:
        return F.coalesce(as_bool(self.value(node, None)), F.lit(False))

    def sequence(self, node: Node) -> Column:
        return F.coalesce(as_seq(self.value(node, None)), empty())

    def number(self, r: Result) -> Column:
        num = as_num(r)
        if not self.strict or r.kind in ("num", "bool"):
            return num
        there = F.size(r.col) > 0 if r.kind == "seq" else r.col.isNotNull()
        return F.when(num.isNull() & there, F.raise_error(F.lit("a value is not a number")).cast("double")).otherwise(num)

    def children(self, item: Column | None, prop: str | None) -> Column:
        if item is None:
            props = self.props
        elif self.nested is None:
            return empty()
        else:
            props = F.try_element_at(self.nested, T.lexical_form(item))
        found = F.flatten(F.filter(F.map_values(props), lambda v: v.isNotNull())) if prop is None else props[prop]
        return F.coalesce(found, empty())

    def value(self, node: Node, item: Column | None, place: Column | None = None, size: Column | None = None) -> Result:
        op = node.op
        if op == "const":
            return Result("seq", F.array(F.lit(node.value)), node.value.split(T.SEP, 1)[-1], node.value)
        if op == "consts":
            return Result("seq", F.array(*[F.lit(v) for v in node.value]) if node.value else empty())
        if op == "self":
            return Result("seq", F.array(item) if item is not None else _one(T.uri(self.ident)) if self.ident is not None else empty())
        if op in ("child", "any"):
            base, prop = node.args[0], node.value if op == "child" else None
            if base.op == "self":
                return Result("seq", self.children(item, prop))
            return Result("seq", F.flatten(F.transform(as_seq(self.value(base, item)), lambda t: self.children(t, prop))))
        if op == "filter":
            seq = as_seq(self.value(node.args[0], item))
            test = node.args[1]
            if node.args[0].op == "self" and item is None:
                return Result("seq", F.when(F.coalesce(as_bool(self.value(test, None)), F.lit(False)), seq).otherwise(empty()))
            if test.op == "const" and T.XSD in test.value:
                return Result("seq", F.filter(seq, lambda t, i: i + 1 == F.lit(float(test.value.split(T.SEP)[1]))))
            return Result("seq", F.filter(seq, lambda t, i: F.coalesce(as_bool(self.value(test, t, i + 1, F.size(seq))), F.lit(False))))
        if op == "|":
            return Result("seq", F.array_union(*[as_seq(self.value(a, item)) for a in node.args]))
        if op == "call" and node.value in ("position", "last"):
            return Result("num", (place if node.value == "position" else size).cast("double"))
        if op == "call" and node.value == "id":
            return Result("seq", F.array(item) if item is not None else _one(T.uri(self.ident)))
        args = [self.value(a, item, place, size) for a in node.args]
        if op == "call":
            return _function(node.value, args)
        if op in ("and", "or"):
            x, y = as_bool(args[0]), as_bool(args[1])
            return Result("bool", (x & y) if op == "and" else (x | y))
        if op in _COMPARE:
            f = _COMPARE[op]
            if args[1].code is not None:
                return Result("bool", F.exists(as_seq(args[0]), lambda x: _compare_with(f, x, args[1].code)))
            left, right = as_seq(args[0]), as_seq(args[1])
            return Result("bool", F.exists(left, lambda x: F.exists(right, lambda y: f(compare_key(x), compare_key(y)))))
        if op == "neg":
            return Result("num", -self.number(args[0]))
        x, y = self.number(args[0]), self.number(args[1])
        safe = F.nullif(y, F.lit(0.0))
        return Result("num", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: x / safe, "mod": lambda: x % safe}[op]())


def condition(text: str, namespaces: dict[str, str] | None = None, arguments: list | None = None, props: str = "props", nested: str | None = None, ident: str | None = "id") -> Column:
    """A filter column; errors and nulls are false."""
    c = Compiler(F.col(props), F.col(nested) if nested else None, F.col(ident) if ident else None)
    return c.boolean(parse(text, namespaces, arguments))


def values(text: str, namespaces: dict[str, str] | None = None, arguments: list | None = None, props: str = "props", nested: str | None = None, ident: str | None = "id") -> Column:
    """The array of terms that an expression yields."""
    c = Compiler(F.col(props), F.col(nested) if nested else None, F.col(ident) if ident else None)
    return c.sequence(parse(text, namespaces, arguments))


#: How ``evaluate`` turns a result into each type.
_TARGETS = {
    "boolean": lambda r: F.coalesce(as_bool(r), F.lit(False)),
    "double": as_num,
    "bigint": lambda r: F.when(as_num(r) == F.floor(as_num(r)), as_num(r).try_cast("bigint")),
    "string": lambda r: r.col if r.kind == "str" else T.lexical_form(first_of(r)),
    "timestamp": _time,
}


def evaluate(
    text: str, kind: str, namespaces: dict[str, str] | None = None, arguments: list | None = None, strict: bool = False, props: str = "props", nested: str | None = None, ident: str | None = "id"
) -> Column:
    """The value of an expression as ``kind`` (boolean, double, bigint, string, timestamp).

    Nothing gives null (a boolean: false). What can't be converted, several values for one, and operands of arithmetic that
    are no numbers give null too, or an error where ``strict``.
    """
    c = Compiler(F.col(props), F.col(nested) if nested else None, F.col(ident) if ident else None, strict)
    r = c.value(parse(text, namespaces, arguments), None)
    value = _TARGETS[kind](r)
    if kind == "boolean":
        return value
    seq = as_seq(r)
    if not strict:
        return F.when(F.size(seq) == 1, value)
    failed = (F.size(seq) > 1) | ((F.size(seq) == 1) & value.isNull())
    return F.when(failed, F.raise_error(F.lit(f"{text} is no single {kind}")).cast(kind)).otherwise(F.when(F.size(seq) == 1, value))
