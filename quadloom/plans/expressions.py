"""Query expressions as columns. An error is a null; a filter takes null for false."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.uris import let
from .algebra import Call, Term, Var
from .parser import SparqlError


@dataclass
class Value:
    """kind: term, bool, num, str or time.

    A number has its double in ``col``; integers and decimals also have it in ``exact``, and ``level`` tells its type (see
    ``terms.LEVELS``). ``code`` is the term of a constant.
    """

    kind: str
    col: Column
    exact: Column | None = None
    level: Column | None = None
    code: str | None = None


@dataclass
class Number:
    exact: Column
    col: Column
    level: Column


def as_term(v: Value) -> Column:
    if v.code is not None:
        return F.lit(v.code)
    if v.kind == "term":
        return v.col
    if v.kind == "bool":
        return T.literal(v.col, T.XSD + "boolean")
    if v.kind == "num":
        return T.number_literal(v.exact, v.col, v.level)
    if v.kind == "time":
        return T.literal(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), T.XSD + "dateTime")
    return T.literal(v.col)


def as_bool(v: Value) -> Column:
    """The effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind == "num":
        return (v.col != 0) & ~F.isnan(v.col)
    if v.kind == "str":
        return v.col != ""
    if v.kind == "time":
        return F.lit(None).cast("boolean")
    number = T.number_of(v.col)
    return F.coalesce(T.boolean_of(v.col), number != 0, F.when((T.tag(v.col) == "") | T.tag(v.col).startswith("@"), T.lexical_form(v.col) != ""))


def as_number(v: Value) -> Number:
    if v.kind == "num":
        return Number(v.exact, v.col, v.level)
    if v.kind == "term":
        return Number(T.exact_of(v.col), T.number_of(v.col), T.level_of(v.col))
    return Number(F.lit(None).cast(T.DECIMAL), F.lit(None).cast("double"), F.lit(None).cast("int"))


def as_str(v: Value) -> Column:
    if v.code is not None:
        return F.lit(v.code.split(T.SEP, 1)[-1])
    if v.kind == "term":
        return T.lexical_form(v.col)
    if v.kind == "num":
        return T.number_text(v.exact, v.col, v.level)
    return T.lexical_form(as_term(v)) if v.kind == "time" else v.col.cast("string")


def as_text(v: Value) -> Column:
    """The text of a string literal, tagged or not; null (an error) for all else."""
    if v.kind == "str":
        return v.col
    if v.kind != "term":
        return F.lit(None).cast("string")
    mark = T.tag(v.col)
    return F.when((mark == "") | mark.startswith("@"), T.lexical_form(v.col))


def like(v: Value, text: Column) -> Value:
    """A string literal with the language of ``v``."""
    if v.kind != "term":
        return Value("str", text)
    return Value("term", F.concat(F.lit("L"), F.when(T.tag(v.col).startswith("@"), T.tag(v.col)).otherwise(""), F.lit(T.SEP), text))


def as_time(v: Value) -> Column:
    return v.col if v.kind == "time" else T.time_of(v.col) if v.kind == "term" else F.lit(None).cast("timestamp")


def _integer(col: Column) -> Value:
    return Value("num", col.cast("double"), col.try_cast(T.DECIMAL), F.when(col.isNotNull(), 0))


def _exact(exact: Column, level: int | Column) -> Value:
    return Value("num", exact.cast("double"), exact, F.lit(level) if isinstance(level, int) else level)


def _double(col: Column, level: int = 3) -> Value:
    return Value("num", col, F.lit(None).cast(T.DECIMAL), F.lit(level))


def _short(exact: Column) -> Column:
    """``exact`` in the digits that a product or quotient keeps in full; null where it has more."""
    small = exact.try_cast("decimal(19,9)")
    return F.when(small == exact, small)


def _with(x: Column, y: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of two columns that are computed once."""
    return let(F.struct(x.alias("x"), y.alias("y")), lambda s: body(s["x"], s["y"]))


def quotient(x: Column, y: Column) -> Column:
    """x / y of exact numbers; null where y is 0. Numbers with more than 19 digits are divided as doubles."""

    def divided(a: Column, b: Column) -> Column:
        exact = F.try_divide(_short(a), _short(b)).try_cast(T.DECIMAL)
        return F.when(b != 0, F.coalesce(exact, F.try_divide(a.cast("double"), b.cast("double")).try_cast(T.DECIMAL)))

    return _with(x, y, divided)


def _product(x: Column, y: Column) -> Column:
    whole = lambda c: F.when(c == F.floor(c), c.try_cast("decimal(19,0)"))

    def multiplied(a: Column, b: Column) -> Column:
        return F.coalesce(
            F.try_multiply(whole(a), whole(b)).try_cast(T.DECIMAL),
            F.try_multiply(_short(a), _short(b)).try_cast(T.DECIMAL),
            (a.cast("double") * b.cast("double")).try_cast(T.DECIMAL),
        )

    return _with(x, y, multiplied)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Integers and decimals exactly (null where the result has more digits than DECIMAL holds), else doubles."""
    x, y = as_number(a), as_number(b)
    level = F.greatest(x.level, y.level)
    if op == "/":
        level = F.greatest(level, F.lit(1))
    exact = {
        "+": lambda: F.try_add(x.exact, y.exact).try_cast(T.DECIMAL),
        "-": lambda: F.try_subtract(x.exact, y.exact).try_cast(T.DECIMAL),
        "*": lambda: _product(x.exact, y.exact),
        "/": lambda: quotient(x.exact, y.exact),
    }[op]()
    by_zero = F.when((x.col == 0) | F.isnan(x.col), float("nan")).otherwise(F.signum(x.col) * float("inf"))
    rough = {
        "+": lambda: x.col + y.col,
        "-": lambda: x.col - y.col,
        "*": lambda: x.col * y.col,
        "/": lambda: F.when(y.col == 0, by_zero).otherwise(x.col / F.nullif(y.col, F.lit(0.0))),
    }[op]()
    return Value("num", F.when(level <= 1, exact.cast("double")).otherwise(rough), exact, level)


def _compare(op: str, a: Value, b: Value) -> Column:
    ops: dict[str, Callable] = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    f = ops[op]
    kinds = {a.kind, b.kind}

    def numbers() -> Column:
        x, y = as_number(a), as_number(b)
        return F.coalesce(f(x.exact, y.exact), f(x.col, y.col))

    if "num" in kinds:
        return numbers()
    if "bool" in kinds:
        return f(a.col if a.kind == "bool" else T.boolean_of(a.col), b.col if b.kind == "bool" else T.boolean_of(b.col))
    if "time" in kinds:
        return f(as_time(a), as_time(b))
    if "str" in kinds:
        plain = lambda v: v.col if v.kind == "str" else F.when(T.tag(v.col) == "", T.lexical_form(v.col))
        if op in ("=", "!="):  # a literal of another kind is not the same, nor is a tagged one
            return f(as_term(a), as_term(b))
        return f(plain(a), plain(b))
    x, y = a.col, b.col
    times = f(T.time_of(x), T.time_of(y))
    if op in ("=", "!="):
        return F.coalesce(numbers(), times, f(T.boolean_of(x), T.boolean_of(y)), f(x, y))
    texts = F.when((T.tag(x) == "") & (T.tag(y) == ""), f(T.lexical_form(x), T.lexical_form(y)))
    return F.coalesce(numbers(), times, texts, f(T.boolean_of(x), T.boolean_of(y)))


def _const_number(e: object) -> bool:
    return isinstance(e, Term) and e.code[1:].split(T.SEP)[0] in T.NUMERIC


def _pattern(text: Column, flags: str) -> Column:
    """A pattern with its flags; ``q`` takes it as plain text. Other flags than i, s, m, x, q are refused."""
    if set(flags) - set("ismxq"):
        raise SparqlError(f"unknown flags {flags}")
    if "q" in flags:
        text = F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    known = "".join(c for c in flags if c != "q")
    return F.concat(F.lit(f"(?{known})"), text) if known else text


def _substring(text: Column, start: Column, length: Column | None) -> Column:
    """Characters whose places, from 1, are at least ``start`` and less than ``start`` + ``length``, both rounded."""
    first = round_half_up(start).cast("int")
    end = F.char_length(text) + 1 if length is None else F.least(first + round_half_up(length).cast("int"), F.char_length(text) + 1)
    low = F.greatest(first, F.lit(1))
    return F.when(end > low, text.substr(low, end - low)).when(text.isNotNull() & end.isNotNull(), "")


def encode_for_uri(s: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


_HASHES = {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda s: F.sha2(s, 256), "SHA384": lambda s: F.sha2(s, 384), "SHA512": lambda s: F.sha2(s, 512)}
#: Groups of the lexical form of dates and times; parts are read as written, whatever the offset.
_DATE = r"^\s*(-?\d{4,})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?))?"
_DATE_PARTS = {"YEAR": 1, "MONTH": 2, "DAY": 3, "HOURS": 4, "MINUTES": 5, "SECONDS": 6}


class Evaluator:
    """Compiles expressions over a DataFrame whose columns named in ``bound`` hold terms."""

    def __init__(self, column: Callable[[str], Column | None], exists: Callable[[object], Column] | None = None, functions: dict[str, Callable] | None = None) -> None:
        self.column, self.exists, self.functions = column, exists, functions or {}

    def boolean(self, e: object) -> Column:
        return F.coalesce(as_bool(self.value(e)), F.lit(False))

    def term(self, e: object) -> Column:
        return as_term(self.value(e))

    def value(self, e: object) -> Value:
        if isinstance(e, Var):
            col = self.column(e.name)
            return Value("term", F.lit(None).cast("string") if col is None else col)
        if isinstance(e, Term):
            if _const_number(e):
                mark, lex = e.code[1:].split(T.SEP, 1)
                level = 0 if mark in T.INTEGER else T.LEVELS.index(mark)
                exact = F.lit(lex if level <= 1 else None).try_cast(T.DECIMAL)
                return Value("num", F.lit(lex).try_cast("double"), exact, F.lit(level), e.code)
            if e.code.startswith("L" + T.SEP):
                return Value("str", F.lit(e.code.split(T.SEP, 1)[1]))
            return Value("term", F.lit(e.code))
        assert isinstance(e, Call)
        if e.op == "EXISTS":
            if self.exists is None:
                raise SparqlError("EXISTS is not possible here")
            return Value("bool", self.exists(e.args[0]))
        if e.op in self.functions:
            return Value("term", self.functions[e.op](*[self.term(a) for a in e.args]))
        method = getattr(self, "_" + {"&&": "and", "||": "or", "!": "not", "IN": "in", "NOT IN": "not_in", "IF": "if"}.get(e.op, "call"))
        return method(e)

    def _and(self, e: Call) -> Value:
        return Value("bool", as_bool(self.value(e.args[0])) & as_bool(self.value(e.args[1])))

    def _or(self, e: Call) -> Value:
        return Value("bool", as_bool(self.value(e.args[0])) | as_bool(self.value(e.args[1])))

    def _not(self, e: Call) -> Value:
        return Value("bool", ~as_bool(self.value(e.args[0])))

    def _in(self, e: Call) -> Value:
        first = self.value(e.args[0])
        out = F.lit(False)
        for item in e.args[1:]:
            out = out | _compare("=", first, self.value(item))
        return Value("bool", out)

    def _not_in(self, e: Call) -> Value:
        return Value("bool", ~self._in(e).col)

    def _if(self, e: Call) -> Value:
        a, b = (self.value(x) for x in e.args[1:])
        test = as_bool(self.value(e.args[0]))
        if a.kind == b.kind and a.kind in ("bool", "str", "time"):
            return Value(a.kind, F.when(test, a.col).when(~test, b.col))
        return Value("term", F.when(test, as_term(a)).when(~test, as_term(b)))

    def _call(self, e: Call) -> Value:
        op, args = e.op, e.args
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", _compare(op, self.value(args[0]), self.value(args[1])))
        if op == "BOUND":
            return Value("bool", self.value(args[0]).col.isNotNull())
        v = [self.value(a) for a in args]
        if op in "+-*/" and len(op) == 1:
            return arithmetic(op, v[0], v[1])
        if op == "neg":
            x = as_number(v[0])
            return Value("num", -x.col, -x.exact, x.level)
        if op == "COALESCE":
            return Value("term", F.coalesce(*map(as_term, v)))
        if op == "SAMETERM":
            return Value("bool", as_term(v[0]) == as_term(v[1]))
        if op in ("ISIRI", "ISURI"):
            return Value("bool", T.is_uri(as_term(v[0])))
        if op == "ISBLANK":
            return Value("bool", T.is_bnode(as_term(v[0])))
        if op == "ISLITERAL":
            return Value("bool", T.is_literal(as_term(v[0])))
        if op == "ISNUMERIC":
            return Value("bool", F.when(as_term(v[0]).isNotNull(), T.is_numeric(as_term(v[0]))))
        if op == "STR":
            return Value("str", as_str(v[0]))
        if op == "LANG":
            return Value("str", T.lang_of(as_term(v[0])))
        if op == "DATATYPE" and v[0].kind == "num" and v[0].code is None:
            kinds = [F.when(v[0].level == i, T.uri_code(name)) for i, name in enumerate(T.LEVELS)]
            return Value("term", F.when(F.coalesce(v[0].exact.isNotNull(), F.lit(False)) | v[0].col.isNotNull(), F.coalesce(*kinds)))
        if op == "DATATYPE":
            return Value("term", T.uri(T.datatype_of(as_term(v[0]))))
        if op == "LANGMATCHES":
            tag, want = F.lower(as_str(v[0])), F.lower(as_str(v[1]))
            return Value("bool", F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))
        if op in ("IRI", "URI"):
            return Value("term", T.uri(as_str(v[0])))
        if op == "BNODE":
            return Value("term", T.bnode(F.md5(as_str(v[0])) if v else F.uuid()))
        if op == "STRDT":
            return Value("term", F.concat(F.lit("L"), F.when(as_str(v[1]) == T.XSD + "string", "").otherwise(as_str(v[1])), F.lit(T.SEP), as_str(v[0])))
        if op == "STRLANG":
            return Value("term", T.literal(as_str(v[0]), lang=as_str(v[1])))
        if op == "REGEX":
            flags = args[2].code.split(T.SEP, 1)[1] if len(args) > 2 else ""
            return Value("bool", F.regexp_like(as_text(v[0]), _pattern(as_str(v[1]), flags)))
        if op == "REPLACE":
            flags = args[3].code.split(T.SEP, 1)[1] if len(args) > 3 else ""
            return like(v[0], F.regexp_replace(as_text(v[0]), _pattern(as_str(v[1]), flags), as_str(v[2])))
        if op == "STRLEN":
            return _integer(F.char_length(as_text(v[0])))
        if op == "SUBSTR":
            return like(v[0], _substring(as_text(v[0]), as_number(v[1]).col, as_number(v[2]).col if len(v) > 2 else None))
        if op in ("UCASE", "LCASE"):
            return like(v[0], (F.upper if op == "UCASE" else F.lower)(as_text(v[0])))
        if op in ("STRSTARTS", "STRENDS", "CONTAINS"):
            f = {"STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains}[op]
            return Value("bool", f(as_text(v[0]), as_text(v[1])))
        if op in ("STRBEFORE", "STRAFTER"):
            text, part = as_text(v[0]), as_text(v[1])
            at = F.position(part, text)
            found = text.substr(F.lit(1), at - 1) if op == "STRBEFORE" else text.substr(at + F.length(part), F.length(text))
            if v[0].kind != "term":
                return Value("str", F.when(at > 0, found).otherwise(F.when(at == 0, "")))
            return Value("term", F.when(at > 0, like(v[0], found).col).when(at == 0, T.literal(F.lit(""))))
        if op == "ENCODE_FOR_URI":
            return Value("str", encode_for_uri(as_text(v[0])))
        if op == "CONCAT":
            whole = F.concat(*map(as_text, v)) if v else F.lit("")
            if not v or v[0].kind != "term" or any(x.kind != "term" for x in v):
                return Value("str", whole)
            same = F.lit(True)  # the language that all have stays
            for x in v[1:]:
                same = same & (T.tag(x.col) == T.tag(v[0].col))
            return Value("term", F.when(same, like(v[0], whole).col).otherwise(T.literal(whole)))
        if op in ("ABS", "CEIL", "FLOOR", "ROUND"):
            f = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": round_half_up}[op]
            x = as_number(v[0])
            return Value("num", f(x.col).cast("double"), f(x.exact).try_cast(T.DECIMAL), x.level)
        if op == "RAND":
            return _double(F.rand())
        if op == "NOW":
            return Value("time", F.current_timestamp())
        if op in _DATE_PARTS:
            written = F.when(as_time(v[0]).isNotNull(), F.regexp_extract(as_str(v[0]), _DATE, _DATE_PARTS[op]))
            return _exact(written.try_cast(T.DECIMAL), 1 if op == "SECONDS" else 0)
        if op in ("TZ", "TIMEZONE"):
            zone = F.regexp_extract(as_str(v[0]), r"(Z|[+-]\d{2}:\d{2})$", 1)
            if op == "TZ":
                return Value("str", zone)
            parts = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), zone.substr(2, 2).try_cast("int").cast("string"), F.lit("H"))
            minutes = zone.substr(5, 2).try_cast("int")
            text = F.when(zone == "Z", "PT0S").when(zone != "", F.concat(parts, F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")))
            return Value("term", T.literal(text, T.XSD + "dayTimeDuration"))
        if op in _HASHES:
            return Value("str", _HASHES[op](as_str(v[0])))
        if op == "UUID":
            return Value("term", T.uri(F.concat(F.lit("urn:uuid:"), F.uuid())))
        if op == "STRUUID":
            return Value("str", F.uuid())
        if op.startswith(T.XSD):
            return self._cast(op, v[0])
        raise SparqlError(f"unknown function {op}")

    def _cast(self, op: str, v: Value) -> Value:
        text = as_str(v)
        if op in T.NUMERIC:
            x = as_number(v)
            truth = v.col if v.kind == "bool" else T.boolean_of(v.col) if v.kind == "term" else F.lit(None).cast("boolean")
            if op not in T.EXACT:
                return _double(F.coalesce(x.col, F.when(truth, 1.0).when(~truth, 0.0), text.try_cast("double")), T.LEVELS.index(op))
            exact = F.coalesce(x.exact, x.col.try_cast(T.DECIMAL), F.when(truth, 1).when(~truth, 0).cast(T.DECIMAL))
            if op == T.XSD + "decimal":
                return _exact(F.coalesce(exact, F.when(text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"), F.btrim(text).try_cast(T.DECIMAL))), 1)
            cut = F.when(exact >= 0, F.floor(exact)).otherwise(F.ceil(exact)).try_cast(T.DECIMAL)
            return _exact(F.coalesce(cut, F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.btrim(text).try_cast(T.DECIMAL))), 0)
        if op == T.XSD + "boolean":
            number = as_number(v).col
            return Value("bool", F.coalesce(number != 0, F.when(F.lower(text).isin("true", "1"), F.lit(True)).when(F.lower(text).isin("false", "0"), F.lit(False))))
        if op in T.TIMES:
            return Value("time", v.col) if v.kind == "time" else Value("term", F.when(text.try_cast("timestamp").isNotNull(), T.literal(text, op)))
        return Value("str", text)
