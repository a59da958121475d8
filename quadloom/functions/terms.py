"""RDF terms as one string column each, and what expressions need of them.

A term is ``U`` and an IRI, ``B`` and a blank-node label, or ``L``, a datatype or ``@language``, a separator and a lexical
form. A plain string literal has an empty datatype. Equal terms are equal strings, so joins and grouping stay cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .uris import let

XSD = "http://www.w3.org/2001/XMLSchema#"
SEP = "\x01"
_INTEGERS = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")
NUMERIC = tuple(XSD + t for t in (*_INTEGERS, "decimal", "double", "float"))
INTEGER = tuple(XSD + t for t in _INTEGERS)
EXACT = (*INTEGER, XSD + "decimal")
TIMES = (XSD + "dateTime", XSD + "date")
#: How exact numbers are held: 20 digits before the point and 18 behind it.
DECIMAL = "decimal(38,18)"
#: Datatypes of computed numbers by level; the higher level of two operands is that of the result.
LEVELS = (XSD + "integer", XSD + "decimal", XSD + "float", XSD + "double")


def uri(col: Column) -> Column:
    return F.concat(F.lit("U"), col.cast("string"))


def bnode(col: Column) -> Column:
    return F.concat(F.lit("B"), col.cast("string"))


def literal(col: Column, datatype: str = "", lang: str | Column | None = None) -> Column:
    if lang is not None:
        lang = F.lit(lang) if isinstance(lang, str) else lang
        return F.concat(F.lit("L@"), F.lower(lang), F.lit(SEP), col.cast("string"))
    return F.concat(F.lit("L" + ("" if datatype == XSD + "string" else datatype) + SEP), col.cast("string"))


def uri_code(text: str) -> str:
    return "U" + text


def literal_code(lex: str, datatype: str = "", lang: str = "") -> str:
    return "L" + ("@" + lang.lower() if lang else "" if datatype == XSD + "string" else datatype) + SEP + lex


def is_uri(t: Column) -> Column:
    return t.startswith("U")


def is_bnode(t: Column) -> Column:
    return t.startswith("B")


def is_literal(t: Column) -> Column:
    return t.startswith("L")


def tag(t: Column) -> Column:
    """Datatype or ``@language`` of a literal; null for other terms."""
    return F.when(is_literal(t), F.substring_index(t.substr(F.lit(2), F.length(t)), SEP, 1))


def lexical_form(t: Column) -> Column:
    """STR(): the lexical form of a literal, the text of an IRI; null for blank nodes."""
    return F.when(is_literal(t), t.substr(F.locate(SEP, t) + 1, F.length(t))).when(is_uri(t), t.substr(F.lit(2), F.length(t)))


def datatype_of(t: Column) -> Column:
    mark = tag(t)
    return F.when(mark == "", XSD + "string").when(mark.startswith("@"), "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(mark)


def lang_of(t: Column) -> Column:
    mark = tag(t)
    return F.when(mark.startswith("@"), mark.substr(F.lit(2), F.length(mark))).when(mark.isNotNull(), "")


def _has_type(t: Column, types: tuple[str, ...]) -> Column:
    return F.substring_index(t, SEP, 1).isin(*["L" + x for x in types])


def is_numeric(t: Column) -> Column:
    return F.coalesce(_has_type(t, NUMERIC), F.lit(False))


def number_of(t: Column) -> Column:
    """The number of a numeric literal; null for all else. Numbers hold no separator, so the last part is the number."""
    return F.when(_has_type(t, NUMERIC), F.substring_index(t, SEP, -1).try_cast("double"))


def exact_of(t: Column) -> Column:
    """The number of an integer or decimal literal, exactly; null for all else."""
    return F.when(_has_type(t, EXACT), F.substring_index(t, SEP, -1).try_cast(DECIMAL))


def level_of(t: Column) -> Column:
    """The place of a numeric literal's type in LEVELS; null for all else."""
    mark = F.substring_index(t, SEP, 1)
    return F.when(_has_type(t, INTEGER), 0).when(mark == "L" + LEVELS[1], 1).when(mark == "L" + LEVELS[2], 2).when(mark == "L" + LEVELS[3], 3)


def time_of(t: Column) -> Column:
    return F.when(tag(t).isin(*TIMES), lexical_form(t).try_cast("timestamp"))


def boolean_of(t: Column) -> Column:
    low = lexical_form(t)
    return F.when(tag(t) == XSD + "boolean", F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False)))


def order_key(t: Column) -> Column:
    """Sort key of the total order: null, then booleans, strings, numbers and times among literals, blank nodes, URIs."""
    group = (
        F.when(t.isNull(), 0)
        .when(is_bnode(t), 5)
        .when(is_uri(t), 6)
        .when(boolean_of(t).isNotNull(), 1)
        .when(number_of(t).isNotNull(), 3)
        .when(time_of(t).isNotNull(), 4)
        .otherwise(2)
    )
    return F.struct(group, boolean_of(t), number_of(t), time_of(t), exact_of(t), lexical_form(t), t)


def plain_decimal(exact: Column) -> Column:
    """An exact number in plain notation, without zeros at the end."""
    return let(exact.cast("string"), lambda text: F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text))


def number_text(exact: Column, number: Column, level: Column) -> Column:
    return F.when(level <= 1, plain_decimal(exact)).otherwise(number.cast("string"))


def number_literal(exact: Column, number: Column, level: Column) -> Column:
    """The literal of a number held exactly (levels 0 and 1) or as a double."""
    kind = F.when(level == 0, LEVELS[0]).when(level == 1, LEVELS[1]).when(level == 2, LEVELS[2]).otherwise(LEVELS[3])
    return F.concat(F.lit("L"), kind, F.lit(SEP), number_text(exact, number, level))


def number_term(num: Column, whole: Column) -> Column:
    """The literal of a number of record paths, which know doubles only: an integer where ``whole``, else a double."""
    return F.when(whole, literal(num.try_cast("bigint"), XSD + "integer")).otherwise(literal(num, XSD + "double"))
