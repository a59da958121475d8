"""Reading of property values as typed values, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .uris import strip_white

_QUOTED = r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^\S+)?\z'
_DOUBLE = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?\z"

TYPES = ("string", "timestamp", "bigint", "int", "double", "boolean")


def lexical(raw: Column) -> Column:
    """The value without enclosing white space and Turtle quotes; an empty one is null."""
    text = strip_white(raw)
    text = F.when(text.rlike(_QUOTED), strip_white(F.regexp_extract(text, _QUOTED, 1))).otherwise(text)
    return F.when(text != "", text)


def read_as(text: Column, kind: str) -> Column:
    """``text`` (see ``lexical``) as the named type, or null where it can't be read as such."""
    if kind == "string":
        return text
    if kind in ("int", "bigint"):
        return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast(kind))
    if kind == "double":
        return F.when(text.rlike(_DOUBLE), text.try_cast("double"))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))
    if kind == "timestamp":
        return F.when(text.rlike(r"^[0-9]{13}\z"), F.timestamp_millis(text.try_cast("bigint"))).when(
            text.rlike(_TIME), F.translate(text, ",", ".").try_cast("timestamp")
        )
    raise ValueError(f"unknown type {kind}")
