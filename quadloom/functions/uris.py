"""One spelling per URI, as JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#@]*@|//)?([^/?#]*)"
_UNRESERVED = r"^[A-Za-z0-9._~-]\z"
#: White space of Unicode (fixed values); with the brackets, what may enclose a URI.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def namespace_map(prefixes: DataFrame, limit: int = 20_000) -> dict[str, str]:
    """The ``prefixes`` table as a dictionary. It is a fixed table; one of more than ``limit`` rows is refused.

    Rows with a null are left out; of several namespaces for one prefix the smallest counts.
    """
    rows = (
        prefixes.where(F.col("prefix").isNotNull() & F.col("namespace_uri").isNotNull())
        .groupBy("prefix")
        .agg(F.min("namespace_uri").alias("namespace_uri"))
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"more than {limit} prefixes")
    return {r[0]: r[1] for r in rows}


def _decode_unreserved(text: Column) -> Column:
    """Escapes of unreserved characters become the characters, other escapes get upper-case digits."""

    def part(piece: Column, at: Column) -> Column:
        char = F.chr(F.conv(F.substring(piece, 1, 2), 16, 10).cast("bigint"))
        escape = piece.rlike(r"(?s)^[0-9A-Fa-f]{2}")
        plain = escape & char.rlike(_UNRESERVED)
        return (
            F.when(at == 0, piece)
            .when(plain, F.concat(char, piece.substr(F.lit(3), F.length(piece))))
            .when(escape, F.concat(F.lit("%"), F.upper(F.substring(piece, 1, 2)), piece.substr(F.lit(3), F.length(piece))))
            .otherwise(F.concat(F.lit("%"), piece))
        )

    return F.when(text.contains("%"), F.concat_ws("", F.transform(F.split(text, "%"), part))).otherwise(text)


def strip_white(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITE))


def _expanded(bare: Column, namespaces: dict[str, str]) -> Column:
    if not namespaces:
        return bare
    known = F.create_map(*[F.lit(x) for pair in sorted(namespaces.items()) for x in pair])
    at = F.locate(":", bare)
    return let(
        F.when((at > 0) & (bare.substr(at + 1, F.lit(2)) != "//"), F.try_element_at(known, F.substring_index(bare, ":", 1))),
        lambda space: F.when(space.isNotNull(), F.concat(space, bare.substr(at + 1, F.length(bare)))).otherwise(bare),
    )


def _lower_head(text: Column) -> Column:
    parts = [F.regexp_extract(text, _HEAD, i) for i in range(4)]
    host = F.when(parts[2] != "", F.lower(parts[3])).otherwise(parts[3])
    return F.when(parts[0] != "", F.concat(F.lower(parts[1]), parts[2], host, text.substr(F.length(parts[0]) + 1, F.length(text)))).otherwise(text)


def normalize_uri(raw: Column, namespaces: dict[str, str]) -> Column:
    """The full URI in normal form; null stays null, blank text becomes null.

    Enclosing white space and angle brackets go, a known ``prefix:`` is expanded, escapes of unreserved characters are
    decoded, and scheme and host turn lower case. Anything else, blank-node labels too, keeps its spelling. Most URIs are
    in normal form already, which a few cheap tests tell.
    """
    head = F.substring_index(raw, "/", 3)
    end = F.substring(raw, -1, 1)
    normal = (
        (F.locate("://", raw) == F.locate(":", raw))
        & raw.contains("://")
        & ~raw.contains("%")
        & (F.lower(head) == head)
        & F.substring(raw, 1, 1).between("a", "z")
        & end.between("!", "~")
        & (end != ">")
    )
    slow = let(
        F.btrim(raw, F.lit(_WHITE + "<>")),
        lambda bare: let(_expanded(bare, namespaces), lambda full: let(_decode_unreserved(full), _lower_head)),
    )
    return F.when(normal, raw).when(raw.isNotNull(), F.nullif(slow, F.lit("")))
