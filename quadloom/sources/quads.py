"""Quads from tables and from N-Quads text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

_SCHEMA = "s string, p string, o string, g string"
_XSD_OF = {"int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


def term_of(df: DataFrame, column: str) -> Column:
    """A literal of the XSD type that fits the column's type."""
    kind = dict(df.dtypes)[column]
    col = F.col(column)
    if kind.startswith("timestamp"):
        return T.literal(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), T.XSD + "dateTime")
    name = "decimal" if kind.startswith("decimal") else _XSD_OF.get(kind)
    return T.literal(col, T.XSD + name if name else "")


def triplify(df: DataFrame, subject: Column, columns: dict[str, str | Column], graph: Column | None = None, rdf_type: str | None = None) -> DataFrame:
    """Quads of a table: one per row and predicate of ``columns`` (predicate IRI to column name, or to a term column).

    Null values give no quad. Each predicate is a branch of a union, so a pattern with a constant predicate reads the one
    or two columns of its branch.
    """
    g = F.lit(None).cast("string") if graph is None else graph
    out = None
    items = list(columns.items())
    if rdf_type:
        items.append(("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", F.lit(T.uri_code(rdf_type))))
    for predicate, source in items:
        value = term_of(df, source) if isinstance(source, str) else source
        part = df.select(subject.alias("s"), F.lit(T.uri_code(predicate)).alias("p"), value.alias("o"), g.alias("g")).where("o is not null and s is not null")
        out = part if out is None else out.unionByName(part)
    return out


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
_LITERAL = r'(?s)^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def _unescaped(text: Column) -> Column:
    plain = text
    for code, char in (("\\\\", "\x02"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\x02", "\\")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return F.when(text.contains("\\"), plain).otherwise(text)


def _term(text: Column) -> Column:
    lang, datatype = F.regexp_extract(text, _LITERAL, 2), F.regexp_extract(text, _LITERAL, 3)
    mark = F.when(lang != "", F.concat(F.lit("@"), F.lower(lang))).when(datatype == T.XSD + "string", "").otherwise(datatype)
    return (
        F.when(text.startswith("<"), F.concat(F.lit("U"), F.regexp_extract(text, "^<(.*)>$", 1)))
        .when(text.startswith("_:"), F.concat(F.lit("B"), F.substring(text, 3, 1 << 20)))
        .when(text.startswith('"'), F.concat(F.lit("L"), mark, F.lit(T.SEP), _unescaped(F.regexp_extract(text, _LITERAL, 1))))
    )


def parse_nquads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quads of N-Triples or N-Quads lines; blank, comment and unreadable lines give none."""
    line = F.col(column)
    parts = [F.regexp_extract(line, _LINE, i) for i in range(1, 5)]
    good = lines.where(line.rlike(_LINE)).select(*[p.alias(n) for p, n in zip(parts, "spog")])
    return good.select(*[_term(F.col(n)).alias(n) for n in "spog"])


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """Files may be plain, gzip or bzip2, told by their names."""
    return parse_nquads(spark.read.text(path))


def _printed(t: Column) -> Column:
    lex = T.lexical_form(t)
    for char, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        lex = F.replace(lex, F.lit(char), F.lit(code))
    mark = T.tag(t)
    tail = F.when(mark == "", "").when(mark.startswith("@"), mark).otherwise(F.concat(F.lit("^^<"), mark, F.lit(">")))
    return (
        F.when(T.is_uri(t), F.concat(F.lit("<"), F.substring(t, 2, 1 << 20), F.lit(">")))
        .when(T.is_bnode(t), F.concat(F.lit("_:"), F.substring(t, 2, 1 << 20)))
        .otherwise(F.concat(F.lit('"'), lex, F.lit('"'), tail))
    )


def to_nquads(quads: DataFrame) -> DataFrame:
    """One ``value`` line per quad."""
    g = F.when(F.col("g").isNotNull(), F.concat(_printed(F.col("g")), F.lit(" "))).otherwise("") if "g" in quads.columns else F.lit("")
    return quads.select(F.concat(_printed(F.col("s")), F.lit(" "), _printed(F.col("p")), F.lit(" "), _printed(F.col("o")), F.lit(" "), g, F.lit(".")).alias("value"))


def write_nquads(quads: DataFrame, path: str, compression: str | None = None) -> None:
    to_nquads(quads).write.mode("overwrite").text(path, compression=compression)


def get_quads(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
    """Quads that match; None stands for anything."""
    for name, code in zip("spog", (s, p, o, g)):
        if code is not None:
            quads = quads.where(F.col(name) == F.lit(code))
    return quads


def add_quads(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Set union; quads without graph are quads too."""
    return quads.select(*"spog").unionByName(new.select(*"spog")).distinct()


def remove_quads(quads: DataFrame, old: DataFrame) -> DataFrame:
    gone = old.select(*[F.col(n).alias(f"{n}_") for n in "spog"]).distinct()
    on = (F.col("s") == F.col("s_")) & (F.col("p") == F.col("p_")) & (F.col("o") == F.col("o_")) & F.col("g").eqNullSafe(F.col("g_"))
    return quads.join(gone, on, "left_anti")


def rewrite_uris(quads: DataFrame, old: str, new: str) -> DataFrame:
    """IRIs that start with ``old`` start with ``new`` instead, in every place."""
    swap = lambda c: F.when(F.col(c).startswith("U" + old), F.concat(F.lit("U" + new), F.col(c).substr(F.lit(len(old) + 2), F.length(c)))).otherwise(F.col(c)).alias(c)
    return quads.select(*[swap(c) for c in quads.columns])


def empty_quads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _SCHEMA)


def skolemize(quads: DataFrame) -> DataFrame:
    """Blank nodes as IRIs ``bnode:label``."""
    swap = lambda c: F.when(F.col(c).startswith("B"), F.concat(F.lit("Ubnode:"), F.substring(F.col(c), 2, 1 << 20))).otherwise(F.col(c)).alias(c)
    return quads.select(*[swap(c) for c in quads.columns])


def deskolemize(quads: DataFrame) -> DataFrame:
    swap = lambda c: F.when(F.col(c).startswith("Ubnode:"), F.concat(F.lit("B"), F.substring(F.col(c), 8, 1 << 20))).otherwise(F.col(c)).alias(c)
    return quads.select(*[swap(c) for c in quads.columns])
