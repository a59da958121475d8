"""Solutions in the result formats of the query language: JSON, XML, CSV, TSV; and RDF files by format name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .quads import _printed, read_nquads, to_nquads

#: Formats that can be read and written here, by MIME type.
RDF_FORMATS = {"application/n-triples": "nt", "application/n-quads": "nq"}


def binding_json(t: Column) -> Column:
    """The object of a term in a JSON result; null for an unbound variable."""
    kind = F.when(T.is_uri(t), "uri").when(T.is_bnode(t), "bnode").otherwise("literal")
    value = F.when(T.is_bnode(t), F.substring(t, 2, 1 << 20)).otherwise(T.lexical_form(t))
    lang = F.nullif(T.lang_of(t), F.lit(""))
    dt = F.when(~F.coalesce(T.tag(t), F.lit("")).startswith("@") & (F.coalesce(T.tag(t), F.lit("")) != ""), T.tag(t))
    return F.when(t.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), lang.alias("xml:lang"), dt.alias("datatype")))


def to_json_lines(solutions: DataFrame) -> DataFrame:
    """One ``value`` line per solution, an object of bindings."""
    return solutions.select(F.to_json(F.struct(*[binding_json(F.col(f"`{c}`")).alias(c) for c in solutions.columns])).alias("value"))


def to_tsv(solutions: DataFrame) -> DataFrame:
    """Lines of terms as they are written in queries, unbound ones empty."""
    return solutions.select(F.concat_ws("\t", *[F.coalesce(_printed(F.col(f"`{c}`")), F.lit("")) for c in solutions.columns]).alias("value"))


def to_csv(solutions: DataFrame) -> DataFrame:
    """Lines of plain values, quoted where they need it."""

    def cell(c: str) -> Column:
        t = F.col(f"`{c}`")
        text = F.coalesce(F.when(T.is_bnode(t), F.concat(F.lit("_:"), F.substring(t, 2, 1 << 20))).otherwise(T.lexical_form(t)), F.lit(""))
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return solutions.select(F.concat_ws(",", *[cell(c) for c in solutions.columns]).alias("value"))


def to_xml(solutions: DataFrame) -> DataFrame:
    """One ``<result>`` element per solution."""

    def escaped(text: Column) -> Column:
        for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(char), F.lit(code))
        return text

    def binding(c: str) -> Column:
        t = F.col(f"`{c}`")
        mark = T.tag(t)
        attribute = F.when(mark == "", "").when(mark.startswith("@"), F.concat(F.lit(' xml:lang="'), F.substring(mark, 2, 100), F.lit('"'))).otherwise(F.concat(F.lit(' datatype="'), escaped(mark), F.lit('"')))
        body = (
            F.when(T.is_uri(t), F.concat(F.lit("<uri>"), escaped(T.lexical_form(t)), F.lit("</uri>")))
            .when(T.is_bnode(t), F.concat(F.lit("<bnode>"), F.substring(t, 2, 1 << 20), F.lit("</bnode>")))
            .otherwise(F.concat(F.lit("<literal"), attribute, F.lit(">"), escaped(T.lexical_form(t)), F.lit("</literal>")))
        )
        return F.coalesce(F.concat(F.lit(f'<binding name="{c}">'), body, F.lit("</binding>")), F.lit(""))

    return solutions.select(F.concat(F.lit("<result>"), *[binding(c) for c in solutions.columns], F.lit("</result>")).alias("value"))


def read_bindings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Solutions of JSON lines as ``to_json_lines`` writes them."""
    one = "STRUCT<type STRING, value STRING, `xml:lang` STRING, datatype STRING>"
    rows = spark.read.schema(", ".join(f"`{n}` {one}" for n in names)).json(path)

    def term(n: str) -> Column:
        b = F.col(f"`{n}`")
        mark = F.coalesce(F.concat(F.lit("@"), b["xml:lang"]), b["datatype"], F.lit(""))
        return F.when(b["type"] == "uri", F.concat(F.lit("U"), b["value"])).when(b["type"] == "bnode", F.concat(F.lit("B"), b["value"])).when(b["type"].isNotNull(), F.concat(F.lit("L"), mark, F.lit(T.SEP), b["value"]))

    return rows.select(*[term(n).alias(n) for n in names])


def read_rdf(spark: SparkSession, path: str, mime: str = "application/n-quads") -> DataFrame:
    if mime not in RDF_FORMATS:
        raise ValueError(f"format {mime} is not supported")
    return read_nquads(spark, path)


def write_rdf(quads: DataFrame, path: str, mime: str = "application/n-quads", compression: str | None = None) -> None:
    if mime not in RDF_FORMATS:
        raise ValueError(f"format {mime} is not supported")
    rows = quads if RDF_FORMATS[mime] == "nq" else quads.withColumn("g", F.lit(None).cast("string"))
    to_nquads(rows).write.mode("overwrite").text(path, compression=compression)
