"""Quads from the statements table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T


def statement_quads(statements: DataFrame) -> DataFrame:
    """(s, p, o, g) of statements as they are spelled; rows without subject, predicate or object have no quad."""
    obj = (
        F.when(F.col("object_kind") == "uri", T.uri(F.col("object")))
        .when(F.col("object_kind") == "bnode", T.bnode(F.regexp_replace("object", "^_:", "")))
        .when(F.col("object_lang").isNotNull(), T.literal(F.col("object"), lang=F.col("object_lang")))
        .otherwise(F.concat(F.lit("L"), F.when(F.coalesce(F.col("object_datatype"), F.lit("string")) == "string", "").otherwise(F.concat(F.lit(T.XSD), F.col("object_datatype"))), F.lit(T.SEP), F.col("object")))
    )
    subject = F.when(F.col("subject").startswith("_:"), T.bnode(F.regexp_replace("subject", "^_:", ""))).otherwise(T.uri(F.col("subject")))
    quads = statements.select(subject.alias("s"), T.uri(F.col("predicate")).alias("p"), obj.alias("o"), T.uri(F.col("context")).alias("g"))
    return quads.where("s is not null and p is not null and o is not null")
