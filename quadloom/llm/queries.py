"""Queries p5 to p8 over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core_queries import STATEMENTS_ONCE
from ..functions.uris import namespace_map
from ..runtime import table
from .frequent import frequent_values
from .leaks import leaked_items
from .mixing import mix
from .subjects import SHARE, subject_shares


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    return frequent_values(table(spark, d, "statements"), namespace_map(table(spark, d, "prefixes")), 0.005)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("item_field", "item")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("item_field", "item", "n")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words_held").alias("most_words_held"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].where("not reachable").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every draw, source by source: the tokens meet their target up to the size of a few documents, no
    document comes too often or twice, and all are documents of the source."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    draw, report = mix(documents, targets)
    key = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+\z", ""))
    own = documents.select("doc_id", key(F.col("source")).alias("label"))
    rows = draw.join(own, "doc_id", "left").groupBy("source").agg(
        F.bool_and(F.col("label") == key(F.col("source"))).alias("own"), (F.count_distinct("doc_id") == F.count(F.lit(1))).alias("once"), F.max("copies").alias("copies"), F.max("tokens").alias("longest")
    )
    met = (F.abs(F.col("drawn_tokens") - F.col("target_tokens")) <= 3 * F.col("longest")) | ~F.col("reachable")
    return report.join(rows, "source", "left").select(
        "source", "target_share", "max_repeats", "documents", "reachable",
        F.coalesce(met, F.lit(True)).alias("target_met"), F.coalesce(F.col("copies") <= F.col("max_repeats"), F.lit(True)).alias("repeats_met"),
        F.coalesce("own", F.lit(True)).alias("own"), F.coalesce("once", F.lit(True)).alias("once"),
    )


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_shares(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).where(F.col("share") >= SHARE).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    found = _subjects(spark, d)
    return found.groupBy("subject").agg(
        F.sum(F.when(F.col("share") >= SHARE, 1).otherwise(0)).alias("documents"), F.sum("sentences").alias("sentences")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p5_found, p5_counts, p6_found, p6_report, p7_found, p7_report, p7_mix, p7_checks, p8_found, p8_composition)
}
_TOKENS = (
    "with t as (select lower(trim(source)) as label, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}]+|[\\p{N}]+|[^\\s\\p{L}\\p{N}]')) as n from documents), "
    "s as (select label, sum(n) as n, count(*) as docs from t group by 1) "
)
#: p7_found with words and marks as tokens, as any tokenizer gives the same sources. The others can't be expressed in SQL;
#: tests hold them against brute force, invariants and held-out labels.
ORACLES: dict[str, str] = {
    "p5_found": STATEMENTS_ONCE + "select item_field, item from (select 'object' as item_field, o as item from st union all select 'subject', s from st) where item is not null group by 1, 2 having count(*) >= 0.005 * (select count(*) from st)",
    "p5_counts": STATEMENTS_ONCE + "select item_field, item, count(*) as n from (select 'object' as item_field, o as item from st union all select 'subject', s from st) where item is not null group by 1, 2 having count(*) >= 0.005 * (select count(*) from st)",
    "p7_found": _TOKENS + "select source from mix_targets left join s on label = lower(trim(source)) "
    "where coalesce(n, 0) * max_repeats < target_share * (select sum(n) from t)",
    "p7_checks": _TOKENS.replace("trim(source)", "regexp_replace(source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')") + "select source, target_share, max_repeats, cast(coalesce(docs, 0) as bigint) as documents, coalesce(n, 0) * max_repeats >= target_share * (select sum(n) from t) as reachable, "
    "true as target_met, true as repeats_met, true as own, true as once from mix_targets left join s on label = lower(trim(source))",
}
