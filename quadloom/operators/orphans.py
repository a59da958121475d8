"""References to keys that are not in force, by a skew-aware split.

References are aggregated per key and period before any join. Keys and periods that hold many references are settled
through a broadcast of their verdicts, whose number the threshold bounds; the rest meets its verdicts in a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uris import normalize_uri
from ..runtime import materialize

#: A key and period is heavy from this share of all references on, so at most 1 / HEAVY_SHARE of them are.
HEAVY_SHARE = 1 / 2000
#: And only where it holds more references than this.
HEAVY_LEAST = 1000
#: Distinct terms of validity up to which a key's terms travel as one array; keys with more are settled by day.
TERMS_LIMIT = 1000
#: Parts that the references of such a key and day are cut into.
SALTS = 16
_ALWAYS = "0001-01-01 00:00:00"


def references(statements: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """(statement_id, ref_field, key, at, period): each subject, and each object of kind uri, that is not null.

    Rows without a statement_id can't be reported and are left out. ``period`` is the year and month as a number, 0 where
    ``asserted_at`` is null.
    """
    ref = F.explode(  # keys are made inside: a filter on them is then not run as a second normalisation
        F.array(
            F.struct(F.lit("subject").alias("f"), normalize_uri(F.col("subject"), namespaces).alias("k")),
            F.struct(F.lit("object").alias("f"), F.when(F.col("object_kind") == "uri", normalize_uri(F.col("object"), namespaces)).alias("k")),
        )
    )
    return (
        statements.where(F.col("statement_id").isNotNull())
        .select("statement_id", F.col("asserted_at").cast("timestamp_ntz").alias("at"), ref.alias("r"))
        .where(F.col("r.k").isNotNull())
        .select(
            "statement_id",
            F.col("r.f").alias("ref_field"),
            F.col("r.k").alias("key"),
            "at",
            F.coalesce(F.year("at") * 100 + F.month("at"), F.lit(0)).alias("period"),
        )
    )


def registry_terms(registry: DataFrame, shared: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """Distinct (key, since, until, rec_type): when each key is in force. Rows without a key or a start are left out."""
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    own = registry.select(
        F.explode(F.array(normalize_uri(F.col("identifier"), namespaces))).alias("key"), ntz("registered_at").alias("since"), ntz("deleted_at").alias("until"), "rec_type"
    )
    always = shared.select(
        F.explode(F.array(normalize_uri(F.col("identifier"), namespaces))).alias("key"),
        F.lit(_ALWAYS).cast("timestamp_ntz").alias("since"),
        F.lit(None).cast("timestamp_ntz").alias("until"),
        F.lit(None).cast("string").alias("rec_type"),
    )
    return own.unionByName(always).where(F.col("key").isNotNull() & F.col("since").isNotNull())


def _in_force(terms: Column, low: Column, high: Column) -> Column:
    """Some single term covers all of low to high."""
    return F.exists(terms, lambda t: (t["since"] <= low) & (t["until"].isNull() | (t["until"] > high)))


def _touched(terms: Column, low: Column, high: Column) -> Column:
    return F.exists(terms, lambda t: (t["since"] <= high) & (t["until"].isNull() | (t["until"] > low)))


def hot_terms(spans: DataFrame, terms_limit: int) -> tuple[DataFrame, DataFrame] | None:
    """Of the keys with more than ``terms_limit`` terms, the state by day and the changes within days; None without any.

    A key is in force where more of its terms have begun than ended, so changes add up: (key, day, active) holds the number
    of terms in force as a day begins, for each day from the first change to the last, (key, day, t, d) the changes.
    """
    hot = spans.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("since").alias("first")).where((F.col("n") > terms_limit) & (F.col("first") > F.lit(_ALWAYS)))
    if not hot.take(1):
        return None
    change = F.explode(F.array(F.struct(F.col("since").alias("t"), F.lit(1).alias("d")), F.struct(F.col("until").alias("t"), F.lit(-1).alias("d"))))
    changes = (
        spans.join(hot.select("key"), "key", "left_semi")
        .select("key", change.alias("c"))
        .where(F.col("c.t").isNotNull())
        .groupBy("key", F.col("c.t").alias("t"))
        .agg(F.sum("c.d").alias("d"))
        .withColumn("day", F.to_date("t"))
    )
    daily = changes.groupBy("key", "day").agg(F.sum("d").alias("net"))
    w = Window.partitionBy("key").orderBy("day")  # a row per day
    after = F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0))
    until = F.coalesce(F.lead("day").over(w), F.col("day"))
    states = daily.select("key", "day", "net", after.alias("after"), until.alias("until")).select(
        "key", F.explode(F.sequence("day", "until")).alias("at_day"), "day", "net", "after"
    )
    states = states.groupBy("key", F.col("at_day").alias("day")).agg(
        F.max_by(F.when(F.col("at_day") == F.col("day"), F.col("after") - F.col("net")).otherwise(F.col("after")), "day").alias("active")
    )
    return states, changes.select("key", "day", "t", "d")


def settled_by_day(asked: DataFrame, states: DataFrame, changes: DataFrame) -> DataFrame:
    """References of hot keys with their kind, by a running sum of the changes of the key and day up to each reference.

    The references of a key and day are cut into SALTS parts, each of which gets the state and the changes of that day.
    """
    day = F.least(F.to_date("at"), "last_day")
    part = F.pmod(F.xxhash64("statement_id", "ref_field"), F.lit(SALTS)).cast("int")
    refs = asked.select("key", day.alias("day"), part.alias("part"), F.col("at").alias("t"), F.lit(0).cast("bigint").alias("d"), F.struct(*asked.columns).alias("ref"))
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")
    start = states.select("key", "day", each, F.lit(None).cast("timestamp_ntz").alias("t"), F.col("active").cast("bigint").alias("d"))
    moved = changes.select("key", "day", each, "t", F.col("d").cast("bigint"))
    events = refs.unionByName(start.unionByName(moved), allowMissingColumns=True)
    w = Window.partitionBy("key", "day", "part").orderBy(F.col("t").asc_nulls_first(), F.col("ref").isNotNull())
    active = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("ref.at") < F.col("ref.first"), "later").when(F.col("active") <= 0, "deleted")
    known = events.withColumn("active", active).where("ref is not null").select(kind.alias("kind"), "ref.*")
    return known.withColumn("orphan_kind", F.col("kind")).where("orphan_kind is not null").drop("kind")


def verdicts(refs: DataFrame, spans: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(key, period, n, verdict, first, rec_type, last_day, terms) of each key and period referred to.

    ``verdict`` is ok, missing, later or deleted where it holds for the whole span of assertions of the period, else mixed,
    or hot for the keys of ``hot``, which are settled by day.
    """
    asked = refs.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    few = spans if hot is None else spans.join(hot, "key", "left_anti")
    per_key = few.groupBy("key").agg(
        F.min("since").alias("first"), F.min("rec_type").alias("rec_type"), F.collect_list(F.struct("since", "until")).alias("terms"),
        F.lit(None).cast("date").alias("last_day"),
    )
    if hot is not None:
        last = F.to_date(F.max(F.greatest("since", "until"))).alias("last_day")
        many = spans.join(hot, "key", "left_semi").groupBy("key").agg(F.min("since").alias("first"), F.min("rec_type").alias("rec_type"), last)
        per_key = per_key.unionByName(many, allowMissingColumns=True)
    known = F.col("first").isNotNull()
    low, high = F.col("low"), F.col("high")
    verdict = (
        F.when(~known, "missing")
        .when(low.isNull(), "ok")
        .when(high < F.col("first"), "later")
        .when(F.col("terms").isNull(), "hot")
        .when(_in_force(F.col("terms"), low, high), "ok")
        .when((low >= F.col("first")) & ~_touched(F.col("terms"), low, high), "deleted")
        .otherwise("mixed")
    )
    return asked.join(per_key, "key", "left").select(
        "key", "period", "n", verdict.alias("verdict"), "first", "rec_type", "last_day", F.when(verdict == "mixed", F.col("terms")).alias("terms")
    )


def orphans(
    statements: DataFrame, registry: DataFrame, shared: DataFrame, namespaces: dict[str, str],
    heavy_share: float = HEAVY_SHARE, terms_limit: int = TERMS_LIMIT,
) -> DataFrame:
    """(statement_id, ref_field, key, rec_type, period, orphan_kind): references not in force when asserted.

    A reference is orphaned as ``missing`` (its key was never registered), ``later`` (asserted before the key's first
    registration) or ``deleted``. Where ``asserted_at`` is null only ``missing`` can be told. One row per statement and
    field; of deliveries that differ the one asserted first counts. ``rec_type`` is the smallest one registered for the
    key, null where unknown. Empty tables give no rows (an empty registry makes every key missing).
    """
    refs = materialize(references(statements, namespaces), "references")  # normalised once, read by both sides of the split
    spans = registry_terms(registry, shared, namespaces).groupBy("key", "since", "until").agg(F.min("rec_type").alias("rec_type"))
    by_day = hot_terms(spans, terms_limit)
    hot = by_day and by_day[0].select("key").distinct()
    total = statements.count() * 2
    heavy_from = max(HEAVY_LEAST + 1, int(total * heavy_share))
    found = materialize(verdicts(refs, spans, hot).where((F.col("verdict") != "ok") | (F.col("n") >= heavy_from)), "verdicts")
    heavy = found.where(F.col("n") >= heavy_from)  # at most 1 / heavy_share rows
    rest = found.where((F.col("n") < heavy_from) & (F.col("verdict") != "ok"))
    marks = heavy.select("key", "period", F.lit(True).alias("is_heavy"), "verdict", "first", "rec_type", "last_day", "terms")
    tried = refs.join(F.broadcast(marks), ["key", "period"], "left")
    ours = tried.where(F.col("is_heavy") & (F.col("verdict") != "ok")).drop("is_heavy")
    others = tried.where(F.col("is_heavy").isNull()).select(*refs.columns).join(rest.drop("n"), ["key", "period"])
    at = F.col("at")
    kind = F.when(F.col("verdict") != "mixed", F.col("verdict")).when(at < F.col("first"), "later").when(~_in_force(F.col("terms"), at, at), "deleted")
    settled = ours.unionByName(others).withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull()).drop("terms")
    if by_day is not None:
        dated = settled_by_day(settled.where("orphan_kind = 'hot'"), *by_day)
        settled = settled.where("orphan_kind <> 'hot'").unionByName(dated.select(*settled.columns))
    row = F.struct("at", "key", "rec_type", "period", F.col("orphan_kind"))
    return (
        settled.groupBy("statement_id", "ref_field")
        .agg(F.min(row).alias("r"))
        .select("statement_id", "ref_field", "r.key", "r.rec_type", "r.period", "r.orphan_kind")
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """(ref_field, rec_type, period, orphan_kind, n): the report per referring field, record type and month."""
    return found.groupBy("ref_field", "rec_type", "period", "orphan_kind").agg(F.count(F.lit(1)).alias("n"))
