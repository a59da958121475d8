"""Streams of statements and records into stores, and running counts, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.uris import normalize_uri
from ..operators.criteria import Criteria
from ..operators.records import merge, present
from ..sources.store import Store


def first_deliveries(statements: DataFrame, event_time: str = "asserted_at", late: str = "30 days") -> DataFrame:
    """Each statement once; state is kept for ``late`` of event time, later repetitions pass."""
    return statements.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["statement_id"])


def windowed_predicates(statements: DataFrame, namespaces: dict[str, str], event_time: str = "asserted_at", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(start, predicate, n) per window of event time; rows that come after ``late`` are left out."""
    keyed = statements.withWatermark(event_time, late).where(F.col("predicate").isNotNull())
    counts = keyed.groupBy(F.window(event_time, window).alias("w"), normalize_uri(F.col("predicate"), namespaces).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "predicate", "n")


def merge_records(records: DataFrame, store: Store, criteria: Criteria, checkpoint: str) -> StreamingQuery:
    """Merge a stream of records (id, props) into a store, batch by batch; a batch that is repeated changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        store.change(lambda old: merge(present(old), batch, criteria)[0], keys=batch)

    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
