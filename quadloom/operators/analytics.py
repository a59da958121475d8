"""Named analyses over quads (s, p, o, g) and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T


def describe_entity(quads: DataFrame, node: str, limit: int | None = None) -> DataFrame:
    """Triples into and out of a node; the node's own side is filled in. A loop appears twice."""
    out = quads.where(F.col("s") == node).select("s", "p", "o").unionByName(quads.where(F.col("o") == node).select("s", "p", "o"))
    return out if limit is None else out.orderBy("s", "p", "o").limit(limit)


def graph_triples(quads: DataFrame, graph: str) -> DataFrame:
    return quads.where(F.col("g") == graph).select("s", "p", "o")


def count_described(quads: DataFrame, node: str) -> DataFrame:
    """How many triples describe the node; a loop counts twice."""
    loop = F.when((F.col("s") == node) & (F.col("o") == node), 2).otherwise(1)
    return quads.where((F.col("s") == node) | (F.col("o") == node)).agg(F.coalesce(F.sum(loop), F.lit(0)).cast("bigint").alias("n"))


def document_of(mention: Column) -> Column:
    """The resource that a mention's id names: what stands before ``#``."""
    return F.substring_index(mention, "#", 1)


def entity_counts(links: DataFrame) -> DataFrame:
    """(entity, mentions, resources) of (entity, mention) links."""
    return links.groupBy("entity").agg(F.count_distinct("mention").alias("mentions"), F.count_distinct(document_of(F.col("mention"))).alias("resources"))


def entity_mentions(links: DataFrame, entity: object, limit: int | None = None) -> DataFrame:
    """(mention, resource) of one entity, in the order of mentions; the first ``limit`` of them."""
    found = links.where(F.col("entity") == F.lit(entity)).select("mention", document_of(F.col("mention")).alias("resource")).distinct()
    return found if limit is None else found.orderBy("mention").limit(limit)


def entity_resources(links: DataFrame, entity: object, limit: int) -> DataFrame:
    """(resource, mentions) of one entity, the resources with most mentions first."""
    found = links.where(F.col("entity") == F.lit(entity)).select("mention").distinct()
    return found.groupBy(document_of(F.col("mention")).alias("resource")).agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "resource").limit(limit)


def resource_mentions(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(mention, begin, end, entities) in the order of the text; a missing begin is 0, a missing end the last."""
    lists = links.groupBy("mention").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    rows = mentions.join(lists, "mention", "left")
    return rows.select("mention", F.coalesce("begin", F.lit(0)).alias("begin"), F.coalesce("end", F.lit(2147483647)).alias("end"), F.coalesce("entities", F.array().cast(lists.schema["entities"].dataType)).alias("entities")).orderBy("begin", "end", "mention")


def mention_entities(quads: DataFrame, link: str, hidden_graph: str) -> DataFrame:
    """(mention, entity) of links that are not in ``hidden_graph``."""
    rows = quads.where(F.col("p") == link)
    gone = rows.where(F.col("g") == hidden_graph).select("s", "o").distinct()
    return rows.select("s", "o").join(gone, ["s", "o"], "left_anti").distinct().select(F.col("o").alias("mention"), F.col("s").alias("entity"))


def property_occurrences(long: DataFrame) -> DataFrame:
    """(property, n): records that have each property."""
    return long.groupBy("property").agg(F.count_distinct("id").alias("n"))


def value_occurrences(long: DataFrame, prop: str) -> DataFrame:
    return long.where(F.col("property") == prop).groupBy("value").agg(F.count_distinct("id").alias("n"))


def property_values(long: DataFrame) -> DataFrame:
    """(property, value, n, example): counts with the smallest id as example."""
    return long.groupBy("property", "value").agg(F.count_distinct("id").alias("n"), F.min("id").alias("example"))


def with_property(long: DataFrame, prop: str, value: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, total) of records with the property (and value), ``total`` counting all of them."""
    hits = long.where(F.col("property") == prop)
    if value is not None:
        hits = hits.where(F.col("value") == value)
    hits = hits.select("id").distinct()
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    shown = hits if limit is None else hits.orderBy("id").limit(limit)
    return shown.crossJoin(F.broadcast(total))  # one row


def record_table(long: DataFrame, props: list[str]) -> DataFrame:
    """A column per property with its smallest value."""
    return long.where(F.col("property").isin(props)).groupBy("id").pivot("property", props).agg(F.min("value"))


def category(*rules: tuple[str, Column], default: str = "other") -> Column:
    """The name of the first condition that holds."""
    out = F.lit(default)
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def latency_statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    """min, quartiles, max, geometric mean, mean, standard deviation, sum and share of time by ``key``.

    Quantiles are exact and interpolate between neighbours. Zero and negative values have no part in the geometric mean.
    """
    v = F.col(value)
    stats = rows.where(v.isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(v).alias("low"),
        F.percentile(v, F.lit(0.25)).alias("q1"),
        F.percentile(v, F.lit(0.5)).alias("q2"),
        F.percentile(v, F.lit(0.75)).alias("q3"),
        F.max(v).alias("high"),
        F.exp(F.avg(F.when(v > 0, F.log(v)))).alias("geometric"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("deviation"),
        F.sum(v).alias("total"),
    )
    whole = rows.agg(F.sum(v).alias("whole"))
    return stats.crossJoin(F.broadcast(whole)).withColumn("share", F.col("total") / F.nullif("whole", F.lit(0.0))).drop("whole")


def describe_terms(quads: DataFrame) -> DataFrame:
    """(kind, n): how many objects are URIs, blank nodes and literals."""
    o = F.col("o")
    return quads.groupBy(F.when(T.is_uri(o), "uri").when(T.is_bnode(o), "bnode").otherwise("literal").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
