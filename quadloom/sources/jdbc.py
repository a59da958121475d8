"""Records in a relational database: rows (id, property, value) of one table, read and written over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import from_long, present, to_long


def write_records(records: DataFrame, url: str, table: str, mode: str = "overwrite", options: dict[str, str] | None = None) -> None:
    """Write records as rows; ids and properties of up to 400 characters, values of up to 4,000."""
    types = "id VARCHAR(400), property VARCHAR(400), value VARCHAR(4000)"
    rows = to_long(present(records))
    rows.write.format("jdbc").options(url=url, dbtable=table, createTableColumnTypes=types, **(options or {})).mode(mode).save()


def read_records(
    spark: SparkSession, url: str, table: str, ids: list[str] | None = None, props: list[str] | None = None, options: dict[str, str] | None = None
) -> DataFrame:
    """Records of the table; ids and properties are asked for in the database.

    ``options`` may cut the reading into parts (``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``).
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
    rows = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids))
    if props is not None:
        rows = rows.where(F.col("property").isin(props))
    return from_long(rows.select("id", "property", "value"))
