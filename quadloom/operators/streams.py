"""A chain of dataflow steps over a DataFrame: one-shot sequences, expressed lazily.

DataFrames have no order of arrival, so steps that depend on one take the columns to order by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import fresh


class Stream:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def of(cls, spark: SparkSession, rows: list, schema: str) -> Stream:
        return cls(spark.createDataFrame(list(rows), schema))

    def concat(self, *others: Stream) -> Stream:
        """Bag union by column name."""
        out = self.df
        for o in others:
            out = out.unionByName(o.df)
        return Stream(out)

    def filter(self, condition: Column) -> Stream:
        return Stream(self.df.where(condition))

    def transform(self, **columns: Column) -> Stream:
        """New columns instead of the old ones; rows that are null in all of them are dropped."""
        out = self.df.select(*[c.alias(n) for n, c in columns.items()])
        return Stream(out.dropna("all"))

    def transform_batches(self, fn: Callable, schema: str) -> Stream:
        """The whole sequence through an iterator of Arrow batches per partition."""
        return Stream(self.df.mapInArrow(fn, schema))

    def path(self, column: str, *steps: str, kind: str | None = None, lenient: bool = True) -> Stream:
        """Follow a path through structs, maps and arrays, flatten every array on it, and convert.

        Values that can't be converted are dropped when ``lenient``, else an error; nulls are dropped.
        """
        out = self.df.select(F.col(column).alias("value"))
        for step in (None, *steps):
            if step is not None:
                out = out.select(F.col("value")[step].alias("value"))
            while out.schema["value"].dataType.typeName() == "array":
                out = out.select(F.explode("value").alias("value"))
        if kind:
            out = out.select((F.col("value").try_cast(kind) if lenient else F.col("value").cast(kind)).alias("value"))
        return Stream(out.where("value is not null"))

    def distinct(self) -> Stream:
        return Stream(self.df.dropDuplicates())

    def slice(self, offset: int = 0, limit: int | None = None, *by: str) -> Stream:
        """Rows from ``offset`` on, ``limit`` of them or all, in the order of ``by`` (of all columns if none)."""
        out = self.df.orderBy(*(by or self.df.columns))
        out = out.offset(offset) if offset else out
        return Stream(out if limit is None else out.limit(limit))

    def chunk(self, size: int, column: str, *by: str) -> Stream:
        """Lists of ``size`` values in the order of ``by``: (chunk, values).

        Positions come from the sizes of range partitions, so the sequence is never pulled into one task.
        """
        pid, at, n = fresh(self.df, "pid_"), fresh(self.df, "at_"), fresh(self.df, "n_")
        ordered = self.df.select(*dict.fromkeys([column, *by])).repartitionByRange(*[F.col(b) for b in by])
        ordered = ordered.withColumn(pid, F.spark_partition_id())
        w = Window.partitionBy(pid).orderBy(*by)
        local = ordered.withColumn(at, F.row_number().over(w) - 1)
        sizes = ordered.groupBy(pid).agg(F.count(F.lit(1)).alias(n))
        starts = sizes.select(pid, (F.sum(n).over(Window.orderBy(pid)) - F.col(n)).alias(n))  # a row per partition
        row = F.struct((F.col(n) + F.col(at)).alias("i"), F.col(column).alias("v"))
        return Stream(
            local.join(F.broadcast(starts), pid)
            .groupBy(F.floor((F.col(n) + F.col(at)) / size).alias("chunk"))
            .agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias("values"))
        )

    def track(self, name: str = "track") -> tuple[Stream, Observation]:
        """Count rows on their way; ``observation.get`` has ``rows`` once an action is over."""
        seen = Observation(name)
        return Stream(self.df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen

    def count(self) -> int:
        return self.df.count()

    def iterate(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def to_list(self) -> list[Row]:
        return self.df.collect()

    def to_set(self) -> list[Row]:
        return self.df.dropDuplicates().collect()

    def sort(self, *by: Column | str) -> Stream:
        return Stream(self.df.orderBy(*by))

    def sort_by_path(self, array: str, *keys: str, kind: str = "string", ties: str | None = None) -> Stream:
        """By the first value that the path of ``keys`` below a column leads to, as ``kind``; rows without one last.

        Without ``keys``, by the first element of an array column. ``ties`` is a column that orders equal ones.
        """
        col = F.col(array)
        for k in keys:
            col = col.getField(k)
        value = dict(self.df.select(col.alias("v")).dtypes)["v"]
        first = F.get(col, F.lit(0)) if value.startswith("array") else col
        order = [(first if kind == "string" and not keys else first.try_cast(kind)).asc_nulls_last(), *([F.col(ties)] if ties else [])]
        return Stream(self.df.orderBy(*order))

    def to_map(self, key: str, value: str, last_by: str) -> Stream:
        """(key, value): of several values the last by ``last_by``; null keys and values are dropped."""
        good = self.df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        return Stream(good.groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(value), F.struct(last_by, value)).alias("value")))

    def to_multimap(self, key: str, value: str) -> Stream:
        good = self.df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        return Stream(good.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(value)).alias("values")))

    def unique(self, default: object = None) -> object:
        """The single row; None without one. Several are an error unless there is a default, which then counts."""
        rows = self.df.take(2)
        if len(rows) > 1:
            if default is None:
                raise ValueError("more than one element")
            return default
        return rows[0] if rows else default

    def group(self, name: str) -> Stream:
        """Jobs of what follows run under this name and can be cancelled by ``cancel(name)``."""
        self.df.sparkSession.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        return self

    def cancel(self, name: str) -> None:
        self.df.sparkSession.sparkContext.cancelJobGroup(name)
