"""Record, quad and file stores as versions of parts: a change writes the parts it touches, then moves the pointer.

Rows are cut into parts by a hash of their key. A version is a list of the folders of its parts; versions share the parts
that did not change, so a change of few rows rewrites few parts, whatever the size of the store. In a part rows are sorted
by key, which lets a look-up skip most of it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

RECORDS = "id string, props map<string,array<string>>"
QUADS = "s string, p string, o string, g string"
PARTS = 16
_PART = "part_"


class Store:
    """A table in a folder. Readers see the version that the pointer names; a single writer is assumed.

    ``key`` is the column that rows are found by (the first one by default); ``parts`` holds from the first write on.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None, parts: int = PARTS) -> None:
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, parts
        self.key = key or Ty.StructType.fromDDL(schema).fieldNames()[0]
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        pointer = self._hadoop(f"{self.path}/current")
        if not self._fs.exists(pointer):
            return None
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(pointer))
        return names[-1].split("~", 1)[1] if names else None

    def _manifest(self, version: str | None) -> dict:
        if version is None:
            return {"parts": self.parts, "folders": {}, "columns": []}
        return json.loads(self.spark.read.text(f"{self.path}/{version}.json", wholetext=True).first()[0])

    def _number(self, count: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(count)).cast("int")

    def _numbers(self, keys: DataFrame, count: int) -> list[int]:
        return [r[0] for r in keys.select(self._number(count).alias("n")).distinct().collect()]  # at most one for each part

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The table; with ``keys`` (a table with the key column) only the parts that may hold them."""
        m = self._manifest(self.version())
        numbers = m["folders"] if keys is None else {str(n) for n in self._numbers(keys, m["parts"])} & set(m["folders"])
        return self._load(m, sorted(m["folders"][n] for n in numbers))

    def _load(self, manifest: dict, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self._unpacked(self.spark.read.schema(self._stored(manifest["columns"])).parquet(*[f"{self.path}/{f}" for f in folders]), manifest["columns"])

    # how rows are stored
    def _columns(self, df: DataFrame, known: list[str]) -> list[str]:
        return []

    def _stored(self, columns: list[str]) -> str:
        return self.schema

    def _packed(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return df.select(*Ty.StructType.fromDDL(self.schema).fieldNames())

    def _unpacked(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return df

    # changes
    def write(self, df: DataFrame, sort_by: str | None = None) -> str:
        """Write the whole table as a new version; a failed write leaves the old one in place."""
        return self._put(df, {"parts": self.parts, "folders": {}, "columns": []}, None, sort_by)

    def _put(self, df: DataFrame, manifest: dict, numbers: list[int] | None, sort_by: str | None = None) -> str:
        columns = self._columns(df, manifest["columns"])
        version, count = f"v-{uuid.uuid4().hex}", manifest["parts"]
        rows = self._packed(df, columns).withColumn(_PART, self._number(count))
        rows.repartition(min(count, 200), _PART).sortWithinPartitions(_PART, sort_by or self.key).write.partitionBy(_PART).parquet(f"{self.path}/{version}")
        new = {s.getPath().getName().split("=", 1)[1]: f"{version}/{s.getPath().getName()}" for s in self._fs.listStatus(self._hadoop(f"{self.path}/{version}")) if s.isDirectory()}
        kept = {} if numbers is None else {n: f for n, f in manifest["folders"].items() if int(n) not in numbers}
        self._save(f"{version}.json", json.dumps({"parts": count, "folders": kept | new, "columns": columns}))
        self._save(f"current/{time.time_ns():020d}~{version}", "")
        return version

    def _save(self, name: str, text: str) -> None:
        out = self._fs.create(self._hadoop(f"{self.path}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()

    def change(self, fn: Callable[[DataFrame], object], keys: DataFrame | None = None, where: Column | None = None) -> DataFrame | None:
        """Apply ``fn`` to the table; it returns the new table, or that and outcomes, which are written beside it.

        With ``keys``, or a condition ``where`` on the rows, ``fn`` sees and rewrites only the parts that may hold such rows;
        all that it adds or changes must be in these.
        """
        m = self._manifest(self.version())
        numbers = None
        if keys is not None:
            numbers = self._numbers(keys, m["parts"])
        elif where is not None:
            numbers = self._numbers(self.read().where(where), m["parts"])
        old = self.read() if numbers is None else self._load(m, sorted(f for n, f in m["folders"].items() if int(n) in numbers))
        out = fn(old)
        new, outcomes = out if isinstance(out, tuple) else (out, None)
        if outcomes is not None:  # before the pointer moves, as it is made of the old version
            place = f"{self.path}/outcomes-{uuid.uuid4().hex}"
            outcomes.write.parquet(place)
            outcomes = self.spark.read.parquet(place)
        if numbers is None or numbers:
            self._put(new, m, numbers)
        return outcomes

    def reset(self) -> None:
        self.write(self.spark.createDataFrame([], self.schema))

    def purge(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions, and the parts that no version has any more; how many versions went."""
        pointer = self._hadoop(f"{self.path}/current")
        if not self._fs.exists(pointer):
            return 0
        entries = sorted((s.getPath() for s in self._fs.listStatus(pointer)), key=lambda p: p.getName())
        names = [p.getName().split("~", 1)[1] for p in entries]
        used = {f for v in names[-keep:] for f in self._manifest(v)["folders"].values()}
        for p, version in zip(entries[:-keep], names[:-keep]):
            for folder in self._manifest(version)["folders"].values():
                if folder not in used:
                    self._fs.delete(self._hadoop(f"{self.path}/{folder}"), True)
            if not any(f.startswith(version) for f in used):
                self._fs.delete(self._hadoop(f"{self.path}/{version}"), True)
            self._fs.delete(self._hadoop(f"{self.path}/{version}.json"), True)
            self._fs.delete(p, True)
        return max(0, len(entries) - keep)


class RecordStore(Store):
    """Records with a column per property, so that a condition reads the properties that it names and no others.

    The properties of a store are a vocabulary, not data; a version lists them.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS) -> None:
        super().__init__(spark, path, RECORDS, "id", parts)

    def _columns(self, df: DataFrame, known: list[str]) -> list[str]:
        met = {r[0] for r in df.select(F.explode(F.map_keys("props"))).distinct().collect()}  # the vocabulary
        return known + sorted(met - set(known))

    def _stored(self, columns: list[str]) -> str:
        return ", ".join(["id string", *(f"c{i} array<string>" for i in range(len(columns)))])

    def _packed(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return df.select("id", *[F.col("props")[p].alias(f"c{i}") for i, p in enumerate(columns)])

    def _unpacked(self, df: DataFrame, columns: list[str]) -> DataFrame:
        from ..operators.records import columns_view

        return columns_view(df, F.col("id"), {p: F.col(f"c{i}") for i, p in enumerate(columns)})
