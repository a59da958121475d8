"""The session surface: records, quads and files in one folder, asked and changed through one object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions import terms as T
from .operators import records as R
from .operators.criteria import Criteria
from .plans.compiler import Dataset
from .sources import files as FS
from .sources import quads as Q
from .sources.store import QUADS, RecordStore, Store

FILES = "name string, content binary, size bigint, md5 string, mime string"
#: Property of a resource that only the engine sets: where its file is.
STORED_AS = "http://www.w3.org/ns/stored#as"


class Engine:
    """Stores below ``folder``: one of records per type, one of quads by predicate, one of files. Changes make a new version
    each and rewrite the parts that they touch."""

    def __init__(self, spark: SparkSession, folder: str, namespaces: dict[str, str] | None = None) -> None:
        self.spark, self.folder, self.namespaces = spark, folder.rstrip("/"), dict(namespaces or {})
        self.closed = False

    def _records(self, kind: str) -> RecordStore:
        if self.closed:
            raise RuntimeError("the session is closed")
        return RecordStore(self.spark, f"{self.folder}/records/{kind}")

    @property
    def quads(self) -> Store:
        return Store(self.spark, f"{self.folder}/quads", QUADS, key="p")

    @property
    def files(self) -> Store:
        return Store(self.spark, f"{self.folder}/files", FILES)

    def condition(self, text: str, arguments: list | None = None) -> Column:
        return paths.condition(text, self.namespaces, arguments)

    # records
    def count(self, kind: str, condition: str | None = None, arguments: list | None = None) -> int:
        return self.retrieve(kind, condition, arguments).count()

    def retrieve(self, kind: str, condition: str | None = None, arguments: list | None = None, ids: list[str] | None = None, props: list[str] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
        tests = [self.condition(condition, arguments)] if condition else []
        keys = None if ids is None else self._ids(ids)
        return R.retrieve(self._records(kind).read(keys), tests, keys, props, offset, limit)

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _own(self, new: DataFrame) -> DataFrame:
        return R.clear(new, [STORED_AS])

    def create(self, kind: str, new: DataFrame) -> DataFrame:
        return self._records(kind).change(lambda old: R.create(R.present(old), self._own(new)), keys=new)

    def merge(self, kind: str, new: DataFrame, criteria: str | None) -> DataFrame:
        rule = Criteria.parse(criteria, self.namespaces) if criteria else None
        return self._records(kind).change(lambda old: R.merge(R.present(old), self._own(new), rule), keys=new)

    def update(self, kind: str, condition: str, patch: dict[str, list[str]], criteria: str = "overwrite *", arguments: list | None = None) -> DataFrame:
        rule = Criteria.parse(criteria, self.namespaces)
        test = self.condition(condition, arguments)
        return self._records(kind).change(lambda old: R.update(R.present(old), test, patch, rule), where=test)

    def delete(self, kind: str, condition: str | None = None, ids: list[str] | None = None, arguments: list | None = None) -> DataFrame:
        if ids is not None:
            gone = self._ids(ids)
            return self._records(kind).change(lambda old: R.delete_ids(R.present(old), gone), keys=gone)
        test = self.condition(condition, arguments) if condition else F.lit(True)
        return self._records(kind).change(lambda old: R.delete(R.present(old), test), where=test)

    def link(self, resources: str, mentions: str, has: str, of: str) -> None:
        """Bring the links of resources into line with what mentions point to."""
        points = R.present(self._records(mentions).read())
        self._records(resources).change(lambda old: R.link_inverses(R.present(old), points, has, of))

    def match(self, left: str, right: str, link: str) -> DataFrame:
        return R.match(R.present(self._records(left).read()), R.present(self._records(right).read()), link)

    # quads
    def sparql(self, text: str, bindings: dict[str, str] | None = None) -> DataFrame:
        return Dataset(self.quads.read()).query(text, self.namespaces, bindings)

    def add(self, new: DataFrame) -> None:
        self.quads.change(lambda old: Q.add_quads(old, new), keys=new)

    def remove(self, gone: DataFrame) -> None:
        self.quads.change(lambda old: Q.remove_quads(old, gone), keys=gone)

    def dump(self, kinds: list[str], path: str) -> None:
        """The records of several types as one file of quads."""
        out = None
        for kind in kinds:
            part = R.encode(R.present(self._records(kind).read()))
            out = part if out is None else out.unionByName(part)
        Q.write_nquads(out if out is not None else Q.empty_quads(self.spark), path)

    # files
    def upload(self, kind: str, files: DataFrame) -> None:
        """Store (name, content) and note it on the resource of that id, which is made where it is missing."""
        self.files.change(lambda old: FS.upload(old, files), keys=files)
        note = files.select(F.col("name").alias("id"), F.create_map(F.lit(STORED_AS), F.array(T.literal(F.col("name")))).alias("props"))
        self._records(kind).change(lambda old: R.merge(R.present(old), note, Criteria.parse("overwrite *"))[0], keys=note)

    def download(self, name: str, accept: str | None = None) -> DataFrame:
        return FS.download(self.files.read(), name, accept)

    def close(self) -> None:
        self.closed = True
