"""Session settings and the shared scratch folder.

Lineage is cut by written tables in the folder that the cluster names in ``spark.checkpoint.dir``; all executors
share it, so a lost executor costs a re-read, never a recomputation from moved row numbers.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def local_session(name: str = "quadloom", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUADLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else its checkpoint folder; a temporary one only where it is one machine."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context_dir.isDefined():
        return context_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quadloom-")
    return "file://" + _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: computed once, safe to read many times."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_dir(spark)}/quadloom-{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out.quadloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read from it any more."""
    path = getattr(df, "quadloom_path", None)
    if path is not None:
        _written[:] = [x for x in _written if x[1] != path]
        _delete(df.sparkSession, path)


def drop_scratch() -> None:
    """Remove what ``materialize`` wrote; results that still read from it must have been written before."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass


@atexit.register
def _at_exit() -> None:
    drop_scratch()
    if _own_dir is not None:
        shutil.rmtree(_own_dir, ignore_errors=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quadloom-code-")
    packed = shutil.make_archive(os.path.join(folder, "quadloom"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(packed)
    _shipped.add(app)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, so that extra input columns never clash with ours."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
