"""Tables written to the folder that driver and executors share, in place of lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_lock = threading.Lock()
_writers: dict[int, int] = {}
_before: dict[int, str | None] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for a local master, else one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-vw-", dir="/tmp")
        return _local[app]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cuts"


def cuts_dir(spark: SparkSession) -> str:
    """The folder of this application's tables, in the shared one."""
    return f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str) -> str:
    """Where ``df`` is written: a folder of its own. Its shuffle files, which nobody reads again, go when it is written."""
    spark = df.sparkSession
    path = f"{cuts_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    return path


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting holds while any thread writes; the first one in sets it, the last one out puts back what was there."""
    key = spark._jsparkSession.hashCode()
    with _lock:
        if not _writers.get(key):
            _before[key] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writers[key] = _writers.get(key, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _writers[key] -= 1
            if not _writers[key]:
                del _writers[key]
                before = _before.pop(key)
                if before is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and read it back: computed once, the same for every reader, safe from lost executors.

    What is read back carries no partitioning, so that joins on it shuffle both
    sides and AQE may split a hot key.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, tag))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def drop_cut(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote; only when all that reads it has itself been written."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/cuts-{df.sparkSession.sparkContext.applicationId}/" in folder:
            _delete(df.sparkSession, folder)


def clear_cuts(spark: SparkSession) -> None:
    """Delete the tables that this application has written so far; call it when their results have been stored."""
    _delete(spark, cuts_dir(spark))
