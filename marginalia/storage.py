"""Shared storage: lineage cuts and table access.

Everything that has to survive the loss of an executor is written below the
folder named by ``spark.checkpoint.dir``.  A machine-local folder is used only
when the session names none and runs in local mode (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a finished execution where this is set, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whatever the scheme."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; sets one of its own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path for a table of the application's own folder; what is left there goes when the driver ends, on any file system."""
    folder = f"{shared_dir(spark)}/marginalia/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        fs, at = _file_system(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _folders.add(folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of the executions inside go as soon as each has ended: their results are written tables."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def persist_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage.

    The copy is durable, columnar and compressed, and later plans get its true
    size as statistics.  The schema is kept as it is, nullability aside.  The
    shuffles that made it are not kept beside it.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Delete tables made by :func:`persist_table` once nothing reads them any more."""
    for df in tables:
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if "/marginalia/" in path:
                fs, at = _file_system(df.sparkSession, path)
                fs.delete(at, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
