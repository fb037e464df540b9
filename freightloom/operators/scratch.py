"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that are deleted when the driver ends.
_LEAVING: set[str] = set()


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it; None where the driver's JVM can't be reached."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder(spark: SparkSession) -> str:
    """This application's folder inside the one that the cluster names in spark.checkpoint.dir.

    Where none is named, a temporary folder serves a local master; on a cluster ValueError is raised, because
    executors can't see each other's local folders. The folder is deleted when the driver ends.
    """
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        name = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", name)
    path = f"{name.rstrip('/')}/freightloom-{spark.conf.get('spark.app.id', 'session')}"
    if path not in _LEAVING and (found := _files(spark, path)):
        _LEAVING.add(path)
        found[0].mkdirs(found[1])
        found[0].deleteOnExit(found[1])
    return path


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


#: Spark's own setting for shuffle files to go when a query ends, not when the driver next collects its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows of `df`, written to a new table and read again: lineage ends there, a lost executor loses nothing, and
    the shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing unwritten reads any more; other data is left alone."""
    for df in tables:
        own = "/" + folder(df.sparkSession).rsplit("/", 1)[1] + "/"
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if own in f}:
            if found := _files(df.sparkSession, name):
                found[0].delete(found[1], True)
