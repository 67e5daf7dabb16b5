"""Cutting lineage in shared storage, so that lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names.

    Where it names none, one temporary folder serves a local session; on a cluster,
    whose machines would each write to a disk of their own, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="textwarden-")
        named = _OWN_DIRS[app]
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once as a table and go on from there.

    Compared with a checkpoint of the same rows, a table also tells the optimizer how
    large it is, so a join may broadcast it when, and only when, it is small.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def let_go(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut_lineage` has written and that nothing unwritten is derived from any more.

    Shuffle files behind written tables are garbage as well; Spark deletes them once the driver
    collects its own, which a driver with little to do may put off for very long. So it is asked to.
    """
    for table in tables:
        delete_folder(table.sparkSession, _PATHS.pop(table))
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def hadoop_path(spark: SparkSession, path: str):
    """The file system that Spark would use for a path, and the path on it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_folder(spark: SparkSession, path: str) -> bool:
    files, place = hadoop_path(spark, path)
    return files.delete(place, True)
