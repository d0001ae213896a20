"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    own = getattr(spark.sparkContext, "_vellum_tables", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext._vellum_tables = "file://" + tempfile.mkdtemp(prefix="vellum-tables-")
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/vellum/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: its lineage ends there, and no lost executor takes it along."""
    spark, path = frame.sparkSession, new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found._vellum_path = path
    return found


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "_vellum_path", None):
            delete_path(frame.sparkSession, path)


def full_uri(spark: SparkSession, path: str) -> str:
    """A path with the scheme by which the session finds it, as readers outside the JVM want it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, none if there is no such folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(jpath) if s.isDirectory()) if files.exists(jpath) else []
