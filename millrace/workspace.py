"""Paths that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a folder of our own in local mode (tests), an error elsewhere."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call gets; it goes when the session ends."""
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    atexit.register(delete_path, spark, path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path in any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_path(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may have ended
        fs, where = hadoop_path(spark, path)
        fs.delete(where, True)


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts lineage and survives lost executors. Without a compression it is the session's."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._millrace_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that is made of them is written too."""
    for df in tables:
        delete_path(df.sparkSession, df._millrace_path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file in any store, in place of what is there."""
    fs, where = hadoop_path(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """What write_text() has put there; it is small."""
    fs, where = hadoop_path(spark, path)
    held = fs.open(where)
    try:
        return bytes(held.readAllBytes()).decode()
    finally:
        held.close()
