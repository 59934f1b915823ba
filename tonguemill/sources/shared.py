"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master gets a temporary folder; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tonguemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's readers report it."""
    store, at = _hadoop(spark, path)
    return store.makeQualified(at).toString()


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder that nothing reads any more."""
    store, at = _hadoop(spark, path)
    store.delete(at, True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small ASCII file; False where there is one of that name."""
    from py4j.protocol import Py4JJavaError

    store, at = _hadoop(spark, path)
    try:
        out = store.create(at, False)
    except Py4JJavaError:
        if store.exists(at):
            return False
        raise
    try:
        out.writeBytes(text)
    finally:
        out.close()
    return True


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: what is read twice is computed once, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
