"""The cluster's shared folder, and files by Hadoop's file systems: what the driver lists, executors and other drivers see too."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, or in a private one where none is set and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends, and its size is known."""
    df.write.parquet(path := shared_folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a glob names, by path; none if a folder is missing."""
    fs, at = _at(spark, pattern)
    return sorted(x.getPath().toString() for x in fs.globStatus(at) or [])


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new small file, whole or not at all; False if the name is taken. Of several writers, one wins."""
    jvm = spark._jvm
    fs, at = _at(spark, path)
    _, part = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:  # a rename that does not replace
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(part, at, none)
    except Exception:
        if fs.exists(at):
            return False
        raise
    finally:
        fs.delete(part, False)
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    if not exists(spark, path):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def deleted(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
