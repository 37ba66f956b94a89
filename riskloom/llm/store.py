"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table below ``spark.checkpoint.dir`` and reading it again, so a lost
executor costs a re-read and never a recomputation of the whole chain.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary folder is set once."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return context.getCheckpointDir().rstrip("/")


def write_table(df: DataFrame) -> str:
    """Write the rows below the shared folder and return the path."""
    path = f"{shared_folder(df.sparkSession)}/riskloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has written, once nothing reads them any more; how many there were."""
    jvm, count = spark._jvm, len(_made)
    while _made:
        target = jvm.org.apache.hadoop.fs.Path(_made.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return count


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df))
