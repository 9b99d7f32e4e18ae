"""Where intermediate results go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all runs in one process (tests), a temporary one.

    On a cluster without that setting it is an error, as executors would write where no other sees it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder: later jobs read the files, also after an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet at the path, read again; unlike what `stored` leaves, it can be removed."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of the file system that Spark would take."""
    files, where = _at(spark, path)
    return files.makeQualified(where).toString()


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table at the path was written to its end."""
    files, where = _at(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete what is at the paths, if there is anything."""
    for path in paths:
        files, where = _at(spark, path)
        files.delete(where, True)
