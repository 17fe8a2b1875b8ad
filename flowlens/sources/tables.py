"""Small helpers around folders of Parquet files, through Spark and the file system that Spark uses."""

from __future__ import annotations

import gc
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table at ``path``, None if nothing was ever written there; any other failure is raised."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_row(spark: SparkSession, path: str, schema: T.StructType, *rows: tuple) -> None:
    """Adds rows to a log folder as one file: all of them are there, or none is."""
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _folder(spark, path)
    return fs.getContentSummary(p).getLength()


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of jobs that are done: its cleaner does when the driver's garbage is collected,
    of which a driver with much memory has little reason."""
    gc.collect()
    time.sleep(0.5)  # a thread of py4j lets go of what Python has dropped
    spark._jvm.System.gc()
