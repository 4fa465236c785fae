"""Intermediate tables that outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set a local session (tests) takes a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if given := spark.conf.get("spark.checkpoint.dir", None):
            sc.setCheckpointDir(given)
        elif not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def durable_at(df: DataFrame) -> tuple[DataFrame, str]:
    """durable(), and the folder of the table, for forget()."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a table of durable_at() that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """Written as a table to the shared folder and read from there: lost executors cost no recomputation, what was dealt out
    stays as it was, and Spark knows the table's size."""
    return durable_at(df)[0]
