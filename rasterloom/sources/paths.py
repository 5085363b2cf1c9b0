"""Files on Spark's filesystems, and folders for intermediate results that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def filesystem(spark: SparkSession, path: str):
    """(filesystem, path) in Hadoop's terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver's JVM ends.

    Where that isn't set, one under /tmp in local mode; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file:///tmp/checkpoints/{os.getuid()}"
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    fs, where = filesystem(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in a folder of ``scratch``."""
    path = f"{scratch(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
