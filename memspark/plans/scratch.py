"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and runs on one machine.
LOCAL_DIR = "/tmp/checkpoints/memspark"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path; what is left there goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(base or LOCAL_DIR).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df, written out and read again: steps that use it twice don't compute it twice, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
