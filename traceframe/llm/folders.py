"""The shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only local sessions that name none get one of their own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again. In loops of joins it takes the place of a checkpoint, which keeps the size
    that the optimizer expected: multiplied round by round, that number grows to millions of digits and stops the driver."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    # Shuffle files that only the write needed go as soon as the driver's JVM collects its garbage.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)
