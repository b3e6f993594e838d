"""Registered queries: a Spark callable per name and, where SQL can say it, an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LARGE = {"documents", "pages", "conversations", "orders", "lineitem", "events"}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. One file may be a single row group, which only one task can read; a
    table with fewer files than cores is spread by its first column, a larger one is left."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in LARGE and len(df.inputFiles()) < cores:
        return df.repartition(cores, df.columns[0])
    return df
