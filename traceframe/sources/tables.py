"""Tables on Parquet: run tables (replace one run, read one run or the latest) and keyed tables that are updated by bucket."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from traceframe.operators.keyed import checkpoint_folder


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads, in order; none when there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def write_table(df: DataFrame, path: str, by: str = "run_id", files_by: list[str] | None = None) -> None:
    """Write rows of one or more runs; former rows of exactly these runs are replaced, so
    a repeated write leaves one copy. Rows are gathered by run, where adaptive execution joins small runs and splits a
    large one into several files."""
    rows = df.repartition(*files_by) if files_by else df.hint("rebalance", by)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def append_table(df: DataFrame, path: str, by: str | None = None, stamp: str | None = "created_at") -> None:
    rows = df.withColumn(stamp, F.current_timestamp()) if stamp else df
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def with_row_id(df: DataFrame, keys: list[str], out: str = "id") -> DataFrame:
    """Row id from natural keys; no counter that all tasks would share."""
    return df.withColumn(out, F.xxhash64(*keys))


def newest_run(spark: SparkSession, path: str, by: str = "run_id"):
    """The largest run id, from the names of the run folders alone; no file is opened."""
    ids = [n.split("=", 1)[1] for n in folder_names(spark, path) if n.startswith(f"{by}=")]
    kind = spark.read.parquet(path).schema[by].dataType
    values = spark.createDataFrame([(i,) for i in ids], "id string").select(F.url_decode("id").cast(kind).alias("id"))
    return values.agg(F.max("id")).first()[0]


def read_runs(spark: SparkSession, path: str, run_id=None, latest: bool = False, by: str = "run_id") -> DataFrame:
    """All runs, one run, or the one with the largest id; of a single run only its folder is read."""
    df = spark.read.parquet(path)
    if run_id is None and latest:
        run_id = newest_run(spark, path, by)
    if run_id is not None:
        df = df.filter(F.col(by) == F.lit(run_id))
    return normalize_status(df) if "status" in df.columns else df


def normalize_status(df: DataFrame, legacy: str = "resolved_reference", current: str = "extracted") -> DataFrame:
    return df.withColumn("status", F.when(F.col("status") == legacy, current).otherwise(F.col("status")))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- keyed tables ---------------------------------------------------------------------
#
# <path>/rows/bucket=<b>/version=<v>/*.parquet   the rows of a bucket, as written by version v
# <path>/manifest/<v>.json                       which version of each bucket is valid after version v
#
# A version becomes visible with its manifest, so that a failed or repeated write changes nothing. One writer at a time.


def _manifest_name(version: int) -> str:
    return f"{version:019d}.json"


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict | None:
    """The newest manifest, or the newest one of an earlier version than ``before``: version, buckets, keys, schema, valid."""
    names = [n for n in folder_names(spark, f"{path}/manifest") if before is None or n < _manifest_name(before)]
    if not names:
        return None
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest/{names[-1]}").first()[0])


def _save_manifest(spark: SparkSession, path: str, state: dict) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{_manifest_name(state['version'])}")
    part = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{uuid.uuid4().hex}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(part, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    files.mkdirs(at.getParent())
    files.delete(at, False)
    files.rename(part, at)


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    """Remove manifests older than the newest ``keep`` and the bucket versions that only they name."""
    names = folder_names(spark, f"{path}/manifest")
    old, kept = names[:-keep], names[-keep:]
    valid = lambda n: set(json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest/{n}").first()[0])["valid"].items())
    needed = set().union(*map(valid, kept))
    jvm = spark.sparkContext._jvm
    for name in old:
        for bucket, version in valid(name) - needed:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/rows/bucket={bucket}/version={version}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read_versions(spark: SparkSession, path: str, state: dict, buckets: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    paths = [f"{path}/rows/bucket={b}/version={state['valid'][b]}" for b in buckets if b in state["valid"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a keyed table, now or after an earlier version that is still kept."""
    state = manifest(spark, path, None if version is None else version + 1)
    return _read_versions(spark, path, state, list(state["valid"]))


def merge_keyed(
    updates: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64,
    version: int | None = None, keep: int = 2,
) -> list[int]:
    """Merge rows into a keyed table and return the buckets that were written; all others are neither read nor rewritten.

    ``merge`` gets the old rows of the touched buckets (None for a new table) and the updates, and returns their new rows.
    The number of buckets is fixed by the first write. A repeated ``version`` replaces itself; the newest ``keep`` versions
    stay readable, what only older ones need is removed."""
    spark = updates.sparkSession
    state = manifest(spark, path, version)
    if state is None:
        state = {"version": -1, "buckets": buckets, "keys": keys, "valid": {}}
    if state["keys"] != keys:
        raise ValueError(f"the table is keyed by {state['keys']}")
    number = state["version"] + 1 if version is None else version
    given = updates.withColumn("bucket", _bucket(keys, state["buckets"]))
    touched = sorted(r[0] for r in given.select("bucket").distinct().collect())  # at most as many rows as buckets
    old = _read_versions(spark, path, state, [str(b) for b in touched]) if "schema" in state else None
    rows = merge(old, updates)
    state["schema"] = json.loads(rows.schema.json())
    # Where a merge leaves no row of a bucket, the bucket is gone.
    written = rows.withColumn("bucket", _bucket(keys, state["buckets"])).withColumn("version", F.lit(number).cast("bigint"))
    written.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{path}/rows")
    for b in touched:
        if f"version={number}" in folder_names(spark, f"{path}/rows/bucket={b}"):
            state["valid"][str(b)] = number
        else:
            state["valid"].pop(str(b), None)
    _save_manifest(spark, path, {**state, "version": number})
    _forget(spark, path, keep)
    return touched
