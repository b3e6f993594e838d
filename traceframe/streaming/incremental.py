"""Incremental ingest, review state and job timings.

State is bounded by watermarks or by the buckets a batch touches; nothing reads what earlier batches stored as a whole.
Every micro-batch is written under its batch number, so that a repeated batch replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from traceframe.operators.keyed import stable
from traceframe.operators.review import dedupe_review
from traceframe.operators.runs import latest
from traceframe.sources.tables import manifest, merge_keyed, read_keyed

REVIEW_KEY = ("category", "title", "detail", "affected_sections")


def file_stream(spark: SparkSession, folder: str, schema, file_glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder; ``folder`` may be a pattern, which also names a single file."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def new_documents(stream: DataFrame, arrived: str | None = None, keep: str = "30 days") -> DataFrame:
    """Documents whose content (``sha256`` of the text) has not arrived within ``keep`` before; of several in one batch any one.

    ``arrived`` is a column with the arrival time, by default the time of the batch. Spark keeps one hash per content in its state
    store until the watermark has passed it by ``keep``; rows that arrive later than that behind the newest ones are dropped, which the
    default time excludes."""
    at = F.col(arrived) if arrived else F.current_timestamp()
    hashed = stream.withColumn("sha256", F.sha2("text", 256)).withColumn("arrived_at", at)
    return hashed.withWatermark("arrived_at", keep).dropDuplicatesWithinWatermark(["sha256"])


def arrived_documents(stream: DataFrame, arrived: str | None = None, keep: str = "30 days") -> DataFrame:
    """All rows of a stream, with ``_new`` rows beside them that name the contents (``sha256`` only) of ``new_documents``."""
    rows = stream.withColumn("sha256", F.sha2("text", 256)).withColumn("arrived_at", F.col(arrived) if arrived else F.current_timestamp())
    return rows.withColumn("_new", F.lit(False)).unionByName(
        new_documents(stream, arrived, keep).select("sha256", F.lit(True).alias("_new")), allowMissingColumns=True)


def first_copies(batch: DataFrame, order: list[str]) -> DataFrame:
    """Of each new content in a batch of ``arrived_documents`` the whole row that is first in ``order``, in one pass with partial
    aggregation, whatever the number of copies."""
    columns = [c for c in batch.columns if c != "_new"]
    own = lambda *names: F.when(~F.col("_new"), F.struct(*names))
    first = batch.groupBy("sha256").agg(F.bool_or("_new").alias("_new"), F.min_by(own(*columns), own(*order)).alias("_row"))
    return first.filter("_new").select("_row.*")


def ingest_batch(new: DataFrame, batch_id: int, store: str, extract, results: str) -> None:
    """Store the new documents of one micro-batch and run ``extract`` (DataFrame to DataFrame) over them only."""
    rows = stable(new.withColumn("batch_id", F.lit(batch_id).cast("long")))  # the state is advanced once for both writes
    _write(rows, store)
    _write(extract(rows).withColumn("batch_id", F.lit(batch_id).cast("long")), results)


def ingest_stream(
    stream: DataFrame, store: str, results: str, checkpoint: str, extract, arrived: str | None = None, keep: str = "30 days",
    order: list[str] | None = None
) -> StreamingQuery:
    """Process all waiting files and stop; call again, or set another trigger, for more. With ``order`` the first of several copies
    in a batch is kept, otherwise any one."""
    rows = arrived_documents(stream, arrived, keep) if order else new_documents(stream, arrived, keep)
    return (
        rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, i: ingest_batch(first_copies(df, order) if order else df, i, store, extract, results)).start()
    )


def review_batch(
    batch: DataFrame, batch_id: int, state: str, key=REVIEW_KEY, buckets: int = 64, stamp: str | None = None, keep: str | None = None
) -> list[int]:
    """Merge a micro-batch of review events into the state, a keyed table: only the buckets of its items are read and written.

    With ``stamp`` (a time of the events) and ``keep``, items closed for longer than ``keep`` before the newest event of the batch leave
    the buckets that are written; ``expire_review`` does so for all."""
    def merge(old, items):
        both = dedupe_review(items if old is None else old.unionByName(items), key)
        if stamp is None or keep is None:
            return both
        newest = items.agg(F.max(stamp).alias("_newest"))
        gone = (F.col("status") != "open") & (F.col(stamp) < F.col("_newest") - F.expr(f"interval {keep}"))
        return both.join(F.broadcast(newest), how="cross").filter(~F.coalesce(gone, F.lit(False))).drop("_newest")  # one row

    items = stable(dedupe_review(batch, key))
    return merge_keyed(items, state, list(key), merge, buckets, batch_id)


def expire_review(spark: SparkSession, state: str, stamp: str, before) -> list[int]:
    """Remove items closed before the given time; only buckets that hold such items are rewritten."""
    now = manifest(spark, state)
    key = now["keys"]
    gone = (F.col("status") != "open") & (F.col(stamp) < F.lit(before).cast("timestamp"))
    old = read_keyed(spark, state).filter(gone)
    return merge_keyed(old, state, key, lambda rows, _: rows.filter(~F.coalesce(gone, F.lit(False))))


def review_stream(stream: DataFrame, state: str, checkpoint: str, **options) -> StreamingQuery:
    return (
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, i: review_batch(df, i, state, **options) and None).start()
    )


def review_state(spark: SparkSession, state: str) -> DataFrame:
    """The newest version of the review state."""
    return read_keyed(spark, state)


def job_timings(events: DataFrame, as_of=None, patience: str = "1 day") -> DataFrame:
    """Start, end and final state of each job from its status changes (``job_id, status,
    ts``); works on a batch and on a stream. With ``as_of`` a job that has been silent for
    longer than ``patience`` without an end counts as interrupted."""
    ended = F.col("status").isin("succeeded", "failed")
    out = events.groupBy("job_id").agg(
        F.min("ts").alias("created_at"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("finished_at"), F.max_by("status", "ts").alias("status"),
        F.max("ts").alias("updated_at"))
    if as_of is None:
        return out
    silent = F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {patience}")
    lost = silent & ~F.col("status").isin("succeeded", "failed")
    return out.withColumn("interrupted", lost).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def job_sessions(events: DataFrame, patience: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Start, end and final state of each job from a stream of status changes (``job_id, status, ts``), without a fixed time to compare with.

    The changes of a job up to a silence of ``patience`` are one session. When the watermark (the newest change less ``late``) has passed
    its end, the stream itself emits the job, as interrupted if it had no end, and forgets it; a job that speaks again later is a
    new session. Hot jobs are combined in the map tasks."""
    ended = F.col("status").isin("succeeded", "failed")
    out = events.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", patience).alias("_w")).agg(
        F.min("ts").alias("created_at"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("finished_at"), F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated_at"))
    lost = ~F.col("status").isin("succeeded", "failed")
    return out.drop("_w").withColumn("interrupted", lost).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def newest_jobs(jobs: DataFrame) -> DataFrame:
    return latest(jobs, ["job_id"], "updated_at")
