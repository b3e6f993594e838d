"""Streams over several batches: bounded state, touched buckets only, jobs ended by the stream itself."""

import datetime as dt
import os

from pyspark.sql import functions as F

from traceframe.operators import runs as RU
from traceframe.sources import tables as ST
from traceframe.streaming import incremental as IN


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


def files_of(path):
    return {os.path.join(root, f) for root, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_ingest_forgets_by_watermark_and_never_reads_the_store(spark, tmp_path):
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    schema = "project string, doc_id int, text string, seen timestamp"
    extract = lambda df: df.groupBy("doc_id").agg(F.length(F.first("text")).alias("n"))
    batches = [
        [("p", 1, "aa", at(0)), ("p", 2, "aa", at(1)), ("p", 3, None, at(1))],
        [("p", 4, "aa", at(3)), ("p", 5, "bbb", at(4)), ("p", 6, None, at(4)), ("p", 7, "cccc", at(1))],  # a repeated file, a late one
        [("p", 8, "ddddd", at(60))],
        [("p", 9, "aa", at(61)), ("p", 10, "bbb", at(20))],  # forgotten by now; behind the watermark
    ]
    kept, sizes = [], []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        store, results = (str(tmp_path / f"{n}{i}") for n in ("store", "results"))  # earlier stores are out of reach
        q = IN.ingest_stream(IN.file_stream(spark, src, schema, "*.parquet"), store, results, mark, extract, "seen", "10 hours")
        q.awaitTermination()
        kept.append(sorted(r.doc_id for r in spark.read.parquet(results).collect()))
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert kept == [[1, 3], [5, 7], [8], [9]]
    assert sizes == [2, 4, 1, 2]  # the four contents of the first day are gone when the watermark has passed them


def review_rows(spark, rows):
    return spark.createDataFrame(
        [(c, t, "d", ["s"], s, o, at(h)) for c, t, s, o, h in rows],
        "category string, title string, detail string, affected_sections array<string>, status string, ord long, seen timestamp")


def test_review_state_rewrites_touched_buckets_only(spark, tmp_path):
    state = str(tmp_path / "state")
    first = review_rows(spark, [("c", f"t{i}", "open", i, 0) for i in range(300)])
    assert len(IN.review_batch(first, 0, state, buckets=32)) == 32
    before = files_of(state)
    one = review_rows(spark, [("c", "t7", "resolved", 400, 1), ("c", "t7", "open", 401, 1)])
    touched = IN.review_batch(one, 1, state)
    assert len(touched) == 1
    new = files_of(state) - before
    assert new and all(f"bucket={touched[0]}/" in f for f in new)
    now = {r.title: (r.status, r.ord) for r in IN.review_state(spark, state).collect()}
    assert len(now) == 300 and now["t7"] == ("resolved", 7) and now["t8"] == ("open", 8)
    # A repeated batch replaces itself.
    assert IN.review_batch(one, 1, state) == touched
    assert {r.title: (r.status, r.ord) for r in IN.review_state(spark, state).collect()} == now
    # Two versions stay readable, older ones go.
    assert {r.status for r in ST.read_keyed(spark, state, 0).filter("title = 't7'").collect()} == {"open"}
    for i in (2, 3):
        IN.review_batch(review_rows(spark, [("c", "t7", "resolved", 500 + i, 2)]), i, state)
    assert len([p for p in os.listdir(f"{state}/rows/bucket={touched[0]}") if p.startswith("version=")]) == 2


def test_review_state_expires_closed_items(spark, tmp_path):
    state = str(tmp_path / "state")
    IN.review_batch(review_rows(spark, [("c", "old", "resolved", 1, 0), ("c", "waiting", "open", 2, 0), ("c", "new", "resolved", 3, 90)]), 0, state, buckets=1)
    IN.review_batch(review_rows(spark, [("c", "next", "open", 4, 100)]), 1, state, stamp="seen", keep="2 days")
    assert {r.title for r in IN.review_state(spark, state).collect()} == {"waiting", "new", "next"}
    assert IN.expire_review(spark, state, "seen", at(95)) == [0]
    assert {r.title for r in IN.review_state(spark, state).collect()} == {"waiting", "next"}
    assert IN.expire_review(spark, state, "seen", at(95)) == []


def test_stream_ends_silent_jobs_by_itself(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "job_id int, status string, ts timestamp"
    batches = [
        [(1, "queued", at(0)), (1, "running", at(0, 5)), (2, "queued", at(0)), (2, "running", at(0, 10))],
        [(1, "succeeded", at(3)), (3, "queued", at(4))],
        [(3, "running", at(9)), (4, "queued", at(11))],
        [(4, "failed", at(12)), (2, "running", at(14)), (5, "queued", at(30))],
    ]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        q = IN.job_sessions(IN.file_stream(spark, src, schema, "*.parquet"), "6 hours", "1 hour").writeStream.trigger(availableNow=True).option(
            "checkpointLocation", mark).outputMode("append").format("parquet").start(out)
        q.awaitTermination()
        seen.append(sorted((r.job_id, r.status, r.interrupted, r.started_at is not None) for r in spark.read.schema(
            "job_id int, status string, interrupted boolean, started_at timestamp").parquet(out).collect()))
    assert seen[:2] == [[], []]
    assert seen[2] == [(1, "succeeded", False, True), (2, "failed", True, True)]  # job 2 was silent
    assert seen[3] == sorted([*seen[2], (2, "failed", True, True), (3, "failed", True, True), (4, "failed", False, False)])
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # only job 5 is remembered


def test_upsert_reads_and_replaces_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    assert RU.upsert_into(path, rows, ["k"], buckets=16) == list(range(16))
    before = files_of(path)
    updates = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (5000, "c", 1)], "k long, v string, at int")
    touched = RU.upsert_into(path, updates, ["k"], order="at")
    assert len(touched) <= 2
    new = files_of(path) - before
    assert {f.split("bucket=")[1].split("/")[0] for f in new} == {str(b) for b in touched}
    out = {r.k: r.v for r in ST.read_keyed(spark, path).collect()}
    assert len(out) == 1001 and out[5] == "b" and out[5000] == "c" and out[6] == "old"


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "keyed")
    RU.upsert_into(path, spark.createDataFrame([(1, "x")], "k long, v string"), ["k"], buckets=4)
    boom = lambda old, own: own.withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    try:
        ST.merge_keyed(spark.createDataFrame([(1, "y")], "k long, v string"), path, ["k"], boom)
    except Exception as e:
        assert "stop" in str(e)
    assert [(r.k, r.v) for r in ST.read_keyed(spark, path).collect()] == [(1, "x")]


def test_latest_run_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "runs")
    ST.write_table(spark.range(100).select((F.col("id") % 11).alias("run_id"), "id"), path)
    df = ST.read_runs(spark, path, latest=True)
    assert {r.run_id for r in df.collect()} == {10}
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in scan and "Aggregate" not in scan and "Join" not in scan
    assert scan.count("Scan") == 1
    ST.write_table(spark.createDataFrame([("a b/ü", 1), ("a", 2)], "run_id string, x int"), str(tmp_path / "names"))
    assert [r.x for r in ST.read_runs(spark, str(tmp_path / "names"), latest=True).collect()] == [1]
