"""Whole flow on files: scan, analyse, write a run twice, read it back, learn cases."""

import pytest
from pyspark.sql import functions as F

from traceframe import config
from traceframe.plans import analyze as PL
from traceframe.sources import files as SF

TENDER = """本项目采用通过制评审，技术标必须响应
项目名称：某河道综合治理工程
计划总工期：180日历天。
质量目标：合格
施工执行《水利水电工程施工组织设计规范》SL 303-2017和《堤防工程施工规范》SL 260-2014。
安全文明施工必须满足要求
"""


@pytest.fixture()
def project(spark, tmp_path):
    root = tmp_path / "new_tenders" / "river"
    root.mkdir(parents=True)
    (root / "招标文件.txt").write_text(TENDER, encoding="utf-8")
    (root / "副本招标文件.txt").write_text(TENDER, encoding="utf-8")
    (root / "初步设计报告.txt").write_bytes(b"\xef\xbb\xbf" + "建设地点：浙江省\n质量目标：优良".encode())
    (root / "总平面图.dxf").write_text("x")
    (root / "outputs").mkdir()
    (root / "outputs" / "old.txt").write_text("x")
    files = SF.scan_files(spark, str(tmp_path)).withColumn("project", F.lit("river"))
    return tmp_path, files


def chapters(spark):
    rows = [("river", i + 1, c, t, "p", ["招标文件", "地质勘察"], ["c"], ["a"]) for i, (c, t, _) in enumerate(config.BLUEPRINT_GROUPS)]
    return spark.createDataFrame(rows, "project string, ord int, code string, title string, purpose string, required_inputs array<string>, components array<string>, acceptance array<string>")


def test_analysis_run(spark, project):
    root, scanned = project
    files = PL.describe_roles(scanned)
    assert files.count() == 4 and files.filter("is_duplicate").count() == 1
    text = SF.read_text_blocks(spark, str(root / "new_tenders"))
    blocks = text.withColumn("project", F.lit("river")).withColumn("doc_id", F.xxhash64("path"))
    projects = spark.createDataFrame([("river", "河道治理")], "project string, project_type string")
    t = PL.analyze(files, blocks, chapters(spark), projects)
    assert {r.code for r in t["standards"].collect()} == {"SL 303-2017", "SL 260-2014"}
    assert t["facts"].count() == 5 and t["conflicts"].count() == 1
    assert t["sections"].count() == 8
    m = t["metrics"].first()
    assert (m.requirement_count, m.standards_count, m.section_count, m.fact_count) == (t["requirements"].count(), 2, 8, 5)
    cats = {r.category for r in t["review"].collect()}
    assert {"资料冲突", "规范待下载", "资料缺失", "案例资产缺失", "章节输入缺失"} <= cats
    store = str(root / "store")
    PL.write_run({k: t[k] for k in ("requirements", "facts", "review")}, store, "r1")
    PL.write_run({k: t[k] for k in ("requirements", "facts", "review")}, store, "r1")
    PL.write_run({"facts": t["facts"].limit(1)}, store, "r2")
    back = PL.load_run(spark, store, "r1", ["facts", "review"])
    assert back["facts"].count() == 5 and back["review"].count() == t["review"].count()
    assert PL.load_run(spark, store, "r2", ["facts"])["facts"].count() == 1


def test_legacy_charset(spark, tmp_path):
    for name in ("javaCharsets", "codingErrorAction"):
        spark.conf.set(f"spark.sql.legacy.{name}", "true")
    try:
        (tmp_path / "a.txt").write_bytes("工期要求".encode("gb18030"))
        (tmp_path / "b.md").write_bytes("质量".encode() + b"\xff")
        rows = {r.path.rsplit("/", 1)[1]: r.text for r in SF.read_text_blocks(spark, str(tmp_path)).collect()}
    finally:
        for name in ("javaCharsets", "codingErrorAction"):
            spark.conf.set(f"spark.sql.legacy.{name}", "false")
    assert rows == {"a.txt": "工期要求", "b.md": "质量"}


def test_streams_resume(spark, tmp_path):
    """A second arrival only adds documents whose content is new."""
    from traceframe.streaming import incremental as IN

    src, store, res, mark = (str(tmp_path / n) for n in ("src", "store", "res", "mark"))
    schema = "project string, doc_id int, text string"
    extract = lambda df: df.groupBy("doc_id").agg(F.length(F.first("text")).alias("n"))
    for batch in ([("p", 1, "aa"), ("p", 2, "aa")], [("p", 3, "aa"), ("p", 4, "bbb")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        IN.ingest_stream(IN.file_stream(spark, src, schema, "*.parquet"), store, res, mark, extract).awaitTermination()
    assert sorted((r.doc_id, r.n) for r in spark.read.parquet(res).collect()) == [(1, 2), (4, 3)]


def test_job_timings_on_a_stream(spark, tmp_path):
    from traceframe.streaming import incremental as IN

    src = str(tmp_path / "jobs")
    rows = [(1, "queued", "2024-01-01 00:00:00"), (1, "running", "2024-01-01 00:01:00"), (1, "succeeded", "2024-01-01 00:05:00"), (2, "queued", "2024-01-01 00:00:30")]
    spark.createDataFrame(rows, "job_id int, status string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = IN.file_stream(spark, src, spark.read.parquet(src).schema, "*.parquet")
    q = IN.job_timings(stream).writeStream.outputMode("complete").format("memory").queryName("timings").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.job_id: (r.status, r.started_at is not None, r.finished_at is not None) for r in spark.table("timings").collect()}
    assert got == {1: ("succeeded", True, True), 2: ("queued", False, False)}
