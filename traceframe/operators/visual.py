"""Answers of an image model as data: merged batches, facts, conflicts, review need."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from traceframe.functions.text import parse_json_answer, safe_int
from traceframe.operators.keyed import in_order, top_n

ITEM = "STRUCT<key: STRING, value: STRING, unit: STRING, page: STRING, figure: STRING, excerpt: STRING, confidence: DOUBLE, field: STRING>"
ANSWER = (
    f"document_summary STRING, facts ARRAY<{ITEM}>, conflicts ARRAY<{ITEM}>, "
    "tables ARRAY<STRING>, drawings ARRAY<STRUCT<drawing_no: STRING, title: STRING, page: STRING, confidence: DOUBLE>>, "
    "needs_human_review ARRAY<STRING>"
)


def parse_results(results: DataFrame, answer: str = "answer") -> DataFrame:
    """Parsed page batches: ``project, job_id, source_path, source_name, batch_no,
    page_offset`` plus the answer's fields and the parse status."""
    keep = [c for c in results.columns if c != answer]
    return results.select(*keep, parse_json_answer(answer, ANSWER).alias("p")).select(*keep, "p.parse_status", "p.value.*")


def image_page(name, fallback):
    digits = F.regexp_extract(name, r"page-(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), fallback)


def _shifted(page, offset, batch: int):
    number = safe_int(page, "first")
    return F.when((number <= batch) & (offset != 0), number + offset).otherwise(number)


def model_items(parsed: DataFrame, field: str, most: int, batch: int = 8) -> DataFrame:
    """Items of one field over all batches of a job in order, cut to ``most`` per job, with
    the page counted over the whole file."""
    key = ["project", "job_id", "source_path", "source_name"]
    rows = parsed.select(*key, "batch_no", "page_offset", F.posexplode(field).alias("item_no", "i"))
    first = top_n(rows, ["project", "job_id"], ["batch_no", "item_no"], most)
    return first.select(*key, "batch_no", "item_no", "page_offset", "i.*").withColumn(
        "page", _shifted("page", F.col("page_offset"), batch).cast("int")).drop("page_offset")


def model_facts(parsed: DataFrame, existing: DataFrame, most: int = 200) -> DataFrame:
    """New facts from answers: with key and value, not known yet at that place, each once."""
    rows = model_items(parsed, "facts", most).withColumn("key", F.trim("key")).withColumn("value", F.trim("value"))
    rows = rows.filter("key <> '' and value <> ''")
    place = ["project", "key", "value", "source_path", "source_page"]
    rows = rows.withColumn("source_page", F.col("page"))
    once = top_n(rows, place, ["job_id", "batch_no", "item_no"])
    known = existing.select(*place).distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place]
    new = once.alias("a").join(known.alias("b"), same, "left_anti")
    return new.select(
        "project", "job_id", "key", "value", F.coalesce("unit", F.lit("")).alias("unit"), "source_path", "source_page",
        F.coalesce("figure", F.lit("")).alias("source_figure"), F.coalesce("excerpt", F.lit("")).alias("source_excerpt"),
        F.greatest(F.lit(0.0), F.least(F.coalesce("confidence", F.lit(0.5)), F.lit(1.0))).alias("confidence"),
        F.lit("extracted").alias("status"))


def model_conflicts(parsed: DataFrame, most: int = 50) -> DataFrame:
    rows = model_items(parsed, "conflicts", most)
    detail = F.to_json(F.struct("field", "key", "value", "page"))
    return rows.select(
        "project", "job_id", F.lit("视觉资料冲突").alias("category"),
        F.concat("source_name", F.lit("："), F.coalesce("field", F.lit("识别结果冲突"))).alias("title"), detail.alias("detail"),
        F.lit("high").alias("severity"), F.lit("open").alias("status"))


def model_summary(parsed: DataFrame, least: float = 0.75, limit: int = 1200) -> DataFrame:
    """Per job: joined summaries, number of facts, and whether a person has to look. The
    batches of a job are the page groups of one file."""
    low = F.exists(F.coalesce("facts", F.array()), lambda f: F.coalesce(f["confidence"], F.lit(1.0)) < least)
    open_ = (F.size(F.coalesce("conflicts", F.array())) > 0) | (F.size(F.coalesce("needs_human_review", F.array())) > 0)
    text = F.when(F.trim("document_summary") != "", F.trim("document_summary"))
    return parsed.groupBy("project", "job_id").agg(
        F.substring(F.array_join(F.array_compact(in_order(text, F.col("batch_no"))), "；"), 1, limit).alias("document_summary"),
        F.sum(F.coalesce(F.size("facts"), F.lit(0))).cast("bigint").alias("fact_count"),
        F.max(open_ | low).alias("needs_review"))
