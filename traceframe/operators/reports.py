"""Report datasets; write them with any DataFrame sink, partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from traceframe import config


def _lines(name: str):
    return F.array_join(name, "\n").alias(name)


def task_spec(sections: DataFrame) -> DataFrame:
    return sections.select(
        "project", "code", "title", "purpose", *[_lines(c) for c in (
            "required_inputs", "components", "acceptance", "project_basis", "reference_basis", "missing_inputs")], "status")


def matrix_report(matrix: DataFrame) -> DataFrame:
    place = F.coalesce(F.nullif("source_page", F.lit(0)), F.col("source_line"))
    return matrix.select("project", "doc_id", "requirement_id", "category", "requirement", place.alias("source_place"), "target_section",
                         "response_strategy", "draft_status", F.when(F.col("human_check"), "是").otherwise("否").alias("human_check"))


def basis_report(files, facts, links, standards, clauses, assets) -> DataFrame:
    """Everything the work rests on, in one shape: kind, name, content, source, page,
    status, note."""
    used = facts.select("project", "path").unionByName(standards.select("project", "path")).distinct().withColumn("_used", F.lit(True))
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = lambda df, kind, name, content, source, p, status, note: df.select(
        "project", F.lit(kind).alias("kind"), name.alias("name"), content.alias("content"), source.alias("source"), p.alias("page"),
        status.alias("status"), note.cast("string").alias("note"))
    none = F.lit("")
    f = files.join(used, ["project", "path"], "left")
    out = row(f, "项目资料", F.col("name"), F.col("role"), F.col("path"), none,
              F.when(F.col("_used"), "已利用").otherwise("待利用/仅作为附件"), F.coalesce("sha256", none))
    out = out.unionByName(row(facts, "项目事实", F.col("key"), F.col("value"), F.col("path"), page("source_page"), F.col("status"), F.col("confidence")))
    target = F.concat_ws(" ", F.when(F.coalesce("target_page", F.lit(0)) != 0, F.concat(F.lit("第"), F.col("target_page").cast("string"), F.lit("页"))),
                         F.nullif("target_table", none))
    target = F.coalesce(F.nullif(target, none), F.lit("目标待定位"))
    answer = F.coalesce(*[F.nullif(c, none) for c in (F.col("resolved_value"), F.array_join("resolved_ids", "、"),
                                                       F.col("resolved_page").cast("string"), F.array_join(F.transform(
                                                           "resolved_pages", lambda p: p.cast("string")), "、"))], none)
    name = F.coalesce(F.nullif("fact_key", none), F.nullif("category", none), "kind")
    out = out.unionByName(row(links, "资料引用链", name, F.concat("source_excerpt", F.lit("\n→ "), target), F.col("path"), page("source_page"),
                              F.col("status"), answer))
    out = out.unionByName(row(standards, "规范标准", F.col("code"), F.col("title"), F.col("path"), page("source_page"), F.col("status"), F.col("official_url")))
    out = out.unionByName(row(clauses, "规范条款", F.concat_ws(" ", "standard_code", "clause_id"), F.col("text"), F.col("path"), page("page"),
                              F.col("verification_status"), F.col("mandatory_level")))
    return out.unionByName(row(assets, "案例资产", F.col("title"), F.col("reuse_rule"), F.col("source_path"), none, F.lit("可用"),
                               F.array_join("applicable_sections", "\n")))


def all_links(requirement_links: DataFrame, fact_links: DataFrame) -> DataFrame:
    """Both kinds of references in one shape."""
    return requirement_links.unionByName(fact_links, allowMissingColumns=True)


def standards_queue(standards: DataFrame, states=config.STANDARD_QUEUE) -> DataFrame:
    return standards.filter(F.col("status").isin(list(states))).select(
        "project", "code", "title", "source_page", "official_platform", "search_query", _lines("affected_sections"), "status")


def review_report(items: DataFrame) -> DataFrame:
    return items.select("project", "category", "title", "detail", "severity", _lines("affected_sections"), "status",
                        F.coalesce("recommended_action", F.lit("")).alias("recommended_action"), F.coalesce("resolution", F.lit("")).alias("resolution"))


def difference_report(differences: DataFrame) -> DataFrame:
    text = lambda c: (F.to_json(c) if differences.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(c)).alias(c)
    return differences.select("task", "primary_model", "review_model", text("primary_result"), text("review_result"), text("difference"), "status")
