"""Review queue, release gate, metrics and progress of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceframe import config
from traceframe.functions.text import compact_text, strings  # noqa: F401
from traceframe.operators.keyed import in_order, salted_lookup, top_n

FIELDS = ["category", "title", "detail", "severity", "affected_sections", "status", "recommended_action"]


def _item(category, title, detail, severity, sections, action) -> list[Column]:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [as_col(category).alias("category"), as_col(title).alias("title"), as_col(detail).alias("detail"),
            as_col(severity).alias("severity"), sections.alias("affected_sections"), F.lit("open").alias("status"),
            as_col(action).alias("recommended_action")]


def one_per_conflict(conflicts: DataFrame) -> DataFrame:
    """A conflict of many values comes in numbered parts; it is one item with all of them."""
    if "part" not in conflicts.columns:
        return conflicts
    return conflicts.groupBy("project", "key", *[c for c in FIELDS if c != "detail"]).agg(
        F.array_join(in_order(F.col("detail"), F.col("part")), "；").alias("detail"))


def build_review_queue(projects: DataFrame, sections: DataFrame, standards: DataFrame, conflicts: DataFrame, files: DataFrame,
                       assets: DataFrame, labels=config.MISSING_ROLE_LABELS) -> DataFrame:
    """Open items of every project: conflicts, standards to fetch, missing file roles, no
    case assets, chapters without input. ``sections`` has ``missing_inputs`` and
    ``required_inputs``; a project's chapters are few."""
    std = standards.filter("status = 'pending_download'").select("project", *_item(
        "规范待下载", F.concat(F.lit("缺少规范原文："), "code"), F.col("title"), "medium", F.col("affected_sections"),
        F.concat(F.lit("从"), "official_platform", F.lit("下载并上传原文。"))))
    roles = projects.select("project", F.explode(F.array(*[F.struct(
        F.lit(r).alias("role"), F.lit(label).alias("label"), F.lit(sev).alias("severity")) for r, label, sev in labels])).alias("r")).select(
        "project", "r.*")
    gone = roles.join(files.select("project", "role").distinct(), ["project", "role"], "left_anti")
    short = sections.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("ord", "title", F.array_join(
        "required_inputs", " ").alias("inputs")))).alias("_s"))
    part = F.filter("_s", lambda s: F.exists(F.split("label", "或"), lambda p: F.contains(s["inputs"], p)))
    role_rows = gone.join(short, "project", "left").withColumn("_hit", F.slice(F.transform(part, lambda s: s["title"]), 1, 6)).select(
        "project", *_item("资料缺失", F.concat(F.lit("未识别到"), "label"), "系统无法完成相应项目事实、工程量或图纸引用核验。", F.col("severity"),
                          F.coalesce("_hit", strings([])), F.concat(F.lit("补充上传"), "label", F.lit("并重新分析。"))))
    bare = projects.select("project").join(assets.select("project").distinct(), "project", "left_anti").select("project", *_item(
        "案例资产缺失", "当前没有可用的公司已通过成品", "本次任务书采用受控水利通用蓝图，不引用历史案例措辞或参数。", "medium",
        strings([config.GLOBAL_SECTION]), "导入1—2套招标文件与已通过技术标案例后重新建立任务。"))
    gaps = sections.filter(F.size("missing_inputs") > 0).select("project", *_item(
        "章节输入缺失", F.concat("title", F.lit("尚缺输入")), F.array_join("missing_inputs", "、"), "medium", F.array("title"),
        "补充资料或人工确认后再生成正式正文。"))
    return one_per_conflict(conflicts).select("project", *FIELDS).unionByName(std).unionByName(role_rows).unionByName(bare).unionByName(gaps)


def reference_review_rows(links: DataFrame) -> DataFrame:
    """Review rows for references whose target was not found."""
    page = F.when(F.coalesce("target_page", F.lit(0)) != 0, F.concat(F.lit("第"), F.col("target_page").cast("string"), F.lit("页")))
    target = F.concat_ws(" ", page, F.nullif("target_table", F.lit("")))
    target = F.coalesce(F.nullif(target, F.lit("")), F.lit("未明确位置"))
    fact = F.col("kind") == "fact_reference"
    subject = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("fact_key", "category") if c in links.columns], F.lit("招标要求"))
    return links.filter("status <> 'resolved'").select("project", "doc_id", *_item(
        F.when(fact, "项目事实引用待解析").otherwise("招标要求引用待解析"), F.concat(F.lit("未找到引用目标："), subject),
        F.concat("source_excerpt", F.lit("；指向："), target, F.lit("。系统未把引用语当作实际项目值。")),
        F.when(fact, "high").otherwise("medium"), strings(["编制说明及工程概况"]), "核对目标页或附表名称，补充可检索文件后重新分析。"))


def dedupe_review(items: DataFrame, key=("category", "title", "detail", "affected_sections"), order: str = "ord",
                  scope: list[str] = ()) -> DataFrame:
    """One row per item: the first that is no longer open, else the first; at the place of
    the first. ``chosen_ord`` keeps the place of the row taken, so that results of several
    parts can be merged again. Partial aggregation keeps one row per item and task."""
    keys = [*scope, *key]
    if "chosen_ord" not in items.columns:
        items = items.withColumn("chosen_ord", F.col(order))
    rest = [c for c in items.columns if c not in keys and c != order]
    rank = F.struct((F.col("status") == "open").cast("int"), F.col("chosen_ord"))
    return items.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"), F.min(order).alias(order)).select(*keys, "_r.*", order)


def release_gate(runs: DataFrame, sections: DataFrame, review: DataFrame, differences: DataFrame,
                 blocking=config.BLOCKING_CATEGORIES) -> DataFrame:
    """Why a run must not go on, one row per reason; a run without rows may. runs:
    ``run_id, file_roles_confirmed, status``."""
    row = lambda df, name: df.select("run_id", F.lit(name).alias("violation")).distinct()
    out = row(runs.filter(~F.coalesce("file_roles_confirmed", F.lit(False))), "roles_unconfirmed")
    out = out.unionByName(row(runs.filter("status = 'visual_analysis_pending'"), "visual_analysis_pending"))
    out = out.unionByName(row(runs.join(sections.select("run_id").distinct(), "run_id", "left_anti"), "no_sections"))
    bad = (F.trim(F.coalesce("title", F.lit(""))) == "") | (F.size("components") <= 0) | (F.size("acceptance") <= 0)
    out = out.unionByName(row(sections.filter(bad), "incomplete_section"))
    high = F.col("category").isin(list(blocking)) & (F.col("severity") == "high") & (F.col("status") == "open")
    out = out.unionByName(row(review.filter(high), "open_conflict"))
    return out.unionByName(row(differences.filter("status = 'open'"), "open_model_difference"))


def resolve_review(items: DataFrame, standards: DataFrame, drawings: DataFrame, decisions: DataFrame,
                   states=config.REVIEW_STATES) -> DataFrame:
    """Close items for which evidence came: an attached standard whose code is in the
    title, a drawing whose PDF was linked, a person's decision (``item_id, status,
    resolution``). standards: ``project, code, path``; drawings: ``project, source_path``."""
    code = F.regexp_replace(F.regexp_extract("title", "^缺少规范原文：(.*)$", 1), " ", "")
    std = standards.select("project", F.regexp_replace("code", " ", "").alias("_code"), F.col("path").alias("_path")).groupBy(
        "project", "_code").agg(F.min("_path").alias("_path"))
    pdf = drawings.select("project", F.col("source_path")).distinct().withColumn("_linked", F.lit(True))
    own = top_n(decisions.filter(F.col("status").isin(list(states))), ["item_id"], [F.desc("decided_at")]).select(
        "item_id", F.col("status").alias("_status"), F.col("resolution").alias("_resolution"))
    out = items.withColumn("_code", F.when(F.col("category") == "规范待下载", code)).join(std, ["project", "_code"], "left")
    out = out.join(pdf, ["project", "source_path"], "left").join(own, "item_id", "left")
    drawn = F.coalesce("_linked", F.lit(False)) & (F.col("category") == "图纸待转换")
    status = F.when(F.col("_status").isNotNull(), F.col("_status")).when(F.col("_path").isNotNull() | drawn, "resolved").otherwise(F.col("status"))
    note = F.coalesce("_resolution", "_path", F.when(drawn, "已关联图纸PDF"), F.lit(""))
    return out.withColumn("status", status).withColumn("resolution", note).drop("_code", "_path", "_linked", "_status", "_resolution")


def refresh_review(items: DataFrame, categories: list[str], fresh: DataFrame) -> DataFrame:
    """Rows of the given categories make room for newly computed ones."""
    return items.filter(~F.col("category").isin(list(categories))).unionByName(fresh, allowMissingColumns=True)


def issue_rows(issues: DataFrame, category: str = "最终文字复核") -> DataFrame:
    """Accepted model issues as review rows; unknown severities count as medium."""
    severity = F.when(F.col("severity").isin("low", "medium", "high"), F.col("severity")).otherwise("medium")
    sections = F.when(F.size("affected_sections") > 0, F.col("affected_sections")).otherwise(strings([config.GLOBAL_SECTION]))
    return issues.select("project", *_item(category, F.coalesce("title", F.lit("文字一致性问题")), F.coalesce("detail", F.lit("")), severity, sections,
                                           "对照项目证据和招标要求修订后重新复核。"))


def percent(part: Column, whole: Column, empty: int) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100).cast("int")).otherwise(empty)


def run_metrics(runs: DataFrame, files, reqs, edges, facts, standards, sections, review, links, by: str = "project") -> DataFrame:
    """Counters and percentages of each run. ``edges`` are the requirements mapped to
    chapters (``project, requirement``). ``high_risks`` counts all high items,
    ``open_high_risks`` those still open."""
    count = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    texts = reqs.select(by, F.trim("requirement").alias("_r")).filter("_r <> ''").distinct()
    mapped = edges.select(by, F.trim("requirement").alias("_r")).distinct()
    parts = [
        count(reqs, "requirement_count"), texts.join(mapped, [by, "_r"], "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("_covered")),
        count(files, "file_count"), count(facts, "fact_count"),
        standards.groupBy(by).agg(F.count(F.lit(1)).alias("standards_count"),
                                  F.count_if(F.col("status").isin(config.STANDARD_READY)).alias("standards_ready")),
        sections.groupBy(by).agg(F.count(F.lit(1)).alias("section_count"), F.bround(F.avg("completion")).cast("int").alias("chapter_completion")),
        review.groupBy(by).agg(F.count_if(F.col("status") == "open").alias("open_confirmations"),
                               F.count_if(F.col("severity") == "high").alias("high_risks"),
                               F.count_if((F.col("severity") == "high") & (F.col("status") == "open")).alias("open_high_risks")),
        links.groupBy(by).agg(F.count(F.lit(1)).alias("reference_link_count"),
                              F.count_if(F.col("status") == "resolved").alias("reference_link_resolved")),
    ]
    out = runs.select(by)
    for part in parts:
        out = out.join(part, by, "left")
    out = out.fillna(0, [c for c in out.columns if c != by])
    return out.select(
        by, "requirement_count", F.least(F.lit(100), percent(F.col("_covered"), F.col("requirement_count"), 0)).alias("requirement_coverage"),
        "file_count", "fact_count", "standards_count", "standards_ready",
        percent(F.col("standards_ready"), F.col("standards_count"), 100).alias("standards_readiness"), "section_count", "chapter_completion",
        "open_confirmations", "high_risks", "open_high_risks", "reference_link_count", "reference_link_resolved",
        percent(F.col("reference_link_resolved"), F.col("reference_link_count"), 100).alias("reference_link_readiness"))


def progress(sections: DataFrame, by: str = "run_id") -> DataFrame:
    """Drafting progress per run: finished, successful, failed, mean completion and the
    share of approved chapters."""
    ok, bad = F.col("status") == "generated", F.col("status") == "blocked"
    return sections.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok | bad).alias("completed"), F.count_if(ok).alias("successful"),
        F.count_if(bad).alias("failed"), F.bround(F.avg("completion")).cast("int").alias("chapter_completion"),
        F.bround(F.count_if(ok) / F.count(F.lit(1)) * 100).cast("int").alias("approved_percent"),
        F.when(F.count_if(ok) == F.count(F.lit(1)), "ready_for_assembly").otherwise("generating").alias("status"))


def contract_violations(df: DataFrame, contract: dict, key: str) -> DataFrame:
    """Rows that break a contract: a required field is null, or a value is not allowed. A
    missing required column is reported once per row."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) if c in df.columns else F.lit(f"{c}: no column") for c in contract["required"]]
    for c, values in contract["enums"].items():
        if c in df.columns:
            checks.append(F.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit("null")))))
    return df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def section_outcomes(sections: DataFrame, results: DataFrame, by: str = "run_id"):
    """Apply drafting results (``run_id, code, ok, content, error, human_items``): new
    chapter rows, a log, review rows for items a person has to confirm, failed runs. Of several results of a chapter the
    successful one with the greatest text counts."""
    rest = [c for c in results.columns if c not in (by, "code")]
    results = results.groupBy(by, "code").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("ok", F.lit(False)), F.coalesce("content", F.lit("")), F.coalesce(
        "error", F.lit("")))).alias("_r")).select(by, "code", "_r.*")
    rows = sections.join(results, [by, "code"], "left")
    done = F.col("ok").isNotNull()
    chapters = rows.select(
        *[c for c in sections.columns if c not in ("status", "completion")],
        F.when(F.col("ok"), "generated").when(done, "blocked").otherwise(F.col("status")).alias("status"),
        F.when(F.col("ok"), 100).otherwise(F.col("completion")).alias("completion"),
        F.when(F.col("ok"), F.col("content")).when(done, F.concat(F.lit("【待人工确认：本章模型生成失败，原因："), F.coalesce(
            "error", F.lit("")), F.lit("】"))).alias("content"))
    log = rows.filter(done).select(by, "code", F.col("title").alias("section"), F.when(F.col("ok"), "success").otherwise("failed").alias("status"),
                                   F.coalesce("error", F.lit("")).alias("error"))
    review = rows.filter("ok").select(by, "title", F.explode("human_items").alias("_d")).select(by, *_item(
        "模型生成待确认", F.concat("title", F.lit("待确认")), F.col("_d"), "medium", F.array("title"), "补充项目资料或人工确认后重新生成本章。"))
    failed = results.groupBy(by).agg(F.count_if("ok").alias("_n"), F.min_by("error", F.when(~F.col("ok"), F.col("code"))).alias("first_error"))
    return chapters, log, review, failed.filter("_n = 0").select(by, "first_error")
