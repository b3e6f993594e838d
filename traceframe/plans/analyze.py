"""Whole flows over many projects at once: analysing projects and learning cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from traceframe import config
from traceframe.operators import (
    cases as CA, drawings as DR, facts as FA, files as FI, outline as OL, requirements as RQ, review as RV, sections as SE,
    standards as ST,
)
from traceframe.operators.keyed import number_by_range, stable
from traceframe.operators.reports import all_links
from traceframe.sources.tables import write_table


def describe_roles(files: DataFrame, kind: str = "new_tender", rules=config.ROLE_RULES, overrides: DataFrame | None = None) -> DataFrame:
    """Scanned files (``project, path, name, suffix, sha256``) with role and duplicates."""
    out = files.withColumn("project_kind", F.lit(kind)).withColumn("_r", FI.classify_role("name", "project_kind", rules)).select(
        *files.columns, "project_kind", "_r.*")
    if overrides is not None:
        out = FI.apply_role_overrides(out, overrides)
    return FI.mark_duplicates(out)


def analyze(files: DataFrame, blocks: DataFrame, sections: DataFrame, projects: DataFrame, cases: DataFrame | None = None,
            project_type_reqs: bool = True, materialize=stable) -> dict[str, DataFrame]:
    """All tables of an analysis run, for every project in one go.

    files: from ``describe_roles``; blocks: located text of all files (``project, doc_id,
    path, block_ord, page, text``); sections: chapter list of each project (``project, ord,
    code, title, purpose, required_inputs, components, acceptance``); projects: ``project,
    project_type``. ``materialize`` is applied to tables that several others are made of."""
    usable = FA.analysable_files(files).select("project", "path")
    primary = FI.select_primary(files)
    tender = primary.filter("pipeline_tender is not null").select("project", F.col("pipeline_tender").alias("path"))
    tender_blocks = blocks.join(tender, ["project", "path"], "left_semi")
    fact_blocks = blocks.join(usable, ["project", "path"], "left_semi")

    reqs = materialize(RQ.extract_requirements(tender_blocks))
    req_links = RQ.resolve_requirement_links(materialize(RQ.requirement_links(RQ.requirement_candidates(tender_blocks), tender_blocks)), reqs)
    matrix = RQ.response_matrix(reqs)
    matches = materialize(FA.fact_matches(fact_blocks))
    mentions = materialize(FA.extract_facts(None, matches=matches))
    fact_links = materialize(FA.resolve_fact_links(FA.fact_links(matches), mentions))
    mentions = FA.apply_resolved_links(mentions, fact_links)
    facts = materialize(FA.merge_facts(mentions))
    links = all_links(req_links, fact_links)
    standards = materialize(ST.map_standard_sections(ST.extract_standards(tender_blocks), sections))
    conflicts = FA.detect_conflicts(facts)

    if cases is None:
        assets = reqs.select("project", F.lit("").alias("asset_id")).filter("false").select(
            "project", "asset_id", F.lit(0).alias("asset_ord"), F.lit("").alias("case_title"), F.lit("").alias("title"),
            F.lit("").alias("reuse_rule"), F.array().cast("array<string>").alias("applicable_sections"))
    else:
        found = materialize(CA.match_cases(projects, cases, reqs))
        assets = materialize(CA.load_case_assets(found, CA.case_assets(cases, wanted=found)))
    basis = SE.section_basis(sections, matrix, facts, standards, assets, "蓝图：水利工程施工组织设计标准蓝图 1.1")
    missing = SE.missing_inputs(sections, SE.evidence_texts(reqs, facts, standards))
    chapters = materialize(SE.build_sections(sections, basis, missing))
    names = files.filter("not is_duplicate" if "is_duplicate" in files.columns else "true").select(
        "project", "name", "path", "suffix", "role", "confidence")
    sides = number_by_range(names, ["project"], [F.desc("confidence"), F.asc("name"), F.asc("path")], "ord")
    dwg = sides.filter("suffix = '.dwg'").select("project", "ord", "name", "path")
    pdf = sides.filter("suffix = '.pdf' and role = 'drawing'").select("project", "ord", "name", "path")
    drawings, gaps = DR.pair_files(dwg, pdf)
    queue = RV.build_review_queue(projects, chapters, standards, conflicts, files, assets)
    extra = RV.reference_review_rows(links).drop("doc_id").unionByName(
        gaps.drop("source_path"), allowMissingColumns=True)
    review = queue.unionByName(extra, allowMissingColumns=True)
    metrics = RV.run_metrics(projects, files, reqs, SE.requirement_edges(matrix, sections), facts, standards, chapters, review, links)
    return {
        "files": files, "primary": primary, "requirements": reqs, "response_matrix": matrix, "facts": facts,
        "fact_mentions": FA.fact_mentions(mentions), "links": links, "standards": standards, "conflicts": conflicts, "assets": assets,
        "basis": basis, "sections": chapters, "drawings": drawings, "review": review, "metrics": metrics,
        "visual_jobs": FI.visual_candidates(files),
    }


def write_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Write every table of a run; a repeated write of the run replaces it."""
    for name, df in tables.items():
        write_table(df.withColumn("run_id", F.lit(run_id)), f"{root}/{name}")


def load_run(spark: SparkSession, root: str, run_id: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}").filter(F.col("run_id") == run_id) for n in names}


def ingest_cases(files: DataFrame, blocks: DataFrame, lexicon=config.REQUIREMENT_LEXICON, markers=config.MANDATORY_MARKERS,
                 categories=config.SCENE_CATEGORIES, default_outline=config.STANDARD_OUTLINE):
    """Learn all case folders at once. Returns cases (one row per folder that has a tender
    and an accepted bid, with counts), their terms and snippets, and folders that lack one."""
    primary = stable(FI.select_primary(files))
    ready = primary.filter("ready")
    of = lambda c: blocks.join(ready.select("project", F.col(c).alias("path")), ["project", "path"], "left_semi")
    tender, bid = of("tender"), of("accepted_bid")
    patterns = OL.case_patterns(tender, bid, lexicon, categories)
    outline = OL.extract_outline(bid, default=default_outline)
    reqs = RQ.extract_requirements(tender, lexicon, markers, located=False)
    size = lambda df, name: df.groupBy("project").agg(F.count(F.lit(1)).alias(name))
    chars = lambda df, name: df.groupBy("project").agg(F.sum(F.length("text")).alias(name))
    out = ready.select("project", "tender", "accepted_bid")
    for part in (chars(tender, "tender_chars"), chars(bid, "bid_chars"), size(outline, "outline_count"), size(reqs, "requirement_count"),
                 size(patterns["scene_terms"], "scene_term_count"), size(patterns["snippets"], "snippet_count")):
        out = out.join(part, "project", "left")
    out = out.fillna(0)
    rejected = primary.filter("not ready").select("project", F.when(F.col("tender").isNull(), "no_tender").otherwise("no_accepted_bid").alias("reason"))
    return {"cases": out, "scene_terms": patterns["scene_terms"], "snippets": patterns["snippets"], "outline": outline, "rejected": rejected}
