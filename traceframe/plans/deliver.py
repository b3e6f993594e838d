"""The last flow: gate, drafts, audit and delivery tables, for every run at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from traceframe.functions.text import strings
from traceframe.operators import audit as AU, requirements as RQ, review as RV
from traceframe.operators.keyed import stable

RUN = ["project", "run_id"]


def audited_drafts(drafts: DataFrame, sections: DataFrame, facts: DataFrame, clauses: DataFrame, matrix: DataFrame,
                   materialize=stable):
    """Drafted chapters (``project, run_id, code, content``) as they may be assembled, and what a person has to confirm.

    A repeated chapter heading, code fences and drawn diagrams go, numbers and citations without evidence are blocked in prose and
    tables, and the trace of the chapter's basis is added. A claim is backed by requirements and basis of its own chapter, and by
    facts and verified clauses of the project. Each step is materialised, as the next one reads it several times."""
    keys = [*RUN, "code"]
    named = drafts.join(sections.select(*keys, "title"), keys)
    bare = named.select(*keys, AU.clean_structure(AU.strip_duplicate_heading("content", "title")).alias("text"))
    plain = materialize(AU.drop_ascii_diagrams(bare, keys))
    own = matrix.select("project", F.col("section_code").alias("code"), F.col("requirement").alias("text")).unionByName(
        sections.select("project", "code", F.explode("project_basis").alias("text")))
    common = facts.select("project", F.concat_ws("", "key", "value", "unit").alias("text")).unionByName(clauses.select("project", "text"))
    claims = materialize(AU.checked_claims(plain, keys, facts, clauses, own, common=common))
    cells = materialize(AU.checked_tables(claims.select(*keys, "text"), keys, facts))
    traced = cells.select(*keys, "text").join(sections.select(*keys, "project_basis", "reference_basis", "missing_inputs"), keys).select(
        *keys, AU.append_trace("text", "project_basis", "reference_basis", "missing_inputs").alias("text"))
    return traced, AU.claim_findings(claims, keys).select(*keys, "finding").unionByName(AU.table_findings(cells, keys).select(*keys, "finding"))


def deliver(runs: DataFrame, sections: DataFrame, results: DataFrame, review: DataFrame, differences: DataFrame, facts: DataFrame,
            clauses: DataFrame, matrix: DataFrame, materialize=stable) -> dict[str, DataFrame]:
    """All tables of a delivery.

    runs: ``project, run_id, file_roles_confirmed, status``; sections: ``project, run_id, ord, code, title, components, acceptance,
    project_basis, reference_basis, missing_inputs, status, completion``; results: ``run_id, code, ok, content, error, human_items`` as a
    model returned them; review and differences with ``run_id``; facts: ``project, key, value, unit``; clauses: ``project, standard_code,
    clause_id, text, verification_status``; matrix: a response matrix with ``project, doc_id, requirement_id, requirement, section_code``.

    Runs that the gate holds back get their reasons and nothing else. Returns violations, drafts, sections, log, review (new items),
    failed runs, coverage and its summary, the matrix with its states, and progress."""
    violations = materialize(RV.release_gate(runs, sections, review, differences))
    released = runs.join(violations.select("run_id").distinct(), "run_id", "left_anti").select(*RUN)
    chapters = materialize(sections.join(released, RUN, "left_semi"))
    mine = results.join(released, "run_id")
    empty = F.coalesce("ok", F.lit(False)) & (F.trim(F.coalesce("content", F.lit(""))) == "")
    mine = materialize(mine.withColumn("error", F.when(empty, "空正文").otherwise(F.col("error"))).withColumn("ok", F.coalesce("ok", F.lit(False)) & ~empty))
    drafts, findings = audited_drafts(mine.filter("ok").select(*RUN, "code", "content"), chapters, facts, clauses, matrix, materialize)
    drafts = materialize(drafts)
    noted = findings.groupBy("run_id", "code").agg(F.array_sort(F.collect_set("finding")).alias("_found"))  # of one chapter
    done = mine.drop("content", "project").join(drafts.select("run_id", "code", F.col("text").alias("content")), ["run_id", "code"], "left").join(
        noted, ["run_id", "code"], "left")
    done = done.withColumn("human_items", F.concat(F.coalesce("human_items", strings([])), F.coalesce("_found", strings([])))).drop("_found")
    finished, log, items, failed = RV.section_outcomes(chapters, done)
    asked = matrix.join(released.select("project").distinct(), "project", "left_semi")
    covered = materialize(AU.coverage(asked, drafts.select("project", "text")))
    missing = asked.join(covered.filter("NOT covered").select("project", "requirement_id"), ["project", "requirement_id"], "left_semi")
    return {
        "violations": violations, "drafts": drafts, "sections": finished, "log": log, "review": items, "failed": failed, "coverage": covered,
        "coverage_summary": AU.coverage_summary(covered, AU.draft_placeholders(drafts)), "matrix": RQ.apply_coverage(asked, missing),
        "progress": RV.progress(finished),
    }
