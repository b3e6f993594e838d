"""Roles, duplicates and the choice of a project's main files.

A file row has ``project, path, name, suffix, sha256, role, confidence``. Files are ordered
by falling confidence, then name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceframe import config
from traceframe.functions.text import col, contains_any, file_suffix, strings
from traceframe.operators.keyed import number_by_range, salted_lookup, top_n


def _rank() -> Column:
    return F.struct((-F.col("confidence")).alias("c"), F.col("name").alias("n"), F.col("path").alias("p"))


def classify_role(name, kind, rules=config.ROLE_RULES) -> Column:
    """STRUCT<role, confidence, reason> of a file name; the first rule that fits wins."""
    name = col(name)
    plain = F.regexp_replace(F.lower(name), config.ROLE_STRIP, "")
    kind = col(kind) if isinstance(kind, (str, Column)) else F.lit(None)
    out = None
    for role, confidence, words, suffixes, needed in rules:
        hit = F.lit(True) if words is None else contains_any(plain, words)
        if suffixes:
            hit = hit | file_suffix(name).isin(suffixes)
        if needed is not None:
            hit = hit & (kind == needed)
        reason = "supporting document" if words is None else f"name matches {role}"
        value = F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def apply_role_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Roles set by people (``path, role``) replace the guessed ones."""
    chosen = overrides.select("path", F.col("role").alias("_role")).dropDuplicates(["path"])
    out = files.join(chosen, "path", "left")
    mine = F.col("_role").isNotNull()
    keep = [c for c in files.columns if c not in ("role", "confidence", "reason", "role_confirmed")]
    reason = F.col("reason") if "reason" in files.columns else F.lit("")
    return out.select(
        *keep, F.coalesce("_role", "role").alias("role"),
        F.when(mine, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(mine, "human confirmed role").otherwise(reason).alias("reason"), mine.alias("role_confirmed"))


def mark_duplicates(files: DataFrame, scope: list[str] = ("project",)) -> DataFrame:
    """Files with the digest of an earlier file of their project become its duplicates.
    Only digests that occur twice are joined back, and their copies are spread over tasks.
    Blank digests are never duplicates."""
    keys = [*scope, "sha256"]
    known = files.filter(F.coalesce("sha256", F.lit("")) != "")
    first = (
        known.groupBy(*keys).agg(F.min(_rank()).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select(*keys, F.col("_first.p").alias("_original"))
    )
    out = salted_lookup(files, first, keys, by=["path"])
    copy = F.coalesce(F.col("_original") != F.col("path"), F.lit(False))
    return out.withColumn("is_duplicate", copy).withColumn(
        "duplicate_of", F.when(copy, F.col("_original")).otherwise("")).drop("_original")


def infer_project(files: DataFrame, passed=config.PASSED_ALIASES, new=config.NEW_ALIASES) -> DataFrame:
    """Project folder and kind: the folder below the first path part that is an alias."""
    parts = F.split(F.lower("path"), "/")
    at = lambda names: F.array_min(F.filter(
        F.transform(strings(names), lambda a: F.array_position(parts, a)), lambda i: i > 0))
    both = at(list(passed) + list(new))
    kind = F.when(F.arrays_overlap(parts, strings(passed)), "passed_case").when(
        F.arrays_overlap(parts, strings(new)), "new_tender").otherwise("unknown")
    deep = both.isNotNull() & (F.size(parts) > both + 1)
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.when(deep, both + 1).otherwise(F.size(parts) - 1).cast("int")), "/")
    return files.withColumn("project_kind", kind).withColumn("project_dir", folder)


def select_primary(files: DataFrame, suffixes=config.PRIMARY_SUFFIXES) -> DataFrame:
    """Per project the tender, the accepted bid, the pipeline's tender and readiness.
    Missing files are nulls and a false ``ready``, not an error."""
    usable = files.filter(~F.col("is_duplicate"))
    best = lambda cond: F.min_by("path", F.when(cond, _rank()))
    role = F.col("role")
    roles = usable.groupBy("project", "project_kind").agg(
        best(role == "tender").alias("_tender"), best(role == "accepted_bid").alias("_bid"),
        best(role.isin("tender", "candidate_tender")).alias("pipeline_tender"))
    # two first primary documents: the second is needed when the first is the tender
    firsts = (
        top_n(usable.filter(file_suffix("name").isin(list(suffixes))), ["project"],
              [F.desc("confidence"), "name", "path"], 2, "_r")
        .groupBy("project").agg(F.max(F.when(F.col("_r") == 1, F.col("path"))).alias("_p1"),
                                F.max(F.when(F.col("_r") == 2, F.col("path"))).alias("_p2"))
    )
    out = files.select("project", "project_kind").distinct().join(roles, ["project", "project_kind"], "left").join(
        firsts, "project", "left")
    kind = F.col("project_kind")
    tender = F.when(kind == "new_tender", F.coalesce("_tender", "_p1")).otherwise(F.col("_tender"))
    out = out.withColumn("tender", tender)
    other = F.when(F.col("_p1").eqNullSafe(F.col("tender")), F.col("_p2")).otherwise(F.col("_p1"))
    out = out.withColumn("accepted_bid", F.when(kind == "passed_case", F.coalesce("_bid", other)).otherwise(F.col("_bid")))
    ready = F.when(kind == "passed_case", F.col("tender").isNotNull() & F.col("accepted_bid").isNotNull()).when(
        kind == "new_tender", F.col("tender").isNotNull()).otherwise(False)
    return out.select("project", "project_kind", "tender", "accepted_bid", "pipeline_tender", ready.alias("ready"))


def visual_candidates(files: DataFrame, roles=config.VISUAL_ROLES, suffixes=config.VISUAL_SUFFIXES) -> DataFrame:
    """Files for image analysis, with a job id counted per project in file order."""
    wanted = files.filter(~F.col("is_duplicate") & F.col("role").isin(list(roles)) & F.col("suffix").isin(list(suffixes)))
    numbered = number_by_range(wanted, ["project"], [F.desc("confidence"), F.asc("name"), F.asc("path")], "job_no")
    text = F.col("job_no").cast("string")
    return numbered.withColumn("job_id", F.concat(F.lit("visual-"), F.when(
        F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))).withColumn("status", F.lit("pending"))
