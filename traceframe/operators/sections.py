"""Chapters: blueprint, basis, missing inputs, completion, task definition, evidence packs.

A project has a short chapter list (tens of rows), which travels as one array per project;
requirements, facts and standards may be many and are joined to it with their key spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceframe import config
from traceframe.functions.text import canonical_title, clean_title, compact_text, file_name, lookup, ordered_distinct, strings
from traceframe.operators.keyed import in_order, number_rows, salted_lookup, counted_pairs, top_n
from traceframe.operators.requirements import best_title

TITLE_CHARS = "[一-鿿A-Za-z0-9]"


def closest_template(titles: DataFrame, templates: DataFrame, on: list[str] = ("project",), title: str = "title") -> DataFrame:
    """Template with most shared letters and digits; the first template if none is shared."""
    on = list(on)
    values = titles.select(*on, title).distinct()
    best = best_title(values, templates.withColumnRenamed("title", "_template"), on, title, "_template", "ord", TITLE_CHARS)
    first = templates.groupBy(*on).agg(F.min_by("title", "ord").alias("_first"))
    out = salted_lookup(values.join(best, [*on, title], "left"), first, on)
    return out.select(*on, title, F.coalesce("matched_title", "_first").alias("template"))


def build_blueprint(projects: DataFrame, base: DataFrame, groups: DataFrame, modules: DataFrame,
                    module_section: str = config.BLUEPRINT_MODULE_SECTION) -> DataFrame:
    """Chapter groups of each project's blueprint.

    projects: ``project, project_type, blueprint``; base: ``blueprint, code, title, purpose,
    required_inputs, components, acceptance``; groups: ``blueprint, ord, code, title,
    members``; modules: ``blueprint, ord, key, title``. Modules whose key occurs in the
    project type add their title to the components of ``module_section``."""
    member = groups.select("blueprint", F.col("ord").alias("gord"), F.col("code").alias("gcode"), F.col("title").alias("gtitle"),
                           F.posexplode("members").alias("mord", "code"))
    parts = member.join(base.drop("title"), ["blueprint", "code"])
    group = parts.groupBy("blueprint", "gord", "gcode", "gtitle").agg(
        F.array_sort(F.collect_list(F.struct("mord", "code", "purpose", "required_inputs", "components", "acceptance"))).alias("m"))
    rows = group.groupBy("blueprint").agg(F.array_sort(F.collect_list(F.struct("gord", "gcode", "gtitle", "m"))).alias("_groups"))
    extra = modules.groupBy("blueprint").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "title"))).alias("_modules"))
    row = rows.join(extra, "blueprint", "left")
    out = salted_lookup(projects, row, ["blueprint"], "inner", by=["project"])
    hits = F.transform(
        F.filter(F.coalesce("_modules", F.array().cast("array<struct<ord:int,key:string,title:string>>")),
                 lambda m: F.contains(F.col("project_type"), m["key"])), lambda m: m["title"])
    out = out.withColumn("_hits", hits).select("project", "_hits", F.explode("_groups").alias("g"))
    flat = lambda name: F.array_distinct(F.flatten(F.transform("g.m", lambda m: m[name])))
    components = F.array_distinct(F.flatten(F.transform("g.m", lambda m: F.when(
        m["code"] == module_section, F.concat(m["components"], F.col("_hits"))).otherwise(m["components"]))))
    purpose = F.concat(F.array_join(F.transform("g.m", lambda m: F.rtrim(F.regexp_replace(m["purpose"], "。+$", ""))), "；"), F.lit("。"))
    own = F.exists("g.m", lambda m: m["code"] == module_section)
    return out.select(
        "project", F.col("g.gord").alias("ord"), F.col("g.gcode").alias("code"), F.col("g.gtitle").alias("title"),
        purpose.alias("purpose"), flat("required_inputs").alias("required_inputs"), components.alias("components"),
        flat("acceptance").alias("acceptance"), F.when(own, F.col("_hits")).otherwise(strings([])).alias("special_modules"),
        F.transform("g.m", lambda m: m["code"]).alias("member_codes"))


def _chapters(sections: DataFrame) -> DataFrame:
    return sections.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("ord", "code", "title"))).alias("_sections"))


def section_edges(items: DataFrame, sections: DataFrame, fits, by: list[str]) -> DataFrame:
    """Rows of ``items`` with each chapter of their project that ``fits(chapter)`` accepts."""
    joined = salted_lookup(items, _chapters(sections), ["project"], "inner", by=by)
    return joined.withColumn("_s", F.explode(F.filter("_sections", fits))).select(
        *items.columns, F.col("_s.code").alias("section_code"), F.col("_s.title").alias("section_title"))


def requirement_edges(matrix: DataFrame, sections: DataFrame, aliases=config.SECTION_ALIASES) -> DataFrame:
    """Requirements under their chapters: the canonical target equals the title or contains
    one of its parts. Chapters are found once per distinct target."""
    targets = matrix.select("project", "target_section").distinct()
    name = canonical_title("target_section", aliases)
    edges = section_edges(targets, sections, lambda s: (s["title"] == name) | F.exists(
        F.split(s["title"], "、"), lambda t: F.contains(name, t)), ["target_section"])
    lists = edges.groupBy("project", "target_section").agg(F.collect_list("section_code").alias("_codes"))
    return salted_lookup(matrix, lists, ["project", "target_section"], "inner", by=["doc_id", "req_no"]).withColumn(
        "section_code", F.explode("_codes")).drop("_codes")


def _fact_words(words, default) -> Column:
    out = None
    for key, values in words.items():
        out = F.when(F.col("key") == key, strings(values)) if out is None else out.when(F.col("key") == key, strings(values))
    return strings(default) if out is None else out.otherwise(strings(default))


def fact_edges(facts: DataFrame, sections: DataFrame, words=config.FACT_SECTION_WORDS, default=config.FACT_SECTION_DEFAULT) -> DataFrame:
    """Facts under the chapters whose title has one of the words of their key."""
    wanted = _fact_words(words, default)
    return section_edges(facts, sections, lambda s: F.exists(wanted, lambda w: F.contains(s["title"], w)), ["key", "norm"])


def section_basis(sections, matrix, facts, standards, assets=None, blueprint: str = "", aliases=config.SECTION_ALIASES,
                  fact_words=config.FACT_SECTION_WORDS, fact_default=config.FACT_SECTION_DEFAULT,
                  limits=(8, 8, 8, 3), anywhere: str = config.GLOBAL_SECTION) -> DataFrame:
    """What each chapter rests on, as edges ``project, section_code, side, kind, ord, item``.
    The first rows per chapter and kind are kept, pruned before the shuffle."""
    key = ["project", "section_code"]
    req = requirement_edges(matrix, sections, aliases)
    req = top_n(req.select(*key, "doc_id", "req_no", F.col("requirement").alias("item")), key, ["doc_id", "req_no"], limits[0], "ord")
    fac = fact_edges(facts, sections, fact_words, fact_default)
    text = F.concat("key", F.lit("："), "value", F.coalesce("unit", F.lit("")))
    fac = top_n(fac.select(*key, "first_seen", "key", "norm", text.alias("item")), key, ["first_seen", "key", "norm"], limits[1], "ord")
    std = section_edges(standards, sections, lambda s: F.array_contains("affected_sections", s["title"]), ["doc_id", "code"])
    std = top_n(std.select(*key, "doc_id", "line_no", "match_ord", F.concat_ws(" ", "code", "title").alias("item")), key,
                ["doc_id", "line_no", "match_ord"], limits[2], "ord")
    pick = lambda df, side, kind: df.select(*key, F.lit(side).alias("side"), F.lit(kind).alias("kind"), "ord", "item")
    out = pick(req, "project", "requirement").unionByName(pick(fac, "project", "fact"))
    if blueprint:
        out = out.unionByName(sections.select("project", F.col("code").alias("section_code"), F.lit("reference").alias("side"),
                                              F.lit("blueprint").alias("kind"), F.lit(1).alias("ord"), F.lit(blueprint).alias("item")))
    out = out.unionByName(pick(std, "reference", "standard"))
    if assets is not None:
        ass = section_edges(assets, sections, lambda s: F.array_contains("applicable_sections", anywhere) | F.array_contains(
            "applicable_sections", s["title"]), ["asset_id"])
        line = F.concat(F.lit("案例资产："), "case_title", F.lit(" / "), "title", F.lit("（"), "reuse_rule", F.lit("）"))
        ass = top_n(ass.select(*key, "asset_ord", "asset_id", line.alias("item")), key, ["asset_ord", "asset_id"], limits[3], "ord")
        out = out.unionByName(pick(ass, "reference", "asset"))
    return out


def input_keywords(name: Column, groups=config.INPUT_KEYWORDS, pattern: str = "[一-鿿]{2,}") -> Column:
    out = None
    for key, words in groups.items():
        out = F.when(name == key, strings(words)) if out is None else out.when(name == key, strings(words))
    free = F.regexp_extract_all(name, F.lit(pattern), F.lit(0))
    return free if out is None else out.otherwise(free)


def input_availability(inputs: DataFrame, evidence: DataFrame, groups=config.INPUT_KEYWORDS, pattern: str = "[一-鿿]{2,}",
                       name: str = "input") -> DataFrame:
    """Whether any keyword of an input occurs in any evidence text of its project.
    inputs: ``project, input``; evidence: ``project, text``."""
    words = inputs.select("project", name).distinct().withColumn("_word", F.explode(input_keywords(F.col(name), groups, pattern)))
    found = counted_pairs(words.select("project", "_word").distinct(), evidence.select("project", "text"), "_word", "text",
                            ["project"]).select("project", "_word").distinct()
    ok = words.join(found, ["project", "_word"], "left_semi").select("project", name).distinct().withColumn("_ok", F.lit(True))
    return inputs.select("project", name).distinct().join(ok, ["project", name], "left").select(
        "project", name, F.coalesce("_ok", F.lit(False)).alias("available"))


def missing_inputs(sections: DataFrame, evidence: DataFrame, **kw) -> DataFrame:
    """Required inputs of each chapter for which the project has no evidence, in order."""
    wanted = sections.select("project", F.col("code").alias("section_code"), F.posexplode("required_inputs").alias("ord", "input"))
    have = input_availability(wanted, evidence, **kw).filter("available").select("project", "input")
    return wanted.join(have, ["project", "input"], "left_anti").select("project", "section_code", "ord", "input")


def evidence_texts(reqs: DataFrame, facts: DataFrame, standards: DataFrame) -> DataFrame:
    return (
        reqs.select("project", F.col("requirement").alias("text"))
        .unionByName(facts.select("project", F.concat("key", "value").alias("text")))
        .unionByName(standards.select("project", F.concat("code", "title").alias("text")))
    )


def completion(project, reference, missing) -> Column:
    """Completion percentage from the numbers of basis items and missing inputs."""
    score = F.lit(20) + project * 8 + reference * 5 - missing * 5
    return F.greatest(F.lit(5), F.least(F.lit(90), score)).cast("int")


def build_sections(sections: DataFrame, basis: DataFrame, missing: DataFrame) -> DataFrame:
    """Chapter rows with basis arrays (at most a few dozen items), missing inputs,
    completion and status."""
    key = ["project", "section_code"]
    order = F.when(F.col("kind") == "requirement", 0).when(F.col("kind") == "fact", 1).when(
        F.col("kind") == "blueprint", 2).when(F.col("kind") == "standard", 3).otherwise(4)
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(
        F.col("side") == s, F.struct(order.alias("k"), F.col("ord"), F.col("item"))))), lambda x: x["item"])
    lists = basis.groupBy(*key).agg(side("project").alias("project_basis"), side("reference").alias("reference_basis"))
    gaps = missing.groupBy(*key).agg(in_order(F.col("input"), F.col("ord")).alias("missing_inputs"))
    out = sections.withColumn("section_code", F.col("code")).join(lists, key, "left").join(gaps, key, "left")
    for c in ("project_basis", "reference_basis", "missing_inputs"):
        out = out.withColumn(c, F.coalesce(c, strings([])))
    done = completion(F.size("project_basis"), F.size("reference_basis"), F.size("missing_inputs"))
    return out.withColumn("completion", done).withColumn(
        "status", F.when(F.size("missing_inputs") == 0, "ready").otherwise("needs_input")).drop("section_code")


def attach_model_facts(sections: DataFrame, basis: DataFrame, facts: DataFrame, words=config.FACT_SECTION_WORDS,
                       default=config.FACT_SECTION_DEFAULT) -> DataFrame:
    """Basis edges for facts read by a model, where the chapter lacks the same text."""
    named = F.coalesce(F.nullif(file_name("source_path"), F.lit("")), F.lit("视觉资料"))
    page = F.coalesce(F.nullif("source_page", F.lit(0)).cast("string"), F.lit("—"))
    item = F.concat("key", F.lit("："), "value", F.coalesce("unit", F.lit("")), F.lit("（"), named, F.lit(" 第"), page, F.lit("页）"))
    rows = facts.withColumn("item", item).withColumn("norm", F.col("item"))
    edges = fact_edges(rows, sections, words, default).select("project", "section_code", "item").distinct()
    return edges.join(basis.select("project", "section_code", "item"), ["project", "section_code", "item"], "left_anti").select(
        "project", "section_code", F.lit("project").alias("side"), F.lit("model_fact").alias("kind"),
        F.lit(1000).alias("ord"), "item")


def clean_spec(proposed: DataFrame, templates: DataFrame) -> DataFrame:
    """Chapter definitions from a proposal: cleaned title, code, blanks filled from the
    closest template. proposed: ``project, ord, title, purpose, required_inputs, components,
    acceptance``; templates the same with ``project, ord``."""
    rows = proposed.withColumn("title", clean_title("title")).filter("title <> ''")
    close = closest_template(rows, templates, ["project"])
    fill = templates.select("project", F.col("title").alias("template"), F.struct(
        "purpose", "required_inputs", "components", "acceptance").alias("_t")).dropDuplicates(["project", "template"])
    out = rows.join(close, ["project", "title"]).join(fill, ["project", "template"], "left")
    pick = lambda c: ordered_distinct(F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"_t.{c}", strings([]))))
    return out.select(
        "project", "ord", F.when(F.col("ord") < 10, F.lpad(F.col("ord").cast("string"), 2, "0")).otherwise(F.col("ord").cast("string")).alias("code"), "title",
        F.coalesce(F.nullif(F.trim("purpose"), F.lit("")), F.col("_t.purpose"), F.lit("明确本章响应范围和可检查交付成果。")).alias("purpose"),
        *[pick(c).alias(c) for c in ("required_inputs", "components", "acceptance")])


def spec_violations(proposed: DataFrame, spec: DataFrame, most: int = 30) -> DataFrame:
    """Why a proposal cannot be used: number of chapters, equal titles, empty chapters."""
    counts = proposed.groupBy("project").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(
        "project", F.lit("chapter_count").alias("violation"), F.col("n").cast("string").alias("detail"))
    none = proposed.select("project").distinct().join(spec.select("project").distinct(), "project", "left_anti").select(
        "project", F.lit("no_valid_chapter").alias("violation"), F.lit("").alias("detail"))
    twice = spec.groupBy("project", "title").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "project", F.lit("duplicate_title").alias("violation"), F.col("title").alias("detail"))
    empty = spec.filter((F.size("components") == 0) | (F.size("acceptance") == 0)).select(
        "project", F.lit("incomplete_chapter").alias("violation"), F.col("title").alias("detail"))
    return counts.unionByName(none).unionByName(twice).unionByName(empty)


def section_bodies(outline: DataFrame, matrix: DataFrame, part_size: int = 500) -> DataFrame:
    """Draft bodies: one line per requirement of a chapter, or a placeholder. A body is cut
    per document and every ``part_size`` requirements, so that no cell grows with the data."""
    line = F.concat(F.lit("【待完善】响应 "), "requirement_id", F.lit(": "), "response_strategy")
    parts = matrix.withColumn("part", F.floor((F.col("req_no") - 1) / part_size).cast("int") + 1)
    bodies = parts.groupBy("project", F.col("target_section").alias("title"), "doc_id", "part").agg(
        F.array_join(in_order(line, F.col("req_no")), "\n").alias("body"))
    none = F.lit("【待完善】请根据响应矩阵和历史通过案例补写本章内容。")
    return outline.select("project", "ord", "title").join(bodies, ["project", "title"], "left").select(
        "project", "ord", "title", "doc_id", F.coalesce("part", F.lit(1)).alias("part"), F.coalesce("body", none).alias("body"))


def asset_basis(sections: DataFrame, asset_codes: DataFrame) -> DataFrame:
    """Basis of generated assets: union of the basis of their chapters, in chapter order.
    sections: ``code`` and basis arrays; asset_codes: ``asset, codes``."""
    codes = asset_codes.select("asset", F.posexplode("codes").alias("_i", "code"))
    names = ["project_basis", "reference_basis", "missing_inputs"]
    rows = codes.join(sections.select("code", *names), "code", "left")
    flat = lambda c: F.array_distinct(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", F.coalesce(c, strings([])).alias("v")))), lambda x: x["v"])))
    return rows.groupBy("asset").agg(*[flat(c).alias(c) for c in names])


def evidence_pack(sections: DataFrame, clauses: DataFrame, assets: DataFrame, facts: DataFrame, clause_n: int = 30,
                  asset_n: int = 12, fact_n: int = 80) -> DataFrame:
    """Everything a chapter may be written from, as one JSON per chapter with fixed limits."""
    key = ["project", "section_code"]
    part = lambda df, order, n, name, *cols: top_n(df, key, order, n, "_r").groupBy(*key).agg(
        in_order(F.struct(*cols), F.col("_r")).alias(name))
    cl = section_edges(clauses, sections, lambda s: F.array_contains("applicable_sections", s["title"]), ["standard_code", "clause_id"])
    cl = part(cl, ["standard_code", "clause_no", "clause_id"], clause_n, "clauses", "standard_code", "clause_id", "text")
    ass = section_edges(assets, sections, lambda s: F.array_contains("applicable_sections", config.GLOBAL_SECTION) |
                        F.array_contains("applicable_sections", s["title"]), ["asset_id"])
    ass = part(ass, ["asset_ord", "asset_id"], asset_n, "assets", "title", "reuse_rule", "content")
    top = top_n(facts, ["project"], ["first_seen", "key", "norm"], fact_n, "_r").groupBy("project").agg(
        in_order(F.struct("key", "value", "unit"), F.col("_r")).alias("facts"))
    out = sections.withColumn("section_code", F.col("code")).join(cl, key, "left").join(ass, key, "left")
    out = salted_lookup(out, top, ["project"], by=["code"])
    pack = F.struct("title", "purpose", "components", "acceptance", "project_basis", "reference_basis", "missing_inputs",
                    "clauses", "assets", "facts")
    return out.select("project", "code", F.to_json(pack).alias("pack"), F.size(F.coalesce("clauses", F.array())).alias("clause_count"),
                      F.size(F.coalesce("assets", F.array())).alias("asset_count"), F.size(F.coalesce("facts", F.array())).alias("fact_count"))


def project_pack(reqs: DataFrame, facts: DataFrame, standards: DataFrame, req_n: int = 100, std_n: int = 80) -> DataFrame:
    """Project-level summary: first requirements (shortened), fact names, first standards."""
    r = top_n(reqs, ["project"], ["doc_id", "req_no"], req_n, "_r").groupBy("project").agg(
        in_order(F.struct("id", "category", compact_text("requirement", 320).alias("requirement")), F.col("_r")).alias("requirements"))
    names = facts.groupBy("project", "key").agg(F.min("first_seen").alias("_f")).groupBy("project").agg(
        in_order(F.col("key"), F.col("_f")).alias("fact_names"))
    s = top_n(standards, ["project"], ["doc_id", "line_no", "match_ord"], std_n, "_r").groupBy("project").agg(
        in_order(F.concat_ws(" ", "code", "title"), F.col("_r")).alias("standards"))
    out = r.join(names, "project", "full").join(s, "project", "full")
    return out.select("project", F.to_json(F.struct("requirements", "fact_names", "standards")).alias("pack"))


def refresh_standard_basis(basis: DataFrame, sections: DataFrame, standards: DataFrame, clauses: DataFrame, n: int = 12) -> DataFrame:
    """After an original was attached: its clauses replace the standard's own line in the
    basis of the chapters it affects."""
    first = top_n(clauses, ["project", "standard_code"], ["clause_no"], n, "_r")
    page = F.coalesce(F.nullif("page", F.lit(0)).cast("string"), F.lit("—"))
    refs = first.select("project", F.col("standard_code").alias("code"), F.col("_r").alias("ord"), F.concat(
        "standard_code", F.lit(" "), "clause_id", F.lit("（原文第"), page, F.lit("页）")).alias("item"))
    where = section_edges(standards.select("project", "code", "affected_sections"), sections, lambda s: F.array_contains(
        "affected_sections", s["title"]), ["code"]).select("project", "section_code", "code").distinct()
    gone = where.select("project", "section_code", F.col("code").alias("_code"))
    std = basis.withColumn("_code", F.when(F.col("kind").isin("standard", "clause"), F.regexp_extract("item", "^(.*?[0-9]) ", 1)))
    kept = std.join(gone, ["project", "section_code", "_code"], "left_anti").drop("_code")
    fresh = where.join(refs, ["project", "code"]).select(
        "project", "section_code", F.lit("reference").alias("side"), F.lit("clause").alias("kind"), "ord", "item")
    return kept.unionByName(fresh)
