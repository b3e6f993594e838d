"""Drafted text against the evidence: coverage, unsupported numbers, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceframe import config
from traceframe.functions.text import LINE_BREAK, col, collapse, contains_any, let, remove_space, split_lines, strings
from traceframe.operators.keyed import bounded, counted_pairs, join_lists, kept, list_sizes, salted_lookup, stable, top_n, unfold


def requirement_tokens(requirement: Column, pattern: str = config.COVERAGE_SPLIT, shortest: int = 2, first: int | None = 8) -> Column:
    """The words that stand for a requirement: its first eight; a rule of the measure, as more words would make any text cover it."""
    words = F.filter(F.split(requirement, pattern, -1), lambda t: F.length(t) >= shortest)
    return words if first is None else F.slice(words, 1, first)


def coverage(reqs: DataFrame, drafts: DataFrame, id_: str = "requirement_id", text: str = "requirement",
             pattern: str = config.COVERAGE_SPLIT) -> DataFrame:
    """Which first words of each requirement occur in its project's draft texts. Words are
    looked up once per project, not per requirement."""
    rows = reqs.select("project", id_, F.posexplode(requirement_tokens(F.col(text), pattern)).alias("n", "token"))
    words = stable(rows.select("project", "token").distinct())
    texts = drafts.select("project", F.col("text").alias("_text"))
    # most words stand alone in some text; only the others are searched inside longer words
    alone = texts.select("project", F.explode(F.array_distinct(F.split("_text", pattern, -1))).alias("token")).join(
        bounded(words), ["project", "token"]).select("project", "token").distinct()
    alone = stable(alone)
    rest = words.join(alone, ["project", "token"], "left_anti")
    inside = counted_pairs(rest, texts, "token", "_text", ["project"]).select("project", "token").distinct()
    found = alone.unionByName(inside)
    hits = salted_lookup(rows, found.withColumn("_hit", F.lit(True)), ["project", "token"], by=[id_, "n"])
    matched = hits.groupBy("project", id_).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_hit"), F.struct("n", "token")))), lambda x: x["token"]).alias("matched"))
    return reqs.select("project", id_).join(matched, ["project", id_], "left").select(
        "project", id_, F.coalesce("matched", strings([])).alias("matched_keywords"),
        (F.size(F.coalesce("matched", strings([]))) > 0).alias("covered"))


def draft_placeholders(drafts: DataFrame, pattern: str = config.COVERAGE_PLACEHOLDER) -> DataFrame:
    """Distinct open placeholders per project."""
    return drafts.select("project", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("placeholder")).distinct()


def coverage_summary(covered: DataFrame, placeholders: DataFrame) -> DataFrame:
    counts = covered.groupBy("project").agg(
        F.count(F.lit(1)).alias("requirement_count"), F.count_if("covered").alias("covered_count"),
        F.count_if(~F.col("covered")).alias("missing_count"))
    open_ = placeholders.groupBy("project").agg(F.count(F.lit(1)).alias("placeholder_count"))
    out = counts.join(open_, "project", "left").withColumn("placeholder_count", F.coalesce("placeholder_count", F.lit(0)))
    return out.withColumn("status", F.when((F.col("missing_count") > 0) | (F.col("placeholder_count") > 0), "needs_human_review")
                          .otherwise("ready_for_manual_final_check"))


def document_audit(headings: DataFrame, sections: DataFrame, counts: DataFrame, figures: int = 5) -> DataFrame:
    """Structure checks per project. headings: ``project, text``; sections: ``project, ord,
    title``; counts: ``project, table_count, image_count, placeholder_count, fields_ready``."""
    present = counted_pairs(sections.select("project", "title").distinct(), headings.select("project", F.col("text").alias("_h")),
                              "title", "_h", ["project"]).select("project", "title").distinct()
    gaps = sections.join(present, ["project", "title"], "left_anti").groupBy("project").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("missing_sections"))
    out = counts.join(gaps, "project", "left").withColumn("missing_sections", F.coalesce("missing_sections", strings([])))
    checks = [
        ("all_sections_present", F.size("missing_sections") == 0), ("has_word_tables", F.col("table_count") > 0),
        ("has_generated_figures", F.col("image_count") >= figures), ("field_update_ready", F.col("fields_ready"))]
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))
    return out.withColumn("failed_checks", failed).withColumn(
        "status", F.when(F.size("failed_checks") == 0, "passed").otherwise("needs_review"))


def placeholder_count(text, pattern: str = config.AUDIT_PLACEHOLDER) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))


# --- unsupported claims -----------------------------------------------------------------


def quantity_form(c) -> Column:
    """Spaces out, one spelling for days and per cent."""
    return F.replace(F.replace(remove_space(col(c)), F.lit("日历天"), F.lit("天")), F.lit("％"), F.lit("%"))


def allowed_quantities(facts: DataFrame) -> DataFrame:
    """``project, token`` of quantities that facts support."""
    return facts.filter(F.trim("value") != "").select(
        "project", quantity_form(F.concat("value", F.coalesce("unit", F.lit("")))).alias("token")).distinct()


def verified_clauses(clauses: DataFrame) -> DataFrame:
    """``project, token`` of clauses read from an original."""
    return clauses.filter("verification_status = 'verified_local_source'").select(
        "project", remove_space(F.concat("standard_code", F.lit("第"), "clause_id", F.lit("条"))).alias("token")).distinct()


PLACEHOLDER = r"【待人工确认：(.+?)的项目或规范依据】"


def _pieces(text: Column, pattern: str, context: int = 12) -> Column:
    """A text as literal and match pieces in turn, with what surrounds each match."""
    def pieces(p):
        lit = lambda i: F.coalesce(F.get(p["lit"], i), F.lit(""))
        hit = lambda i: F.coalesce(F.get(p["hit"], i), F.lit(""))
        return F.transform(p["lit"], lambda t, i: F.struct(
            t.alias("before"), hit(i).alias("token"), remove_space(hit(i)).alias("plain"), F.concat(
                F.right(F.concat(lit(i - 1), hit(i - 1), t), F.lit(context)), hit(i),
                F.left(F.concat(lit(i + 1), hit(i + 1), lit(i + 2)), F.lit(context))).contains(config.UNCONFIRMED).alias("open")))

    return let(F.struct(F.split(text, pattern, -1).alias("lit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")), pieces)


def _spliced(pieces: Column, shown) -> Column:
    """The text again, each match as ``shown`` says; prose between the matches stays as it was."""
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], shown(p))), "")


LIST_VALUES = 500


def _told(rows: DataFrame, asked: Column, on: list[str], support) -> DataFrame:
    """Rows with ``_ok``, the asked values that evidence supports. Values are asked once for each key in ``on``.

    Short lists of supported values travel to the rows, which are then read once and not taken apart: by broadcast, when they are counted
    few, else by a join on the key. Where a key has many, every row is told its own ones, known by its columns ``_t1, _t2``, so that rows
    with equal keys don't mix."""
    rows = rows.withColumn("_asked", F.array_distinct(asked))
    spread = unfold(rows, [*on, "_t1", "_t2"], F.col("_asked"), "plain")
    distinct = stable(spread.select(*on, "plain").distinct())  # several lookups read the few distinct values, not the texts
    none = strings([])
    if distinct.isEmpty():
        return rows.drop("_asked").withColumn("_ok", none)
    yes = stable(support(distinct).select(*on, "plain").distinct())
    longest, total, keys = list_sizes(yes, on)
    if longest <= LIST_VALUES:
        told = join_lists(rows.drop("_asked"), yes.groupBy(*on).agg(F.collect_set("plain").alias("_ok")), on, "left", total, keys, ["_t1", "_t2"])
        return told.withColumn("_ok", F.coalesce("_ok", none))
    found = salted_lookup(spread, yes.withColumn("_yes", F.lit(True)), [*on, "plain"], "inner", ["_t1", "_t2"])
    told = found.groupBy("_t1", "_t2").agg(F.collect_set("plain").alias("_ok"))
    return rows.drop("_asked").join(told, ["_t1", "_t2"], "left").withColumn("_ok", F.coalesce("_ok", none))


def _known_rows(drafts: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, "text"]
    return drafts.select(*columns, F.xxhash64(*columns).alias("_t1"), F.xxhash64(F.lit(1), *columns).alias("_t2"))


def _by_project(tokens: DataFrame, quantities: DataFrame, clauses: DataFrame) -> DataFrame:
    """Tokens (``project, plain``) that facts or verified clauses of the project support."""
    by_fact = tokens.withColumn("token", quantity_form("plain")).join(quantities, ["project", "token"], "left_semi")
    by_clause = counted_pairs(clauses.withColumnRenamed("token", "_clause"), tokens.select("project", "plain").distinct(), "_clause", "plain", ["project"])
    return by_fact.select("project", "plain").unionByName(by_clause.select("project", "plain")).distinct()


def restore_placeholders(drafts: DataFrame, keys: list[str], quantities: DataFrame, clauses: DataFrame) -> DataFrame:
    """Put back text behind placeholders that the evidence supports by now, inside each text. Texts without one pass by."""
    has = F.coalesce(F.col("text").rlike(PLACEHOLDER), F.lit(False))
    rows = _known_rows(drafts.filter(has), keys).withColumn("_p", _pieces(F.col("text"), PLACEHOLDER))
    inner = lambda p: F.regexp_extract(p["token"], PLACEHOLDER, 1)
    asked = F.transform(F.filter("_p", lambda p: p["token"] != ""), lambda p: remove_space(inner(p)))
    told = _told(rows, asked, ["project"], lambda tokens: _by_project(tokens, quantities, clauses))
    back = lambda p: (p["token"] != "") & F.array_contains("_ok", remove_space(inner(p)))
    out = told.select(*keys, _spliced(F.col("_p"), lambda p: F.when(back(p), inner(p)).otherwise(p["token"])).alias("text"))
    return drafts.filter(~has).select(*keys, "text").unionByName(out)


def either(first: str, second: str) -> str:
    """One pattern that matches the first or else the second."""
    bare = lambda p: p.removeprefix("(?iu)")
    flags = "(?iu)" if first.startswith("(?iu)") or second.startswith("(?iu)") else ""
    return f"{flags}(?:{bare(first)})|(?:{bare(second)})"


def checked_claims(drafts: DataFrame, keys: list[str], facts: DataFrame, clauses: DataFrame, allowed: DataFrame,
                   quantity: str = config.QUANTITY, citation: str = config.CLAUSE_CITATION, context: int = 12,
                   exact: bool = False, restore: bool = True, common: DataFrame | None = None) -> DataFrame:
    """Clause citations and quantities without evidence become placeholders.

    drafts: ``project``, further keys, ``text``; facts: ``project, value, unit``; clauses:
    ``project, standard_code, clause_id, verification_status``; allowed: ``project, text`` and any of the further keys: with a
    chapter column a text backs claims of its own chapter only (requirements and basis of the chapter), without one those of the whole
    project; common: ``project, text``, further texts for all chapters. Every distinct token is checked once, and texts are rewritten inside their row, all prose kept. ``exact`` leaves out
    support by containment in an allowed text. Returns keys, ``text`` and ``blocked``, the distinct tokens that were replaced."""
    quantities, verified = allowed_quantities(facts), verified_clauses(clauses)
    given = restore_placeholders(drafts, keys, quantities, verified) if restore else drafts.select(*keys, "text")
    on = ["project", *[k for k in keys if k != "project" and k in allowed.columns]]
    pattern = either(citation, quantity)
    has = F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    rows = _known_rows(given.filter(has), keys).withColumn("_p", _pieces(F.col("text"), pattern, context))
    claim = lambda p: (p["token"] != "") & ~p["open"]

    def support(tokens):
        tokens = tokens.select(*on, "plain").distinct()
        known = _by_project(tokens.select("project", "plain").distinct(), quantities, verified)
        out = tokens.join(known, ["project", "plain"], "left_semi")
        if exact:
            return out
        rest = tokens.join(known, ["project", "plain"], "left_anti")
        inside = counted_pairs(rest, allowed.select(*on, remove_space("text").alias("_text")), "plain", "_text", on)
        out = out.unionByName(inside.select(*on, "plain"))
        if common is None:
            return out
        shared = counted_pairs(rest.select("project", "plain").distinct(), common.select("project", remove_space("text").alias("_text")), "plain", "_text", ["project"])
        return out.unionByName(rest.join(shared.select("project", "plain").distinct(), ["project", "plain"], "left_semi").select(*on, "plain"))

    told = _told(rows, F.transform(F.filter("_p", claim), lambda p: p["plain"]), on, support)
    bad = lambda p: claim(p) & ~F.array_contains("_ok", p["plain"])
    shown = lambda p: F.when(bad(p), F.concat(F.lit("【待人工确认："), p["token"], F.lit("的项目或规范依据】"))).otherwise(p["token"])
    blocked = told.withColumn("_bad", F.filter("_p", bad))
    firsts = F.filter("_bad", lambda p, i: F.array_position(F.col("_bad")["plain"], p["plain"]) == i + 1)
    out = blocked.select(*keys, _spliced(F.col("_p"), shown).alias("text"), F.transform(firsts, lambda p: p["token"]).alias("blocked"))
    return given.filter(~has).select(*keys, "text", strings([]).alias("blocked")).unionByName(out)


def claim_findings(checked: DataFrame, keys: list[str]) -> DataFrame:
    """One finding per distinct blocked token of a text."""
    message = F.concat(F.lit("检测到无证据数字或条款引用“"), "token", F.lit("”，已在正文中阻断。"))
    return unfold(checked, keys, F.col("blocked"), "token").withColumn("finding", message)


def block_unsupported_claims(drafts: DataFrame, keys: list[str], *evidence, **options):
    """``checked_claims`` as texts and findings, one finding per distinct token of a text."""
    checked = checked_claims(drafts, keys, *evidence, **options)
    return checked.select(*keys, "text"), claim_findings(checked, keys)


def block_table_quantities(cells: DataFrame, keys: list[str], facts: DataFrame, headers=config.QUANTITY_HEADERS,
                           pattern: str = config.TABLE_QUANTITY):
    """Bare numbers in quantity columns that no fact supports. ``cells`` as from
    ``markdown.markdown_tables`` with ``audit``; each cell carries its column's header, so texts with equal
    keys don't mix. Returns all cells with replacements, and the findings."""
    known = facts.filter(F.trim("value") != "").select("project", remove_space("value").alias("_value")).distinct().withColumn(
        "_known", F.lit(True))
    rows = cells.withColumn("_value", remove_space("cell"))
    bare = contains_any("header", headers) & (F.col("row_no") > 0) & F.col("_value").rlike(pattern)
    rows = rows.withColumn("_bare", bare & ~F.col("cell").contains(config.UNCONFIRMED))
    rows = salted_lookup(rows, known, ["project", "_value"], by=[*keys, "table_no", "row_no", "col_no"])
    bad = F.col("_bare") & F.col("_known").isNull()
    out = rows.select(*keys, "table_no", "row_no", "col_no", F.when(bad, F.concat(F.lit("【待人工确认："), "cell", F.lit("】")))
                      .otherwise(F.col("cell")).alias("cell"), bad.alias("blocked"), F.col("cell").alias("_old"))
    findings = out.filter("blocked").select(*keys, "table_no", "row_no", "col_no", F.concat(
        F.lit("检测到表格中的无证据数量“"), "_old", F.lit("”，已在正文中阻断。")).alias("finding"))
    return out.drop("_old"), findings


SEPARATOR_LINE = r"^[ \t|:\-]+$"


def checked_tables(drafts: DataFrame, keys: list[str], facts: DataFrame, headers=config.QUANTITY_HEADERS,
                   pattern: str = config.TABLE_QUANTITY) -> DataFrame:
    """Bare numbers under a quantity header that no fact supports become placeholders.

    drafts: ``project``, further keys, ``text``. A line that starts with a pipe and is followed by a separator line heads a table, which
    takes all lines with a pipe that follow. Tables are rewritten inside their text, a changed row with single blanks around its cells; all
    other lines stay. Returns keys, ``text`` and ``blocked`` (``line, col`` from 0, ``cell``)."""
    known = facts.filter(F.trim("value") != "").select("project", remove_space("value").alias("plain")).distinct()
    tables = F.col("text").rlike(r"(?m)^\s*\|")
    rows = _known_rows(drafts, keys).filter(tables).withColumn("_l", split_lines("text"))
    rows = rows.withColumn("_f", F.transform("_l", collapse)).withColumn("_b", F.transform("_f", lambda f: f.startswith("|")))
    bar = lambda i: F.coalesce(F.get("_b", i), F.lit(False))
    flat = lambda i: F.get("_f", i)
    places = F.sequence(F.lit(0), F.size("_l") - 1)
    starts = F.filter(places, lambda i: bar(i) & ~bar(i - 1))
    ends = F.filter(places, lambda i: bar(i) & ~bar(i + 1))

    def table(i, until):
        rule = F.get(F.filter(F.sequence(i + 1, F.greatest(until, i + 1)), lambda j: (j <= until) & flat(j).rlike(SEPARATOR_LINE)), F.lit(0))
        wanted = lambda titles: F.filter(F.sequence(F.lit(0), F.greatest(F.size(titles) - 1, F.lit(0))), lambda c: contains_any(
            F.coalesce(F.get(titles, c), F.lit("")), headers))
        return let(rule, lambda r: F.struct((r + 1).alias("first"), until.alias("last"), let(_flat_cells(flat(r - 1)), wanted).alias("columns")))

    pairs = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    found = F.filter(F.transform(pairs, lambda z: table(z["s"], z["e"])), lambda t: t["first"].isNotNull() & (F.size(t["columns"]) > 0) & (t["first"] <= t["last"]))

    def claims(t):
        return F.flatten(F.transform(F.sequence(t["first"], t["last"]), lambda j: let(_flat_cells(flat(j)), lambda cells: F.transform(
            t["columns"], lambda c: F.struct(j.alias("line"), c.alias("col"), F.get(cells, c).alias("cell"), remove_space(F.get(cells, c)).alias("plain"))))))

    is_bare = lambda x: F.coalesce(x["plain"].rlike(pattern) & ~x["cell"].contains(config.UNCONFIRMED), F.lit(False))
    rows = rows.withColumn("_c", F.filter(F.flatten(F.transform(found, claims)), is_bare)).drop("_b")
    known = kept(known)
    longest, total, projects = list_sizes(known, ["project"])
    if longest <= LIST_VALUES:  # few facts travel to the texts, whose tables are then taken apart once and not a second time for what they ask
        lists = known.groupBy("project").agg(F.collect_set("plain").alias("_ok"))
        told = join_lists(rows, lists, ["project"], "left", total, projects, ["_t1", "_t2"]).withColumn("_ok", F.coalesce("_ok", strings([])))
    else:
        told = _told(rows, F.transform("_c", lambda x: x["plain"]), ["project"], lambda tokens: tokens.join(known, ["project", "plain"], "left_semi"))
    told = told.withColumn("_bad", F.filter("_c", lambda x: ~F.array_contains("_ok", x["plain"])))

    def line_of(raw, j):
        def shown(own):
            cells = F.transform(_flat_cells(flat(j)), lambda cell, c: F.when(F.exists(own, lambda x: x["col"] == c), F.concat(
                F.lit("【待人工确认："), cell, F.lit("】"))).otherwise(cell))
            return F.when(F.size(own) > 0, F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))).otherwise(raw)

        return let(F.filter("_bad", lambda x: x["line"] == j), shown)

    changed = F.when(F.size("_bad") > 0, F.array_join(F.transform("_l", line_of), "\n")).otherwise(F.col("text"))
    cells = F.transform("_bad", lambda x: F.struct(x["line"].alias("line"), x["col"].alias("col"), x["cell"].alias("cell")))
    plain = drafts.filter(~F.coalesce(tables, F.lit(False))).select(*keys, "text", F.array().cast("array<struct<line:int,col:int,cell:string>>").alias("blocked"))
    return plain.unionByName(told.select(*keys, changed.alias("text"), cells.alias("blocked")))


def table_findings(checked: DataFrame, keys: list[str]) -> DataFrame:
    """One finding per blocked cell (``line_no, col_no`` from 1)."""
    return unfold(checked, keys, F.col("blocked"), "b").select(
        *keys, (F.col("b.line") + 1).alias("line_no"), (F.col("b.col") + 1).alias("col_no"),
        F.concat(F.lit("检测到表格中的无证据数量“"), "b.cell", F.lit("”，已在正文中阻断。")).alias("finding"))


def block_table_texts(drafts: DataFrame, keys: list[str], facts: DataFrame, **options):
    """``checked_tables`` as texts and findings."""
    checked = checked_tables(drafts, keys, facts, **options)
    return checked.select(*keys, "text"), table_findings(checked, keys)


def _flat_cells(line: Column) -> Column:
    """Cells of a table row with single blanks, without the pipes around it."""
    return F.transform(F.split(F.btrim(line, F.lit("|")), r"\|", -1), lambda x: F.trim(x))


# --- review of a draft by a model -------------------------------------------------------


def validate_review_issues(issues: DataFrame, texts: DataFrame, titles: DataFrame, assets: DataFrame, clauses: DataFrame,
                           quantity: str = config.REVIEW_QUANTITY, key: str = "issue_id"):
    """Split issues into accepted and dismissed; the first reason that applies counts.

    issues: ``project, issue_id, title, detail, affected_sections``; texts: ``project, text``
    (drafts and facts); titles: ``project, title``; assets: ``project, asset``; clauses:
    ``project, clause_id`` that were verified."""
    ids = ["project", key]
    rows = issues.withColumn("claim", F.concat_ws(" ", "title", "detail"))
    cited = rows.select(*ids, F.posexplode(F.regexp_extract_all("claim", F.lit(quantity), F.lit(0))).alias("n", "token"))
    cited = cited.withColumn("plain", remove_space("token"))
    there = counted_pairs(cited.select("project", "plain").distinct(), texts.select("project", remove_space("text").alias("_text")),
                            "plain", "_text", ["project"]).select("project", "plain").distinct()
    absent = cited.join(there, ["project", "plain"], "left_anti").groupBy(*ids).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]), "、").alias("_absent"))
    in_titles = rows.select(*ids, F.explode("affected_sections").alias("title")).join(
        titles.select("project", "title").distinct(), ["project", "title"], "left_semi").select(*ids).distinct().withColumn("_titled", F.lit(True))
    own = assets.groupBy("project").agg(F.collect_set("asset").alias("_assets"))  # a handful of generated figures
    numbers = rows.select(*ids, F.explode(F.array_distinct(F.regexp_extract_all("claim", F.lit(r"(\d+(?:\.\d+){1,3})\s*条"), F.lit(1)))).alias("clause_id"))
    checked = numbers.join(clauses.select("project", "clause_id").distinct().withColumn("_v", F.lit(True)), ["project", "clause_id"], "left")
    proven = checked.groupBy(*ids).agg((F.count("_v") == F.count(F.lit(1))).alias("_proven"))
    out = rows.join(absent, ids, "left").join(in_titles, ids, "left").join(proven, ids, "left")
    out = salted_lookup(out, own, ["project"], by=[key])
    has = lambda name: F.coalesce(F.array_contains("_assets", name), F.lit(False))
    claim = lambda *w: contains_any("claim", w)
    reason = (
        F.when(F.col("_absent").isNotNull(), F.concat(F.lit("正文及项目事实中不存在被指称数字："), "_absent"))
        .when(claim("未独立成章", "未专设章节", "缺少章节") & F.coalesce("_titled", F.lit(False)), "章节清单和DOCX结构审计已确认对应独立章节存在")
        .when(claim("进度图", "横道图", "网络图") & has("schedule_template_png"), "资产清单和DOCX结构审计已确认进度图存在")
        .when(claim("组织机构图") & has("organization_chart_png"), "资产清单和DOCX结构审计已确认组织机构图存在")
        .when(claim("流程图") & (has("quality_flow_png") | has("safety_flow_png")), "资产清单和DOCX结构审计已确认流程图存在")
        .when(claim("无法验证", "未验证", "无依据", "需验证", "原文支撑") & F.coalesce("_proven", F.lit(False)),
              "引用条款已由本地规范原文解析并标记为已验证")
    )
    out = out.withColumn("dismissed_reason", reason).select(*issues.columns, "dismissed_reason")
    return out.filter("dismissed_reason is null").drop("dismissed_reason"), out.filter("dismissed_reason is not null")


# --- structure of generated text --------------------------------------------------------


def clean_structure(text, note: str = config.DIAGRAM_NOTE, trace: str = config.TRACE_HEADING) -> Column:
    """Without code fences, sub/sup/br tags and the trace section; a note stands for
    removed diagrams; at most one blank line in a row."""
    text = col(text)
    had = text.rlike(r"(?i)```mermaid\b")
    t = F.regexp_replace(text, r"(?is)```mermaid\b.*?```", "")
    t = F.regexp_replace(t, r"(?s)```(?:\w+)?\s*.*?```", "")
    t = F.regexp_replace(t, r"(?i)</?(?:sub|sup|br)\s*/?>", "")
    t = F.regexp_replace(t, rf"(?ms)^#{{1,4}}\s*{trace}\s*$.*\z", "")
    t = F.when(had, F.concat(F.regexp_replace(t, r"\s+\z", ""), F.lit("\n\n" + note))).otherwise(t)
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


def drop_ascii_diagrams(texts: DataFrame, keys: list[str], heading: str = config.DIAGRAM_HEADING, mark: str = config.DIAGRAM_LINE,
                        note: str = config.DIAGRAM_NOTE, least: int = 3) -> DataFrame:
    """Under a diagram heading, text with at least ``least`` drawing lines gives way to a
    note, up to the next heading of the same or a higher level; a diagram heading inside such a part belongs to it. The text is
    folded inside its row: a state machine over its headings finds the parts, and lines are never shuffled."""
    head = "struct<at:int,level:int,opens:boolean>"
    parts = F.array().cast("array<struct<at:int,end:int>>")
    marked = F.col("text").contains("#")  # texts without any heading pass by
    rows = texts.select(*keys, "text", F.when(marked, split_lines("text")).alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda raw, i: F.struct(
        i.alias("at"), F.length(F.regexp_extract(F.trim(raw), r"^(#{1,4})\s+", 1)).alias("level"), F.trim(raw).rlike(heading).alias("opens"))), lambda h: h["level"] > 0)

    def step(s, h):
        inside = s["now"].isNotNull() & (h["level"] > s["now"]["level"])
        done = F.when(s["now"].isNotNull(), F.concat(s["done"], F.array(F.struct(s["now"]["at"].alias("at"), h["at"].alias("end"))))).otherwise(s["done"])
        return F.when(inside, s).otherwise(F.struct(F.when(h["opens"], h).alias("now"), done.alias("done")))

    ended = F.aggregate(heads, F.struct(F.lit(None).cast(head).alias("now"), parts.alias("done")), step, lambda s: F.when(
        s["now"].isNotNull(), F.concat(s["done"], F.array(F.struct(s["now"]["at"].alias("at"), F.size("_lines").alias("end"))))).otherwise(s["done"]))
    drawn = lambda raw: F.trim(raw).rlike(mark) | F.trim(raw).isin("...", "…")
    rows = rows.withColumn("_parts", ended).withColumn("_cut", F.filter("_parts", lambda p: F.size(F.filter(
        F.slice("_lines", p["at"] + 2, p["end"] - p["at"] - 1), drawn)) >= least))
    before = lambda i: F.coalesce(F.get("_cut", i - 1)["end"], F.lit(0))
    kept = F.transform("_cut", lambda p, i: F.concat(
        F.array_join(F.slice("_lines", before(i) + 1, p["at"] - before(i) + 1), "\n"), F.lit("\n\n" + note + "\n")))
    last = F.coalesce(F.get("_cut", F.size("_cut") - 1)["end"], F.lit(0))
    rest = F.when(last < F.size("_lines"), F.array(F.array_join(F.slice("_lines", last + 1, F.size("_lines") - last), "\n"))).otherwise(strings([]))
    same = F.regexp_replace(F.regexp_replace("text", LINE_BREAK, "\n"), r"\n\z", "")
    return rows.select(*keys, F.when(~marked, same).otherwise(F.array_join(F.concat(kept, rest), "\n")).alias("text"))


def strip_duplicate_heading(text, title) -> Column:
    """Drop the first non-blank line if, without its number, it is the chapter title."""
    text, title = col(text), col(title)
    first = F.regexp_extract(text, r"^(?:[^\S\n]*\n)*([^\n]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.trim(first), r"^#{1,4}\s*", ""), r"^第[一二三四五六七八九十百\d]+章\s*", "")
    same = F.btrim(bare, F.lit(" ：:")) == F.btrim(title, F.lit(" ：:"))
    rest = F.regexp_replace(text, r"^((?:[^\S\n]*\n)*)[^\n]*(?:\n|\z)", "$1")
    return F.regexp_replace(F.when(same, rest).otherwise(text), r"^\s+|\s+\z", "")


def append_trace(text, project_basis, reference_basis, missing, heading: str = config.TRACE_HEADING, most: int | None = None) -> Column:
    """Add a table of what the chapter rests on, all of it or the first ``most`` of each kind."""
    safe = lambda x: F.replace(x, F.lit("|"), F.lit("／"))
    rows = lambda c, kind: F.transform(col(c) if most is None else F.slice(col(c), 1, most), lambda x: F.concat(F.lit(f"| {kind} | "), safe(x), F.lit(" |")))
    gaps = F.when(F.size(col(missing)) > 0, F.array(F.concat(
        F.lit("| 待确认输入 | "), F.array_join(F.transform(col(missing), safe), "、"), F.lit(" |")))).otherwise(strings([]))
    table = F.concat(strings([f"### {heading}", "", "| 依据类型 | 来源 |", "|---|---|"]), rows(project_basis, "项目依据"),
                     rows(reference_basis, "编制依据"), gaps)
    return F.concat(F.regexp_replace(col(text), r"\s+\z", ""), F.lit("\n\n"), F.array_join(table, "\n"))


def cells_to_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of tables as Markdown lines again."""
    row = cells.groupBy(*keys, "table_no", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("col_no", "cell"))), lambda x: x["cell"]), " | ").alias("line"))
    return row.withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |")))

