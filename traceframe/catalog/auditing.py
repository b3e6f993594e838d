"""Queries over draft audits and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe import config
from traceframe.catalog import fixtures as X
from traceframe.catalog.documents import NUMBER, STANDARDS, standards
from traceframe.catalog.extraction import C10_SQL, SECTION_SQL, TEXT_FACTS, order_facts, requirements, text_facts
from traceframe.catalog.matching import ALIASES, BASIS, KEYWORDS, MISSING, basis, chapters, evidence
from traceframe.catalog.registry import query, table
from traceframe.functions.text import strings
from traceframe.operators import audit as AU, facts as FA, markdown as MD, requirements as RQ, review as RV, sections as SE
from traceframe.operators.keyed import stable


def sources(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("project")).distinct()


def bench_reqs(spark, d):
    """Benchmark items as requirements, dealt out to the sources."""
    return table(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("project"),
                                               F.col("item_id").alias("requirement_id"), F.col("text").alias("requirement"))


def source_drafts(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("project"), "doc_id", "text")


COVER = r"""q AS (SELECT item_id, i, string_split_regex(text, '[，。；、\s]+')[i] AS w FROM benchmark, generate_series(1, 300) g(i) WHERE i <= len(string_split_regex(text, '[，。；、\s]+'))),
 k AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM q WHERE length(w) >= 2 QUALIFY n <= 8),
 u AS (SELECT DISTINCT w FROM k), f AS (SELECT DISTINCT source AS project, w FROM u JOIN documents ON contains(text, w)),
 c AS (SELECT 'src' || (b.item_id % 20) AS project, b.item_id AS requirement_id, coalesce(string_agg(k.w, '|' ORDER BY n) FILTER (f.w IS NOT NULL), '') AS matched
 FROM benchmark b LEFT JOIN k ON k.item_id = b.item_id LEFT JOIN f ON f.project = 'src' || (b.item_id % 20) AND f.w = k.w GROUP BY 1, 2)"""


@query("e1_coverage", f"WITH {COVER} SELECT project, requirement_id, matched, (matched <> '')::INT AS covered FROM c")
def e1(spark, d):
    out = AU.coverage(bench_reqs(spark, d), source_drafts(spark, d))
    return out.select("project", "requirement_id", F.array_join("matched_keywords", "|").alias("matched"), F.col("covered").cast("int").alias("covered"))


@query("e1_coverage_summary", f"""WITH {COVER}, p AS (SELECT source AS project, count(DISTINCT w) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '\\w+\\$\\$\\$')) AS w FROM documents) GROUP BY 1)
 SELECT project, count(*) AS requirement_count, count(*) FILTER (matched <> '') AS covered_count, count(*) FILTER (matched = '') AS missing_count,
 coalesce(any_value(n), 0) AS placeholder_count, CASE WHEN count(*) FILTER (matched = '') > 0 OR any_value(n) > 0 THEN 'needs_human_review' ELSE 'ready_for_manual_final_check' END AS status
 FROM c LEFT JOIN p USING (project) GROUP BY 1""")
def e1_summary(spark, d):
    drafts = source_drafts(spark, d)
    return AU.coverage_summary(AU.coverage(bench_reqs(spark, d), drafts), AU.draft_placeholders(drafts, r"(?-U)[A-Za-z0-9_]+\$\$\$"))


@query("e2_apply_coverage", f"""WITH {X.REQUIREMENTS} SELECT doc_id, req_no::INT AS req_no, CASE WHEN quality = 1 AND req_no % 2 = 1 THEN 'missing' ELSE 'covered' END AS draft_status
 FROM reqs LEFT JOIN labels USING (doc_id)""")
def e2(spark, d):
    m = RQ.response_matrix(requirements(spark, d))
    bad = table(spark, d, "labels").filter("quality = 1").join(m.select("project", "doc_id", "requirement_id", "req_no"), "doc_id").filter("req_no % 2 = 1")
    return RQ.apply_coverage(m, bad).select("doc_id", "req_no", "draft_status")


@query("e3_document_audit", r"""WITH h AS (SELECT regexp_extract(url, '://[^/]*\.([a-z]+)/', 1) AS project, page_id, html, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t FROM pages),
 s(ord, title) AS (VALUES (0, 'the'), (1, 'Zq never'), (2, 'que')), p AS (SELECT project, count(*) AS n, count(*) FILTER (contains(html, '<br>')) AS br FROM h GROUP BY 1),
 m AS (SELECT project, string_agg(title, '|' ORDER BY ord) AS missing FROM p, s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.project = p.project AND contains(t, title)) GROUP BY 1)
 SELECT project, coalesce(missing, '') AS missing_sections, rtrim(CASE WHEN missing IS NOT NULL THEN 'all_sections_present|' ELSE '' END || CASE WHEN br = 0 THEN 'has_word_tables|' ELSE '' END
 || CASE WHEN n < 100 THEN 'has_generated_figures|' ELSE '' END || CASE WHEN project = 'com' THEN 'field_update_ready|' ELSE '' END, '|') AS failed_checks FROM p LEFT JOIN m USING (project)""")
def e3(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"://[^/]*\.([a-z]+)/", 1).alias("project"), "html")
    heads = p.select("project", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("text"))
    s = p.select("project").distinct().select("project", F.posexplode(strings(["the", "Zq never", "que"])).alias("ord", "title"))
    counts = p.groupBy("project").agg(F.count_if(F.col("html").contains("<br>")).alias("table_count"), F.count(F.lit(1)).alias("image_count"),
                                      F.lit(0).alias("placeholder_count")).withColumn("fields_ready", F.col("project") != "com")
    out = AU.document_audit(heads, s, counts, 100)
    return out.select("project", F.array_join("missing_sections", "|").alias("missing_sections"), F.array_join("failed_checks", "|").alias("failed_checks"))


CITE = r"License, [Vv]ersion \d+"


def claim_inputs(spark, d):
    facts = table(spark, d, "documents").select(F.col("source").alias("project"), (F.col("n_chars") % 9).cast("string").alias("value"), F.lit("").alias("unit")).distinct()
    clauses = sources(spark, d).select("project", F.lit("License, Version").alias("standard_code"), F.lit("9").alias("clause_id"),
                                       F.lit("verified_local_source").alias("verification_status"))
    allowed = table(spark, d, "documents").select(F.col("source").alias("project"), F.when(F.col("lang") == "de", F.col("text")).otherwise("").alias("text"))
    return facts, clauses, allowed


CLAIMS = r"""d AS (SELECT source AS project, doc_id, regexp_replace(text, 'License, [Vv]ersion \d+', 'x', 'g') AS t, text FROM documents),
 tok AS (SELECT project, doc_id, unnest(regexp_extract_all(regexp_replace(t, '\s', '  ', 'g'), '(?:^|[^A-Za-z0-9_.-])(\d+(?:\.\d+)?)(?:[^A-Za-z0-9_]|$)', 1)) AS token, t FROM d),
 cit AS (SELECT project, doc_id, unnest(regexp_extract_all(text, 'License, [Vv]ersion \d+')) AS token FROM d),
 ok AS (SELECT DISTINCT source AS project, (n_chars % 9)::VARCHAR AS token FROM documents),
 allw AS (SELECT project, doc_id, t, token FROM tok WHERE (project, token) NOT IN (SELECT (project, token) FROM ok)),
 bad AS (SELECT DISTINCT project, doc_id, token FROM allw a WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = a.project AND x.lang = 'de' AND contains(regexp_replace(x.text, '\s+', '', 'g'), a.token))
 UNION SELECT DISTINCT project, doc_id, token FROM cit a WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = a.project AND x.lang = 'de' AND contains(regexp_replace(x.text, '\s+', '', 'g'), replace(a.token, ' ', ''))))"""


@query("e4_block_unsupported_claims", f"WITH {CLAIMS} SELECT project, doc_id, token FROM bad")
def e4(spark, d):
    _, findings = AU.block_unsupported_claims(source_drafts(spark, d), ["project", "doc_id"], *claim_inputs(spark, d), NUMBER, CITE)
    return findings.select("project", "doc_id", "token")


@query("e4_blocked_texts")
def e4_text(spark, d):
    text, _ = AU.block_unsupported_claims(source_drafts(spark, d), ["project", "doc_id"], *claim_inputs(spark, d), NUMBER, CITE)
    return text


_ORDERS = "SELECT o_orderpriority AS project, o_orderstatus AS section, o_orderkey, o_custkey % 40 AS n, o_orderkey % 30 AS m FROM orders"


@query("e4_blocked_chapters", f"""WITH o AS ({_ORDERS}), a AS (SELECT DISTINCT project, section, '计划' || n || '天' AS t FROM o WHERE o_orderkey % 50 = 0),
 f AS (SELECT DISTINCT project, m FROM o WHERE m < 4), k AS (SELECT DISTINCT o.project, o.section, o.n FROM o JOIN a ON a.project = o.project AND a.section = o.section AND contains(a.t, o.n || '天'))
 SELECT o.project, o.section, o_orderkey, '第一段' || chr(10) || '工期 ' || CASE WHEN k.n IS NULL THEN '【待人工确认：' || o.n || ' 天的项目或规范依据】' ELSE o.n || ' 天' END || '完成，另需'
 || CASE WHEN f.m IS NULL THEN '【待人工确认：' || o.m || '　人的项目或规范依据】' ELSE o.m || '　人' END || '。' || chr(10) AS text
 FROM o LEFT JOIN k ON k.project = o.project AND k.section = o.section AND k.n = o.n LEFT JOIN f ON f.project = o.project AND f.m = o.m""")
def e4_chapters(spark, d):
    """Every order is a draft of a chapter; a number of days is backed by texts of its own chapter only, a number of people by facts."""
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("section"), "o_orderkey", (F.col("o_custkey") % 40).cast("string").alias("n"),
        (F.col("o_orderkey") % 30).alias("m"))
    people = F.col("m").cast("string")
    text = F.concat(F.lit("第一段\n工期 "), "n", F.lit(" 天完成，另需"), people, F.lit("　人。\n"))
    allowed = o.filter("o_orderkey % 50 = 0").select("project", "section", F.concat(F.lit("计划"), "n", F.lit("天")).alias("text")).distinct()
    facts = o.filter("m < 4").select("project", people.alias("value"), F.lit("人").alias("unit")).distinct()
    clauses = o.limit(0).select("project", F.lit("").alias("standard_code"), F.lit("").alias("clause_id"), F.lit("").alias("verification_status"))
    keys = ["project", "section", "o_orderkey"]
    texts, _ = AU.block_unsupported_claims(o.select(*keys, text.alias("text")), keys, facts, clauses, allowed)
    return texts.select(*keys, "text")


def quantity_tables(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(F.lit("| 名称 | 计划数量 |\n|---|---|\n| "), F.col("l_partkey").cast("string"), F.lit(" | "), q, F.lit(" |\n| 7 | "), q, F.lit("-99 |\n| 说明 | 约"), q, F.lit(" |"))
    return li.select(F.col("l_returnflag").alias("project"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))


@query("e5_block_table_quantities", """WITH f AS (SELECT DISTINCT l_returnflag AS p, l_linenumber AS v FROM lineitem WHERE l_tax > 0.07), l AS (SELECT l_returnflag AS project, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS q FROM lineitem)
 SELECT project, l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 AS row_no, '检测到表格中的无证据数量“' || q || '”，已在正文中阻断。' AS finding FROM l WHERE (project, q) NOT IN (SELECT (p, v) FROM f)
 UNION ALL SELECT project, l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, '检测到表格中的无证据数量“' || q || '-99”，已在正文中阻断。' FROM l""")
def e5(spark, d):
    keys = ["project", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    cells = MD.markdown_tables(quantity_tables(spark, d), keys, audit=True)
    facts = table(spark, d, "lineitem").filter("l_tax > 0.07").select(F.col("l_returnflag").alias("project"), F.col("l_linenumber").cast("string").alias("value")).distinct()
    _, findings = AU.block_table_quantities(cells, keys, facts)
    return findings.select(*keys, "row_no", "finding")


@query("e5_blocked_table_texts", """WITH f AS (SELECT DISTINCT l_returnflag AS p, l_linenumber AS v FROM lineitem), l AS (SELECT l_returnflag AS project, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS q FROM lineitem),
 k AS (SELECT *, (project, q) IN (SELECT (p, v) FROM f) AS ok FROM l)
 SELECT project, l_orderkey, l_linenumber, l_partkey, l_suppkey, 'prose | 5' || chr(10) || '| 名称 | 计划数量 | 备注' || chr(10) || '|--|:-:|' || chr(10)
 || CASE WHEN ok THEN '|' || l_partkey || '|' || q || '|9' ELSE '| ' || l_partkey || ' | 【待人工确认：' || q || '】 | 9 |' END || chr(10)
 || '| 7 | 【待人工确认：' || q || '～99】 |' || chr(10) || '| 说明 | 约' || q || ' |' || chr(10) || chr(10) || '| 数量 |' || chr(10) || '| 3 |' AS text FROM k""")
def e5_texts(spark, d):
    """Tables between prose: a short separator, an open row, a range with a wide sign, and pipes that are no table."""
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    keys = ["project", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    text = F.concat(F.lit("prose | 5\n| 名称 | 计划数量 | 备注\n|--|:-:|\n|"), F.col("l_partkey").cast("string"), F.lit("|"), q, F.lit("|9\n| 7 | "), q,
                    F.lit("～99 |\n| 说明 | 约"), q, F.lit(" |\n\n| 数量 |\n| 3 |"))
    drafts = li.select(F.col("l_returnflag").alias("project"), *keys[1:], text.alias("text"))
    facts = li.select(F.col("l_returnflag").alias("project"), F.col("l_linenumber").cast("string").alias("value")).distinct()
    texts, _ = AU.block_table_texts(drafts, keys, facts)
    return texts


def issues(spark, d):
    lab = table(spark, d, "labels")
    kind = F.col("doc_id") % 7
    detail = (
        F.when(kind == 0, F.concat(F.lit("工期 "), F.col("doc_id").cast("string"), F.lit(" 天与 12km 不符")))
        .when(kind == 1, F.lit("技术部分缺少章节")).when(kind == 2, F.lit("进度图缺失")).when(kind == 3, F.lit("组织机构图不清"))
        .when(kind == 4, F.lit("流程图缺失")).when(kind == 5, F.concat(F.lit("第3."), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("条无依据")))
        .otherwise(F.lit("措辞不当")))
    where = F.when(F.col("quality") == 1, strings(["Chapter A"])).otherwise(strings(["Chapter Q"]))
    return lab.select(F.lit("all").alias("project"), F.col("doc_id").alias("issue_id"), F.concat(F.lit("q"), F.col("toxic").cast("string")).alias("title"),
                      detail.alias("detail"), where.alias("affected_sections"))


def review_evidence(spark, d):
    one = F.lit("all").alias("project")
    texts = table(spark, d, "labels").filter("quality = 1").select(one, F.concat(F.col("doc_id").cast("string"), F.lit("天 12km")).alias("text"))
    titles = table(spark, d, "region").select(one, F.concat(F.lit("Chapter "), F.substring("r_name", 1, 1)).alias("title"))
    assets = table(spark, d, "region").select(one, F.when(F.col("r_regionkey") == 0, "schedule_template_png").otherwise("quality_flow_png").alias("asset"))
    clauses = table(spark, d, "region").filter("r_regionkey in (1, 2)").select(one, F.concat(F.lit("3."), F.col("r_regionkey").cast("string")).alias("clause_id"))
    return texts, titles, assets, clauses


ISSUES = """i AS (SELECT doc_id AS issue_id, doc_id % 7 AS k, quality FROM labels),
 r AS (SELECT issue_id, CASE WHEN k = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = 1 AND contains(l.doc_id || '天', i.issue_id || '天')) THEN '正文及项目事实中不存在被指称数字：' || issue_id || ' 天'
 WHEN k = 1 AND quality = 1 THEN '章节清单和DOCX结构审计已确认对应独立章节存在' WHEN k = 2 THEN '资产清单和DOCX结构审计已确认进度图存在'
 WHEN k = 4 THEN '资产清单和DOCX结构审计已确认流程图存在' WHEN k = 5 AND issue_id % 3 + 1 IN (1, 2) THEN '引用条款已由本地规范原文解析并标记为已验证' END AS reason FROM i)"""


@query("e6_dismissed_issues", f"WITH {ISSUES} SELECT issue_id, reason AS dismissed_reason FROM r WHERE reason IS NOT NULL")
def e6(spark, d):
    _, dismissed = AU.validate_review_issues(issues(spark, d), *review_evidence(spark, d))
    return dismissed.select("issue_id", "dismissed_reason")


@query("e6_accepted_issues", f"WITH {ISSUES} SELECT issue_id FROM r WHERE reason IS NULL")
def e6_accepted(spark, d):
    accepted, _ = AU.validate_review_issues(issues(spark, d), *review_evidence(spark, d))
    return accepted.select("issue_id")


@query("e7_clean_structure", r"""WITH t AS (SELECT page_id, starts_with(url, 'https') AS m, CASE WHEN starts_with(url, 'https') THEN '```mermaid' || chr(10) || 'A-->B' || chr(10) || '```' || chr(10) || chr(10) || chr(10) ELSE '```py' || chr(10) || 'x' || chr(10) || '```' END
 || 'x<sub>2</sub>' || html || chr(10) || '## 本章依据追溯' || chr(10) || '| a |' AS t FROM pages),
 a AS (SELECT page_id, m, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)```mermaid\b.*?```', '', 'g'), '(?s)```(?:\w+)?\s*.*?```', '', 'g'), '(?i)</?(?:sub|sup|br)\s*/?>', '', 'g'), '(?s)(^|\n)#{1,4}\s*本章依据追溯\s*\n.*$', '\1') AS t FROM t)
 SELECT page_id, trim(regexp_replace(CASE WHEN m THEN regexp_replace(t, '\s+$', '') || chr(10) || chr(10) || '图示由系统以原生图形组件生成，见本节末。' ELSE t END, '\n{3,}', chr(10) || chr(10), 'g'), E' \n\t\r') AS text FROM a""")
def e7(spark, d):
    p = table(spark, d, "pages")
    head = F.when(F.col("url").startswith("https"), F.lit("```mermaid\nA-->B\n```\n\n\n")).otherwise(F.lit("```py\nx\n```"))
    text = F.concat(head, F.lit("x<sub>2</sub>"), "html", F.lit("\n## 本章依据追溯\n| a |"))
    return p.select("page_id", AU.clean_structure(text).alias("text"))


@query("e8_drop_ascii_diagrams", """SELECT conv_id, turn, CASE role WHEN 'user' THEN '# a' || chr(10) || '## 组织机构图' || chr(10) || chr(10) || '图示由系统以原生图形组件生成，见本节末。' || chr(10)
 || chr(10) || '## next' || chr(10) || text WHEN 'assistant' THEN '### 流程图' || chr(10) || '↓' || chr(10) || '→' || chr(10) || '# x' || chr(10) || text
 ELSE '# 流程图' || chr(10) || chr(10) || '图示由系统以原生图形组件生成，见本节末。' || chr(10) END AS text FROM conversations WHERE NOT contains(text, '#') AND length(text) > 0""")
def e8(spark, d):
    c = table(spark, d, "conversations").filter(~F.col("text").contains("#") & (F.length("text") > 0))
    text = (
        F.when(F.col("role") == "user", F.concat(F.lit("# a\n## 组织机构图\n| x |\n...\n### deep\n→\nword\n## next\n"), "text"))
        .when(F.col("role") == "assistant", F.concat(F.lit("### 流程图\n↓\n→\n# x\n"), "text"))
        .otherwise(F.concat(F.lit("# 流程图\n↓\n→\n## 组织机构图\n|\n"), F.translate("text", "\n", " "))))
    return AU.drop_ascii_diagrams(c.select("conv_id", "turn", text.alias("text")), ["conv_id", "turn"])


@query("e9_strip_duplicate_heading", r"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t FROM pages) SELECT page_id,
 CASE WHEN starts_with(url, 'https') THEN trim('body ' || t) ELSE 'other ' || t || chr(10) || 'body' END AS text FROM p""")
def e9(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("t"))
    text = F.when(F.col("url").startswith("https"), F.concat(F.lit(" \n\n## 第三章 "), "t", F.lit("：\nbody "), "t", F.lit("\n"))).otherwise(
        F.concat(F.lit("other "), "t", F.lit("\nbody")))
    return p.select("page_id", AU.strip_duplicate_heading(text, F.col("t")).alias("text"))


@query("e10_append_trace", r"""WITH a AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: '| 项目依据 | ' || replace(x || '|', '|', '／') || ' |') AS p, string_split(text, ' ')[13:15] AS r, role FROM conversations)
 SELECT conv_id, turn, 'body' || chr(10) || chr(10) || '### 本章依据追溯' || chr(10) || chr(10) || '| 依据类型 | 来源 |' || chr(10) || '|---|---|' || chr(10) || array_to_string(p, chr(10)) ||
 coalesce((SELECT string_agg(chr(10) || '| 编制依据 | ' || x || ' |', '') FROM (SELECT unnest(r) AS x)), '') || CASE role WHEN 'user' THEN chr(10) || '| 待确认输入 | a、b |' ELSE '' END AS text FROM a""")
def e10(spark, d):
    words = F.split("text", " ")
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", F.transform(words, lambda w: F.concat(w, F.lit("|"))).alias("p"), F.slice(words, 13, 3).alias("r"),
        F.when(F.col("role") == "user", strings(["a", "b"])).otherwise(strings([])).alias("m"))
    return c.select("conv_id", "turn", AU.append_trace(F.lit("body \n"), "p", "r", "m").alias("text"))


# --- review queue ---------------------------------------------------------------------

def queue(spark, d):
    s = chapters(spark, d)
    full = SE.build_sections(s, basis(spark, d), SE.missing_inputs(s, evidence(spark, d), **KEYWORDS))
    stds = standards(spark, d).withColumn("affected_sections", strings(["Chapter C"]))
    docs = table(spark, d, "documents")
    files = docs.filter("lang <> 'fr' or source like '%1'").select(F.col("source").alias("project"), F.when(
        F.col("lang") == "de", "drawing").when(F.col("lang") == "fr", "budget").otherwise("tender").alias("role"))
    assets = docs.filter("source like '%2'").select(F.col("source").alias("project"))
    labels = [("design_report", "token或nothing", "high"), ("budget", "MIT", "high"), ("drawing", "x", "medium")]
    return RV.build_review_queue(sources(spark, d), full, stds, FA.detect_conflicts(text_facts(spark, d)), files, assets, labels)


@query("e11_build_review_queue", f"""WITH {STANDARDS}, {MISSING}, {TEXT_FACTS.replace('hits AS', 'fh AS').replace('FROM hits', 'FROM fh')},
 ch(sc, title) AS (VALUES ('01', 'Chapter A、Basics'), ('02', 'Chapter B'), ('03', 'Chapter C、Licences'), ('04', 'Chapter Z')),
 v AS (SELECT project, key, count(DISTINCT norm) AS n FROM norms GROUP BY 1, 2)
 SELECT project, '资料冲突' AS category, key || '存在不一致' AS title, 'high' AS severity, '工程概况与施工条件|施工进度计划及保证措施' AS sections FROM v WHERE n > 1
 UNION ALL SELECT project, '规范待下载', '缺少规范原文：' || code, 'medium', 'Chapter C' FROM stds
 UNION ALL SELECT project, '资料缺失', '未识别到token或nothing', 'high', 'Chapter A、Basics' FROM pr
 UNION ALL SELECT project, '资料缺失', '未识别到MIT', 'high', 'Chapter C、Licences' FROM pr WHERE project NOT IN (SELECT source FROM documents WHERE lang = 'fr' AND source LIKE '%1')
 UNION ALL SELECT project, '资料缺失', '未识别到x', 'medium', '' FROM pr WHERE project NOT IN (SELECT source FROM documents WHERE lang = 'de')
 UNION ALL SELECT project, '案例资产缺失', '当前没有可用的公司已通过成品', 'medium', '全局' FROM pr WHERE project NOT LIKE '%2'
 UNION ALL SELECT project, '章节输入缺失', any_value(title) || '尚缺输入', 'medium', any_value(title) FROM missing JOIN ch USING (sc) GROUP BY project, sc""")
def e11(spark, d):
    return queue(spark, d).select("project", "category", "title", "severity", F.array_join("affected_sections", "|").alias("sections"))


@query("e12_reference_review_rows", C10_SQL + """ SELECT l.doc_id, '未找到引用目标：' || l.key AS title, l.fulltext || '；指向：' || '第' || target_page || '页' ||
 CASE WHEN tb = '' THEN '' ELSE ' ' || tb END || '。系统未把引用语当作实际项目值。' AS detail, 'high' AS severity FROM links l LEFT JOIN r USING (doc_id, block_ord) WHERE r.value IS NULL""")
def e12(spark, d):
    facts, links = order_facts(spark, d)
    return RV.reference_review_rows(FA.resolve_fact_links(links, facts)).select("doc_id", "title", "detail", "severity")


def event_items(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_type").alias("category"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("title"), F.lit("d").alias("detail"),
        F.when(k > 66, "high").when(k > 33, "medium").otherwise("low").alias("severity"), F.array(F.col("event_type")).alias("affected_sections"),
        F.when(F.col("value") < 30, "open").when(F.col("value") < 60, "resolved").otherwise("dismissed").alias("status"), F.col("event_id").alias("ord"))


ITEMS = """items AS (SELECT event_id, user_id, event_type AS category, 't' || user_id AS title, CASE WHEN json_extract(props, '$.k')::INT > 66 THEN 'high' WHEN json_extract(props, '$.k')::INT > 33 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN value < 30 THEN 'open' WHEN value < 60 THEN 'resolved' ELSE 'dismissed' END AS status FROM events)"""


@query("e13_dedupe_review", f"""WITH {ITEMS} SELECT category, title, status, severity, first AS ord FROM (SELECT *, min(event_id) OVER (PARTITION BY category, title) AS first,
 row_number() OVER (PARTITION BY category, title ORDER BY status = 'open', event_id) AS rn FROM items) WHERE rn = 1""")
def e13(spark, d):
    return RV.dedupe_review(event_items(spark, d)).select("category", "title", "status", "severity", "ord")


@query("e14_release_gate", f"""WITH {ITEMS}, runs AS (SELECT DISTINCT o_custkey AS run_id FROM orders),
 st AS (SELECT o_custkey AS run_id, min(o_orderstatus) AS s, max(o_orderpriority) AS p FROM orders GROUP BY 1),
 secs AS (SELECT c_custkey AS run_id, c_mktsegment AS title, c_acctbal FROM customer WHERE c_acctbal > 0)
 SELECT run_id, 'roles_unconfirmed' AS violation FROM st WHERE p < '5' UNION ALL SELECT run_id, 'visual_analysis_pending' FROM st WHERE s = 'O'
 UNION ALL SELECT run_id, 'no_sections' FROM runs WHERE run_id NOT IN (SELECT run_id FROM secs) UNION ALL SELECT DISTINCT run_id, 'incomplete_section' FROM secs WHERE title = 'MACHINERY' OR c_acctbal > 9000
 UNION ALL SELECT DISTINCT user_id, 'open_conflict' FROM items WHERE category = 'error' AND severity = 'high' AND status = 'open'
 UNION ALL SELECT DISTINCT doc_id, 'open_model_difference' FROM labels WHERE toxic = 1""")
def e14(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        (F.max("o_orderpriority") >= "5").alias("file_roles_confirmed"), F.when(F.min("o_orderstatus") == "O", "visual_analysis_pending").otherwise("ok").alias("status"))
    secs = table(spark, d, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("run_id"), F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(F.col("c_mktsegment")).alias("title"),
        F.array(F.lit("c")).alias("components"), F.when(F.col("c_acctbal") > 9000, strings([])).otherwise(strings(["a"])).alias("acceptance"))
    items = event_items(spark, d).withColumn("run_id", F.substring("title", 2, 10).cast("bigint"))
    diffs = table(spark, d, "labels").select(F.col("doc_id").alias("run_id"), F.when(F.col("toxic") == 1, "open").otherwise("closed").alias("status"))
    return RV.release_gate(runs, secs, items, diffs, ["error"])


@query("e15_resolve_review", """WITH i AS (SELECT event_id, user_id, event_type, value, json_extract(props, '$.k')::INT AS k FROM events)
 SELECT event_id AS item_id, CASE WHEN user_id % 3 = 0 AND value > 40 THEN 'dismissed' WHEN event_type = 'click' AND k % 10 < 5 THEN 'resolved' WHEN event_type = 'view' AND user_id < 20 THEN 'resolved' ELSE 'open' END AS status,
 CASE WHEN user_id % 3 = 0 AND value > 40 THEN 'by hand' WHEN event_type = 'click' AND k % 10 < 5 THEN 's/' || (k % 10) WHEN event_type = 'view' AND user_id < 20 THEN '已关联图纸PDF' ELSE '' END AS resolution FROM i""")
def e15(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    one = F.lit("all").alias("project")
    kind = F.col("event_type")
    items = e.select(
        one, F.col("event_id").alias("item_id"), F.when(kind == "click", "规范待下载").when(kind == "view", "图纸待转换").otherwise("other").alias("category"),
        F.concat(F.lit("缺少规范原文：SL 30"), (F.col("k") % 10).cast("string")).alias("title"), F.concat(F.lit("d/"), F.col("user_id").cast("string")).alias("source_path"), F.lit("open").alias("status"))
    stds = table(spark, d, "region").select(one, F.concat(F.lit("SL30"), F.col("r_regionkey").cast("string")).alias("code"), F.concat(F.lit("s/"), F.col("r_regionkey").cast("string")).alias("path"))
    drawings = table(spark, d, "nation").filter("n_nationkey < 20").select(one, F.concat(F.lit("d/"), F.col("n_nationkey").cast("string")).alias("source_path"))
    decisions = e.filter("user_id % 3 = 0").select(F.col("event_id").alias("item_id"), F.when(F.col("value") > 40, "dismissed").otherwise("maybe").alias("status"),
                                                   F.lit("by hand").alias("resolution"), F.col("ts").alias("decided_at"))
    return RV.resolve_review(items, stds, drawings, decisions).select("item_id", "status", "resolution")


@query("e16_run_metrics", f"""WITH {BASIS}, p AS (SELECT DISTINCT source AS project FROM documents), rq AS (SELECT project, count(*) AS n FROM reqs GROUP BY 1),
 cov AS (SELECT project, count(DISTINCT trim(item)) AS n FROM re WHERE sc IS NOT NULL GROUP BY 1), fl AS (SELECT source AS project, count(*) AS n FROM documents GROUP BY 1),
 fc AS (SELECT project, count(*) AS n FROM mf GROUP BY 1), sd AS (SELECT project, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS r FROM stds GROUP BY 1),
 lb AS (SELECT source AS project, count(*) AS n, count(*) FILTER (quality = 1) AS o, count(*) FILTER (toxic = 1) AS h, count(*) FILTER (toxic = 1 AND quality = 1) AS oh, sum(doc_id % 101) / count(*) AS av FROM labels JOIN documents USING (doc_id) GROUP BY 1)
 SELECT p.project, coalesce(rq.n, 0) AS requirement_count, CASE WHEN coalesce(rq.n, 0) = 0 THEN 0 ELSE least(100, round_even(coalesce(cov.n, 0) / rq.n * 100, 0)) END::INT AS requirement_coverage, fl.n AS file_count, coalesce(fc.n, 0) AS fact_count,
 coalesce(sd.n, 0) AS standards_count, coalesce(sd.r, 0) AS standards_ready, CASE WHEN sd.n > 0 THEN round_even(sd.r / sd.n * 100, 0) ELSE 100 END::INT AS standards_readiness, coalesce(lb.n, 0) AS section_count,
 coalesce(round_even(lb.av, 0), 0)::INT AS chapter_completion, coalesce(o, 0) AS open_confirmations, coalesce(h, 0) AS high_risks, coalesce(oh, 0) AS open_high_risks,
 coalesce(lb.n, 0) AS reference_link_count, coalesce(o, 0) AS reference_link_resolved, CASE WHEN lb.n > 0 THEN round_even(o / lb.n * 100, 0) ELSE 100 END::INT AS reference_link_readiness
 FROM p LEFT JOIN rq USING (project) LEFT JOIN cov USING (project) LEFT JOIN fl USING (project) LEFT JOIN fc USING (project) LEFT JOIN sd USING (project) LEFT JOIN lb USING (project)""")
def e16(spark, d):
    reqs = stable(requirements(spark, d))
    edges = SE.requirement_edges(RQ.response_matrix(reqs), chapters(spark, d), ALIASES)
    docs = table(spark, d, "documents").select(F.col("source").alias("project"), "doc_id")
    marks = table(spark, d, "labels").join(docs, "doc_id")
    review = marks.select("project", F.when(F.col("quality") == 1, "open").otherwise("resolved").alias("status"), F.when(F.col("toxic") == 1, "high").otherwise("low").alias("severity"))
    links = marks.select("project", F.when(F.col("quality") == 1, "resolved").otherwise("unresolved").alias("status"))
    stds = standards(spark, d).withColumn("status", F.when(F.col("doc_id") % 2 == 0, "available").otherwise("pending_download"))
    secs = marks.select("project", (F.col("doc_id") % 101).alias("completion"))
    return RV.run_metrics(sources(spark, d), docs, reqs, edges, FA.merge_facts(text_facts(spark, d)), stds, secs, review, links)


@query("e16_requirement_metrics", f"""WITH {X.REQUIREMENTS}, m AS (SELECT project, requirement, {SECTION_SQL} AS s FROM reqs)
 SELECT project, count(*) AS requirement_count, least(100, round_even(count(DISTINCT requirement) FILTER (s <> 'Chapter Z') / count(*) * 100, 0))::INT AS requirement_coverage FROM m GROUP BY 1""")
def e16_requirements(spark, d):
    m = RQ.response_matrix(requirements(spark, d)).withColumn("mapped", F.when(F.col("target_section") != X.DEFAULT_SECTION, F.col("requirement")))
    return m.groupBy("project").agg(F.count(F.lit(1)).alias("requirement_count"), F.count_distinct("mapped").alias("_c")).select(
        "project", "requirement_count", F.least(F.lit(100), RV.percent(F.col("_c"), F.col("requirement_count"), 0)).alias("requirement_coverage"))


@query("e17_progress", """SELECT o_custkey AS run_id, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS completed, count(*) FILTER (o_orderstatus = 'O') AS successful, count(*) FILTER (o_orderstatus = 'F') AS failed,
 round_even(sum(o_orderkey % 101) / count(*), 0)::INT AS chapter_completion, round_even(count(*) FILTER (o_orderstatus = 'O') / count(*) * 100, 0)::INT AS approved_percent,
 CASE WHEN count(*) FILTER (o_orderstatus = 'O') = count(*) THEN 'ready_for_assembly' ELSE 'generating' END AS status FROM orders GROUP BY 1""")
def e17(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 101).alias("completion"), F.when(
        F.col("o_orderstatus") == "O", "generated").when(F.col("o_orderstatus") == "F", "blocked").otherwise("pending").alias("status"))
    return RV.progress(s)


@query("e18_validate_contract", """SELECT event_id, 'severity: odd' AS violation FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'status: view' FROM events WHERE event_type = 'view'
 UNION ALL SELECT event_id, 'title: missing' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'detail: no column' FROM events""")
def e18(spark, d):
    kind = F.col("event_type")
    e = table(spark, d, "events").select(
        "event_id", kind.alias("category"), F.when(kind != "error", F.lit("t")).alias("title"), F.when(kind == "click", "odd").otherwise("low").alias("severity"),
        F.when(kind == "view", "view").otherwise("open").alias("status"))
    return RV.contract_violations(e, config.CONTRACTS["confirmation"], "event_id")


@query("e19_refresh_review", f"""WITH {ITEMS} SELECT category, title, severity, status FROM items WHERE category NOT IN ('click', 'view')
 UNION ALL SELECT 'click', 'fresh' || doc_id, CASE quality WHEN 1 THEN 'high' ELSE 'medium' END, 'open' FROM labels""")
def e19(spark, d):
    fresh = table(spark, d, "labels").select(
        F.lit("all").alias("project"), F.concat(F.lit("fresh"), F.col("doc_id").cast("string")).alias("title"), F.lit("d").alias("detail"),
        F.when(F.col("quality") == 1, "high").otherwise("urgent").alias("severity"), strings([]).alias("affected_sections"))
    rows = RV.issue_rows(fresh, "click").drop("project")
    return RV.refresh_review(event_items(spark, d), ["click", "view"], rows).select("category", "title", "severity", "status")


def outcome_tables(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("code"), "o_orderstatus", "o_orderpriority")
    secs = o.select("run_id", "code", F.col("o_orderpriority").alias("title"), F.lit("ready").alias("status"), F.lit(40).alias("completion"))
    res = o.filter("o_orderstatus <> 'P'").select(
        "run_id", "code", (F.col("o_orderstatus") == "O").alias("ok"), F.lit("text").alias("content"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("e"), "code")).alias("error"),
        F.when(F.col("o_orderpriority").startswith("1"), strings(["ask a", "ask b"])).otherwise(strings([])).alias("human_items"))
    return secs, res


@query("e20_section_outcomes", """SELECT o_custkey AS run_id, o_orderkey::VARCHAR AS code, CASE o_orderstatus WHEN 'O' THEN 'generated' WHEN 'F' THEN 'blocked' ELSE 'ready' END AS status,
 CASE o_orderstatus WHEN 'O' THEN 100 ELSE 40 END AS completion, CASE o_orderstatus WHEN 'O' THEN 'text' WHEN 'F' THEN '【待人工确认：本章模型生成失败，原因：e' || o_orderkey || '】' ELSE '' END AS content FROM orders""")
def e20(spark, d):
    chapters_, _, _, _ = RV.section_outcomes(*outcome_tables(spark, d))
    return chapters_.select("run_id", "code", "status", "completion", F.coalesce("content", F.lit("")).alias("content"))


@query("e20_outcome_review", """SELECT o_custkey AS run_id, o_orderpriority || '待确认' AS title, unnest(['ask a', 'ask b']) AS detail, 'medium' AS severity FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%'""")
def e20_review(spark, d):
    _, _, review, _ = RV.section_outcomes(*outcome_tables(spark, d))
    return review.select("run_id", "title", "detail", "severity")


@query("e20_failed_runs", """SELECT o_custkey AS run_id, min_by('e' || o_orderkey, o_orderkey::VARCHAR) AS first_error FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING bool_and(o_orderstatus = 'F')""")
def e20_failed(spark, d):
    _, _, _, failed = RV.section_outcomes(*outcome_tables(spark, d))
    return failed
