"""Queries over run tables, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.catalog import fixtures as X
from traceframe.catalog.auditing import ITEMS, event_items
from traceframe.catalog.documents import CLAUSES, STANDARDS, clauses, standards
from traceframe.catalog.extraction import C10_SQL, SECTION_SQL, TEXT_FACTS, order_facts, requirements, text_facts
from traceframe.catalog.files import DOC_FILES, doc_files
from traceframe.catalog.matching import BASIS, KEYWORDS, MISSING, basis, chapters, evidence
from traceframe.catalog.registry import query, table
from traceframe.functions.text import strings
from traceframe.operators import facts as FA, files as FI, reports as RP, requirements as RQ, runs as RU, sections as SE
from traceframe.plans.analyze import ingest_cases
from traceframe.plans.deliver import deliver
from traceframe.sources import tables as ST
from traceframe.streaming import incremental as IN


@query("f1_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def f1(spark, d):
    return RU.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("f2_list_projects", """SELECT 'c' || o_custkey AS project_dir, max(o_orderkey) AS run_id FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def f2(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("project_dir"))
    return RU.list_projects(runs)


@query("f3_recent", "SELECT event_id, event_type FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 20")
def f3(spark, d):
    return RU.recent(table(spark, d, "events"), "event_id", 20, F.col("user_id") == 8).select("event_id", "event_type")


@query("f4_search_lessons", """SELECT conv_id, turn FROM conversations WHERE lower(text) LIKE '%the%' AND role = 'user' ORDER BY conv_id * 1000 + turn DESC LIMIT 10""")
def f4(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("scope"), F.lit("t").alias("title"), F.col("text").alias("lesson"),
                                                F.lit("case").alias("tags"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"))
    return RU.search_lessons(c, "The", "user").select("conv_id", "turn")


@query("f5_upsert", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
 WHERE o_orderstatus <> 'P' OR o_orderpriority LIKE '1%'""")
def f5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    base = o.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.filter("o_orderpriority like '1%'").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return RU.upsert(base, new, ["o_orderkey"])


@query("f5_upsert_stored", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 3 OR o_orderpriority LIKE '1%' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
 FROM orders""")
def f5_stored(spark, d):
    """A stored table is updated twice, by bucket."""
    path = ST.scratch_path(spark, "orders")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    more = (F.col("o_totalprice") + 1).alias("o_totalprice")
    RU.upsert_into(path, o.drop("o_orderpriority").filter("o_orderkey % 7 <> 3"), ["o_orderkey"], buckets=16)
    RU.upsert_into(path, o.filter("o_orderpriority like '1%'").select("o_orderkey", "o_custkey", more), ["o_orderkey"])
    RU.upsert_into(path, o.filter("o_orderkey % 7 = 3").select("o_orderkey", "o_custkey", more), ["o_orderkey"])
    return ST.read_keyed(spark, path)


@query("f5_confirm_facts", """WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2), k AS (SELECT doc_id % 60 AS u, min(doc_id) AS v FROM labels GROUP BY 1)
 SELECT e.user_id, e.event_type AS key, CASE WHEN e.event_type = 'click' AND e.event_id = f.o AND v IS NOT NULL THEN 'v' || v ELSE e.value::VARCHAR END AS value FROM events e JOIN f ON f.user_id = e.user_id AND f.event_type = e.event_type
 LEFT JOIN k ON u = e.user_id UNION ALL SELECT u, 'click', 'v' || v FROM k WHERE u NOT IN (SELECT user_id FROM f WHERE event_type = 'click')""".replace("e.value::VARCHAR", "'old'"))
def f5_facts(spark, d):
    facts = table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("key"), F.lit("old").alias("value"),
                                             F.lit("").alias("unit"), F.col("event_id").alias("ord"), F.lit("extracted").alias("status"))
    dec = table(spark, d, "labels").groupBy((F.col("doc_id") % 60).alias("project")).agg(F.min("doc_id").alias("v")).select(
        "project", F.lit("click").alias("key"), F.concat(F.lit("v"), F.col("v").cast("string")).alias("value"), F.lit("").alias("unit"))
    return RU.confirm_facts(facts, dec).select(F.col("project").alias("user_id"), "key", "value")


F6_SQL = """WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%')),
 o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g))"""


def cascaded(spark, d):
    t = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    doomed = t["customer"].filter("c_acctbal < 0")
    busy = t["orders"].filter("o_orderstatus = 'P' and o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    parents = {"orders": ("customer", "c_custkey", "o_custkey"), "lineitem": ("orders", "o_orderkey", "l_orderkey")}
    return RU.cascade_delete(t, parents, "customer", "c_custkey", doomed, busy)


@query("f6_cascade_delete", F6_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)")
def f6(spark, d):
    return cascaded(spark, d)["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("f6_cascade_roots", F6_SQL + " SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g)")
def f6_roots(spark, d):
    return cascaded(spark, d)["customer"].select("c_custkey")


@query("f9_revision_history", """SELECT o_custkey, o_orderkey, row_number() OVER w AS revision, coalesce(lead(o_orderkey) OVER w, -1) AS valid_to,
 (lead(o_orderkey) OVER w IS NULL)::INT AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def f9(spark, d):
    h = RU.revision_history(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return h.select("o_custkey", "o_orderkey", "revision", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.col("is_current").cast("int").alias("is_current"))


@query("f10_model_differences", "SELECT doc_id AS source_path, 'a' AS primary_model, quality AS primary_result, toxic AS review_result, 'open' AS status FROM labels WHERE quality <> toxic")
def f10(spark, d):
    lab = table(spark, d, "labels")
    side = lambda c, m: lab.select(F.col("doc_id").alias("source_path"), F.lit(m).alias("model"), F.col(c).alias("result"))
    return RU.model_differences(side("quality", "a"), side("toxic", "b")).select("source_path", "primary_model", "primary_result", "review_result", "status")


@query("f10_model_run_log", """SELECT event_id AS run_id, event_type AS task_type, '["' || event_type || '"]' AS input_basis, CASE WHEN value > 90 THEN 'failed' ELSE 'success' END AS status FROM events""")
def f10_log(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.lit("text_master").alias("role"), F.lit("m").alias("model"), F.col("event_type").alias("task_type"),
        F.array("event_type").alias("input_basis"), F.when(F.col("value") > 90, "failed").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error"))
    path = ST.scratch_path(spark, "model_runs")
    ST.append_table(RU.model_run_log(e), path, stamp=None)
    return spark.read.parquet(path).select("run_id", "task_type", "input_basis", "status")


def case_files(spark, d):
    """Sources as case folders; english files are tenders, german ones accepted bids."""
    role = F.when(F.col("lang") == "en", "tender").when((F.col("lang") == "de") & ~F.col("source").endswith("3"), "accepted_bid").otherwise("attachment")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("source").endswith("3"), ".xlsx").otherwise(".pdf"))
    f = table(spark, d, "documents").select(
        F.col("source").alias("project"), F.concat("source", F.lit("/"), name).alias("path"), name.alias("name"), F.lit(".pdf").alias("suffix"),
        F.sha2("text", 256).alias("sha256"), role.alias("role"), F.lit(0.9).alias("confidence"), F.lit("passed_case").alias("project_kind"), "doc_id", "text")
    blocks = f.select("project", "doc_id", "path", F.lit(0).alias("block_ord"), F.lit(None).cast("int").alias("page"), "text")
    return FI.mark_duplicates(f.drop("doc_id", "text")), blocks


@query("f11_ingest_cases")
def f11(spark, d):
    files, blocks = case_files(spark, d)
    return ingest_cases(files, blocks, X.LEXICON, X.MARKERS, ["licence", "secret", "german"], ["One"])["cases"]


@query("f11_rejected_cases", """SELECT source AS project, 'no_accepted_bid' AS reason FROM documents WHERE source LIKE '%3' GROUP BY 1""")
def f11_rejected(spark, d):
    files, blocks = case_files(spark, d)
    return ingest_cases(files, blocks, X.LEXICON, X.MARKERS, ["licence"], ["One"])["rejected"]


@query("f12_append", "SELECT event_id, event_type, 1 AS unique_id, 1 AS stamped FROM events")
def f12(spark, d):
    path = ST.scratch_path(spark, "lessons")
    e = ST.with_row_id(table(spark, d, "events").select("event_id", "event_type"), ["event_id", "event_type"])
    ST.append_table(e.filter("event_type = 'view'"), path)
    ST.append_table(e.filter("event_type <> 'view'"), path)
    out = spark.read.parquet(path)
    n = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return out.join(n, "id").select("event_id", "event_type", F.col("n").cast("int").alias("unique_id"), F.col("created_at").isNotNull().cast("int").alias("stamped"))


@query("f13_lookup", """SELECT k AS o_orderkey, (o_custkey IS NOT NULL)::INT AS found, coalesce(o_custkey, -1) AS o_custkey FROM (SELECT DISTINCT l_orderkey + 1000 AS k FROM lineitem) LEFT JOIN orders ON o_orderkey = k""")
def f13(spark, d):
    keys = table(spark, d, "lineitem").select((F.col("l_orderkey") + 1000).alias("o_orderkey"))
    out = RU.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, "o_orderkey")
    return out.select("o_orderkey", F.col("found").cast("int").alias("found"), F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"))


def patched(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    u = table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"), F.when(F.col("quality") == 1, "xx").alias("lang"), F.when(F.col("toxic") == 1, "yy").alias("source"))
    return RU.patch(docs, u, "doc_id")


@query("f14_patch", """SELECT d.doc_id, CASE WHEN quality = 1 THEN 'xx' ELSE lang END AS lang, CASE WHEN toxic = 1 THEN 'yy' ELSE source END AS source FROM documents d LEFT JOIN labels l ON l.doc_id * 2 = d.doc_id""")
def f14(spark, d):
    return patched(spark, d)[0]


@query("f14_patch_rejects", "SELECT doc_id * 2 AS doc_id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def f14_rejects(spark, d):
    return patched(spark, d)[1].select("doc_id")


@query("f15_search_review", "SELECT conv_id, turn FROM conversations WHERE contains(role || text, 'ion the')")
def f15(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.col("text").alias("detail"))
    return RU.search_review(c, "ion the").select("conv_id", "turn")


@query("f15_top_open", f"WITH {ITEMS} SELECT category, event_id AS ord, title FROM items WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY category ORDER BY event_id) <= 5")
def f15_open(spark, d):
    return RU.top_open(event_items(spark, d), ["category"], ["ord"]).select("category", "ord", "title")


# --- reports --------------------------------------------------------------------------


@query("g1_task_spec", f"""WITH {BASIS}, {MISSING}, c AS (SELECT project, sc, string_agg(item, chr(10) ORDER BY kind = 'fact', ord) FILTER (side = 'project') AS pb,
 string_agg(item, chr(10) ORDER BY kind = 'standard', ord) FILTER (side = 'reference') AS rb FROM basis GROUP BY 1, 2), m AS (SELECT project, sc, string_agg(input, chr(10) ORDER BY ord) AS mi FROM missing GROUP BY 1, 2),
 ri AS (SELECT sc, string_agg(input, chr(10) ORDER BY ord) AS r FROM inp GROUP BY 1)
 SELECT c.project, c.sc AS code, coalesce(r, '') AS required_inputs, 'text' AS components, coalesce(pb, '') AS project_basis, rb AS reference_basis, coalesce(mi, '') AS missing_inputs,
 CASE WHEN mi IS NULL THEN 'ready' ELSE 'needs_input' END AS status FROM c LEFT JOIN m USING (project, sc) LEFT JOIN ri USING (sc)""")
def g1(spark, d):
    s = chapters(spark, d)
    full = SE.build_sections(s, basis(spark, d), SE.missing_inputs(s, evidence(spark, d), **KEYWORDS))
    return RP.task_spec(full).select("project", "code", "required_inputs", "components", "project_basis", "reference_basis", "missing_inputs", "status")


@query("g2_response_matrix", f"""WITH {X.REQUIREMENTS} SELECT project, doc_id, line_no AS source_place, category, requirement, {SECTION_SQL} AS target_section, 'pending' AS draft_status,
 CASE WHEN category = 'licence' THEN '是' ELSE '否' END AS human_check FROM reqs""")
def g2(spark, d):
    m = RQ.response_matrix(requirements(spark, d), checked=["licence"])
    return RP.matrix_report(m).select("project", "doc_id", "source_place", "category", "requirement", "target_section", "draft_status", "human_check")


_G3_LINKS = C10_SQL.removeprefix("WITH ").replace("hits AS", "oh AS").replace("FROM hits", "FROM oh").replace("facts AS", "ofacts AS").replace("FROM facts", "FROM ofacts").replace(
    " r AS (SELECT doc_id, block_ord, key", " rr AS (SELECT doc_id, block_ord, key")


@query("g3_basis_report", f"""WITH {DOC_FILES}, {TEXT_FACTS.replace('hits AS', 'th AS').replace('FROM hits', 'FROM th')}, {STANDARDS.replace('hits AS', 'sh AS').replace('FROM hits', 'FROM sh')},
 {CLAUSES.removeprefix(X.RAW + ', ')}, {_G3_LINKS},
 used AS (SELECT project, doc_id FROM norms UNION SELECT project, doc_id FROM stds)
 SELECT files.project, '项目资料' AS kind, name, role AS content, files.project || '/' || files.doc_id || '.txt' AS source, '' AS page, CASE WHEN used.doc_id IS NULL THEN '待利用/仅作为附件' ELSE '已利用' END AS status FROM files LEFT JOIN used ON used.doc_id = files.doc_id
 UNION ALL SELECT project, '项目事实', key, value, project || '/' || doc_id || '.txt', '', 'extracted' FROM norms
 UNION ALL SELECT 'tender', '资料引用链', l.key, l.fulltext || chr(10) || '→ 第' || target_page || '页' || CASE WHEN tb = '' THEN '' ELSE ' ' || tb END, l.path, l.page::VARCHAR, CASE WHEN rr.value IS NULL THEN 'unresolved' ELSE 'resolved' END FROM links l LEFT JOIN rr USING (doc_id, block_ord)
 UNION ALL SELECT project, '规范标准', code, title, project || '/' || doc_id || '.txt', '', 'pending_download' FROM stds
 UNION ALL SELECT project, '规范条款', 'T ' || clause_id, text, project || '/' || doc_id || '.txt', '', 'verified_local_source' FROM clauses
 UNION ALL SELECT source, '案例资产', 'Case ' || doc_id, 'structure_only', 'b.docx', '', '可用' FROM documents""")
def g3(spark, d):
    files = doc_files(spark, d).withColumn("path", F.concat("project", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    ofacts, olinks = order_facts(spark, d)
    links = FA.resolve_fact_links(olinks, ofacts).withColumn("category", F.lit("")).withColumn("resolved_ids", strings([])).withColumn(
        "resolved_pages", F.array().cast("array<int>"))
    cl = clauses(spark, d).withColumn("standard_code", F.lit("T"))
    assets = table(spark, d, "documents").select(
        F.col("source").alias("project"), F.concat(F.lit("Case "), F.col("doc_id").cast("string")).alias("title"), F.lit("structure_only").alias("reuse_rule"),
        F.lit("b.docx").alias("source_path"), strings(["全局"]).alias("applicable_sections"))
    return RP.basis_report(files, text_facts(spark, d), links, standards(spark, d), cl, assets).drop("note")


@query("g4_standards_queue", f"""WITH {STANDARDS} SELECT project, code, title, CASE WHEN doc_id % 3 = 1 THEN 'blocked' ELSE 'pending_download' END AS status, 'A' || chr(10) || 'B' AS affected_sections
 FROM stds WHERE doc_id % 3 <> 0""")
def g4(spark, d):
    s = standards(spark, d).withColumn("affected_sections", strings(["A", "B"])).withColumn("status", F.when(
        F.col("doc_id") % 3 == 0, "available").when(F.col("doc_id") % 3 == 1, "blocked").otherwise("pending_download"))
    return RP.standards_queue(s).select("project", "code", "title", "status", "affected_sections")


@query("g5_review_report", f"WITH {ITEMS} SELECT category, title, 'd' AS detail, severity, category AS affected_sections, status, '' AS recommended_action, '' AS resolution FROM items")
def g5(spark, d):
    items = event_items(spark, d).withColumn("project", F.lit("p")).withColumn("recommended_action", F.lit(None).cast("string")).withColumn("resolution", F.lit(None).cast("string"))
    return RP.review_report(items).drop("project")


@query("g6_model_differences", """SELECT doc_id::VARCHAR AS task, '{"quality":' || quality || '}' AS primary_result, '{"toxic":' || toxic || '}' AS review_result, 'open' AS status FROM labels""")
def g6(spark, d):
    lab = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("task"), F.lit("a").alias("primary_model"), F.lit("b").alias("review_model"), F.struct("quality").alias("primary_result"),
        F.struct("toxic").alias("review_result"), F.lit("x").alias("difference"), F.lit("open").alias("status"))
    return RP.difference_report(lab).select("task", "primary_result", "review_result", "status")


# --- delivery -------------------------------------------------------------------------


@query("l3_deliver_drafts", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_custkey % 17 AS n FROM orders WHERE o_custkey % 5 <> 0),
 bad AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'P')
 SELECT o_custkey AS run_id, o_orderkey::VARCHAR AS code, '正文 x2 ' || CASE WHEN o_orderkey % 4 = 0 OR n < 2 THEN n || ' 天' ELSE '【待人工确认：' || n || ' 天的项目或规范依据】' END
 || '。' || chr(10) || '| 数量 |' || chr(10) || '|--|' || chr(10) || CASE WHEN n < 2 THEN '|' || n || '|' ELSE '| 【待人工确认：' || n || '】 |' END
 || chr(10) || chr(10) || '### 本章依据追溯' || chr(10) || chr(10) || '| 依据类型 | 来源 |' || chr(10) || '|---|---|' || chr(10) || '| 项目依据 | b1 |' || chr(10) || '| 编制依据 | r |' AS text
 FROM o WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM bad)""")
def l3_drafts(spark, d):
    """Every customer is a run, every order a chapter: the gate holds back some, the rest is cleaned, audited and traced."""
    return delivery(spark, d)["drafts"].select("run_id", "code", "text")


@query("l3_deliver_progress", """WITH bad AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'P')
 SELECT o_custkey AS run_id, count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS successful, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders
 WHERE o_custkey % 5 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM bad) GROUP BY 1""")
def l3_progress(spark, d):
    return delivery(spark, d)["progress"].select("run_id", "total", "successful", "failed")


def delivery(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 17).cast("string").alias("n"))
    o = o.select("*", F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project"), F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("code"))
    runs = o.select("project", "run_id", (F.col("run_id") % 5 != 0).alias("file_roles_confirmed"), F.lit("open").alias("status")).distinct()
    sections = o.select(
        "project", "run_id", F.col("o_orderkey").alias("ord"), "code", F.concat(F.lit("标题"), "code").alias("title"), strings(["c"]).alias("components"),
        strings(["a"]).alias("acceptance"), strings(["b1"]).alias("project_basis"), strings(["r"]).alias("reference_basis"), strings([]).alias("missing_inputs"),
        F.lit("ready").alias("status"), F.lit(40).alias("completion"))
    text = F.concat(F.lit("## 第一章 标题"), "code", F.lit("\n正文 x<sub>2</sub> "), "n", F.lit(" 天。\n| 数量 |\n|--|\n|"), "n", F.lit("|"))
    results = o.select("run_id", "code", (F.col("o_orderstatus") != "F").alias("ok"), text.alias("content"), F.lit("e").alias("error"), strings([]).alias("human_items"))
    review = o.filter("o_orderpriority like '1%' and o_orderstatus = 'P'").select(
        "run_id", F.lit("资料冲突").alias("category"), F.lit("high").alias("severity"), F.lit("open").alias("status"))
    differences = o.limit(0).select("run_id", F.lit("open").alias("status"))
    facts = o.filter("n in ('0', '1')").select("project", F.lit("工期").alias("key"), F.col("n").alias("value"), F.lit("日历天").alias("unit")).distinct()
    clauses = o.limit(0).select("project", *[F.lit("").alias(c) for c in ("standard_code", "clause_id", "text", "verification_status")])
    matrix = o.filter("o_orderkey % 4 = 0").select("project", F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("REQ-"), "code").alias("requirement_id"),
                                                   F.concat(F.lit("需"), "n", F.lit("天")).alias("requirement"), F.col("code").alias("section_code"))
    return deliver(runs, sections, results, review, differences, facts, clauses, matrix)


# --- streams --------------------------------------------------------------------------


@query("h1_stream_blocks", f"""WITH first AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)), {X.LINES} SELECT doc_id, count(*) AS lines FROM lines WHERE doc_id IN (SELECT doc_id FROM first) GROUP BY 1""")
def h1(spark, d):
    """Documents arrive as files; copies are dropped and lines counted for new ones."""
    from traceframe.operators.lines import meaningful_lines

    schema = table(spark, d, "documents").schema
    # as a pattern, the table may be one file or a folder of files
    stream = IN.file_stream(spark, f"{d}/documents.parque[t]", schema, "*.parquet").select(
        F.lit("all").alias("project"), "doc_id", F.lit("").alias("path"), F.lit(0).alias("block_ord"), F.lit(None).cast("int").alias("page"), "text")
    store, results, state = (ST.scratch_path(spark, n) for n in ("store", "results", "stream"))

    def extract(new):
        lines = meaningful_lines(new.select("project", "doc_id", "path", "block_ord", "page", "text"))
        return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))

    IN.ingest_stream(stream, store, results, state, extract, order=["doc_id"]).awaitTermination()
    return spark.read.parquet(results).select("doc_id", "lines")


@query("h2_stream_review", f"""WITH {ITEMS} SELECT category, title, status, severity, first AS ord FROM (SELECT *, min(event_id) OVER (PARTITION BY category, title) AS first,
 row_number() OVER (PARTITION BY category, title ORDER BY status = 'open', event_id) AS rn FROM items) WHERE rn = 1""")
def h2(spark, d):
    """Review events arrive in several files and leave one row per item."""
    source, state, mark = (ST.scratch_path(spark, n) for n in ("events", "review", "stream"))
    items = event_items(spark, d)
    items.repartition(3, "ord").write.parquet(source)
    stream = IN.file_stream(spark, source, spark.read.parquet(source).schema, "*.parquet", 1)
    IN.review_stream(stream, state, mark).awaitTermination()
    return IN.review_state(spark, state).select("category", "title", "status", "severity", "ord")


def job_events(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(kind == "click", "running").when(kind == "purchase", "succeeded").when(
            kind == "error", "failed").otherwise("queued").alias("status"))


@query("h3_job_timings", """WITH e AS (SELECT user_id AS job_id, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS s FROM events),
 j AS (SELECT job_id, min(t) AS created_at, coalesce(min(t) FILTER (s = 'running'), -1) AS started_at, coalesce(max(t) FILTER (s IN ('succeeded', 'failed')), -1) AS finished_at, max_by(s, t) AS st, max(t) AS upd FROM e GROUP BY 1)
 SELECT job_id, created_at, started_at, finished_at, (upd < epoch_us(TIMESTAMP '2024-01-30 00:00:00') AND st NOT IN ('succeeded', 'failed'))::INT AS interrupted,
 CASE WHEN upd < epoch_us(TIMESTAMP '2024-01-30 00:00:00') AND st NOT IN ('succeeded', 'failed') THEN 'failed' ELSE st END AS status FROM j""")
def h3(spark, d):
    t = IN.job_timings(job_events(spark, d), "2024-01-30 06:00:00", "6 hours")
    micros = lambda c: F.coalesce(F.unix_micros(c), F.lit(-1)).alias(c)
    return t.select("job_id", micros("created_at"), micros("started_at"), micros("finished_at"), F.col("interrupted").cast("int").alias("interrupted"), "status")


@query("h3_job_sessions", """WITH e AS (SELECT user_id AS job_id, ts, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS s FROM events),
 g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY job_id ORDER BY t) > 21600000000, true)::INT AS fresh FROM e),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY t) AS no FROM g),
 j AS (SELECT job_id, min(t) AS created_at, coalesce(min(t) FILTER (s = 'running'), -1) AS started_at, coalesce(max(t) FILTER (s IN ('succeeded', 'failed')), -1) AS finished_at, max_by(s, t) AS st, max(t) AS upd FROM n GROUP BY job_id, no)
 SELECT job_id, created_at, started_at, finished_at, (st NOT IN ('succeeded', 'failed'))::INT AS interrupted, CASE WHEN st NOT IN ('succeeded', 'failed') THEN 'failed' ELSE st END AS status FROM j
 WHERE upd + 21600000000 <= (SELECT max(t) FROM e) - 3600000000""")
def h3_sessions(spark, d):
    """Status changes arrive week by week, and the stream goes on where it stopped; it emits jobs that were silent for six hours."""
    source, out, mark = (ST.scratch_path(spark, n) for n in ("changes", "jobs", "stream"))
    changes = job_events(spark, d)
    for low, high in (("2000-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2100-01-01")):
        changes.filter((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(source)
        sessions = IN.job_sessions(IN.file_stream(spark, source, changes.schema, "*.parquet"), "6 hours", "1 hour")
        sessions.writeStream.trigger(availableNow=True).option("checkpointLocation", mark).outputMode("append").format("parquet").start(out).awaitTermination()
    micros = lambda c: F.coalesce(F.unix_micros(c), F.lit(-1)).alias(c)
    return spark.read.parquet(out).select(
        "job_id", micros("created_at"), micros("started_at"), micros("finished_at"), F.col("interrupted").cast("int").alias("interrupted"), "status")
