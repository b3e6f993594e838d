"""Behaviour on small Chinese documents with the default word lists."""

from pyspark.sql import functions as F

from traceframe.functions import references as R, text as X
from traceframe.operators import (
    audit as AU, cases as CA, drawings as DR, facts as FA, markdown as MD, requirements as RQ, review as RV, standards as ST,
)


def blocks(spark, pages, doc=1, path="a/t.pdf", project="p"):
    rows = [(project, doc, path, i, page, text) for i, (page, text) in enumerate(pages)]
    return spark.createDataFrame(rows, "project string, doc_id int, path string, block_ord int, page int, text string")


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def facts_of(spark, pages):
    m = FA.fact_matches(blocks(spark, pages))
    facts = FA.extract_facts(None, matches=m)
    links = FA.resolve_fact_links(FA.fact_links(m), facts)
    return facts, links, FA.merge_facts(FA.apply_resolved_links(facts, links))


def test_pointer_resolves_without_conflict(spark):
    pages = [(5, "项目名称：详见P12页投标人须知前附表\n工期要求详见第12页附表一"),
             (12, "投标人须知前附表\n项目名称：某河道综合治理工程\n计划总工期：180日历天。")]
    facts, links, merged = facts_of(spark, pages)
    link = links.collect()
    assert [(r.fact_key, r.target_page, r.target_table, r.status, r.resolved_value, r.resolved_page) for r in link] == [
        ("项目名称", 12, "投标人须知前附表", "resolved", "某河道综合治理工程", 12)]
    rows = {r.key: r for r in merged.collect()}
    assert rows["项目名称"].value == "某河道综合治理工程" and rows["项目名称"].confidence == 0.95
    assert rows["项目名称"].chain_count == 1
    assert rows["总工期"].value == "180" and rows["总工期"].unit == "日历天"
    assert FA.detect_conflicts(facts).count() == 0


def test_equal_mentions_merge_and_conflicts_stay(spark):
    pages = [(2, "项目名称：某河道治理工程"), (8, "工程名称：《某河道治理工程》"), (9, "项目名称：另一工程")]
    facts, _, merged = facts_of(spark, pages)
    rows = sorted((r.value, r.mention_count, r.source_page) for r in merged.collect())
    assert rows == [("另一工程", 1, 9), ("某河道治理工程", 2, 2)]
    c = FA.detect_conflicts(facts).collect()
    assert len(c) == 1 and c[0].detail == "某河道治理工程（t.pdf 第2页）；另一工程（t.pdf 第9页）"


def test_nearest_page_is_taken(spark):
    pages = [(3, "质量目标：合格"), (30, "质量标准：合格。"), (20, "质量目标：详见第28页")]
    _, links, _ = facts_of(spark, pages)
    assert [(r.status, r.resolved_page) for r in links.collect()] == [("resolved", 30)]


def test_pointer_line_is_an_edge(spark):
    b = blocks(spark, [(5, "工期要求详见第12页附表一"), (12, "附表一\n计划总工期为180日历天，必须响应")])
    reqs = RQ.extract_requirements(b)
    links = RQ.resolve_requirement_links(RQ.requirement_links(RQ.requirement_candidates(b), b), reqs)
    assert [(r.id, r.source_page, r.source_line) for r in reqs.collect()] == [("REQ-001", 12, 2)]
    row = links.first()
    assert (row.status, row.resolved_ids, row.resolved_pages) == ("resolved", ["REQ-001"], [12])
    assert RQ.reference_chain(links).count() == 1


def test_value_with_reference_is_kept(spark):
    b = blocks(spark, [(4, "总工期为180日历天，关键节点安排详见第12页附表一。")])
    assert RQ.extract_requirements(b).count() == 1
    assert RQ.requirement_links(RQ.requirement_candidates(b), b).count() == 1


def test_summary_lists_open_references(spark):
    b = blocks(spark, [(4, "本项目采用通过制评审\n安全要求详见第99页附表九")])
    reqs = RQ.extract_requirements(b)
    links = RQ.resolve_requirement_links(RQ.requirement_links(RQ.requirement_candidates(b), b), reqs)
    s = RQ.requirement_summary(reqs, links).first()
    assert s.detected_mode == "pass_fail" and len(s.human_checks) == 4 and s.human_checks[3].endswith("安全要求详见第99页附表九")


def test_standard_keeps_page_and_platform(spark):
    b = blocks(spark, [(28, "执行《水利水电工程施工组织设计规范》SL 303-2017。"), (29, "技术标准 DB33/T 1001—2020 与 SL 303-2017")])
    rows = {r.code: r for r in ST.extract_standards(b).collect()}
    assert rows["SL 303-2017"].source_page == 28 and rows["SL 303-2017"].title == "水利水电工程施工组织设计规范"
    assert rows["SL 303-2017"].official_platform == "水利部及水利行业标准平台" and rows["SL 303-2017"].version == "2017"
    assert rows["DB33/T 1001—2020"].version == "2020"


def test_clauses_and_identity(spark):
    text = "SL 303-2017\n1.0.1 为规范编制，制定本规范。\n3.2.1 施工前应编制方案。\n继续说明\n3.2.2 严禁擅自变更。"
    b = blocks(spark, [(1, text)])
    cl = ST.extract_clauses(b)
    rows = [(r.clause_id, r.mandatory_level, r.text) for r in cl.orderBy("line_no").collect()]
    assert [r[0] for r in rows] == ["1.0.1", "3.2.1", "3.2.2"] and rows[2][1] == "mandatory"
    assert rows[1][2] == "施工前应编制方案。 继续说明"
    att = spark.createDataFrame([("p", 1, "SL 303—2017"), ("p", 1, "SL 999-2000")], "project string, doc_id int, code string")
    got = {r.code: (r.identity_verified, r.status, r.clause_count) for r in ST.verify_standards(att, b, cl).collect()}
    assert got == {"SL 303—2017": (True, "available", 3), "SL 999-2000": (False, "needs_confirmation", 3)}


def test_code_across_a_page_break_is_found(spark):
    b = blocks(spark, [(1, "本标准编号 SL 3"), (2, "03-2017 自发布之日起实施")])
    att = spark.createDataFrame([("p", 1, "SL 303-2017")], "project string, doc_id int, code string")
    assert ST.verify_standards(att, b, ST.extract_clauses(b)).first().identity_verified


def claims(spark, text, facts=(), clauses=(), allowed="", **kw):
    d = spark.createDataFrame([("p", 1, text)], "project string, id int, text string")
    f = spark.createDataFrame(list(facts), "project string, value string, unit string")
    c = spark.createDataFrame(list(clauses), "project string, standard_code string, clause_id string, verification_status string")
    a = spark.createDataFrame([("p", allowed)], "project string, text string")
    out, findings = AU.block_unsupported_claims(d, ["project", "id"], f, c, a, **kw)
    return out.first().text, sorted(r.token for r in findings.collect())


def test_unsupported_claims_are_blocked(spark):
    text, found = claims(spark, "总工期180日历天；压实度95%；依据SL 260-2014第6.2条。", [("p", "180", "日历天")])
    assert found == ["95%", "SL 260-2014第6.2条"]
    assert text == ("总工期180日历天；压实度【待人工确认：95%的项目或规范依据】；依据【待人工确认：SL 260-2014第6.2条的项目或规范依据】。")


def test_verified_clause_stays_and_placeholder_returns(spark):
    text, found = claims(
        spark, "按SL 303-2017第3.2.1条执行。原占位【待人工确认：180天的项目或规范依据】", [("p", "180", "日历天")],
        [("p", "SL 303-2017", "3.2.1", "verified_local_source")])
    assert found == [] and text == "按SL 303-2017第3.2.1条执行。原占位180天"


def test_support_by_containment_and_exact(spark):
    assert claims(spark, "历时80天", [], [], "总工期180天")[1] == []
    assert claims(spark, "历时80天", [], [], "总工期180天", exact=True)[1] == ["80天"]


def test_table_quantities(spark):
    t = spark.createDataFrame([("p", 1, "| 岗位 | 人数 |\n|---|---|\n| 经理 | 2 |\n| 工人 | 4 |\n| 说明 | 若干 |")], "project string, id int, text string")
    cells = MD.markdown_tables(t, ["project", "id"], audit=True)
    facts = spark.createDataFrame([("p", "2")], "project string, value string")
    out, findings = AU.block_table_quantities(cells, ["project", "id"], facts)
    assert [r.finding for r in findings.collect()] == ["检测到表格中的无证据数量“4”，已在正文中阻断。"]
    lines = AU.cells_to_text(out.drop("blocked"), ["project", "id"]).orderBy("row_no").collect()
    assert lines[2].line == "| 工人 | 【待人工确认：4】 |"


def test_structure_cleaning(spark):
    text = "正文<br>\n```mermaid\ngraph TD\n```\n\n\n\n尾\n### 本章依据追溯\n| a | b |"
    assert one(spark, AU.clean_structure(F.lit(text))) == "正文\n\n尾\n\n图示由系统以原生图形组件生成，见本节末。"
    d = spark.createDataFrame([(1, "## 组织机构图\n|a|\n↓\n...\n## 后文\n内容")], "id int, text string")
    assert AU.drop_ascii_diagrams(d, ["id"]).first().text == "## 组织机构图\n\n图示由系统以原生图形组件生成，见本节末。\n\n## 后文\n内容"
    assert one(spark, AU.strip_duplicate_heading(F.lit("\n## 第一章 概况：\n内容"), F.lit("概况"))) == "内容"
    assert one(spark, AU.strip_duplicate_heading(F.lit("其他\n概况"), F.lit("概况"))) == "其他\n概况"


def test_false_review_claims_are_dismissed(spark):
    issues = spark.createDataFrame(
        [("p", 1, "工期", "写成367天", []), ("p", 2, "图", "缺少进度图", []), ("p", 3, "条款", "3.2.1条无法验证", []), ("p", 4, "措辞", "重复", [])],
        "project string, issue_id int, title string, detail string, affected_sections array<string>")
    texts = spark.createDataFrame([("p", "总工期180天")], "project string, text string")
    titles = spark.createDataFrame([("p", "概况")], "project string, title string")
    assets = spark.createDataFrame([("p", "schedule_template_png")], "project string, asset string")
    cl = spark.createDataFrame([("p", "3.2.1")], "project string, clause_id string")
    ok, no = AU.validate_review_issues(issues, texts, titles, assets, cl)
    assert [r.issue_id for r in ok.collect()] == [4]
    assert {r.issue_id for r in no.collect()} == {1, 2, 3}


def test_drawing_without_pdf_is_a_gap(spark):
    schema = "project string, ord int, name string, path string"
    dwg = spark.createDataFrame([("p", 1, "总平面图.dwg", "a.dwg"), ("p", 2, "孤立.dwg", "b.dwg")], schema)
    pdf = spark.createDataFrame([("p", 1, "总平面图-最终版.pdf", "a.pdf"), ("p", 2, "zzz.pdf", "z.pdf")], schema)
    reg, gaps = DR.pair_files(dwg, pdf)
    rows = {(r.side, r.ord): (r.pdf_path, r.status) for r in reg.collect()}
    assert rows == {("dwg", 1): ("a.pdf", "pending_analysis"), ("dwg", 2): ("", "missing_pdf"), ("pdf", 2): ("z.pdf", "pending_analysis")}
    assert [r.title for r in gaps.collect()] == ["孤立.dwg 尚无对应PDF"]


def test_disabled_case_is_never_matched(spark):
    cols = ("case_id int, title string, project_type string, enabled boolean, updated_at int, tags string, tender_text string, bid_text string, patterns string")
    cases = spark.createDataFrame([(1, "a", "河道", True, 1, "", "", "", ""), (2, "b", "河道", False, 2, "", "", "", "")], cols)
    p = spark.createDataFrame([("x", "河道")], "project string, project_type string")
    assert [r.case_id for r in CA.match_cases(p, cases).collect()] == [1]
    assert [r.case_id for r in CA.search_cases(cases, project_type="河道").collect()] == [1]


def test_case_parameters_are_masked(spark):
    assert one(spark, X.mask_parameters(F.lit("围堰高25m，工期180日历天"))) == "围堰高【项目参数】，工期【项目参数】"


def test_text_functions(spark):
    assert one(spark, X.compact_text(F.lit("一　二 三  四"), 5)) == "一 二…"
    assert one(spark, X.split_lines(F.lit("a\r\nb c\n"))) == ["a", "b", "c"]
    assert one(spark, X.split_lines(F.lit(""))) == []
    assert one(spark, R.is_reference_only(F.lit("以 P.12 为准"))) is True
    assert one(spark, R.strip_reference_tail(F.lit("合格（详见第3页前附表）"))) == "合格"
    assert one(spark, R.parse_reference(F.lit("见表 3．2"))).target_table == "表3.2"
    assert [one(spark, X.chinese_number(F.lit(n))) for n in (0, 9, 10, 19, 20, 99, 100)] == ["0", "九", "十", "十九", "二十", "九十九", "100"]
    assert one(spark, X.host_allowed(F.lit("https://www.mwr.gov.cn/x"))) is True
    assert one(spark, X.host_allowed(F.lit("https://xgov.cn/x"))) is False
    hits = one(spark, X.find_all(F.lit("a12b3"), r"\d+"))
    assert [(h.start, h.full) for h in hits] == [(1, "12"), (4, "3")]


def test_dedupe_review_prefers_closed(spark):
    rows = [("c", "t", "d", ["s"], "open", 1), ("c", "t", "d", ["s"], "resolved", 2), ("c", "u", "d", ["s"], "open", 3)]
    df = spark.createDataFrame(rows, "category string, title string, detail string, affected_sections array<string>, status string, ord int")
    got = sorted((r.title, r.status, r.ord) for r in RV.dedupe_review(df).collect())
    assert got == [("t", "resolved", 1), ("u", "open", 3)]


def test_table_quantities_of_open_tables_and_equal_keys(spark):
    texts = ["| 岗位 | 人数 |\n|--|--|\n| 工长 | 4 |", "| 岗位 | 人数\n|--|--\n| 工长 | 4", "| 岗位 | 人数 |\n|---|---|\n| 工长 | 7 |"]
    t = spark.createDataFrame([("p", 1, x) for x in texts], "project string, id long, text string")
    facts = spark.createDataFrame([("p", "7")], "project string, value string")
    out, findings = AU.block_table_quantities(MD.markdown_tables(t, ["project", "id"], audit=True), ["project", "id"], facts)
    assert out.count() == 12
    assert findings.count() == 2


def test_patch_takes_the_last_update(spark):
    from traceframe.operators import runs as RU

    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, n int")
    updates = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 1)], "id long, name string, at int")
    out, missing = RU.patch(base, updates, "id", order="at")
    assert sorted(map(tuple, out.select("id", "name", "n").collect())) == [(1, "y", 1), (2, "b", 1)]
    assert [r.id for r in missing.collect()] == [9]
    assert RU.patch(base, updates.drop("at"), "id")[0].count() == 2
