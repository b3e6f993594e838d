"""Texts rewritten in place: evidence by chapter, equal keys, restored placeholders, tables between prose, diagrams."""

from pyspark.sql import functions as F

from traceframe.operators import audit as AU, standards as ST

CLAUSES = "project string, standard_code string, clause_id string, verification_status string"


def test_claims_by_chapter_and_equal_keys(spark):
    drafts = spark.createDataFrame([
        ("p", "01", "工期 180 天。\r\n- 需 25 台设备，25 台备用"), ("p", "02", "工期 180 天"), ("p", "01", "另一段：25 台，见 SL 260-2014 第 3.2 条"),
        ("p", "01", "另一段：25 台，见 SL 260-2014 第 3.2 条"), ("q", "01", "【待人工确认：30 天的项目或规范依据】后 9 km"), ("q", "02", None), ("q", "03", "")],
        "project string, section string, text string")
    facts = spark.createDataFrame([("q", "30", "日历天")], "project string, value string, unit string")
    clauses = spark.createDataFrame([("p", "SL 260-2014", "3.2", "verified_local_source")], CLAUSES)
    allowed = spark.createDataFrame([("p", "01", "总工期180天"), ("p", "02", "设备25台")], "project string, section string, text string")
    texts, findings = AU.block_unsupported_claims(drafts, ["project", "section"], facts, clauses, allowed)
    blocked = lambda t: f"【待人工确认：{t}的项目或规范依据】"
    assert sorted((r.project, r.section, str(r.text)) for r in texts.collect()) == sorted([
        ("p", "01", f"工期 180 天。\r\n- 需 {blocked('25 台')}设备，{blocked('25 台')}备用"), ("p", "02", f"工期 {blocked('180 天')}"),
        ("p", "01", f"另一段：{blocked('25 台')}，见 SL 260-2014 第 3.2 条"), ("p", "01", f"另一段：{blocked('25 台')}，见 SL 260-2014 第 3.2 条"),
        ("q", "01", f"30 天后 {blocked('9 km')}"), ("q", "02", "None"), ("q", "03", "")])
    assert sorted((r.project, r.section, r.token) for r in findings.collect()) == [
        ("p", "01", "25 台"), ("p", "01", "25 台"), ("p", "01", "25 台"), ("p", "02", "180 天"), ("q", "01", "9 km")]
    wide = allowed.drop("section")
    texts, _ = AU.block_unsupported_claims(drafts, ["project", "section"], facts, clauses, wide)
    assert not any("【" in r.text for r in texts.filter("project = 'p'").collect())


def test_tables_between_prose(spark):
    text = "数量 5\n| 名称 | 数量(台) | 工期 |\n|:--|--|-|\n|挖机|１２|30~40|\n| 泵 | 3 | 待人工确认 |\n| 短 |\n\n|数量|\n|8|\n文字 | 7 |\n| a |\n| -- |"
    drafts = spark.createDataFrame([("p", 1, text), ("p", 1, "| 数量 |\n|--|\n|7|"), ("p", 2, "no table"), ("p", 3, None), ("p", 4, "|--|\n|数量|\n|--|\n|4|\n")],
                                   "project string, id int, text string")
    facts = spark.createDataFrame([("p", "3"), ("q", "7")], "project string, value string")
    texts, findings = AU.block_table_texts(drafts, ["project", "id"], facts)
    want = text.replace("|挖机|１２|30~40|", "| 挖机 | 【待人工确认：１２】 | 【待人工确认：30~40】 |")
    assert sorted((r.id, str(r.text)) for r in texts.collect()) == sorted([
        (1, want), (1, "| 数量 |\n|--|\n| 【待人工确认：7】 |"), (2, "no table"), (3, "None"), (4, "|--|\n|数量|\n|--|\n| 【待人工确认：4】 |")])
    assert sorted((r.id, r.line_no, r.col_no) for r in findings.collect()) == [(1, 3, 1), (1, 4, 2), (1, 4, 3), (4, 4, 1)]


def test_diagrams_fold_in_the_row(spark):
    note = AU.config.DIAGRAM_NOTE
    text = "# 一\n## 组织机构图\n| a |\n→\n### 流程图\n↓\n## 二\n### 流程图\n→\n→\n→\nend"
    df = spark.createDataFrame([(1, text), (2, "plain\n\n"), (3, None)], "id int, text string")
    out = AU.drop_ascii_diagrams(df, ["id"])
    assert {r.id: r.text for r in out.collect()} == {
        1: f"# 一\n## 组织机构图\n\n{note}\n\n## 二\n### 流程图\n\n{note}\n", 2: "plain\n", 3: None}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_clauses_move_without_lines(spark):
    lines = ["1.1 首条", "续一", "续二", "续三", "续四" * 300, "", "1.2 次条", "1.2 重复", "", "散行"] + [f"2.{i} 条文必须" for i in range(900)]
    df = spark.createDataFrame([("p", 1, "a", 0, 1, "\n".join(lines))], "project string, doc_id int, path string, block_ord int, page int, text string")
    out = ST.extract_clauses(df)
    rows = out.orderBy("clause_no").collect()
    assert len(rows) == 902 and rows[0].text.startswith("首条 续一 续二 续三 续四续四") and len(rows[0].text) > 600
    assert [r.clause_no for r in rows] == list(range(1, 903)) and rows[1].text == "次条"
    few = ST.extract_clauses(df, max_clauses=5, follow=2, follow_length=220, limit=6).orderBy("clause_no").collect()
    assert len(few) == 5 and few[0].text == "首条 续一…"
    scans = df.select(F.size(F.split("text", "\n"))).first()[0]
    assert scans == len(lines)
