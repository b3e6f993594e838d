"""Ideographic spaces and full-width digits count in every pattern."""

import pytest
from pyspark.sql import functions as F

from traceframe import config
from traceframe.functions import references as RF, text as TX
from traceframe.functions.patterns import wide
from traceframe.operators import audit as AU, facts as FA, markdown as MD, requirements as RQ

BLOCKS = "project string, doc_id int, path string, block_ord int, page int, text string"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("value,unit", [("180", "　日历天"), ("１８０", "日历天"), ("１８０", "　日历天"), ("180", " 天")])
def test_facts(spark, value, unit):
    df = spark.createDataFrame([("p", 1, "a.txt", 0, 1, f"计划总工期：{value}{unit}")], BLOCKS)
    got = FA.extract_facts(df).collect()
    assert [(r.key, r.value, r.unit) for r in got] == [("总工期", value, unit.strip())]


def test_references(spark):
    ref = one(spark, RF.parse_reference("t"), t="工期要求详见第　１２　页附表　３")
    assert (ref.target_page, ref.target_table) == (12, "附表３")
    assert one(spark, RF.is_reference_only(F.lit("详见第１２页")))
    assert one(spark, RF.strip_reference_tail(F.lit("合格（详见第　１２页）"))) == "合格"


def test_links_meet_across_scripts(spark):
    blocks = [("p", 1, "a", 0, 1, "总工期：详见第１２页附表３"), ("p", 1, "a", 1, 12, "附表　３ 计划总工期：１８０　天")]
    m = FA.fact_matches(spark.createDataFrame(blocks, BLOCKS), [("总工期", wide(r"总工期[：:](\s*详见[^\n]*|\s*\d+\s*天)"), False)])
    out = FA.resolve_fact_links(FA.fact_links(m), FA.extract_facts(None, matches=m)).collect()
    assert [(r.status, r.resolved_page) for r in out] == [("resolved", 12)]


def test_claims_masks_and_tables(spark):
    text = "设备２５　台，工期 30　天，依据 SL 260-2014 第　３.２　条"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = sorted(r.token for r in MD.extract_claims(df, ["doc_id"]).collect())
    assert got == sorted(["２５　台", "30　天", "SL 260-2014 第　３.２　条"])
    assert one(spark, TX.mask_parameters(F.lit("长２５　m，宽3 m"))) == f"长{config.CASE_PARAMETER_MASK}，宽{config.CASE_PARAMETER_MASK}"
    assert one(spark, TX.safe_int(F.lit("１２"))) == 12 and one(spark, TX.safe_int(F.lit("第１２页"), "first")) == 12
    drafts = spark.createDataFrame([("p", "s", "配备２５　台，工期30　天。")], "project string, section string, text string")
    facts = spark.createDataFrame([("p", "30", "天")], "project string, value string, unit string")
    none = spark.createDataFrame([], "project string, standard_code string, clause_id string, verification_status string")
    texts, findings = AU.block_unsupported_claims(drafts, ["project", "section"], facts, none, spark.createDataFrame([], "project string, text string"))
    assert [r.text for r in texts.collect()] == ["配备【待人工确认：２５　台的项目或规范依据】，工期30　天。"]
    assert [r.token for r in findings.collect()] == ["２５　台"]


def test_requirements_keep_whole_texts(spark):
    """Lines that agree in 120 characters, a table named far behind in a block, and long texts."""
    start = "投标人必须" + "一" * 300
    text = "\n".join([start + "甲", start + "乙", "工期必须满足", "文" * 900 + " 附表９"])
    df = spark.createDataFrame([("p", 1, "a", 0, 3, text), ("p", 1, "a", 1, 4, "工期要求必须详见附表９")], BLOCKS)
    reqs = RQ.extract_requirements(df)
    found = [r.requirement for r in reqs.orderBy("req_no").collect()]
    assert start + "甲" in found and start + "乙" in found
    links = RQ.resolve_requirement_links(RQ.requirement_links(RQ.requirement_candidates(df), df), reqs).collect()
    assert [r.status for r in links] == ["resolved"]
