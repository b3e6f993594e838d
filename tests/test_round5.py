"""Findings of round 4: nothing is made for rows that nobody asks for, and large steps keep few bytes on disk."""

from pyspark.sql import functions as F

from traceframe.operators import cases as CA, keyed as K


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_cases(spark, n=40):
    """Cases with computed outlines and snippets, as a learned library has them."""
    words = F.split("text", " ")
    rows = [(i, f"w{i} has {i} days and more", "Case", "t", "b") for i in range(n)]
    raw = spark.createDataFrame(rows, "case_id long, text string, title string, project_type string, bid_path string").repartition(3, "case_id")
    return raw.select(
        "case_id", "title", "project_type", "bid_path", F.transform(words, lambda w: F.struct(F.lit(1).alias("level"), w.alias("title"))).alias("outline"),
        F.transform(words, lambda w: F.struct(w.alias("keyword"), F.concat(w, F.lit(" 25 days")).alias("text"))).alias("snippets"),
        F.array(F.lit("n")).alias("style_notes"), F.col("case_id").alias("layout_profile_id"))


def test_assets_are_made_for_wanted_cases_only(spark, monkeypatch):
    cases = some_cases(spark)
    wanted = spark.createDataFrame([(3,), (7,), (7,), (None,), (99,)], "case_id long")
    want = sorted(map(str, CA.case_assets(cases).filter("case_id in (3, 7)").collect()))
    few = CA.case_assets(cases, wanted=wanted)
    assert sorted(map(str, few.collect())) == want and len(want) > 10
    # the other cases go below the spread of the table, before outlines and snippets are made
    assert "array_contains" in plan(few).split("RepartitionByExpression")[1]
    monkeypatch.setattr(K, "LIST_KEYS", 1)
    assert sorted(map(str, CA.case_assets(cases, wanted=wanted).collect())) == want


def test_few_assets_for_many_projects_are_dealt_to_several_tasks(spark):
    matches = spark.createDataFrame([(p, 1, 3) for p in range(300)], "project long, rank int, case_id long")
    out = CA.load_case_assets(matches, CA.case_assets(some_cases(spark), wanted=matches))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.groupBy("project").count().select("count").distinct().count() == 1 and out.select("project").distinct().count() == 300


def test_assets_are_unfolded_before_they_are_made(spark):
    import json

    kind = "case_id long, title string, project_type string, bid_path string, outline array<struct<level:int,title:string>>, snippets array<struct<keyword:string,text:string>>, style_notes array<string>, layout_profile_id int"
    many = [(f"k{i}", f'a "{i}" 7 days') for i in range(150)]
    rows = [(1, "A", "t", "b", [(1, "x")], many, ["n", None], 5), (2, "B", "t", "b", [], [("k", None), None], None, None), (3, "C", "t", "b", None, None, ["m"], 6), (4, "D", "t", "b", [], [], [], None)]
    out = CA.case_assets(spark.createDataFrame(rows, kind), {}, {"one": ["k1"], "two": ["days"], "three": ["k2", "days"]}, {"one": "S1", "three": "S3"}, "Z", r"\d+ days", "P")
    got = {(r.case_id, r.asset_id): (r.asset_ord, r.asset_type, r.title, r.content, r.applicable_sections, r.reuse_rule) for r in out.collect()}

    def section(k):
        scores = [("S1", "k1" in k), ("Z", 1), ("S3", ("k2" in k) + 1)]
        return max(scores, key=lambda s: s[1])[0]

    want = {(1, "case-1-outline"): (0, "outline", "A章节结构", '[{"level":1,"title":"x"}]', ["全局"], "structure_only")}
    for i, (k, _) in enumerate(many, 1):
        body = json.dumps({"keyword": k, "text": f'a "{i - 1}" P'}, separators=(",", ":"))
        want[1, f"case-1-wording-{i}"] = (i, "wording", f"{k}稳健措辞", body, [section(k)], "replace_parameters")
    for c, n, at, text in ((1, 1, 151, "n"), (1, 2, 152, None), (3, 1, 100, "m")):
        want[c, f"case-{c}-style-{n}"] = (at, "style_note", "公司成品写作规则", text, ["全局"], "structure_only")
    want[2, "case-2-wording-1"] = (1, "wording", "k稳健措辞", '{"keyword":"k"}', ["Z"], "replace_parameters")
    want[2, "case-2-wording-2"] = (2, "wording", None, "{}", ["Z"], "replace_parameters")
    for c, t, p in ((1, "A", 5), (3, "C", 6)):
        want[c, f"case-{c}-layout"] = (200, "layout", f"{t}版式配置", f'{{"layout_profile_id":{p}}}', ["全局"], "layout_only")
    # a section needs a text
    assert {k: v for k, v in got.items() if k[0] != 2} == {k: v for k, v in want.items() if k[0] != 2}
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
    # chapters are not looked for where nobody wants them
    assert "days" in plan(out.select("applicable_sections")) and "S3" not in plan(out.select("case_id", "content"))


def test_kept_rows_are_read_by_column(spark):
    df = spark.range(5).select("id", F.lit("x").alias("wide"))
    assert "ReadSchema: struct<id:bigint>" in K.kept(df).select("id")._jdf.queryExecution().executedPlan().toString()
    assert K.kept(df.withColumn("none", F.lit(None))).collect() == df.withColumn("none", F.lit(None)).collect()


def test_answers_of_links_shuffle_wanted_candidates_only(spark):
    from traceframe.operators import facts as FA

    facts = spark.createDataFrame([("p", d, k, d, 0, 0, "v", "n", d % 3, ["", "附表", f"附表{d}"]) for d in range(40) for k in "kl"] + [("p", None, "k", 1, 0, 0, "v", "n", 1, [""])],
                                  "project string, doc_id long, key string, block_ord int, pattern_ord int, match_ord int, value string, norm string, source_page int, block_tables array<string>")
    links = spark.createDataFrame([("p", d, "k", 2, "附表3" if d == 3 else "") for d in range(40)] + [("p", None, "k", 1, "")],
                                  "project string, doc_id long, fact_key string, target_page int, target_table string")
    asked = links.select(F.col("fact_key").alias("key"), F.explode(F.array(F.lit(""), F.col("target_table"))).alias("table"))
    found = facts.select("key", F.explode("block_tables").alias("table"))
    assert K.maybe_in(found, asked, ["key", "table"]).count() <= 45 < found.count()
    out = FA.resolve_fact_links(links, facts)
    # candidates are grouped by page once, for what stands there and for what lies around
    assert "collect_set" not in plan(out) and "block_tables" not in plan(out)
    assert [r.doc_id for r in out.filter("status = 'unresolved'").collect()] == [None] and out.count() == 41


def test_matches_without_excerpts_are_those_with_them(spark):
    from traceframe.operators import facts as FA

    blocks = spark.createDataFrame([("p", 1, "p/1", 0, 1, "总工期：180日历天\n附表1 总工期：90日历天"), ("p", 2, "p/2", 0, 1, None)],
                                   "project string, doc_id int, path string, block_ord int, page int, text string")
    whole, slim = FA.fact_matches(blocks), FA.fact_matches(blocks, excerpts=False)
    assert set(whole.columns) - set(slim.columns) == {"start", "source_excerpt", "source_block_excerpt"}
    assert sorted(map(str, whole.select(slim.columns).collect())) == sorted(map(str, slim.collect())) and slim.count() > 1


def test_links_to_requirements_group_wanted_candidates_once(spark):
    from traceframe.operators import requirements as RQ

    reqs = spark.createDataFrame([("p", d, c, n, f"R{n}", n % 3, ["", "附表", f"附表{n}"]) for d in range(20) for n, c in enumerate("abc")] + [("p", 3, None, 9, "R9", 1, [""])],
                                 "project string, doc_id int, category string, req_no int, id string, source_page int, context_tables array<string>")
    links = spark.createDataFrame([("p", d, "a", d, 7, "附表0") for d in range(20)] + [("p", 3, None, 30, 1, "")],
                                  "project string, doc_id int, category string, source_line int, target_page int, target_table string")
    out = RQ.resolve_requirement_links(links, reqs)
    assert "context_tables" not in plan(out) and plan(out).count("collect_set") == 0
    assert sorted((r.source_line, *r.resolved_ids) for r in out.collect()) == [*((d, "R0") for d in range(20)), (30,)]


def test_few_facts_travel_to_the_tables_of_a_text(spark, monkeypatch):
    from traceframe.operators import audit as AU

    text = "|项|数量|\n|--|--|\n|a|{}|\n|b|7|"
    drafts = spark.createDataFrame([("p", 1, text.format(5)), ("p", 1, text.format(6)), ("q", 2, text.format(5)), (None, 3, text.format(5)), ("p", 4, "5"), ("p", 5, None)], "project string, n int, text string")
    facts = spark.createDataFrame([("p", "5"), ("p", " 7 "), ("q", "7"), ("q", " "), (None, "5")], "project string, value string")
    few, asks = AU.checked_tables(drafts, ["project", "n"], facts), []
    told = AU._told
    monkeypatch.setattr(AU, "_told", lambda *a: asks.append(1) or told(*a))
    rows = sorted(map(str, few.collect()))
    assert rows == sorted(map(str, AU.checked_tables(drafts, ["project", "n"], facts).collect())) and not asks
    monkeypatch.setattr(AU, "LIST_VALUES", 1)
    assert rows == sorted(map(str, AU.checked_tables(drafts, ["project", "n"], facts).collect())) and asks
    assert sum("待人工确认：5" in r for r in rows) == 2 and sum("待人工确认：7" in r for r in rows) == 1
