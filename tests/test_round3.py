"""Faults found on larger tables and on tables of several files."""

from pyspark.sql import functions as F

from traceframe import catalog


def test_stream_reads_a_table_of_several_files_and_keeps_the_smallest_id(spark, tmp_path):
    rows = [(9, "one line here\nand another"), (3, "one line here\nand another"), (5, "a single line"), (4, None), (7, "a single line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    docs.repartition(3, "doc_id").write.parquet(f"{many}/documents.parquet")
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(f"{one}/documents.parquet")
    for folder in (many, one):
        got = catalog.queries()["h1_stream_blocks"](spark, folder)
        assert got.columns == ["doc_id", "lines"]
        assert sorted(map(tuple, got.collect())) == [(3, 2), (5, 1)]


def test_array_items_are_not_computed_again_below_the_explode(spark):
    """The inferred filter of an inner explode pulled the line splitting of a text into its lambdas, once for each line."""
    import time

    from traceframe.operators import audit as AU

    text = "| 名称 | 数量 |\n|---|---|\n" + "\n".join(f"| a | {i} |" for i in range(400))
    drafts = spark.range(200).select(F.lit("p").alias("project"), "id", F.lit(text).alias("text")).repartition(8)
    facts = spark.createDataFrame([("p", "7")], "project string, value string")
    start = time.time()
    texts, found = AU.block_table_texts(drafts, ["project", "id"], facts)
    assert found.count() == 200 * 399
    assert time.time() - start < 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "outer" in plan.lower() or "Generate explode" not in plan
    one = texts.filter("id = 3").first().text
    assert "| a | 7 |" in one and "| a | 【待人工确认：8】 |" in one


def test_supported_values_by_broadcast_by_key_and_by_row_agree(spark, monkeypatch):
    from traceframe.operators import audit as AU, keyed as K

    drafts = spark.createDataFrame([("p", 1, "长 5 天，另 6 天"), ("p", 1, "又 7 天"), ("q", 2, "长 5 天"), (None, 3, "长 5 天"), ("p", 4, "无")], "project string, id int, text string")
    facts = spark.createDataFrame([("p", "5", "天"), ("p", "7", "日历天"), ("q", "8", "天")], "project string, value string, unit string")
    clauses = spark.createDataFrame([], "project string, standard_code string, clause_id string, verification_status string")
    allowed = spark.createDataFrame([("p", "共 6 天")], "project string, text string")
    seen = []
    for rows, values in ((20_000, 500), (2, 500), (0, 500), (0, 0)):
        monkeypatch.setattr(K, "NEEDLE_ROWS", rows)
        monkeypatch.setattr(AU, "LIST_VALUES", values)
        texts, found = AU.block_unsupported_claims(drafts, ["project", "id"], facts, clauses, allowed)
        seen.append((sorted(map(str, texts.collect())), sorted(map(str, found.collect()))))
    assert seen[0] == seen[1] == seen[2] == seen[3]
    assert len(seen[0][0]) == 5 and sum("待人工确认" in t for t in seen[0][0]) == 2


def test_counted_needles_agree_with_the_index(spark, monkeypatch):
    from traceframe.operators import keyed as K

    texts = spark.createDataFrame([("p", 1, "the token here"), ("p", 1, "the token here"), ("q", 2, "tokens"), ("p", 3, None), (None, 4, "token")], "project string, id int, text string")
    needles = spark.createDataFrame([("p", "token", 1), ("p", "token", 2), ("p", "he", 3), ("q", "kens", 4), ("q", "absent", 5), ("p", "", 6)], "project string, needle string, tag int")
    for cols in (["project", "needle"], ["project", "needle", "tag"]):
        want = sorted(map(str, K.substring_pairs(needles.select(*cols), texts, "needle", "text", ["project"]).collect()))
        for rows, most in ((20_000, 1000), (2, 1000), (0, 1000), (0, 0)):
            monkeypatch.setattr(K, "NEEDLE_ROWS", rows)
            monkeypatch.setattr(K, "NEEDLE_LIST", most)
            pairs = K.counted_pairs(needles.select(*cols), texts, "needle", "text", ["project"])
            assert sorted(map(str, pairs.collect())) == want and len(want) in (5, 7)
    monkeypatch.setattr(K, "NEEDLE_LIST", 1000)
    plan = K.counted_pairs(needles.select("needle"), texts, "needle", "text")
    assert plan.count() == K.substring_pairs(needles.select("needle"), texts, "needle", "text").count()
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_conflict_in_parts_is_one_item_with_all_values(spark):
    from traceframe.operators import facts as FA, review as RV

    rows = [("p", i, "k", 0, 0, f"v{i}", "", f"n{i:04d}", f"f/{i}.txt", 1) for i in range(1203)]
    facts = spark.createDataFrame(rows, "project string, doc_id long, key string, pattern_ord int, match_ord int, value string, unit string, norm string, path string, source_page int")
    facts = facts.withColumn("source_path", F.col("path")).withColumn("block_ord", F.lit(0)).withColumn("line_no", F.lit(0))
    conflicts = FA.detect_conflicts(facts, ["doc_id"])
    assert conflicts.count() == 3
    queue = RV.one_per_conflict(conflicts).collect()
    assert len(queue) == 1 and queue[0].detail.count("；") == 1202


def test_assets_of_equal_matches_are_found_once_and_reach_every_project(spark):
    from traceframe.operators import cases as CA

    matches = spark.createDataFrame([(p, r, c) for p in range(200) for r, c in (((1, 7), (2, 8)) if p % 2 else ((1, 8),))], "project long, rank int, case_id long")
    rows = [(c, f"a{c}-{i}", i, "wording", f"t{i % 3}", "x", ["s"], "r") for c in (7, 8, 9) for i in range(6)]
    assets = spark.createDataFrame(rows, "case_id long, asset_id string, asset_ord int, asset_type string, title string, content string, applicable_sections array<string>, reuse_rule string")
    got = sorted((r.project, r.case_id, r.asset_id, r.asset_ord) for r in CA.load_case_assets(matches, assets).collect())
    want = sorted((p, 7 if p % 2 else 8, f"a{7 if p % 2 else 8}-{i}", 1_000_000_000 + i) for p in range(200) for i in range(3))
    assert got == want
