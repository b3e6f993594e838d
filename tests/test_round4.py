"""Findings of round 3 that were open: expensive steps are made once, and not below the spread of a table."""

from pyspark.sql import functions as F

from traceframe.operators import outline as OL, standards as ST


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def blocks(spark, texts):
    rows = [("p", i, f"p/{i}", 0, 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "project string, doc_id int, path string, block_ord int, page int, text string").repartition(3, "doc_id")


def test_few_excerpts_are_looked_for_inside_the_texts(spark):
    items = spark.createDataFrame([(1, "b c"), (2, "x"), (3, "c d")], "item_id int, text string")
    out = OL.locate_excerpts(items, blocks(spark, ["a b  cd", "abcd", "zz"]))
    assert "regexp_extract_all" not in plan(out)
    assert sorted((r.item_id, r.doc_id) for r in out.collect()) == [(1, 0), (3, 0)]


def test_originals_are_normalised_once_behind_the_spread(spark):
    b = blocks(spark, ["see GB 50 1-2 here", "nothing", ""])
    att = spark.createDataFrame([("p", 0, "gb501—2"), ("p", 0, "GB 9"), ("p", 1, "GB 7"), ("p", 2, "GB 8")], "project string, doc_id int, code string")
    out = ST.verify_standards(att, b, ST.extract_clauses(b))
    assert plan(out).count("upper(regexp_replace(text") == 1
    assert sorted((r.doc_id, r.code, r.identity_verified) for r in out.collect()) == [
        (0, "GB 9", False), (0, "gb501—2", True), (1, "GB 7", False), (2, "GB 8", False)]


def test_running_total_makes_its_rows_once(spark):
    from traceframe.operators.keyed import running_total

    df = spark.range(10).select(F.lit(1).alias("k"), "id", F.length(F.reverse(F.col("id").cast("string"))).alias("v"))
    out = running_total(df, ["k"], ["id"], F.col("v"), "t", F.floor(F.col("id") / 4))
    assert "reverse" not in plan(out)
    assert [r.t for r in out.orderBy("id").collect()] == list(range(1, 11))


def test_matches_and_candidates_are_made_once_for_values_and_links(spark):
    from traceframe.catalog import extraction as E

    d = "/root/testdata/sf0.001"
    for df in E.order_facts(spark, d):
        assert "regexp_extract_all(text" not in plan(df)
    links, reqs = E.order_requirements(spark, d)
    for df in (links, reqs):
        assert "split(text" not in plan(df)


def test_packs_make_the_matrix_at_most_once(spark, monkeypatch):
    from traceframe.catalog import matching as M

    calls, made = [], M.RQ.response_matrix
    monkeypatch.setattr(M.RQ, "response_matrix", lambda *a, **k: calls.append(1) or made(*a, **k))
    M.d15_project(spark, "/root/testdata/sf0.001")
    assert not calls
    M.d15(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
