"""Building blocks against brute force, with one key that holds most rows."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from traceframe.operators import drawings as DR, facts as FA, keyed as K
from traceframe.catalog import queries


def hot(spark, n=4000):
    rnd = random.Random(7)
    rows = [(("hot" if i % 3 else f"k{rnd.randrange(50)}"), i, rnd.randrange(100)) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, o int, v int").repartition(7)


def expected_numbers(rows):
    out, seen = {}, {}
    for k, o, _ in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        out[o] = seen[k]
    return out


def test_number_rows_in_chunks(spark):
    rows, df = hot(spark)
    got = {r.o: r.n for r in K.number_rows(df, ["k"], ["o"], "n", F.floor(col("o") / 97).cast("bigint")).collect()}
    assert got == expected_numbers(rows)


def test_number_by_range(spark):
    rows, df = hot(spark)
    got = {r.o: r.n for r in K.number_by_range(df, ["k"], [F.asc("o")], "n").collect()}
    assert got == expected_numbers(rows)


def test_running_total(spark):
    rows, df = hot(spark)
    want, sums = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        want[o] = sums[k]
    got = {r.o: r.t for r in K.running_total(df, ["k"], ["o"], col("v"), "t", F.floor(col("o") / 50).cast("bigint")).collect()}
    assert got == want


def test_salted_lookup_keeps_every_row(spark):
    rows, df = hot(spark)
    names = spark.createDataFrame([("hot", "H"), ("k1", "one")], "k string, name string")
    got = sorted((r.o, r.name) for r in K.salted_lookup(df, names, ["k"], by=["o"]).collect())
    assert got == sorted((o, {"hot": "H", "k1": "one"}.get(k)) for k, o, _ in rows)


def test_substring_pairs_both_ways(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("abc ") for _ in range(60))) for i in range(60)]
    needles = sorted({"".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 4, 5, 13]))) for _ in range(40)} | {texts[3][1][5:25]})
    t = spark.createDataFrame(texts, "id int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    want = sorted((i, x) for i, s in texts for x in needles if x in s)
    for options in ({}, {"splits": 1, "probes": 1}, {"sizes": (3, 1), "bits": 64}):
        got = sorted((r.id, r.needle) for r in K.substring_pairs(n, t, "needle", "text", **options).collect())
        assert got == want


def test_substring_pairs_keep_rows_and_columns(spark):
    """Repeated texts stay, columns of both sides come along, keys hold apart, null and empty values find nothing."""
    t = spark.createDataFrame([("p", "工期180天", 1), ("p", "工期180天", 1), ("q", "工期180天", 2), ("p", None, 3), ("p", "", 4), (None, "工期", 5)], "project string, text string, n int")
    n = spark.createDataFrame([("p", "工期", "a"), ("p", "工期", "b"), ("q", "180天", "c"), ("q", "", "d"), ("p", None, "e"), ("q", "300天", "f")],
                              "project string, needle string, tag string")
    got = sorted((r.project, r.text, r.n, r.needle, r.tag) for r in K.substring_pairs(n, t, "needle", "text", ["project"]).collect())
    assert got == sorted([("p", "工期180天", 1, "工期", x) for x in "aabb"] + [("q", "工期180天", 2, "180天", "c")])
    assert K.substring_pairs(n.filter("false"), t, "needle", "text", ["project"]).collect() == []


def test_substring_pairs_plan_without_jobs_and_split_lists(spark):
    """Planning starts no job, and the list of an n-gram that every text holds is read by many tasks."""
    texts = spark.range(2000).select(F.concat(F.lit("common part "), F.col("id").cast("string")).alias("text"))
    needles = spark.createDataFrame([("common",), ("part 1999",)], "needle string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    pairs = K.substring_pairs(needles, texts, "needle", "text")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert pairs.groupBy("needle").count().collect() and pairs.count() == 2001
    filed = texts.select(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(K.SALTS)).alias("salt")).groupBy("salt").count()
    assert filed.agg(F.max("count")).first()[0] < 2000 / K.SALTS * 2


def test_pairing_matches_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9)))
    left = [("p", i, word() + ".dwg", f"l{i}") for i in range(60)]
    right = [("p", i, word() + ".pdf", f"r{i}") for i in range(60)]
    schema = "project string, ord int, name string, path string"
    stem = lambda s: re.sub(r"(cad|pdf|dwg)", "", s.rsplit(".", 1)[0])
    registry, _ = DR.pair_files(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    got = {r.ord: r.pdf_path for r in registry.filter("side = 'dwg'").collect()}
    for _, i, name, _ in left:
        best, top = "", 0.0
        for _, _, other, path in right:
            a, b = stem(name), stem(other)
            s = 1 - edit(a, b) / max(len(a), len(b), 1)
            if s > top:
                best, top = path, s
        assert got[i] == (best if top >= 0.55 else ""), name


def test_similar_names_meet_in_few_pairs(spark):
    """Names of one project that share a frequent part: the rarest characters decide, and no pair above the threshold is lost."""
    rnd = random.Random(8)
    names = lambda seed: sorted({"".join(rnd.choice("bcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.randint(6, 9))) + "aaa" for _ in range(300)})
    left, right = names(1), names(2)
    right += [x[:3] + "zz" + x[3:] for x in left[::10]]
    df = lambda xs: spark.createDataFrame([("p", x) for x in xs], "project string, stem string")
    pairs = {(r.ls, r.rs) for r in DR.candidate_stems(df(left), df(right), 0.7).collect()}
    want = {(a, b) for a in left for b in right if 1 - edit(a, b) / max(len(a), len(b)) >= 0.7}
    assert len(want) >= 30 and want <= pairs and len(pairs) < len(left) * len(right) / 10


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_long_conflicts_come_in_parts(spark):
    rows = [("p", i, 0, 0, 0, "f/a.pdf", "k", f"v{i}", "", None, f"v{i}") for i in range(1203)]
    f = spark.createDataFrame(rows, "project string, doc_id int, block_ord int, pattern_ord int, match_ord int, path string, key string, value string, unit string, source_page int, norm string")
    parts = FA.detect_conflicts(f).orderBy("part").collect()
    assert [p.part for p in parts] == [1, 2, 3] and {p.variant_count for p in parts} == {1203}
    labels = "；".join(p.detail for p in parts).split("；")
    assert labels == [f"v{i}（a.pdf）" for i in range(1203)]


PLANNED = ["c3_extract_requirements", "c5_resolve_requirement_links", "c8_extract_facts", "c11_merge_facts", "c12_detect_conflicts", "a4_mark_duplicates",
           "c15_extract_clauses", "d2_response_matrix", "d10_pair_files", "e13_dedupe_review", "e4_block_unsupported_claims", "f9_revision_history",
           "f5_upsert", "c19_markdown_tables", "d13_model_facts", "d5_section_basis", "c18_locate_excerpts"]


def test_plans(spark, capsys):
    """No nested loops, no row-wise Python, no window over all rows."""
    for name in PLANNED:
        df = queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in plan, (name, bad)
        # Rows meet in one task only as partial aggregates without keys, one row from each task.
        lines = plan.split("\n")
        for line, below in zip(lines, lines[1:], strict=False):
            assert "SinglePartition" not in line or "keys=[], functions=[partial_" in below, (name, line, below)


def test_first_rows_are_pruned_before_the_shuffle(spark):
    df = spark.range(100).select((col("id") % 3).alias("k"), "id")
    assert "WindowGroupLimit" in K.top_n(df, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["f3_recent"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan and "EqualTo(user_id,8)" in plan


def test_numbers_of_hashed_ids_stay_parallel(spark):
    """Order keys without any density and one key with most rows: sampled ranges hold at most twice the mean, and numbers and next rows are whole."""
    rows = spark.range(20000).select(F.when(col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (col("id") % 40).cast("string"))).alias("k"),
                                     F.xxhash64("id").alias("o"), col("id").alias("v"))
    out = K.number_by_range(rows, ["k"], [col("o")], "n", {"next_v": "v"})
    want, data = {}, sorted((r.k, r.o, r.v) for r in rows.collect())
    number = 0
    for i, (k, o, v) in enumerate(data):
        number = number + 1 if i and data[i - 1][0] == k else 1
        want[v] = (number, data[i + 1][2] if i + 1 < len(data) and data[i + 1][0] == k else None)
    assert {r.v: (r.n, r.next_v) for r in out.collect()} == want
    sizes = [r["count"] for r in rows.repartitionByRange(8, "k", "o").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_numbering_holds_null_groups_and_descending_order(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 2), ("a", 5)], "k string, o int")
    got = sorted((str(r.k), r.o, r.n, r.after) for r in K.number_by_range(df, ["k"], [F.desc("o")], "n", {"after": "o"}).collect())
    assert got == sorted([("None", 3, 1, 1), ("None", 1, 2, None), ("a", 5, 1, 2), ("a", 2, 2, None)], key=lambda r: r[:3])
