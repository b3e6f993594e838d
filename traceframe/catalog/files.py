"""Queries over files, sources and drawings."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.catalog import fixtures as X
from traceframe.catalog.registry import query, table
from traceframe.operators import drawings as DR, files as FI
from traceframe.sources import files as SF, tables as ST


def raw_files(spark, d):
    """Documents as files; the language decides the suffix, some lie in ignored folders."""
    suffix = X_SUFFIX()
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("/data/"), F.col("source"), F.when(F.col("lang") == "es", "/assets").otherwise(""), F.lit("/f"),
                           F.col("doc_id").cast("string"), suffix).alias("path"),
        F.length(F.col("text").cast("binary")).cast("bigint").alias("length"), F.col("text").cast("binary").alias("content"))


def X_SUFFIX():
    return F.when(F.col("lang") == "en", ".TXT").when(F.col("lang") == "de", ".pdf").when(F.col("lang") == "fr", ".exe").otherwise(".md")


@query("a1_scan_files", """SELECT '/data/' || source || '/f' || doc_id || CASE lang WHEN 'en' THEN '.TXT' ELSE '.pdf' END AS path,
 'f' || doc_id || CASE lang WHEN 'en' THEN '.TXT' ELSE '.pdf' END AS name, CASE lang WHEN 'en' THEN '.txt' ELSE '.pdf' END AS suffix,
 strlen(text) AS size, sha256(text) AS sha256 FROM documents WHERE lang IN ('en', 'de')""")
def a1(spark, d):
    return SF.describe_files(raw_files(spark, d))


RULES = [
    ("design_report", 0.86, ["the", "an"], [], None),
    ("drawing", 0.84, ["zz"], [".2"], None),
    ("tender", 0.92, ["in", "on"], [], None),
    ("accepted_bid", 0.88, ["er", "st"], [], "passed_case"),
    ("candidate_tender", 0.45, None, [], "new_tender"),
    ("attachment", 0.35, None, [], None),
]


def page_files(spark, d):
    """Web pages as files; host words act as the name."""
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", "://([^/]*)/", 1)
    return p.select(
        "page_id", host.alias("host"), "url",
        F.when(F.col("url").startswith("https"), "passed_case").otherwise("new_tender").alias("kind"))


_NAME = r"regexp_replace(lower(regexp_extract(url, '://([^/]*)/', 1)), '[\s_\-（）()【】\[\]]+', '', 'g')"
_ROLE = f"""CASE WHEN contains({_NAME}, 'the') OR contains({_NAME}, 'an') THEN 'design_report' WHEN contains({_NAME}, 'zz') THEN 'drawing'
 WHEN contains({_NAME}, 'in') OR contains({_NAME}, 'on') THEN 'tender' WHEN starts_with(url, 'https') AND
 (contains({_NAME}, 'er') OR contains({_NAME}, 'st')) THEN 'accepted_bid' WHEN NOT starts_with(url, 'https') THEN 'candidate_tender' ELSE 'attachment' END"""


@query("a2_classify_role", f"""SELECT page_id, {_ROLE} AS role, CASE {_ROLE} WHEN 'design_report' THEN 0.86 WHEN 'drawing' THEN 0.84
 WHEN 'tender' THEN 0.92 WHEN 'accepted_bid' THEN 0.88 WHEN 'candidate_tender' THEN 0.45 ELSE 0.35 END::DOUBLE AS confidence FROM pages""")
def a2(spark, d):
    return page_files(spark, d).select("page_id", FI.classify_role("host", "kind", RULES).alias("r")).select(
        "page_id", "r.role", "r.confidence")


def doc_files(spark, d):
    """Documents as project files with a role from their language."""
    role = F.when(F.col("lang") == "de", "tender").when(F.col("lang") == "fr", "accepted_bid").when(
        F.col("lang") == "es", "drawing").otherwise("attachment")
    return table(spark, d, "documents").select(
        F.col("source").alias("project"), "doc_id",
        F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), F.lit(".pdf").alias("suffix"),
        F.sha2("text", 256).alias("sha256"), role.alias("role"),
        (F.lit(0.9) - (F.col("n_chars") % 3) / 10).alias("confidence"),
        F.when(F.col("source").endswith("1"), "passed_case").when(F.col("source").endswith("2"), "unknown").otherwise(
            "new_tender").alias("project_kind"))


DOC_FILES = """files AS (SELECT source AS project, doc_id, source || '/f' || doc_id || '.pdf' AS path, 'f' || doc_id || '.pdf' AS name,
 sha256(text) AS sha, CASE lang WHEN 'de' THEN 'tender' WHEN 'fr' THEN 'accepted_bid' WHEN 'es' THEN 'drawing' ELSE 'attachment' END AS role,
 0.9::DOUBLE - (n_chars % 3)::DOUBLE / 10 AS confidence, CASE WHEN source LIKE '%1' THEN 'passed_case' WHEN source LIKE '%2' THEN 'unknown' ELSE 'new_tender' END AS kind FROM documents),
 dup AS (SELECT *, first_value(path) OVER (PARTITION BY project, sha ORDER BY confidence DESC, name) AS orig FROM files),
 usable AS (SELECT * FROM dup WHERE orig = path)"""


@query("a3_apply_role_overrides", f"""WITH {DOC_FILES} SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'role' || quality ELSE role END AS role,
 CASE WHEN quality IS NOT NULL THEN 1.0 ELSE confidence END::DOUBLE AS confidence, (quality IS NOT NULL)::INT AS role_confirmed
 FROM files LEFT JOIN labels USING (doc_id)""")
def a3(spark, d):
    files = doc_files(spark, d)
    marks = table(spark, d, "labels").join(files.select("doc_id", "path"), "doc_id").select(
        "path", F.concat(F.lit("role"), F.col("quality").cast("string")).alias("role"))
    return FI.apply_role_overrides(files, marks).select(
        "doc_id", "role", "confidence", F.col("role_confirmed").cast("int").alias("role_confirmed"))


@query("a4_mark_duplicates", f"""WITH {DOC_FILES} SELECT doc_id, (orig <> path)::INT AS is_duplicate,
 CASE WHEN orig <> path THEN orig ELSE '' END AS duplicate_of FROM dup""")
def a4(spark, d):
    return FI.mark_duplicates(doc_files(spark, d)).select(
        "doc_id", F.col("is_duplicate").cast("int").alias("is_duplicate"), "duplicate_of")


@query("a4_duplicates_across_projects", """WITH f AS (SELECT doc_id, source || '/f' || doc_id || '.pdf' AS path, sha256(text) AS sha,
 0.9::DOUBLE - (n_chars % 3)::DOUBLE / 10 AS c, 'f' || doc_id || '.pdf' AS n FROM documents)
 SELECT doc_id, CASE WHEN first_value(path) OVER w <> path THEN first_value(path) OVER w ELSE '' END AS duplicate_of
 FROM f WINDOW w AS (PARTITION BY sha ORDER BY c DESC, n)""")
def a4_all(spark, d):
    return FI.mark_duplicates(doc_files(spark, d), []).select("doc_id", "duplicate_of")


@query("a5_select_primary", f"""WITH {DOC_FILES}, p AS (SELECT project, kind FROM files GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY confidence DESC, name) AS r FROM usable),
 b AS (SELECT project, role, path FROM usable QUALIFY row_number() OVER (PARTITION BY project, role ORDER BY confidence DESC, name) = 1),
 x AS (SELECT p.project, p.kind, t.path AS tender0, a.path AS bid0, o1.path AS p1, o2.path AS p2 FROM p
 LEFT JOIN b t ON t.project = p.project AND t.role = 'tender' LEFT JOIN b a ON a.project = p.project AND a.role = 'accepted_bid'
 LEFT JOIN o o1 ON o1.project = p.project AND o1.r = 1 LEFT JOIN o o2 ON o2.project = p.project AND o2.r = 2),
 y AS (SELECT *, CASE WHEN kind = 'new_tender' THEN coalesce(tender0, p1) ELSE tender0 END AS tender FROM x)
 SELECT project, kind AS project_kind, coalesce(tender, '') AS tender, coalesce(CASE WHEN kind = 'passed_case' THEN coalesce(bid0, CASE WHEN p1 = tender
 THEN p2 ELSE p1 END) ELSE bid0 END, '') AS accepted_bid, coalesce(tender0, '') AS pipeline_tender,
 (CASE kind WHEN 'passed_case' THEN tender IS NOT NULL AND coalesce(bid0, p2) IS NOT NULL WHEN 'new_tender' THEN tender IS NOT NULL ELSE false END)::INT AS ready FROM y""")
def a5(spark, d):
    out = FI.select_primary(FI.mark_duplicates(doc_files(spark, d)))
    none = F.lit("")
    return out.select("project", "project_kind", F.coalesce("tender", none).alias("tender"),
                      F.coalesce("accepted_bid", none).alias("accepted_bid"),
                      F.coalesce("pipeline_tender", none).alias("pipeline_tender"), F.col("ready").cast("int").alias("ready"))


@query("a6_infer_project", r"""SELECT page_id, CASE WHEN regexp_matches(url, '/(en|fr)/') THEN 'passed_case' WHEN regexp_matches(url, '/de/')
 THEN 'new_tender' ELSE 'unknown' END AS project_kind, CASE WHEN regexp_matches(url, '/(en|fr|de)/[^/]*/') THEN
 regexp_extract(url, '^.*?/(?:en|fr|de)/[^/]*') ELSE regexp_replace(url, '/[^/]*$', '') END AS project_dir FROM pages""")
def a6(spark, d):
    f = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return FI.infer_project(f, ["en", "fr"], ["de"]).select("page_id", "project_kind", "project_dir")


@query("a7_read_text_blocks", "SELECT '/data/' || source || '/' || doc_id || '.txt' AS path, 0 AS block_ord, text FROM documents")
def a7(spark, d):
    bom = F.when(F.col("lang") == "de", F.lit("﻿")).otherwise("")
    raw = table(spark, d, "documents").select(
        F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(bom, F.col("text")).cast("binary").alias("content"))
    return SF.text_blocks(raw).select("path", "block_ord", "text")


@query("a8_tabular_blocks", """SELECT p_brand AS sheet, 'A' || rn AS cell, p_partkey || ' | ' || p_name || CASE WHEN p_type = 'SMALL' THEN ''
 ELSE ' | ' || p_type END || ' | ' || p_size AS text FROM (SELECT *, p_partkey + 1 AS rn FROM part) WHERE rn <= 5000""")
def a8(spark, d):
    p = table(spark, d, "part").select(
        "p_brand", "p_partkey", "p_name", F.when(F.col("p_type") == "SMALL", F.lit("  ")).otherwise(F.col("p_type")).alias("p_type"),
        "p_size", (F.col("p_partkey") + 1).alias("row_no"))
    return SF.tabular_blocks(p, ["p_partkey", "p_name", "p_type", "p_size"], "p_brand", "row_no").select("sheet", "cell", "text")


@query("a9_page_blocks")
def a9(spark, d):
    return SF.page_blocks(table(spark, d, "pages"), ["page_id"])


@query("a10_write_table", """SELECT event_type AS run_id, event_id, CASE event_type WHEN 'view' THEN value * 2 ELSE value END AS value FROM events""")
def a10(spark, d):
    """Write all runs, then write one of them again with other values."""
    path = ST.scratch_path(spark, "events")
    rows = table(spark, d, "events").select(F.col("event_type").alias("run_id"), "event_id", "value")
    ST.write_table(rows, path)
    ST.write_table(rows.filter("run_id = 'view'").withColumn("value", F.col("value") * 2), path)
    return ST.read_runs(spark, path)


@query("a11_read_runs", """SELECT event_type AS run_id, event_id, CASE WHEN value > 50 THEN 'extracted' ELSE 'open' END AS status FROM events
 WHERE event_type = (SELECT max(event_type) FROM events)""")
def a11(spark, d):
    path = ST.scratch_path(spark, "runs")
    status = F.when(F.col("value") > 50, "resolved_reference").otherwise("open")
    ST.write_table(table(spark, d, "events").select(F.col("event_type").alias("run_id"), "event_id", status.alias("status")), path)
    return ST.read_runs(spark, path, latest=True)


def drawing_sides(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_brand").alias("project"), F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(".dwg")).alias("name"),
        F.concat(F.lit("d/"), F.col("p_partkey").cast("string")).alias("path"), "p_type")
    return p.filter("p_type = 'SMALL'").drop("p_type"), p.filter("p_type = 'LARGE'").drop("p_type")


_STEM = "regexp_replace(replace(replace(replace(lower(p_name), 'cad', ''), 'pdf', ''), 'dwg', ''), '[^0-9a-z]+', '', 'g')"
PAIRS = f"""l AS (SELECT p_brand AS project, p_partkey AS ord, p_name, {_STEM} AS s FROM part WHERE p_type = 'SMALL'),
 r AS (SELECT p_brand AS project, p_partkey AS ord, p_name, {_STEM} AS s FROM part WHERE p_type = 'LARGE'),
 sc AS (SELECT l.project, l.ord, r.ord AS rord, 1.0 - levenshtein(l.s, r.s)::DOUBLE / greatest(length(l.s), length(r.s)) AS score FROM l JOIN r USING (project)),
 best AS (SELECT * FROM sc WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY project, ord ORDER BY score DESC, rord) = 1)"""


@query("d10_pair_files", f"""WITH {PAIRS} SELECT l.project, 'dwg' AS side, l.ord, coalesce('d/' || rord, '') AS pdf_path,
 CASE WHEN rord IS NULL THEN 'missing_pdf' ELSE 'pending_analysis' END AS status, round(coalesce(score, 0), 3)::DOUBLE AS match_score
 FROM l LEFT JOIN best ON best.project = l.project AND best.ord = l.ord UNION ALL
 SELECT project, 'pdf', ord, 'd/' || ord, 'pending_analysis', 0 FROM r WHERE (project, ord) NOT IN (SELECT (project, rord) FROM best)""")
def d10(spark, d):
    registry, _ = DR.pair_files(*drawing_sides(spark, d))
    return registry.select("project", "side", "ord", "pdf_path", "status", "match_score")


@query("d10_pairing_gaps", f"""WITH {PAIRS} SELECT project, p_name || '.dwg 尚无对应PDF' AS title, 'd/' || ord AS source_path, 'high' AS severity
 FROM l WHERE (project, ord) NOT IN (SELECT (project, ord) FROM best)""")
def d10_gaps(spark, d):
    _, review = DR.pair_files(*drawing_sides(spark, d))
    return review.select("project", "title", "source_path", "severity")


def drawing_jobs(spark, d):
    """Pages as PDF rows; the headline words of one part act as detected drawings."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("pdf_path"),
                                        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"), "url")
    words = F.filter(F.split("h1", " "), lambda w: F.length(w) > 4)
    drawings = F.when(F.col("url").startswith("https"), F.transform(words, lambda w, i: F.struct(
        F.lit("N").alias("drawing_no"), w.alias("title"), F.when(i < 2, F.lit("1")).otherwise((i + 1).cast("string")).alias("page"),
        (i / 10).alias("confidence")))).otherwise(F.array())
    images = F.when(F.col("url").startswith("https"), F.array()).otherwise(
        F.transform(F.sequence(F.lit(1), (F.col("page_id") % 4).cast("int") + 1), lambda i: F.concat(F.lit("i/page-00"), i.cast("string"), F.lit(".png"))))
    registry = p.select(F.lit("all").alias("project"), F.concat(F.lit("pdf-"), F.col("page_id").cast("string")).alias("drawing_id"), "pdf_path", F.col("h1").alias("title"))
    return registry, p.select(F.lit("all").alias("project"), "pdf_path", drawings.alias("drawings"), images.alias("images"))


@query("d11_expand_drawings")
def d11(spark, d):
    return DR.expand_drawings(*drawing_jobs(spark, d))


@query("d12_visual_candidates", f"""WITH {DOC_FILES} SELECT doc_id, role, 'visual-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS job_id
 FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY confidence DESC, name) AS n FROM usable WHERE role IN ('tender', 'drawing'))""")
def d12(spark, d):
    return FI.visual_candidates(FI.mark_duplicates(doc_files(spark, d))).select("doc_id", "role", "job_id")


@query("d20_route_drawings", """WITH dr AS (SELECT p_partkey, p_type, p_name, p_size FROM part WHERE p_type <> 'PROMO'),
 t AS (SELECT p_partkey, p_name, p_size, unnest(CASE p_type WHEN 'SMALL' THEN ['03', 'NATION_1'] WHEN 'LARGE' THEN ['NATION_2', 'nowhere'] WHEN 'MEDIUM' THEN ['4'] ELSE ['04'] END) AS target FROM dr)
 SELECT p_partkey, CASE WHEN regexp_matches(target, '^\\d{2}$') THEN target ELSE coalesce((SELECT lpad((n_nationkey + 1)::VARCHAR, 2, '0') FROM nation
 WHERE contains(n_name, target) ORDER BY n_nationkey LIMIT 1), '04') END AS section_code, p_name || CASE WHEN p_size > 25 THEN '|landscape' ELSE '' END AS caption FROM t""".replace("\\\\d", "\\d"))
def d20(spark, d):
    p = table(spark, d, "part")
    kind = F.col("p_type")
    targets = F.when(kind == "SMALL", F.array(F.lit("03"), F.lit("NATION_1"))).when(
        kind == "LARGE", F.array(F.lit("NATION_2"), F.lit("nowhere"))).when(kind == "MEDIUM", F.array(F.lit("4"))).otherwise(F.array())
    dr = p.select(
        F.lit("all").alias("project"), "p_partkey", F.col("p_partkey").alias("drawing_id"), F.lit("x.pdf").alias("pdf_path"),
        F.when(kind == "PROMO", "pending").otherwise("confirmed").alias("status"), targets.cast("array<string>").alias("applicable_sections"),
        F.lit("").alias("caption"), F.col("p_name").alias("title"), F.lit("").alias("drawing_no"),
        F.when(F.col("p_size") > 25, "landscape_page").otherwise("inline").alias("placement"))
    s = table(spark, d, "nation").select(
        F.lit("all").alias("project"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0").alias("code"),
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"))
    return DR.route_drawings(dr, s).select(F.col("drawing_id").alias("p_partkey"), "section_code", "caption")
