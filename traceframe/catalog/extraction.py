"""Queries over requirement and fact extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.catalog import fixtures as X
from traceframe.catalog.registry import query, table
from traceframe.operators import facts as FA, requirements as RQ
from traceframe.operators.keyed import kept
from traceframe.operators.lines import block_starts, meaningful_lines

SECTION_SQL = X.sql_map("category", X.SECTIONS, X.sql_text(X.DEFAULT_SECTION))


def requirements(spark, d):
    return RQ.extract_requirements(
        X.text_blocks(spark, d), X.LEXICON, X.MARKERS, X.SECTIONS, X.DEFAULT_SECTION, located=False)


@query("c1_classify_lines", f"""WITH {X.LINES} SELECT doc_id, line_no, {X.sql_category('line', X.LEXICON)} AS category FROM lines""")
def c1(spark, d):
    return meaningful_lines(X.text_blocks(spark, d)).select(
        "doc_id", "line_no", RQ.classify("line", X.LEXICON).alias("category"))


@query("c2_suggest_section", f"""WITH {X.LINES}, c AS (SELECT doc_id, line_no, {X.sql_category('line', X.LEXICON)} AS category FROM lines)
 SELECT doc_id, line_no, {SECTION_SQL} AS section FROM c""")
def c2(spark, d):
    return meaningful_lines(X.text_blocks(spark, d)).select(
        "doc_id", "line_no",
        RQ.suggest_section(RQ.classify("line", X.LEXICON), X.SECTIONS, X.DEFAULT_SECTION).alias("section"))


@query("c3_extract_requirements", f"""WITH {X.REQUIREMENTS} SELECT project, doc_id, 'REQ-' || CASE WHEN req_no < 1000
 THEN lpad(req_no::VARCHAR, 3, '0') ELSE req_no::VARCHAR END AS id, category, requirement, line_no AS source_line,
 {SECTION_SQL} AS suggested_section, {X.sql_compact('line', 500)} AS source_context, 'needs_response' AS status FROM reqs""")
def c3(spark, d):
    return requirements(spark, d).select(
        "project", "doc_id", "id", "category", "requirement", "source_line", "suggested_section", "source_context", "status")


@query("c3_located_requirements", f"""WITH {X.TURN_LINES}, cand AS (SELECT *, {X.sql_category('line', X.LEXICON)} AS category,
 row_number() OVER (PARTITION BY doc_id, line ORDER BY run_no) AS rn FROM lines WHERE {X.sql_any('line', X.ALL_WORDS)}),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run_no)::INT AS req_no FROM cand WHERE rn = 1)
 SELECT r.doc_id, req_no, category, run_no AS source_line, page AS source_page, line AS requirement,
 {X.sql_compact('c.text', 500)} AS source_context FROM r JOIN conversations c ON c.conv_id = r.doc_id AND c.turn = r.block_ord""")
def c3_located(spark, d):
    return RQ.extract_requirements(
        X.turn_blocks(spark, d).drop("role"), X.LEXICON, X.MARKERS, X.SECTIONS, X.DEFAULT_SECTION
    ).select("doc_id", "req_no", "category", "source_line", "source_page", "requirement", "source_context")


@query("c3_requirement_summary", f"""WITH {X.REQUIREMENTS} SELECT project, doc_id,
 CASE WHEN bool_or(category = 'licence') THEN 'licence' ELSE 'unknown' END AS detected_mode, count(*) AS requirement_count
 FROM reqs GROUP BY 1, 2""")
def c3_summary(spark, d):
    return RQ.requirement_summary(requirements(spark, d), mode="licence").drop("human_checks")


# --- references inside order pages -----------------------------------------------------

CATS = {"schedule": ["工期"], "quality": ["质量"], "scene": ["河道"]}
MARKS = ["必须"]
_P = r"第\s*(\d{1,4})\s*页"
_T = r"附表\s*[一二三四五六七八九十百\dA-Za-z.—-]*"
_PUNCT = " ：:；;，,。"
ORDER_REQS = X.ORDER_BLOCKS + rf""", ol AS (SELECT doc_id, block_ord, page, path, text, unnest(string_split(text, chr(10))) AS raw,
 generate_subscripts(string_split(text, chr(10)), 1)::INT AS pos FROM blocks),
 ml AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_ord, pos)::INT AS line_no FROM
 (SELECT * EXCLUDE (raw), trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM ol) WHERE length(line) >= 4),
 cand AS (SELECT *, {X.sql_category('line', CATS)} AS category,
 regexp_extract(line, '(?:详见|参见|见|按|按照|以).{{0,16}}') AS mk, regexp_extract(line, '{_P}', 1) AS pg,
 regexp_replace(regexp_extract(line, '{_T}'), '\s+', '', 'g') AS tb,
 trim(regexp_replace(line, '^[^：:]*[：:]', ''), '{_PUNCT}') AS tail
 FROM ml WHERE {X.sql_any('line', ['工期', '质量', '河道', '必须'])}),
 cand2 AS (SELECT *, mk <> '' AND (pg <> '' OR tb <> '') AS is_ref FROM cand),
 links AS (SELECT *, nullif(pg, '')::INT AS target_page FROM cand2 WHERE is_ref),
 kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS rn FROM cand2
 WHERE NOT (is_ref AND regexp_matches(tail, '(详见|参见|见|按|按照|以)')
 AND (regexp_matches(tail, '{_P}') OR regexp_matches(tail, '{_T}'))
 AND length(trim(regexp_replace(tail, '(详见|参见|见|按|按照|以).*$', ''), '{_PUNCT}')) <= 12)),
 reqs AS (SELECT doc_id, category, page, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS req_no,
 line_no, line FROM kept WHERE rn = 1)"""


def order_requirements(spark, d):
    blocks = X.order_blocks(spark, d)
    candidates, starts = kept(RQ.requirement_candidates(blocks, CATS, MARKS)), kept(block_starts(blocks))
    links = RQ.requirement_links(candidates, blocks, starts)
    return links, RQ.extract_requirements(blocks, CATS, MARKS, candidates=candidates, starts=starts)


@query("c4_requirement_links", f"""WITH {ORDER_REQS} SELECT doc_id, line_no AS source_line, category, page AS source_page,
 coalesce(target_page, -1) AS target_page, tb AS target_table, line AS reference_text, trim(mk) AS marker, line AS source_excerpt FROM links""")
def c4(spark, d):
    links, _ = order_requirements(spark, d)
    return links.select("doc_id", "source_line", "category", "source_page",
                        F.coalesce("target_page", F.lit(-1)).alias("target_page"), "target_table", "reference_text",
                        "marker", "source_excerpt")


@query("c3_pointer_lines_dropped", f"WITH {ORDER_REQS} SELECT doc_id, req_no, category, page AS source_page, line AS requirement FROM reqs")
def c3_pointers(spark, d):
    _, reqs = order_requirements(spark, d)
    return reqs.select("doc_id", "req_no", "category", "source_page", "requirement")


@query("c5_resolve_requirement_links", f"""WITH {ORDER_REQS}, pairs AS (SELECT l.doc_id, l.line_no, r.req_no, r.page AS rp,
 r.page = l.target_page AS page_hit, l.tb <> '' AND contains(regexp_replace(r.text, '\\s+', '', 'g'), l.tb) AS table_hit,
 l.target_page, l.tb FROM links l JOIN reqs r ON r.doc_id = l.doc_id AND r.category = l.category),
 p2 AS (SELECT *, coalesce(bool_or(page_hit) OVER w, false) AS any_page, count(*) OVER w AS n FROM pairs
 WINDOW w AS (PARTITION BY doc_id, line_no)),
 p3 AS (SELECT *, CASE WHEN any_page THEN page_hit ELSE true END AS in_page FROM p2),
 p4 AS (SELECT *, bool_or(in_page AND table_hit) OVER (PARTITION BY doc_id, line_no) AS any_table FROM p3),
 ok AS (SELECT doc_id, line_no, string_agg('REQ-' || lpad(req_no::VARCHAR, 3, '0'), ',' ORDER BY req_no) AS ids,
 string_agg(DISTINCT rp::VARCHAR, ',' ORDER BY rp::VARCHAR) AS pages FROM p4
 WHERE in_page AND (table_hit OR NOT any_table) AND (any_table OR any_page OR n = 1) GROUP BY 1, 2)
 SELECT l.doc_id, l.line_no AS source_line, CASE WHEN ids IS NULL THEN 'unresolved' ELSE 'resolved' END AS status,
 coalesce(ids, '') AS ids, coalesce(pages, '') AS pages FROM links l LEFT JOIN ok USING (doc_id, line_no)""")
def c5(spark, d):
    links, reqs = order_requirements(spark, d)
    # both are read several times; what the answers don't need is not kept
    links = kept(links.select("project", "doc_id", "category", "source_line", "target_page", "target_table"))
    reqs = kept(reqs.select("project", "doc_id", "category", "req_no", "id", "source_page", "context_tables"))
    out = RQ.resolve_requirement_links(links, reqs)
    return out.select("doc_id", "source_line", "status", F.array_join("resolved_ids", ",").alias("ids"),
                      F.array_join(F.transform("resolved_pages", lambda p: p.cast("string")), ",").alias("pages"))


# --- facts ------------------------------------------------------------------------------

TEXT_PATTERNS = [
    ("host", r"(\d+\.\d+\.\d+)\.(\d+)", True),
    ("token", r'token = "([0-9a-f]{6})', False),
    ("version", r"[Vv]ersion (\d+(?:\.\d+)?)", False),
]
_HITS = " UNION ALL ".join(
    f"SELECT source AS project, doc_id, '{k}' AS key, {n} AS pattern_ord, text, "
    f"unnest(regexp_extract_all(text, '{p}', 1)) AS value, "
    + (f"unnest(regexp_extract_all(text, '{p}', 2)) AS unit, " if u else "'' AS unit, ")
    + f"generate_subscripts(regexp_extract_all(text, '{p}', 1), 1) AS match_ord FROM documents"
    for n, (k, p, u) in enumerate(TEXT_PATTERNS)
)
TEXT_FACTS = f"""hits AS ({_HITS}), facts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key, value
 ORDER BY pattern_ord, match_ord) AS rn FROM hits) WHERE rn = 1),
 norms AS (SELECT *, lower(regexp_replace(value, '[\\s:：,，。；;、_—–-]+', '', 'g') || unit) AS norm FROM facts)"""


def text_facts(spark, d):
    return FA.extract_facts(X.text_blocks(spark, d), TEXT_PATTERNS)


@query("c8_extract_facts", f"""WITH {TEXT_FACTS} SELECT project, doc_id, key, value, unit, norm, 'extracted' AS status,
 {X.sql_compact('text', 800)} AS source_block_excerpt, 0.86::DOUBLE AS confidence FROM norms""")
def c8(spark, d):
    return text_facts(spark, d).select(
        "project", "doc_id", "key", "value", "unit", "norm", "status", "source_block_excerpt", "confidence")


@query("c11_merge_facts", f"""WITH {TEXT_FACTS}, g AS (SELECT project, key, norm, count(*) AS mention_count,
 min(doc_id) AS doc_id FROM norms GROUP BY 1, 2, 3)
 SELECT g.*, n.value, n.unit FROM g JOIN (SELECT *, row_number() OVER (PARTITION BY project, key, norm
 ORDER BY doc_id, pattern_ord, match_ord) AS r FROM norms) n USING (project, key, norm, doc_id) WHERE n.r = 1""")
def c11(spark, d):
    return FA.merge_facts(text_facts(spark, d)).select("project", "key", "norm", "mention_count", "doc_id", "value", "unit")


@query("c11_fact_mentions", f"""WITH {TEXT_FACTS} SELECT project, key, norm, doc_id,
 project || '/' || doc_id || '.txt' AS path FROM norms""")
def c11_mentions(spark, d):
    return FA.fact_mentions(text_facts(spark, d)).select("project", "key", "norm", "doc_id", "path")


@query("c12_detect_conflicts", f"""WITH {TEXT_FACTS}, v AS (SELECT project, key, norm,
 min_by(value || unit || '（' || doc_id || '.txt）', row(doc_id, pattern_ord, match_ord)) AS label,
 min(row(doc_id, pattern_ord, match_ord)) AS seen FROM norms GROUP BY 1, 2, 3),
 n AS (SELECT *, row_number() OVER (PARTITION BY project, key ORDER BY seen) AS no FROM v)
 SELECT project, key, ((no - 1) // 500 + 1)::INT AS part, max(c) AS variant_count, key || '存在不一致' AS title,
 string_agg(label, '；' ORDER BY no) AS detail, 'high' AS severity, 'open' AS status
 FROM (SELECT *, count(*) OVER (PARTITION BY project, key) AS c FROM n) WHERE c > 1 GROUP BY 1, 2, 3""")
def c12(spark, d):
    return FA.detect_conflicts(text_facts(spark, d)).select(
        "project", "key", "part", "variant_count", "title", "detail", "severity", "status")


ORDER_FACTS = X.ORDER_BLOCKS + r""", hits AS (
 SELECT doc_id, block_ord, page, path, text, '总工期' AS key, 0 AS po, regexp_extract(text, '总工期[^\d]{0,12}(\d+)\s*日历天', 1) AS value, '日历天' AS unit,
 '' AS fulltext FROM blocks WHERE regexp_matches(text, '总工期[^\d]{0,12}\d+\s*日历天')
 UNION ALL SELECT doc_id, block_ord, page, path, text, '质量标准', 1, regexp_extract(text, '质量标准：([^。；\n|]+)', 1), '',
 regexp_extract(text, '质量标准：([^。；\n|]+)') FROM blocks WHERE contains(text, '质量标准')
 UNION ALL SELECT doc_id, block_ord, page, path, text, '项目名称', 2, regexp_extract(text, '项目名称：([^。；\n|]+)', 1), '', ''
 FROM blocks WHERE contains(text, '项目名称')
 UNION ALL SELECT doc_id, block_ord, page, path, text, '总工期', 3, regexp_extract(text, '总工期：(详见[^\n]+)', 1), '',
 regexp_extract(text, '总工期：(详见[^\n]+)') FROM blocks WHERE contains(text, '总工期：详见'))"""
ORDER_PATTERNS = [
    ("总工期", r"总工期[^\d]{0,12}(\d+)\s*(日历天)", True),
    ("质量标准", r"质量标准：([^。；\n|]+)", False),
    ("项目名称", r"项目名称：([^。；\n|]+)", False),
    ("总工期", r"总工期：(详见[^\n]+)", False),
]
ORDER_FACTS2 = ORDER_FACTS + r""", links AS (SELECT *, regexp_extract(fulltext, '第\s*(\d{1,4})\s*页', 1)::INT AS target_page,
 regexp_extract(fulltext, '附表\d*') AS tb FROM hits WHERE po = 3 OR (po = 1 AND value LIKE '合格（%')),
 facts AS (SELECT doc_id, block_ord, page, path, text, key, po, unit,
 CASE WHEN po = 1 THEN '合格并且满足合同全部条款约定' ELSE value END AS value,
 CASE WHEN po = 2 THEN regexp_replace(value, '[《》]', '', 'g') WHEN po = 1 THEN '合格并且满足合同全部条款约定' ELSE value || unit END AS norm,
 row_number() OVER (PARTITION BY doc_id, key, CASE WHEN po = 1 THEN '合格并且满足合同全部条款约定' ELSE value END, page ORDER BY block_ord, po) AS rn
 FROM hits WHERE po IN (0, 2) OR (po = 1 AND value NOT LIKE '合格（%')), f AS (SELECT * FROM facts WHERE rn = 1)"""


def order_facts(spark, d):
    matches = kept(FA.fact_matches(X.order_blocks(spark, d), ORDER_PATTERNS, excerpts=False))
    return FA.extract_facts(None, matches=matches), FA.fact_links(matches)


@query("c8_reference_values", f"""WITH {ORDER_FACTS2} SELECT doc_id, block_ord, key, value, unit, norm, page AS source_page FROM f""")
def c8_refs(spark, d):
    facts, _ = order_facts(spark, d)
    return facts.select("doc_id", "block_ord", "key", "value", "unit", "norm", "source_page")


@query("c9_fact_links", f"""WITH {ORDER_FACTS2} SELECT doc_id, block_ord, key AS fact_key, page AS source_page, target_page,
 tb AS target_table, fulltext AS source_excerpt, 'fact_reference' AS kind FROM links""")
def c9(spark, d):
    _, links = order_facts(spark, d)
    return links.select("doc_id", "block_ord", "fact_key", "source_page", "target_page", "target_table", "source_excerpt", "kind")


C10_SQL = f"""WITH {ORDER_FACTS2}, p AS (SELECT l.doc_id, l.block_ord, l.key, l.target_page, f.page, f.value, f.norm, f.block_ord AS fb, f.po AS fp,
 l.target_page IS NOT NULL AND f.page = l.target_page AS ph, l.tb <> '' AND contains(regexp_replace(f.text, '\\s+', '', 'g'), l.tb) AS th
 FROM links l JOIN f ON f.doc_id = l.doc_id AND f.key = l.key),
 p2 AS (SELECT *, bool_or(ph) OVER (PARTITION BY doc_id, block_ord) AS ap FROM p),
 p3 AS (SELECT *, ph OR NOT ap AS ip FROM p2),
 p4 AS (SELECT *, bool_or(ip AND th) OVER (PARTITION BY doc_id, block_ord) AS atb FROM p3),
 c AS (SELECT * FROM p4 WHERE ip AND (th OR NOT atb)),
 r AS (SELECT doc_id, block_ord, key, min_by(value, row(abs(page - target_page), fb, fp)) AS value,
 min_by(page, row(abs(page - target_page), fb, fp)) AS rp FROM c GROUP BY 1, 2, 3 HAVING min(norm) = max(norm))"""


@query("c10_resolve_fact_links", C10_SQL + """ SELECT l.doc_id, l.block_ord,
 CASE WHEN r.value IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, coalesce(r.value, '') AS resolved_value,
 coalesce(rp, -1) AS resolved_page FROM links l LEFT JOIN r USING (doc_id, block_ord)""")
def c10(spark, d):
    facts, links = order_facts(spark, d)
    return FA.resolve_fact_links(links, facts).select(
        "doc_id", "block_ord", "status", "resolved_value", F.coalesce("resolved_page", F.lit(-1)).alias("resolved_page"))


@query("c10_raised_confidence", C10_SQL + """ SELECT f.doc_id, f.block_ord, f.key, f.value, count(r.value) AS chain_count,
 CASE WHEN count(r.value) > 0 THEN 0.95 ELSE 0.86 END::DOUBLE AS confidence FROM f LEFT JOIN r
 ON r.doc_id = f.doc_id AND r.key = f.key AND r.value = f.value AND r.rp = f.page GROUP BY 1, 2, 3, 4""")
def c10_confidence(spark, d):
    facts, links = order_facts(spark, d)
    facts = kept(facts)
    return FA.apply_resolved_links(facts, FA.resolve_fact_links(links, facts)).select(
        "doc_id", "block_ord", "key", "value", "chain_count", "confidence")


@query("d2_response_matrix", f"""WITH {X.REQUIREMENTS} SELECT project, doc_id, req_no::INT AS req_no, category, requirement, {SECTION_SQL} AS target_section,
 {X.sql_map('category', X.STRATEGIES, "'cover it'")} AS response_strategy, 'pending' AS draft_status,
 (category IN ('licence', 'secret'))::INT AS human_check FROM reqs""")
def d2(spark, d):
    m = RQ.response_matrix(requirements(spark, d), None, X.STRATEGIES, "cover it", ["licence", "secret"])
    return m.select("project", "doc_id", "req_no", "category", "requirement", "target_section", "response_strategy",
                    "draft_status", F.col("human_check").cast("int").alias("human_check"))
