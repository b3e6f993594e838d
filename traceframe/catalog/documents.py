"""Queries over standards, clauses, outlines, case patterns and Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.catalog import fixtures as X
from traceframe.catalog.extraction import requirements
from traceframe.catalog.registry import query, table
from traceframe.operators import markdown as MD, outline as OL, standards as ST

CODE = r"(?i)((?:Public License|License|BY-NC),?\s*(?:version)?\s*\d+(?:\.\d+)?)"
SOURCES = [("PUBLIC", "registry", "r.example"), ("LICENSE", "archive", "a.example"), ("", "other", "o.example")]


def standards(spark, d):
    return ST.extract_standards(X.text_blocks(spark, d), ["icens"], CODE, SOURCES)


STANDARDS = X.RAW + rf""", hits AS (SELECT project, doc_id, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM raw),
 codes AS (SELECT *, trim(regexp_replace(upper(unnest(regexp_extract_all(line, '{CODE}', 1))), '\s+', ' ', 'g')) AS code,
 generate_subscripts(regexp_extract_all(line, '{CODE}', 1), 1) AS m FROM hits WHERE contains(line, 'icens')),
 stds AS (SELECT project, doc_id, code, line_no::INT AS line_no, {X.sql_compact('line', 100)} AS title FROM (SELECT *, row_number() OVER (
 PARTITION BY doc_id, code ORDER BY line_no, m) AS rn FROM codes) WHERE rn = 1)"""


@query("c6_extract_standards", f"""WITH {STANDARDS} SELECT project, doc_id, code, line_no, title,
 CASE WHEN code LIKE 'PUBLIC%' THEN 'registry' WHEN code LIKE 'LICENSE%' THEN 'archive' ELSE 'other' END AS official_platform,
 code || ' ' || title || ' 官方 PDF' AS search_query, 'pending_download' AS status FROM stds""")
def c6(spark, d):
    return standards(spark, d).select(
        "project", "doc_id", "code", "line_no", "title", "official_platform", "search_query", "status")


RULES = [(["SMALL", "PROMO"], ["A"]), (["ECO"], ["E", "U"]), (["Brand#1"], ["M"])]


@query("c7_map_standard_sections", """WITH s AS (SELECT r_name AS t, r_regionkey AS o FROM region),
 r AS (SELECT 0 AS n, t, o FROM s WHERE contains(t, 'A') QUALIFY row_number() OVER (ORDER BY o) <= 2 UNION ALL
 SELECT 1, t, o FROM s WHERE contains(t, 'E') OR contains(t, 'U') QUALIFY row_number() OVER (ORDER BY o) <= 2 UNION ALL
 SELECT 2, t, o FROM s WHERE contains(t, 'M') QUALIFY row_number() OVER (ORDER BY o) <= 2),
 h AS (SELECT p_partkey, t, min(n * 10 + o) AS k FROM part JOIN r ON (n = 0 AND (contains(p_type, 'SMALL') OR contains(p_type, 'PROMO')))
 OR (n = 1 AND contains(p_type, 'ECO')) OR (n = 2 AND contains(p_brand, 'Brand#1')) GROUP BY 1, 2)
 SELECT p_partkey, coalesce(string_agg(h.t, '|' ORDER BY k), (SELECT t FROM s ORDER BY o LIMIT 1)) AS sections
 FROM part LEFT JOIN h USING (p_partkey) GROUP BY 1""")
def c7(spark, d):
    stds = table(spark, d, "part").select(
        F.lit("all").alias("project"), "p_partkey", F.col("p_brand").alias("code"), F.col("p_type").alias("title"))
    sections = table(spark, d, "region").select(
        F.lit("all").alias("project"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("title"))
    return ST.map_standard_sections(stds, sections, RULES).select(
        "p_partkey", F.array_join("affected_sections", "|").alias("sections"))


def numbered_turns(spark, d):
    """User turns start with a numbered title line."""
    b = X.turn_blocks(spark, d)
    number = F.concat((F.col("page") + 1).cast("string"), F.lit("."), F.col("page").cast("string"), F.lit(" "))
    head = F.concat(number, F.translate("text", "\n", " "), F.lit("\n"))
    return b.withColumn("text", F.concat(F.when(F.col("role") == "user", head).otherwise(""), F.col("text"))).drop("role")


NUMBERED = r"""blk AS (SELECT conv_id AS doc_id, turn::INT AS block_ord, (turn + 1)::INT AS page, CASE role WHEN 'user' THEN (turn + 2) || '.' || (turn + 1)
 || ' ' || replace(text, chr(10), ' ') || chr(10) ELSE '' END || text AS text FROM conversations),
 raw AS (SELECT doc_id, block_ord, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM blk),
 lines AS (SELECT doc_id, block_ord, page, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM raw)"""
OUTLINE_DEFAULT = ["Introduction", "Plan", "Result"]


@query("c13_extract_outline", f"""WITH {NUMBERED}, h AS (SELECT doc_id, block_ord, line_no,
 regexp_extract(line, '^(\\d+(?:[.．]\\d+)*[、.．]?)\\s*(.+?)\\s*$', 2) AS title,
 length(regexp_replace(regexp_extract(line, '^\\d+(?:[.．]\\d+)*'), '\\d', '', 'g')) + 1 AS level
 FROM lines WHERE length(line) >= 4 AND regexp_matches(line, '^\\d+(?:[.．]\\d+)*[、.．]?\\s*.+')),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_ord, line_no)::INT AS ord FROM h)
 SELECT doc_id, ord, level::INT AS level, title, line_no AS source_line FROM k UNION ALL
 SELECT doc_id, o, 1, t, 0 FROM (SELECT DISTINCT doc_id FROM blk WHERE doc_id NOT IN (SELECT doc_id FROM k)),
 (VALUES (1, 'Introduction'), (2, 'Plan'), (3, 'Result')) v(o, t)""")
def c13(spark, d):
    return OL.extract_outline(numbered_turns(spark, d), default=OUTLINE_DEFAULT).select(
        "doc_id", "ord", "level", "title", "source_line")


THEMES = [(["GNU", "MIT"], "Licences"), (["token"], "Secrets"), (["src1"], "Special"), (["nowhere-to-be-found"], "Never")]


@query("c14_generate_outline", f"""WITH {X.REQUIREMENTS}, f AS (SELECT project, bool_or(contains(requirement, 'GNU') OR contains(requirement, 'MIT')) AS a,
 bool_or(contains(requirement, 'token')) AS b FROM reqs GROUP BY 1),
 p AS (SELECT source AS project FROM documents GROUP BY 1),
 t AS (SELECT project, 10 AS k, 'Introduction' AS title FROM p UNION ALL SELECT project, 20, 'Plan' FROM p UNION ALL SELECT project, 30, 'Result' FROM p
 UNION ALL SELECT project, 11, 'Special' FROM p WHERE contains('type ' || project, 'src1')
 UNION ALL SELECT project, 12, 'Secrets' FROM f WHERE b UNION ALL SELECT project, 13, 'Licences' FROM f WHERE a)
 SELECT project, 1 AS level, title, row_number() OVER (PARTITION BY project ORDER BY k)::INT AS ord FROM t""")
def c14(spark, d):
    projects = X.text_blocks(spark, d).select("project").distinct().withColumn(
        "project_type", F.concat(F.lit("type "), "project"))
    return OL.generate_outline(projects, requirements(spark, d), OUTLINE_DEFAULT, THEMES, 1)


CLAUSE = r"^\s*(?:(Th[a-z]*)|(In|Is|On|Er[a-z]*))\s*[、.．:,]?\s*(.*)$"


def clauses(spark, d):
    return ST.extract_clauses(X.text_blocks(spark, d), CLAUSE, ["ingingon", "able"])


CLAUSES = X.RAW + rf""", l AS (SELECT project, doc_id, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM raw),
 s AS (SELECT *, regexp_matches(line, '{CLAUSE}') AS st FROM l),
 r AS (SELECT *, sum((st OR line = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM s),
 o AS (SELECT *, bool_or(st) OVER (PARTITION BY doc_id, run) AS opens FROM r),
 k AS (SELECT * FROM o WHERE opens AND (st OR line <> '')),
 c0 AS (SELECT project, doc_id, run, min(line_no)::INT AS line_no, max(CASE WHEN st THEN regexp_extract(line, '{CLAUSE}', 1) || regexp_extract(line, '{CLAUSE}', 2) END) AS clause_id,
 string_agg(CASE WHEN st THEN trim(regexp_extract(line, '{CLAUSE}', 3)) ELSE line END, ' ' ORDER BY line_no) AS body FROM k GROUP BY 1, 2, 3),
 c1 AS (SELECT * EXCLUDE (body), {X.sql_compact('body', None)} AS text FROM c0),
 clauses AS (SELECT project, doc_id, line_no, clause_id, text FROM c1 WHERE text <> ''
 QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY line_no) = 1)"""


@query("c15_extract_clauses", f"""WITH {CLAUSES} SELECT *, CASE WHEN contains(text, 'ingingon') OR contains(text, 'able') THEN 'mandatory'
 ELSE 'unknown' END AS mandatory_level FROM clauses""")
def c15(spark, d):
    return clauses(spark, d).select("project", "doc_id", "line_no", "clause_id", "text", "mandatory_level")


def attached(spark, d):
    """Every document as an original; one in two carries a code taken from its own text."""
    own = F.substring("text", 11, 14)
    return X.text_blocks(spark, d).select("project", "doc_id", F.when(
        F.col("doc_id") % 2 == 0, own).otherwise(F.concat(F.lit("GB 50"), F.col("doc_id").cast("string"))).alias("code"))


VERIFIED = CLAUSES + r""", att AS (SELECT source AS project, doc_id, text, CASE WHEN doc_id % 2 = 0 THEN substr(text, 11, 14)
 ELSE 'GB 50' || doc_id END AS code FROM documents), n AS (SELECT doc_id, count(*) AS n FROM clauses GROUP BY 1),
 ver AS (SELECT project, att.doc_id, code, contains(replace(replace(regexp_replace(upper(text), '\s+', '', 'g'), '—', '-'), '–', '-'),
 replace(replace(regexp_replace(upper(code), '\s+', '', 'g'), '—', '-'), '–', '-')) AS hit, coalesce(n, 0) AS clause_count
 FROM att LEFT JOIN n ON n.doc_id = att.doc_id)"""


@query("c16_verify_standard", f"""WITH {VERIFIED} SELECT project, doc_id, code, hit::INT AS identity_verified, clause_count,
 CASE WHEN hit THEN 'available' ELSE 'needs_confirmation' END AS status,
 CASE WHEN clause_count > 0 THEN 'ready' ELSE 'needs_confirmation' END AS clause_parse_status FROM ver""")
def c16(spark, d):
    out = ST.verify_standards(attached(spark, d), X.text_blocks(spark, d), clauses(spark, d))
    return out.withColumn("identity_verified", F.col("identity_verified").cast("int"))


@query("c16_attachment_review", f"""WITH {VERIFIED} SELECT doc_id, '规范解析待确认' AS category, code || '未识别到可定位条款' AS title,
 'high' AS severity FROM ver WHERE clause_count = 0 UNION ALL SELECT doc_id, '规范版本待确认', code || '原文身份未核验', 'high' FROM ver WHERE NOT hit""")
def c16_review(spark, d):
    v = ST.verify_standards(attached(spark, d), X.text_blocks(spark, d), clauses(spark, d))
    return ST.attachment_review(v).select("doc_id", "category", "title", "severity")


TERMS = ["token", "icens", "Version", "und ", "thereheon", "able", "$$$", "GNU", "que ", "ßheit"]


def case_blocks(spark, d):
    """A source as a case: english documents are the tender, all others the accepted bid."""
    docs = table(spark, d, "documents").select(
        F.col("source").alias("project"), "doc_id", F.lit(0).alias("block_ord"), "text", "lang")
    return docs.filter("lang = 'en'").drop("lang"), docs.filter("lang <> 'en'").drop("lang")


_TERM_VALUES = ", ".join(f"({X.sql_text(t)})" for t in TERMS)
SCENE = f"""terms AS (SELECT project, t, row_number() OVER (PARTITION BY project ORDER BY t)::INT AS term_no FROM (
 SELECT DISTINCT source AS project, t FROM documents, (VALUES {_TERM_VALUES}) v(t) WHERE contains(text, t)))"""


@query("c17_scene_terms", f"WITH {SCENE} SELECT project, t AS term, term_no FROM terms")
def c17(spark, d):
    return OL.scene_terms(table(spark, d, "documents").withColumnRenamed("source", "project"), TERMS)


@query("c17_case_snippets", f"""WITH {SCENE}, {X.LINES}, h AS (SELECT l.project, t, term_no, line, row_number() OVER (
 PARTITION BY l.project, t ORDER BY l.doc_id, line_no) AS rn FROM lines l JOIN documents d ON d.doc_id = l.doc_id AND lang <> 'en'
 JOIN terms ON terms.project = l.project AND contains(line, t) WHERE length(line) BETWEEN 18 AND 260)
 SELECT project, term_no, t AS keyword, {X.sql_compact('line', 220)} AS text FROM h WHERE rn = 1 AND term_no <= 20""")
def c17_snippets(spark, d):
    tender, bid = case_blocks(spark, d)
    return OL.case_patterns(tender, bid, {"x": TERMS}, ["x"])["snippets"]


@query("c18_locate_excerpts", r"""WITH b AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS n FROM benchmark),
 t AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents)
 SELECT item_id, min(doc_id) AS doc_id FROM b JOIN t ON contains(t, n) WHERE n <> '' GROUP BY 1""")
def c18(spark, d):
    return OL.locate_excerpts(table(spark, d, "benchmark"), X.text_blocks(spark, d)).select("item_id", "doc_id")


def markdown_parts(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("# "), "p_name", F.lit("\n\n| Name | Size |\n|---|---:|\n| "), "p_name", F.lit(" | "), size, F.lit(" |\n| "),
        "p_brand", F.lit(" |\nafter\n| lone |\n- one\n* two\n1. three\n第二章 "), "p_type",
        F.when(F.col("p_type") == "SMALL", F.lit("\n一、more\n|a|b|c|\n|:---:|---|---|\n|1|2|3|\n![x](y.png)")).otherwise(F.lit("\n\nlast")),
    )
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query("c19_markdown_tables", """WITH c AS (SELECT p_partkey AS doc_id, 1 AS table_no, r AS row_no, c AS col_no, v AS cell FROM part,
 LATERAL (VALUES (0, 0, 'Name'), (0, 1, 'Size'), (1, 0, p_name), (1, 1, p_size::VARCHAR), (2, 0, p_brand), (2, 1, '')) t(r, c, v)
 UNION ALL SELECT p_partkey, 2, r, c, v FROM part, (VALUES (0, 0, 'a'), (0, 1, 'b'), (0, 2, 'c'), (1, 0, '1'), (1, 1, '2'), (1, 2, '3')) t(r, c, v)
 WHERE p_type = 'SMALL') SELECT * FROM c""")
def c19(spark, d):
    return MD.markdown_tables(markdown_parts(spark, d), ["doc_id"]).withColumn("table_no", F.col("table_no").cast("int"))


@query("c20_markdown_stats", """SELECT p_partkey AS doc_id, CASE WHEN p_type = 'SMALL' THEN 3 ELSE 2 END AS headings,
 CASE WHEN p_type = 'SMALL' THEN 2 ELSE 1 END AS tables, 3 AS lists, CASE WHEN p_type = 'SMALL' THEN 2 ELSE 3 END AS paragraphs,
 CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS images FROM part""")
def c20(spark, d):
    s = MD.markdown_stats(markdown_parts(spark, d), ["doc_id"])
    return s.select("doc_id", *[F.col(c).cast("int").alias(c) for c in s.columns if c != "doc_id"])


@query("c21_number_headings", f"""WITH h AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn % 3 + 1 ELSE CASE role WHEN 'assistant' THEN 2 ELSE 4 END END AS l
 FROM conversations),
 k AS (SELECT a.conv_id, a.turn, a.l, (SELECT coalesce(max(b.turn), -1) FROM h b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.l < a.l) AS since FROM h a),
 n AS (SELECT conv_id, turn, l, count(*) OVER (PARTITION BY conv_id, l, since ORDER BY turn)::INT AS n FROM k),
 z AS (SELECT *, CASE WHEN n < 10 THEN list_value('一','二','三','四','五','六','七','八','九')[n] ELSE CASE WHEN n < 20 THEN '' ELSE
 list_value('一','二','三','四','五','六','七','八','九')[n // 10] END || '十' || CASE WHEN n % 10 = 0 THEN '' ELSE list_value('一','二','三','四','五','六','七','八','九')[n % 10] END END AS c FROM n)
 SELECT conv_id, turn, n AS number, CASE l WHEN 1 THEN '第' || c || '章 ' WHEN 2 THEN '第' || c || '节 ' WHEN 3 THEN c || '、' ELSE n || '、' END || 'part' AS numbered_title FROM z""")
def c21(spark, d):
    c = table(spark, d, "conversations")
    level = F.when(F.col("role") == "user", F.col("turn") % 3 + 1).when(F.col("role") == "assistant", 2).otherwise(4)
    rows = c.select("conv_id", "turn", level.cast("int").alias("level"), F.lit("3.1 part").alias("title"))
    return MD.number_headings(rows, ["conv_id"], "turn").select("conv_id", "turn", "number", "numbered_title")


NUMBER = r"(?<![A-Za-z0-9_.-])\d+(?:\.\d+)?(?![A-Za-z0-9_])"


@query("c22_extract_claims", r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s', '  ', 'g') AS t, text FROM documents)
 SELECT doc_id, 'quantity' AS kind, unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_.-])(\d+(?:\.\d+)?)(?:[^A-Za-z0-9_]|$)', 1)) AS token FROM t
 UNION ALL SELECT doc_id, 'citation', unnest(regexp_extract_all(text, 'License, [Vv]ersion \d+')) FROM t""")
def c22(spark, d):
    return MD.extract_claims(table(spark, d, "documents"), ["doc_id"], quantity=NUMBER,
                             citation=r"License, [Vv]ersion \d+").select("doc_id", "kind", "token")
