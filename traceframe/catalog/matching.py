"""Queries over chapters, cases and model answers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from traceframe.catalog import fixtures as X
from traceframe.catalog.documents import STANDARDS, TERMS, case_blocks, standards
from traceframe.catalog.extraction import SECTION_SQL, TEXT_FACTS, requirements, text_facts
from traceframe.catalog.registry import query, table
from traceframe.functions.text import strings
from traceframe.operators import cases as CA, facts as FA, outline as OL, requirements as RQ, sections as SE, visual as VI
from traceframe.operators.keyed import salted_lookup, stable

_CHARS = "list_distinct(regexp_extract_all({0}, '{1}'))"


def _shared(a: str, b: str, pattern: str = "(?s).") -> str:
    return f"len(list_intersect({_CHARS.format(a, pattern)}, {_CHARS.format(b, pattern)}))"


def nation_titles(spark, d):
    return table(spark, d, "nation").select(
        F.lit("all").alias("project"), F.col("n_nationkey").cast("int").alias("ord"), F.concat("n_name", F.lit("/"), F.col("n_regionkey").cast("string")).alias("title"))


@query("d1_best_outline_match", f"""WITH v AS (SELECT p_partkey, p_brand || p_type AS v FROM part), u AS (SELECT DISTINCT v FROM v),
 s AS (SELECT v, n_name || '/' || n_regionkey AS t, n_nationkey AS o, {_shared('v', "n_name || '/' || n_regionkey")} AS s FROM u, nation),
 b AS (SELECT * FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY v ORDER BY s DESC, o) = 1)
 SELECT p_partkey, coalesce(t, v) AS matched_title, coalesce(s, 0)::BIGINT AS score FROM v LEFT JOIN b USING (v)""")
def d1(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit("all").alias("project"), F.concat("p_brand", "p_type").alias("section"))
    best = RQ.best_outline_match(p, nation_titles(spark, d), ["project"])
    return salted_lookup(p, best, ["project", "section"], by=["p_partkey"]).select(
        "p_partkey", "matched_title", F.col("score").cast("bigint").alias("score"))


@query("d2_matrix_with_outline", f"""WITH {X.REQUIREMENTS}, r AS (SELECT *, {SECTION_SQL} AS v FROM reqs), u AS (SELECT DISTINCT project, v FROM r), ol AS (SELECT DISTINCT source AS project, doc_id % 25 AS o FROM documents),
 s AS (SELECT project, v, n_name || '/' || n_regionkey AS t, o, {_shared('v', "n_name || '/' || n_regionkey")} AS s FROM u JOIN ol USING (project) JOIN nation ON n_nationkey = o),
 b AS (SELECT * FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY project, v ORDER BY s DESC, o) = 1)
 SELECT doc_id, req_no::INT AS req_no, coalesce(t, v) AS target_section FROM r LEFT JOIN b USING (project, v)""")
def d2_outline(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("project"), (F.col("doc_id") % 25).cast("int").alias("ord")).distinct()
    outline = docs.join(nation_titles(spark, d).drop("project"), "ord")
    return RQ.response_matrix(stable(requirements(spark, d)), outline).select("doc_id", "req_no", "target_section")


@query("d3_closest_template", f"""WITH v AS (SELECT DISTINCT p_size % 5 AS project, p_name || p_size AS v FROM part),
 s AS (SELECT project, v, n_name AS t, n_nationkey AS o, {_shared('v', 'n_name', '[A-Za-z0-9]')} AS s FROM v JOIN nation ON n_regionkey = project)
 SELECT project::INT AS project, v AS title, t AS template FROM s QUALIFY row_number() OVER (PARTITION BY project, v ORDER BY s DESC, o) = 1""")
def d3(spark, d):
    titles = table(spark, d, "part").select(F.col("p_size").cast("int") % 5, F.concat("p_name", F.col("p_size").cast("string")).alias("title")).toDF("project", "title")
    templates = table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("project"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"))
    return SE.closest_template(titles, templates)


@query("d4_build_blueprint", """WITH base AS (SELECT n_nationkey AS code, n_regionkey AS g, n_name, (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) FROM customer
 WHERE c_nationkey = n_nationkey) AS segs FROM nation),
 p AS (SELECT s_suppkey AS project, CASE s_suppkey % 3 WHEN 0 THEN 'FURNITURE works' WHEN 1 THEN 'plain' ELSE 'MACHINERY and BUILDING' END AS ty FROM supplier),
 m(o, k) AS (VALUES (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'MACHINERY')),
 x AS (SELECT g, code, 0 AS k, i AS o, segs[i] AS v, '' AS need FROM base, generate_series(1, len(segs)) t(i) UNION ALL SELECT g, code, 1, m.o, 'mod ' || m.k, m.k FROM base, m WHERE code = 6),
 y AS (SELECT project, g, v, min(code * 1000 + k * 100 + o) AS ord FROM p JOIN x ON need = '' OR contains(ty, need) GROUP BY 1, 2, 3)
 SELECT project, r_name AS title, (SELECT string_agg('do ' || n_name, '；' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) || '。' AS purpose,
 string_agg(v, '|' ORDER BY ord) AS components FROM y JOIN region ON r_regionkey = g GROUP BY project, r_name, r_regionkey""")
def d4(spark, d):
    one = lambda c: F.regexp_replace(c, "^.*$", "b").alias("blueprint")
    n = table(spark, d, "nation")
    seg = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.array_sort(F.collect_set("c_mktsegment")).alias("segs"))
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    base = n.join(seg, "n_nationkey").select(
        one("n_name"), code.alias("code"), F.col("n_name").alias("title"), F.concat(F.lit("do "), "n_name", F.lit("。")).alias("purpose"),
        F.col("segs").alias("required_inputs"), F.col("segs").alias("components"), F.col("segs").alias("acceptance"))
    members = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(code)).alias("members"))
    groups = table(spark, d, "region").join(members, F.col("r_regionkey") == F.col("n_regionkey")).select(
        one("r_name"), F.col("r_regionkey").alias("ord"), F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("title"), "members")
    keys = table(spark, d, "customer").select("c_mktsegment").distinct().filter(
        F.col("c_mktsegment").isin("BUILDING", "FURNITURE", "MACHINERY"))
    modules = keys.select(one("c_mktsegment"), F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "FURNITURE", 2).otherwise(3).alias("ord"),
                          F.col("c_mktsegment").alias("key"), F.concat(F.lit("mod "), "c_mktsegment").alias("title"))
    kind = F.col("s_suppkey") % 3
    projects = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), one("s_name"), F.when(
        kind == 0, "FURNITURE works").when(kind == 1, "plain").otherwise("MACHINERY and BUILDING").alias("project_type"))
    return SE.build_blueprint(projects, base, groups, modules).select(
        "project", "title", "purpose", F.array_join("components", "|").alias("components"))


# --- chapters of each source ----------------------------------------------------------

CHAPTERS = [("01", "Chapter A、Basics"), ("02", "Chapter B"), ("03", "Chapter C、Licences"), ("04", "Chapter Z")]
FACT_WORDS = {"host": ["B"], "token": ["Basics", "Z"]}
FACT_DEFAULT = ["Licences"]
ALIASES = {"Chapter Z": "Chapter B"}
INPUTS = {"01": ["token", "zzqzz", "Version"], "02": ["able", "GNU"], "03": ["MIT license", "nowherefound"], "04": []}


def chapters(spark, d):
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("code"), F.lit(t).alias("title"), F.lit("say " + t).alias("purpose"),
                              strings(INPUTS[c]).alias("required_inputs"), strings(["text"]).alias("components"),
                              strings(["checked"]).alias("acceptance")) for i, (c, t) in enumerate(CHAPTERS)])
    return table(spark, d, "documents").select(F.col("source").alias("project")).distinct().select("project", F.explode(rows).alias("r")).select(
        "project", "r.*")


def fact_inputs(spark, d):
    facts = FA.merge_facts(text_facts(spark, d))
    stds = standards(spark, d).withColumn("affected_sections", strings(["Chapter C、Licences", "elsewhere"]))
    return facts, stds


def basis_inputs(spark, d):
    return stable(RQ.response_matrix(requirements(spark, d))), *fact_inputs(spark, d)


def basis(spark, d, inputs=None):
    matrix, facts, stds = inputs or basis_inputs(spark, d)
    return SE.section_basis(chapters(spark, d), matrix, facts, stds, None, "Base 1.0", ALIASES, FACT_WORDS, FACT_DEFAULT)


_STD = STANDARDS.replace("hits AS", "std_hits AS").replace("FROM hits", "FROM std_hits").removeprefix(X.RAW + ", ")
BASIS = f"""{X.REQUIREMENTS}, {TEXT_FACTS}, {_STD},
 mx AS (SELECT *, {SECTION_SQL} AS target FROM reqs),
 re AS (SELECT project, CASE WHEN target = 'Chapter A' THEN '01' WHEN target IN ('Chapter B', 'Chapter Z') THEN '02' WHEN target = 'Chapter C' THEN '03' END AS sc,
 doc_id, req_no, requirement AS item FROM mx),
 ro AS (SELECT project, sc, 'project' AS side, 'requirement' AS kind, row_number() OVER (PARTITION BY project, sc ORDER BY doc_id, req_no) AS ord, item FROM re WHERE sc IS NOT NULL),
 mf AS (SELECT project, key, norm, value, unit, doc_id, pattern_ord, match_ord FROM norms QUALIFY row_number() OVER (PARTITION BY project, key, norm ORDER BY doc_id, pattern_ord, match_ord) = 1),
 fe AS (SELECT project, unnest(CASE key WHEN 'host' THEN ['01', '02'] WHEN 'token' THEN ['01', '04'] ELSE ['03'] END) AS sc, doc_id, pattern_ord, match_ord, key, norm, key || '：' || value || unit AS item FROM mf),
 fe2 AS (SELECT * FROM fe WHERE true),
 fo AS (SELECT project, sc, 'project' AS side, 'fact' AS kind, row_number() OVER (PARTITION BY project, sc ORDER BY doc_id, pattern_ord, match_ord, key, norm) AS ord, item FROM fe2),
 so AS (SELECT project, '03' AS sc, 'reference' AS side, 'standard' AS kind, row_number() OVER (PARTITION BY project ORDER BY doc_id, line_no, code) AS ord, code || ' ' || title AS item FROM stds),
 bo AS (SELECT project, sc, 'reference' AS side, 'blueprint' AS kind, 1 AS ord, 'Base 1.0' AS item FROM (SELECT DISTINCT source AS project FROM documents), (VALUES ('01'), ('02'), ('03'), ('04')) v(sc)),
 basis AS (SELECT * FROM ro WHERE ord <= 8 UNION ALL SELECT * FROM fo WHERE ord <= 8 UNION ALL SELECT * FROM so WHERE ord <= 8 UNION ALL SELECT * FROM bo)"""


@query("d5_section_basis", f"WITH {BASIS} SELECT project, sc AS section_code, side, kind, ord::INT AS ord, item FROM basis")
def d5(spark, d):
    return basis(spark, d)


@query("d5_requirement_edges", f"WITH {BASIS} SELECT project, sc AS section_code, count(*) AS requirements FROM re WHERE sc IS NOT NULL GROUP BY 1, 2")
def d5_edges(spark, d):
    edges = SE.requirement_edges(stable(RQ.response_matrix(requirements(spark, d))), chapters(spark, d), ALIASES)
    return edges.groupBy("project", "section_code").agg(F.count(F.lit(1)).alias("requirements"))


def evidence(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("project"), "text")


_INPUT_ROWS = ", ".join(f"('{c}', {i}, '{t}')" for c, ts in INPUTS.items() for i, t in enumerate(ts))
MISSING = f"""inp(sc, ord, input) AS (VALUES {_INPUT_ROWS}), pr AS (SELECT DISTINCT source AS project FROM documents),
 kw AS (SELECT sc, ord, input, unnest(CASE input WHEN 'Version' THEN ['Version 3', 'Public License'] ELSE regexp_extract_all(input, '[A-Za-z]{{3,}}') END) AS w FROM inp),
 ok AS (SELECT DISTINCT source AS project, sc, input FROM kw JOIN documents ON contains(text, w)),
 missing AS (SELECT project, sc, ord, input FROM pr, inp WHERE (project, sc, input) NOT IN (SELECT (project, sc, input) FROM ok))"""
KEYWORDS = {"groups": {"Version": ["Version 3", "Public License"]}, "pattern": "[A-Za-z]{3,}"}


@query("d6_missing_inputs", f"WITH {MISSING} SELECT project, sc AS section_code, ord::INT AS ord, input FROM missing")
def d6(spark, d):
    return SE.missing_inputs(chapters(spark, d), evidence(spark, d), **KEYWORDS)


@query("d6_available_inputs", r"""WITH b AS (SELECT item_id, text AS input, unnest(regexp_extract_all(text, '[A-Za-z]{12,}')) AS w FROM benchmark)
 SELECT i.text AS input, coalesce(bool_or(t.doc_id IS NOT NULL), false)::INT AS available FROM benchmark i LEFT JOIN b USING (item_id)
 LEFT JOIN documents t ON contains(t.text, w) GROUP BY 1""")
def d6_available(spark, d):
    inputs = table(spark, d, "benchmark").select(F.lit("all").alias("project"), F.col("text").alias("input"))
    texts = table(spark, d, "documents").select(F.lit("all").alias("project"), "text")
    return SE.input_availability(inputs, texts, {}, "[A-Za-z]{12,}").select("input", F.col("available").cast("int").alias("available"))


@query("d7_section_completion", """SELECT o_custkey, greatest(5, least(90, 20 + 8 * count(*) FILTER (o_orderstatus = 'P') + 5 * count(*) FILTER (o_orderstatus = 'F')
 - 5 * count(*) FILTER (o_orderstatus = 'O')))::INT AS completion FROM orders GROUP BY 1""")
def d7(spark, d):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy("o_custkey").agg(n("P").alias("p"), n("F").alias("f"), n("O").alias("o")).select(
        "o_custkey", SE.completion(F.col("p"), F.col("f"), F.col("o")).alias("completion"))


@query("d5_build_sections", f"""WITH {BASIS}, {MISSING}, c AS (SELECT project, sc, count(*) FILTER (side = 'project') AS p, count(*) FILTER (side = 'reference') AS r,
 string_agg(item, '|' ORDER BY kind = 'fact', ord) FILTER (side = 'project') AS pb FROM basis GROUP BY 1, 2),
 m AS (SELECT project, sc, count(*) AS n, string_agg(input, '|' ORDER BY ord) AS mi FROM missing GROUP BY 1, 2)
 SELECT c.project, c.sc AS code, coalesce(pb, '') AS project_basis, coalesce(mi, '') AS missing_inputs,
 greatest(5, least(90, 20 + 8 * p + 5 * r - 5 * coalesce(n, 0)))::INT AS completion, CASE WHEN n IS NULL THEN 'ready' ELSE 'needs_input' END AS status
 FROM c LEFT JOIN m USING (project, sc)""")
def d5_sections(spark, d):
    s = chapters(spark, d)
    out = SE.build_sections(s, basis(spark, d), SE.missing_inputs(s, evidence(spark, d), **KEYWORDS))
    return out.select("project", "code", F.array_join("project_basis", "|").alias("project_basis"),
                      F.array_join("missing_inputs", "|").alias("missing_inputs"), "completion", "status")


# --- cases ----------------------------------------------------------------------------

def doc_cases(spark, d):
    """Every document as a case."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("case_id"), F.concat(F.lit("Case "), "source").alias("title"), F.concat(F.lit("Type "), "lang").alias("project_type"),
        (F.col("n_chars") % 5 != 0).alias("enabled"), F.col("n_chars").alias("updated_at"), F.lit("").alias("tags"),
        F.col("text").alias("tender_text"), F.lit("").alias("bid_text"), F.lit("").alias("patterns"))


@query("d8_search_cases", """SELECT doc_id AS case_id, 'Case ' || source AS title FROM documents WHERE n_chars % 5 <> 0 AND lower('Type ' || lang) LIKE '%type e%'
 AND (lower('Case ' || source) LIKE '%gnu%' OR lower(text) LIKE '%gnu%') ORDER BY n_chars DESC, doc_id DESC LIMIT 5""")
def d8(spark, d):
    return CA.search_cases(doc_cases(spark, d), "GNU", "type E", 5).select("case_id", "title")


PROJECT_TYPES = {0: "type en", 1: "harbour token", 2: "harbour", 3: ""}


def case_projects(spark, d):
    kind = F.col("s_suppkey") % 4
    out = F.lit("")
    for k, v in PROJECT_TYPES.items():
        out = F.when(kind == k, v).otherwise(out)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), out.alias("project_type"))


WORDS = ["nowhere-to-be-found", "token", "GNU", "MIT"]


def case_reqs(spark, d):
    """Every sixth supplier asks for GNU."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.when(
        F.col("s_suppkey") % 6 == 0, "needs GNU").when(F.col("s_suppkey") % 6 == 2, "MIT or GNU").otherwise("plain").alias("requirement"))


@query("d9_match_cases", """WITH c AS (SELECT doc_id, n_chars, lang, text FROM documents WHERE n_chars % 5 <> 0),
 p AS (SELECT s_suppkey AS project, s_suppkey % 4 AS k, CASE s_suppkey % 6 WHEN 0 THEN 'needs GNU' WHEN 2 THEN 'MIT or GNU' ELSE 'plain' END AS r FROM supplier),
 en AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS rank FROM c WHERE lang = 'en' QUALIFY rank <= 3),
 al AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS rank FROM c QUALIFY rank <= 3),
 w AS (SELECT v.k, v.w, doc_id, row_number() OVER (PARTITION BY v.w ORDER BY n_chars DESC, doc_id DESC) AS rank FROM c, (VALUES (1, 'token'), (2, 'GNU'), (3, 'MIT'), (4, 'the')) v(k, w)
 WHERE contains(lower(text), lower(v.w)) QUALIFY rank <= 3),
 pw AS (SELECT project, 1 AS k FROM p WHERE p.k = 1 UNION ALL SELECT project, 2 FROM p WHERE p.k IN (1, 2) AND contains(r, 'GNU') UNION ALL
 SELECT project, 3 FROM p WHERE p.k IN (1, 2) AND contains(r, 'MIT') UNION ALL SELECT project, 4 FROM p WHERE p.k = 2 AND r = 'plain'),
 n AS (SELECT project, pw.k, (SELECT count(*) FROM w WHERE w.k = pw.k) AS n FROM pw),
 b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
 h AS (SELECT project, w.doc_id, min(b.k * 10 + w.rank) AS o FROM b JOIN w ON w.k = b.k WHERE before < 3 GROUP BY 1, 2)
 SELECT project, rank::INT AS rank, doc_id AS case_id FROM p, en WHERE k = 0 UNION ALL SELECT project, rank::INT, doc_id FROM p, al WHERE k = 3
 UNION ALL SELECT project, row_number() OVER (PARTITION BY project ORDER BY o)::INT AS r, doc_id FROM h QUALIFY r <= 3""")
def d9(spark, d):
    return CA.match_cases(case_projects(spark, d), doc_cases(spark, d), case_reqs(spark, d), words=WORDS, default="the")


def pattern_cases(spark, d):
    """Documents as learned cases with outline, snippets, notes and layout."""
    words = F.split("text", " ")
    outline = F.transform(words, lambda w, i: F.struct(((i % 2) + 1).alias("level"), F.concat((i + 1).cast("string"), F.lit(". "), w).alias("title")))
    snippets = F.transform(F.slice(words, 7, F.greatest(F.size(words) - 6, F.lit(0))), lambda w: F.struct(w.alias("keyword"), F.concat(w, F.lit(" lasts 25 days")).alias("text")))
    return doc_cases(spark, d).withColumn("text", F.col("tender_text")).select(
        "case_id", "title", "project_type", "enabled", "updated_at", "text", F.lit("b.docx").alias("bid_path"),
        F.when(F.size(F.split("text", " ")) > 3, outline).otherwise(F.slice(outline, 1, 0)).alias("outline"), snippets.alias("snippets"),
        strings(["note one", "note two"]).alias("style_notes"), F.when(F.col("case_id") % 2 == 0, F.col("case_id").cast("int")).alias("layout_profile_id"))


def project_assets(spark, d):
    matches = stable(CA.match_cases(case_projects(spark, d), doc_cases(spark, d), case_reqs(spark, d), words=WORDS, default="the"))
    assets = CA.case_assets(pattern_cases(spark, d), {}, X.LEXICON, X.SECTIONS, X.DEFAULT_SECTION, r"\d+ days", "【P】", wanted=matches)
    return CA.load_case_assets(matches, assets)


@query("d9_case_assets", r"""WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS ws FROM documents)
 SELECT doc_id AS case_id, asset_id, title, content FROM (
 SELECT doc_id, 'case-' || doc_id || '-wording-' || i AS asset_id, ws[6 + i] || '稳健措辞' AS title,
 json_object('keyword', ws[6 + i], 'text', ws[6 + i] || ' lasts 【P】')::VARCHAR AS content FROM w, generate_series(1, len(ws) - 6) t(i)
 UNION ALL SELECT doc_id, 'case-' || doc_id || '-style-' || i, '公司成品写作规则', CASE i WHEN 1 THEN 'note one' ELSE 'note two' END FROM w, generate_series(1, 2) t(i)
 UNION ALL SELECT doc_id, 'case-' || doc_id || '-layout', 'Case ' || (SELECT source FROM documents x WHERE x.doc_id = w.doc_id) || '版式配置', '{"layout_profile_id":' || doc_id || '}' FROM w WHERE doc_id % 2 = 0)""")
def d9_assets(spark, d):
    assets = CA.case_assets(pattern_cases(spark, d), {}, X.LEXICON, X.SECTIONS, X.DEFAULT_SECTION, r"\d+ days", "【P】")
    return assets.filter("asset_type <> 'outline'").select("case_id", "asset_id", "title", "content")


@query("d9_load_case_assets")
def d9_load(spark, d):
    return project_assets(spark, d).select("project", "case_id", "asset_id", "asset_ord", "asset_type", "title", "content", "reuse_rule")


@query("d16_outline_candidates", r"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), t AS (SELECT doc_id, i,
 trim(regexp_replace(i || '. ' || ws[i], '^\s*(?:第[一二三四五六七八九十百0-9]+章|[0-9]+(?:\.[0-9]+)*[、.．]?)\s*', '')) AS t FROM w, generate_series(1, len(ws)) g(i)
 WHERE len(ws) > 3 AND i % 2 = 1) SELECT doc_id AS case_id, string_agg(t, '|' ORDER BY i) AS titles FROM t WHERE t <> '' GROUP BY 1""")
def d16(spark, d):
    return CA.outline_candidates(pattern_cases(spark, d)).select("case_id", F.array_join("titles", "|").alias("titles"))


@query("d16_suggest_titles", r"""WITH w AS (SELECT source, doc_id, string_split(text, ' ') AS ws FROM documents), t AS (SELECT source, doc_id, i,
 trim(regexp_replace(i || '. ' || ws[i], '^\s*(?:第[一二三四五六七八九十百0-9]+章|[0-9]+(?:\.[0-9]+)*[、.．]?)\s*', '')) AS t FROM w, generate_series(1, len(ws)) g(i)
 WHERE len(ws) > 3 AND i % 2 = 1), c AS (SELECT source, doc_id, string_agg(t, '|' ORDER BY i) AS ts, count(*) AS n FROM t WHERE t <> '' GROUP BY 1, 2)
 SELECT s.source AS project, coalesce(min_by(ts, doc_id), 'Base') AS titles FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN c ON c.source = s.source AND n BETWEEN 3 AND 15 GROUP BY 1""")
def d16_suggest(spark, d):
    cases = pattern_cases(spark, d).withColumn("project", F.regexp_extract("title", "src.*$", 0)).withColumn("asset_ord", F.lit(0))
    projects = cases.select("project").distinct()
    base = projects.select("project", strings(["Base"]).alias("titles"))
    return CA.suggest_titles(projects, CA.outline_candidates(cases), base, 3).select("project", F.array_join("titles", "|").alias("titles"))


@query("d21_pick_layout", """WITH a AS (SELECT source AS project, doc_id, quality FROM documents JOIN labels USING (doc_id)),
 f AS (SELECT project, min(doc_id) AS p FROM a WHERE doc_id % 2 = 0 GROUP BY 1)
 SELECT project, p AS layout_profile_id, quality FROM f JOIN labels ON doc_id = p""")
def d21(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("project"), "doc_id")
    marks = table(spark, d, "labels")
    a = docs.join(marks, "doc_id").select(
        "project", F.col("doc_id").alias("asset_ord"), F.col("doc_id").cast("string").alias("asset_id"),
        F.lit("layout").alias("asset_type"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("layout_profile_id"))
    return CA.pick_layout(a, marks.select(F.col("doc_id").alias("layout_profile_id"), "quality"))


# --- model answers --------------------------------------------------------------------

def model_results(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    fact = F.struct(F.when(k % 11 == 0, " ").otherwise(F.col("event_type")).alias("key"), k.cast("string").alias("value"), F.lit("u").alias("unit"),
                    F.concat(F.lit("p"), (k % 12).cast("string")).alias("page"), (F.col("value") / 20).alias("confidence"))
    conflict = F.when(k > 90, F.array(F.struct(F.col("event_type").alias("field"), k.cast("string").alias("value"))))
    answer = F.to_json(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("document_summary"), F.array(fact).alias("facts"),
                                conflict.alias("conflicts")))
    return e.select(
        F.lit("all").alias("project"), F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"),
        F.concat(F.lit("f/"), F.col("user_id").cast("string")).alias("source_path"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("source_name"),
        F.col("event_id").alias("batch_no"), F.when(F.col("event_type") == "view", 100).otherwise(0).alias("page_offset"), answer.alias("answer"))


def known_facts(spark, d):
    p = table(spark, d, "customer")
    return p.select(F.lit("all").alias("project"), F.lit("click").alias("key"), (F.col("c_custkey") % 50).cast("string").alias("value"),
                    F.concat(F.lit("f/"), (F.col("c_custkey") % 40).cast("string")).alias("source_path"), (F.col("c_custkey") % 50 % 12).cast("int").alias("source_page"))


MODEL = """r AS (SELECT *, 'j' || user_id AS job_id, json_extract(props, '$.k')::INT AS k FROM events),
 m AS (SELECT *, CASE WHEN event_type = 'view' AND k % 12 <= 8 THEN k % 12 + 100 ELSE k % 12 END AS page FROM r)"""


@query("d13_model_facts", f"""WITH {MODEL}, t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id) <= 200),
 u AS (SELECT * FROM t WHERE k % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY event_type, k, user_id, page ORDER BY event_id) = 1),
 known AS (SELECT DISTINCT 'click' AS key, c_custkey % 50 AS v, c_custkey % 40 AS u, c_custkey % 50 % 12 AS p FROM customer)
 SELECT job_id, event_type AS key, k::VARCHAR AS value, 'u' AS unit, page::INT AS source_page, greatest(0, least(1, value / 20))::DOUBLE AS confidence FROM u
 WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.key = event_type AND v = k AND known.u = user_id AND p = page)""")
def d13(spark, d):
    out = VI.model_facts(VI.parse_results(model_results(spark, d)), known_facts(spark, d))
    return out.select("job_id", "key", "value", "unit", "source_page", "confidence")


@query("d13_model_conflicts", f"""WITH {MODEL} SELECT job_id, 'n' || user_id || '：' || event_type AS title, 'high' AS severity FROM m WHERE k > 90
 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id) <= 50""")
def d13_conflicts(spark, d):
    return VI.model_conflicts(VI.parse_results(model_results(spark, d))).select("job_id", "title", "severity")


@query("d13_model_summary", f"""WITH {MODEL} SELECT job_id, substr(string_agg('s' || k, '；' ORDER BY event_id), 1, 1200) AS document_summary, count(*) AS fact_count,
 bool_or(k > 90 OR value / 20 < 0.75)::INT AS needs_review FROM m GROUP BY 1""")
def d13_summary(spark, d):
    out = VI.model_summary(VI.parse_results(model_results(spark, d)))
    return out.select("job_id", "document_summary", "fact_count", F.col("needs_review").cast("int").alias("needs_review"))


@query("d14_attach_model_facts", f"""WITH {TEXT_FACTS}, f AS (SELECT DISTINCT project, key, value, unit FROM norms),
 t AS (SELECT project, unnest(CASE key WHEN 'host' THEN ['01', '02'] WHEN 'token' THEN ['01', '04'] ELSE ['03'] END) AS sc, key, value,
 key || '：' || value || unit || '（' || project || '.pdf 第' || '—' || '页）' AS item FROM f)
 SELECT project, sc AS section_code, item FROM t WHERE NOT (sc = '01' AND key = 'host')""")
def d14(spark, d):
    facts = text_facts(spark, d).select("project", "key", "value", "unit").distinct().withColumn(
        "source_path", F.concat(F.lit("x/"), "project", F.lit(".pdf"))).withColumn("source_page", F.lit(None).cast("int"))
    known = facts.filter("key = 'host'").select("project", F.lit("01").alias("section_code"), F.concat(
        "key", F.lit("："), "value", "unit", F.lit("（"), "project", F.lit(".pdf 第—页）")).alias("item"))
    return SE.attach_model_facts(chapters(spark, d), known, facts, FACT_WORDS, FACT_DEFAULT).select("project", "section_code", "item")


@query("d15_evidence_pack")
def d15(spark, d):
    s = chapters(spark, d)
    inputs = basis_inputs(spark, d)
    _, facts, stds = inputs
    full = SE.build_sections(s, basis(spark, d, inputs), SE.missing_inputs(s, evidence(spark, d), **KEYWORDS))
    cl = stds.select("project", F.col("code").alias("standard_code"), F.col("doc_id").cast("string").alias("clause_id"),
                     F.col("title").alias("text"), "affected_sections", F.col("line_no").alias("clause_no")).withColumnRenamed(
        "affected_sections", "applicable_sections")
    assets = pattern_cases(spark, d).select(
        F.regexp_extract("title", "src.*$", 0).alias("project"), F.col("case_id").cast("string").alias("asset_id"),
        F.col("case_id").alias("asset_ord"), "title", F.lit("structure_only").alias("reuse_rule"), F.lit("c").alias("content"),
        strings(["Chapter B"]).alias("applicable_sections"))
    return SE.evidence_pack(full, cl, assets, facts)


@query("d15_project_pack")
def d15_project(spark, d):
    facts, stds = fact_inputs(spark, d)
    return SE.project_pack(requirements(spark, d), facts, stds)


def proposals(spark, d):
    """Part names of a brand as a proposal; every size is one project."""
    p = table(spark, d, "part")
    rank = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    none = strings([])
    return p.select(
        F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("project"), rank.alias("ord"),
        F.concat(rank.cast("string"), F.lit(". "), "p_name").alias("title"), F.when(F.col("p_type") == "SMALL", F.lit(" own ")).otherwise("").alias("purpose"),
        none.alias("required_inputs"), F.when(F.col("p_type") == "LARGE", strings(["x", "x ", "y"])).otherwise(none).alias("components"), none.alias("acceptance"))


def templates(spark, d, projects):
    """The 25 nations as templates of every project."""
    wanted = projects.select("project").distinct().select("project", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("ord"))
    n = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("title"), F.concat(F.lit("do "), "n_name").alias("purpose"), strings(["in"]).alias("required_inputs"),
        F.when(F.col("n_nationkey") == 3, strings([])).otherwise(F.array("n_name")).alias("components"), strings(["ok"]).alias("acceptance"))
    return wanted.join(n, "ord")


SPEC = f"""p AS (SELECT p_brand || '/' || p_size AS project, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey)::INT AS ord, p_name AS title, p_type FROM part),
 s AS (SELECT DISTINCT title, n_nationkey, n_name, {_shared('title', 'n_name', '[A-Za-z0-9]')} AS s FROM p, nation),
 b AS (SELECT title, n_nationkey, n_name FROM s QUALIFY row_number() OVER (PARTITION BY title ORDER BY s DESC, n_nationkey) = 1),
 spec AS (SELECT project, ord, lpad(ord::VARCHAR, 2, '0') AS code, title, CASE WHEN p_type = 'SMALL' THEN 'own' ELSE 'do ' || n_name END AS purpose,
 CASE WHEN p_type = 'LARGE' THEN 'x|y' WHEN n_nationkey = 3 THEN '' ELSE n_name END AS components FROM p JOIN b USING (title))"""


@query("d17_apply_task_spec", f"WITH {SPEC} SELECT * FROM spec")
def d17(spark, d):
    p = proposals(spark, d)
    return SE.clean_spec(p, templates(spark, d, p)).select(
        "project", "ord", "code", "title", "purpose", F.array_join("components", "|").alias("components"))


@query("d17_spec_violations", f"""WITH {SPEC} SELECT project, 'duplicate_title' AS violation, title AS detail FROM spec GROUP BY 1, 3 HAVING count(*) > 1
 UNION ALL SELECT project, 'incomplete_chapter', title FROM spec WHERE components = ''
 UNION ALL SELECT project, 'chapter_count', count(*)::VARCHAR FROM p GROUP BY 1 HAVING count(*) > 3""")
def d17_violations(spark, d):
    p = proposals(spark, d)
    return SE.spec_violations(p, SE.clean_spec(p, templates(spark, d, p)), 3)


@query("d18_section_bodies", f"""WITH {X.REQUIREMENTS}, m AS (SELECT project, doc_id, req_no, ((req_no - 1) // 500 + 1)::INT AS part, {SECTION_SQL} AS title,
 '【待完善】响应 REQ-' || CASE WHEN req_no < 1000 THEN lpad(req_no::VARCHAR, 3, '0') ELSE req_no::VARCHAR END || ': cover it' AS line FROM reqs),
 b AS (SELECT project, title, doc_id, part, string_agg(line, chr(10) ORDER BY req_no) AS body FROM m GROUP BY 1, 2, 3, 4),
 o AS (SELECT project, t AS title FROM (SELECT DISTINCT source AS project FROM documents), (VALUES ('Chapter A'), ('Chapter C'), ('Chapter Q')) v(t))
 SELECT project, title, coalesce(doc_id, -1) AS doc_id, coalesce(part, 1) AS part, coalesce(body, '【待完善】请根据响应矩阵和历史通过案例补写本章内容。') AS body FROM o LEFT JOIN b USING (project, title)""")
def d18(spark, d):
    projects = table(spark, d, "documents").select(F.col("source").alias("project")).distinct()
    outline = projects.select("project", F.posexplode(strings(["Chapter A", "Chapter C", "Chapter Q"])).alias("ord", "title"))
    m = RQ.response_matrix(requirements(spark, d), None, {}, "cover it")
    return SE.section_bodies(outline, m).select("project", "title", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "part", "body")


@query("d19_asset_basis", """WITH s AS (SELECT c_nationkey AS code, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS b FROM customer GROUP BY 1),
 x AS (SELECT r_name AS asset, n_nationkey AS o, i, b[i] AS v FROM region JOIN nation ON n_regionkey = r_regionkey JOIN s ON s.code = n_nationkey, generate_series(1, 5) t(i) WHERE i <= len(b)),
 f AS (SELECT asset, v, min(o * 100 + i) AS o FROM x GROUP BY 1, 2) SELECT asset, string_agg(v, '|' ORDER BY o) AS project_basis FROM f GROUP BY 1""")
def d19(spark, d):
    s = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(
        F.array_sort(F.collect_set("c_mktsegment")).alias("project_basis")).withColumn("reference_basis", strings([])).withColumn("missing_inputs", strings([]))
    a = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("codes")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("asset"), "codes")
    return SE.asset_basis(s, a).select("asset", F.array_join("project_basis", "|").alias("project_basis"))


@query("f7_case_summary", """SELECT doc_id AS case_id, CASE WHEN len(string_split(text, ' ')) > 3 THEN len(string_split(text, ' ')) ELSE 0 END::INT AS outline_count,
 greatest(len(string_split(text, ' ')) - 6, 0)::INT AS snippet_count, 2 AS style_note_count FROM documents""")
def f7(spark, d):
    c = pattern_cases(spark, d).withColumn("pattern_outline", F.lit(None).cast("array<string>")).withColumn("scene_terms", strings([]))
    return CA.case_summary(c).select("case_id", "outline_count", "snippet_count", "style_note_count")


def messy_cases(spark, d):
    lines = F.split("text", "\n")
    outline = F.transform(lines, lambda x, i: F.struct((F.length(x) % 9 - 1).alias("level"), F.concat(F.lit(" "), x).alias("title")))
    snippets = F.transform(lines, lambda x: F.struct(F.when(F.length(x) % 2 == 0, F.lit("")).otherwise(F.lit(" k ")).alias("keyword"), x.alias("text")))
    return table(spark, d, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), F.when(F.col("role") == "system", F.slice(outline, 1, 0)).otherwise(outline).alias("outline"),
        snippets.alias("snippets"), F.when(F.col("role") == "user", "confirmed").when(F.col("turn") == 1, "odd").otherwise("pending_review").alias("review_status"))


MESSY = r"""c AS (SELECT conv_id || '-' || turn AS case_id, role, turn, string_split(text, chr(10)) AS l FROM conversations),
 o AS (SELECT case_id, i, greatest(1, least(6, CASE WHEN length(l[i]) % 9 - 1 = 0 THEN 1 ELSE length(l[i]) % 9 - 1 END)) AS level, trim(' ' || l[i]) AS t FROM c, generate_series(1, len(l)) g(i) WHERE role <> 'system'),
 oo AS (SELECT case_id, string_agg(level || ':' || i || ':' || t, '|' ORDER BY i) AS outline FROM o WHERE t <> '' GROUP BY 1),
 bad AS (SELECT c.case_id, 'empty_outline' AS violation FROM c LEFT JOIN oo USING (case_id) WHERE outline IS NULL UNION ALL SELECT case_id, 'review_status' FROM c WHERE role <> 'user' AND turn = 1)"""


@query("f8_normalize_case", f"""WITH {MESSY} SELECT case_id, outline FROM oo WHERE case_id NOT IN (SELECT case_id FROM bad)""")
def f8(spark, d):
    good, _ = CA.normalize_cases(messy_cases(spark, d))
    text = F.transform("outline", lambda o: F.concat_ws(":", o["level"].cast("string"), o["ord"].cast("string"), o["title"]))
    return good.select("case_id", F.array_join(text, "|").alias("outline"))


@query("f8_case_violations", f"WITH {MESSY} SELECT * FROM bad")
def f8_bad(spark, d):
    _, bad = CA.normalize_cases(messy_cases(spark, d))
    return bad
