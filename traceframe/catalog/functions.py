"""Queries over the column functions (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.catalog.fixtures import ORDER_BLOCKS, order_blocks, sql_compact, text_blocks, LINES
from traceframe.catalog.registry import query, table
from traceframe.functions import references as R, text as X
from traceframe.operators.lines import meaningful_lines

IP = r"\d+\.\d+\.\d+\.\d+"
TITLES = """titles AS (SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN '第三章 ' || p_name WHEN 'SMALL' THEN '2.1 ' || p_name
 WHEN 'MEDIUM' THEN '四、' || p_name WHEN 'LARGE' THEN p_size || '. ' || p_name WHEN 'PROMO' THEN '1.2.3.4.5 ' || p_name
 ELSE p_name END AS title FROM part)"""


def titles(spark, d):
    name = F.col("p_name")
    kind = F.col("p_type")
    title = (
        F.when(kind == "STANDARD", F.concat(F.lit("第三章 "), name))
        .when(kind == "SMALL", F.concat(F.lit("2.1 "), name))
        .when(kind == "MEDIUM", F.concat(F.lit("四、"), name))
        .when(kind == "LARGE", F.concat(F.col("p_size").cast("string"), F.lit(". "), name))
        .when(kind == "PROMO", F.concat(F.lit("1.2.3.4.5 "), name))
        .otherwise(name)
    )
    return table(spark, d, "part").select("p_partkey", title.alias("title"))


@query("b1_compact_text", f"SELECT doc_id, {sql_compact('text', 80)} AS brief FROM documents")
def b1(spark, d):
    return table(spark, d, "documents").select("doc_id", X.compact_text("text", 80).alias("brief"))


@query("b2_meaningful_lines", f"WITH {LINES} SELECT project, doc_id, line_no, line FROM lines")
def b2(spark, d):
    return meaningful_lines(text_blocks(spark, d)).select("project", "doc_id", "line_no", "line")


# One line per order page; the reference forms that occur there.
ORDER_LINES = ORDER_BLOCKS + r""", ol AS (SELECT doc_id, block_ord, unnest(string_split(text, chr(10))) AS raw,
 generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM blocks),
 lines AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM ol),
 refs AS (SELECT *, regexp_extract(line, '(?:详见|参见|见|按|按照|以).{0,16}') AS mk,
 regexp_extract(line, '第\s*(\d{1,4})\s*页', 1) AS pg,
 regexp_replace(regexp_extract(line, '附表\s*[一二三四五六七八九十百\dA-Za-z.—-]*'), '\s+', '', 'g') AS tb FROM lines)"""


def order_lines(spark, d):
    from traceframe.operators.lines import raw_lines

    return raw_lines(order_blocks(spark, d)).select("doc_id", "block_ord", "line_no", "line")


@query("b3_parse_reference", f"""WITH {ORDER_LINES} SELECT doc_id, block_ord, line_no, coalesce(nullif(pg, '')::INT, -1) AS target_page,
 tb AS target_table, line AS reference_text, trim(mk) AS marker FROM refs WHERE mk <> '' AND (pg <> '' OR tb <> '')""")
def b3(spark, d):
    ref = order_lines(spark, d).withColumn("r", R.parse_reference("line")).filter("r is not null")
    return ref.select("doc_id", "block_ord", "line_no", F.coalesce("r.target_page", F.lit(-1)).alias("target_page"),
                      "r.target_table", "r.reference_text", "r.marker")


PUNCT = " ：:；;，,。"


@query("b4_is_reference_only", f"""WITH {ORDER_LINES}, v AS (SELECT *, trim(line, '{PUNCT}') AS c FROM refs)
 SELECT doc_id, block_ord, line_no, (mk <> '' AND (pg <> '' OR tb <> '')
 AND length(trim(regexp_replace(c, '(详见|参见|见|按|按照|以).*$', ''), '{PUNCT}')) <= 12)::INT AS only_reference FROM v""")
def b4(spark, d):
    return order_lines(spark, d).select("doc_id", "block_ord", "line_no",
                                        R.is_reference_only("line").cast("int").alias("only_reference"))


@query("b5_strip_reference_tail", f"""WITH {ORDER_LINES} SELECT doc_id, block_ord, line_no, trim(regexp_replace(line,
 '[（(]?\\s*(?:详见|参见|见|按|按照).{{0,100}}?(?:第\\s*\\d{{1,4}}\\s*页|附表|表\\s*\\d).*?[）)]?\\s*$', ''), '{PUNCT}') AS value
 FROM refs""")
def b5(spark, d):
    return order_lines(spark, d).select("doc_id", "block_ord", "line_no", R.strip_reference_tail("line").alias("value"))


@query("b6_normalize_fact_value", r"""SELECT doc_id, lower(replace(regexp_replace(regexp_replace(
 text, '[《》〈〉“”"''`]', '', 'g'), '[\s:：,，。；;、_—–-]+', '', 'g'), 'ß', 'ss')) || 'kg' AS norm FROM documents""")
def b6(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", R.normalize_fact_value(F.lit("k"), F.col("text"), F.lit(" k g")).alias("norm"))


@query("b7_safe_int", r"""SELECT event_id, coalesce(try_cast(trim(json_extract_string(props, '$.k')) AS BIGINT), -1) AS strict_k,
 coalesce(try_cast(nullif(regexp_extract(props, '\d+'), '') AS BIGINT), -1) AS first_k,
 coalesce(try_cast(CASE event_type WHEN 'click' THEN ' 42 ' ELSE event_type END AS BIGINT), -1) AS strict_type FROM events""")
def b7(spark, d):
    e = table(spark, d, "events")
    none = F.lit(-1).cast("bigint")
    kind = F.when(F.col("event_type") == "click", F.lit(" 42 ")).otherwise(F.col("event_type"))
    return e.select(
        "event_id", F.coalesce(X.safe_int(F.get_json_object("props", "$.k")), none).alias("strict_k"),
        F.coalesce(X.safe_int("props", "first"), none).alias("first_k"),
        F.coalesce(X.safe_int(kind), none).alias("strict_type"))


@query("b8_canonical_title", """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'COMPACT' WHEN 'PROMO' THEN 'OFFER'
 ELSE p_type END AS title FROM part""")
def b8(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", X.canonical_title("p_type", {"SMALL": "COMPACT", "PROMO": "OFFER"}).alias("title"))


@query("b9_clean_title", f"""WITH {TITLES} SELECT p_partkey,
 substr(trim(regexp_replace(title, '^\\s*(?:第[一二三四五六七八九十百0-9]+章|[0-9]+(?:\\.[0-9]+)*[、.．]?)\\s*', '')), 1, 120) AS cleaned,
 CASE WHEN title LIKE '第%章 %' THEN trim(substr(title, 5)) WHEN title LIKE '四、%' THEN trim(substr(title, 3))
 ELSE trim(regexp_replace(title, '^\\d+(?:\\.\\d+)*(?:[.)、．]|\\s+)', '')) END AS bare FROM titles""")
def b9(spark, d):
    return titles(spark, d).select(
        "p_partkey", X.clean_title("title").alias("cleaned"), X.strip_heading_number("title").alias("bare"))


@query("b10_ordered_distinct", r"""WITH w AS (SELECT conv_id, turn, trim(unnest(string_split(text, ' '))) AS w,
 generate_subscripts(string_split(text, ' '), 1) AS o FROM conversations),
 f AS (SELECT conv_id, turn, w, min(o) AS o FROM w WHERE w <> '' GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS r FROM f)
 SELECT conv_id, turn, string_agg(substr(w, 1, 6), '|' ORDER BY o) AS words FROM r WHERE r <= 10 GROUP BY 1, 2""")
def b10(spark, d):
    c = table(spark, d, "conversations")
    out = c.select("conv_id", "turn", F.array_join(X.ordered_distinct(F.split("text", " "), 6, 10), "|").alias("words"))
    return out.filter(F.col("words") != "")


@query("b11_heading_level", f"""WITH {TITLES} SELECT p_partkey, CASE WHEN title LIKE '第%' THEN 1
 WHEN regexp_matches(title, '^\\s*\\d') THEN least(length(regexp_replace(regexp_extract(title, '^\\s*(\\d+(?:[.．]\\d+)*)', 1), '\\d', '', 'g')) + 1, 4)
 WHEN title LIKE '四、%' THEN 1 ELSE 2 END::INT AS level FROM titles""")
def b11(spark, d):
    return titles(spark, d).select("p_partkey", X.heading_level("title").alias("level"))


_DIGITS = "list_value('一','二','三','四','五','六','七','八','九')"


@query("b12_chinese_number", f"""WITH n AS (SELECT c_custkey, (c_acctbal / 80)::BIGINT AS n FROM customer)
 SELECT c_custkey, n, CASE WHEN n <= 0 OR n > 99 THEN n::VARCHAR WHEN n < 10 THEN {_DIGITS}[n]
 ELSE CASE WHEN n < 20 THEN '' ELSE {_DIGITS}[n // 10] END || '十' || CASE WHEN n % 10 = 0 THEN '' ELSE {_DIGITS}[n % 10] END
 END AS numeral FROM n""")
def b12(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.bround(F.col("c_acctbal") / 80).cast("bigint").alias("n"))
    return c.select("c_custkey", "n", X.chinese_number("n").alias("numeral"))


@query("b13_normalized_stem", r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(
 regexp_extract(url, '[^/]*$'), '(.)\.[^.]+$', '\1')), '(cad|pdf|dwg|图纸)', '', 'g'), '[^0-9a-z一-鿿]+', '', 'g') AS stem FROM pages""")
def b13(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalized_stem("url").alias("stem"))


@query("b14_mask_parameters", r"""SELECT doc_id, regexp_replace(text, '\d+\.\d+\.\d+\.\d+|\d+%', '【P】', 'g') AS masked
 FROM documents""")
def b14(spark, d):
    return table(spark, d, "documents").select("doc_id", X.mask_parameters("text", IP + r"|\d+%", "【P】").alias("masked"))


BRANDS = [("BRAND#1", "alpha", "a.example"), ("BRAND#2", "beta", "b.example"), ("", "other", "o.example")]


@query("b15_official_source", """SELECT p_partkey, CASE WHEN upper(p_brand) LIKE 'BRAND#1%' THEN 'alpha'
 WHEN upper(p_brand) LIKE 'BRAND#2%' THEN 'beta' ELSE 'other' END AS platform,
 CASE WHEN upper(p_brand) LIKE 'BRAND#1%' THEN 'a.example' WHEN upper(p_brand) LIKE 'BRAND#2%' THEN 'b.example'
 ELSE 'o.example' END AS url FROM part""")
def b15(spark, d):
    return table(spark, d, "part").select("p_partkey", X.official_source("p_brand", BRANDS).alias("s")).select(
        "p_partkey", "s.platform", "s.url")


@query("b16_host_allowed", r"""SELECT page_id, regexp_matches(lower(url), '^[a-z]+://([^/?#]*\.)?(example\.net|m\.example\.org)([:/?#]|$)')::INT
 AS allowed FROM pages""")
def b16(spark, d):
    return table(spark, d, "pages").select(
        "page_id", X.host_allowed("url", ["example.net", "m.example.org"]).cast("int").alias("allowed"))


KINDS = [(["SMALL"], "table"), (["E", "M"], "flowchart"), (["A"], "attachment")]


@query("b17_component_kind", """SELECT p_partkey, CASE WHEN contains(p_type, 'SMALL') THEN 'table'
 WHEN contains(p_type, 'E') AND contains(p_type, 'M') THEN 'flowchart' WHEN contains(p_type, 'A') THEN 'attachment'
 ELSE 'text' END AS kind FROM part""")
def b17(spark, d):
    return table(spark, d, "part").select("p_partkey", X.component_kind("p_type", KINDS).alias("kind"))


@query("b18_match_excerpt", r"""WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '\d+\.\d+\.\d+\.\d+')) AS hit,
 generate_subscripts(regexp_extract_all(text, '\d+\.\d+\.\d+\.\d+'), 1) AS n FROM documents),
 p AS (SELECT doc_id, length(unnest(string_split_regex(text, '\d+\.\d+\.\d+\.\d+'))) AS gap,
 generate_subscripts(string_split_regex(text, '\d+\.\d+\.\d+\.\d+'), 1) AS n FROM documents),
 s AS (SELECT m.doc_id, m.n, m.text, m.hit, sum(gap + length(hit)) OVER (PARTITION BY m.doc_id ORDER BY m.n) - length(hit) AS st
 FROM m JOIN p ON m.doc_id = p.doc_id AND m.n = p.n),
 e AS (SELECT doc_id, n, hit, st, substr(text, greatest(st - 80, 0)::BIGINT + 1, (st + length(hit) + 140 - greatest(st - 80, 0))::BIGINT) AS x FROM s)
 SELECT doc_id, n::INT AS match_no, hit, st::INT AS start, """ + sql_compact("x", 320) + " AS excerpt FROM e")
def b18(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").rlike(IP))
    hits = docs.select("doc_id", "text", F.posexplode(X.find_all("text", IP)).alias("n", "h"))
    return hits.select(
        "doc_id", (F.col("n") + 1).alias("match_no"), F.col("h.full").alias("hit"), "h.start",
        X.match_excerpt("text", F.col("h.start"), F.col("h.start") + F.length("h.full")).alias("excerpt"))


@query("b19_parse_json_answer", """SELECT event_id, CASE event_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'extracted'
 WHEN 'error' THEN 'extracted' ELSE 'ok' END AS parse_status, CASE event_type WHEN 'click' THEN -1
 ELSE json_extract(props, '$.k')::INT END AS k FROM events""")
def b19(spark, d):
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", F.lit("no {json here"))
        .when(kind == "view", F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done")))
        .when(kind == "error", F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .otherwise(F.col("props"))
    )
    p = table(spark, d, "events").select("event_id", X.parse_json_answer(answer, "k INT").alias("p"))
    return p.select("event_id", "p.parse_status", F.coalesce("p.value.k", F.lit(-1)).alias("k"))
