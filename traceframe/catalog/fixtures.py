"""Views of the given tables in the library's shapes, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from traceframe.catalog.registry import table

LEXICON = {
    "english": ["the ", " and ", "with"],
    "spanish": ["que ", " los"],
    "german": ["und ", " der ", "icht"],
    "licence": ["icens", "GNU", "Version"],
    "secret": ["token", "@"],
}
MARKERS = ["http", "$$$"]
SECTIONS = {"english": "Chapter A", "spanish": "Chapter B", "german": "Chapter B", "licence": "Chapter C"}
DEFAULT_SECTION = "Chapter Z"
STRATEGIES = {"english": "answer in english", "licence": "quote the licence"}


def text_blocks(spark, d) -> DataFrame:
    """One block per document; the source is the project."""
    return table(spark, d, "documents").select(
        F.col("source").alias("project"), "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit(0).alias("block_ord"), F.lit(None).cast("int").alias("page"), "text",
    )


def turn_blocks(spark, d) -> DataFrame:
    """A conversation as a document with one page per turn; one project holds all."""
    return table(spark, d, "conversations").select(
        F.lit("chat").alias("project"), F.col("conv_id").alias("doc_id"),
        F.concat(F.lit("chat/"), F.col("conv_id").cast("string")).alias("path"),
        F.col("turn").cast("int").alias("block_ord"), (F.col("turn") + 1).cast("int").alias("page"), "text", "role",
    )


def order_blocks(spark, d) -> DataFrame:
    """A customer's orders as pages of a document with values and references."""
    o = table(spark, d, "orders")
    page = (F.col("o_orderkey") % 9 + 1).cast("int")
    target = (F.col("o_orderkey") % 7 + 1).cast("string")
    digit = F.substring("o_orderpriority", 1, 1)
    days = (F.floor(F.col("o_totalprice") / 100000) + 1).cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "P", F.concat(
            F.lit("总工期：详见第"), target, F.lit("页附表"), digit, F.lit("\n工期要求详见附表"), digit))
        .when(F.col("o_orderstatus") == "F", F.concat(
            F.lit("计划总工期："), days, F.lit("日历天\n附表"), digit, F.lit(" 工期 安排必须满足\n见第"), target, F.lit("页")))
        .otherwise(F.concat(
            F.lit("项目名称：《河道"), digit, F.lit("》\n质量标准：合格"),
            F.when(digit == "1", "").otherwise("并且满足合同全部条款约定"), F.lit("（详见第"), target, F.lit("页）\n附表"), digit)))
    return o.select(
        F.col("o_orderpriority").alias("project"), F.col("o_custkey").alias("doc_id"),
        F.concat(F.lit("c/"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("path"),
        F.col("o_orderkey").cast("int").alias("block_ord"), page.alias("page"), text.alias("text"),
    ).withColumn("project", F.lit("tender"))


RAW = """raw AS (SELECT source AS project, doc_id, unnest(string_split(text, chr(10))) AS raw,
 generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents)"""
LINES = RAW + r""", lines AS (SELECT * FROM (SELECT project, doc_id, line_no,
 trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM raw) WHERE length(line) >= 4)"""
TURN_LINES = r"""raw AS (SELECT 'chat' AS project, conv_id AS doc_id, turn::INT AS block_ord, (turn + 1)::INT AS page, role,
 unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no
 FROM conversations),
 lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_ord, line_no)::INT AS run_no FROM (
 SELECT * EXCLUDE (raw), trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM raw) WHERE length(line) >= 4)"""
ORDER_BLOCKS = """blocks AS (SELECT o_custkey AS doc_id, o_orderkey::INT AS block_ord, (o_orderkey % 9 + 1)::INT AS page,
 'c/' || o_custkey || '.pdf' AS path,
 CASE o_orderstatus
 WHEN 'P' THEN '总工期：详见第' || (o_orderkey % 7 + 1) || '页附表' || substr(o_orderpriority, 1, 1) || chr(10) || '工期要求详见附表' || substr(o_orderpriority, 1, 1)
 WHEN 'F' THEN '计划总工期：' || (floor(o_totalprice / 100000) + 1)::BIGINT || '日历天' || chr(10) || '附表' || substr(o_orderpriority, 1, 1) || ' 工期 安排必须满足' || chr(10) || '见第' || (o_orderkey % 7 + 1) || '页'
 ELSE '项目名称：《河道' || substr(o_orderpriority, 1, 1) || '》' || chr(10) || '质量标准：合格' || CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE '并且满足合同全部条款约定' END || '（详见第' || (o_orderkey % 7 + 1) || '页）' || chr(10) || '附表' || substr(o_orderpriority, 1, 1)
 END AS text FROM orders)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {sql_text(w)})" for w in words) + ")"


def sql_map(expr: str, mapping, default: str) -> str:
    whens = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def sql_category(expr: str, lexicon) -> str:
    """First category with the largest number of contained words."""
    scores = {c: " + ".join(f"contains({expr}, {sql_text(w)})::INT" for w in ws) for c, ws in lexicon.items()}
    best = "greatest(" + ", ".join(f"({s})" for s in scores.values()) + ")"
    whens = " ".join(f"WHEN ({s}) = {best} THEN {sql_text(c)}" for c, s in scores.items())
    return f"CASE WHEN {best} = 0 THEN 'general' {whens} END"


def sql_compact(expr: str, limit: int | None) -> str:
    c = f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"
    if limit is None:
        return c
    return f"CASE WHEN length({c}) <= {limit} THEN {c} ELSE rtrim(substr({c}, 1, {limit - 1})) || '…' END"


ALL_WORDS = [w for ws in LEXICON.values() for w in ws] + MARKERS
REQUIREMENTS = LINES + f""", cand AS (SELECT *, {sql_category('line', LEXICON)} AS category,
 row_number() OVER (PARTITION BY project, doc_id, line ORDER BY line_no) AS rn
 FROM lines WHERE {sql_any('line', ALL_WORDS)}),
 reqs AS (SELECT project, doc_id, category, line_no, line, line AS requirement,
 row_number() OVER (PARTITION BY project, doc_id ORDER BY line_no) AS req_no FROM cand WHERE rn = 1)"""
