"""Tables, line kinds, headings and claims in Markdown texts.

Input: ``doc_id, text`` and further key columns; one text is one cell, so windows over a
text's lines are bounded by that cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceframe import config
from traceframe.functions.text import LINE_BREAK, chinese_number, col, find_all, strip_heading_number


_BLANK = r"[^\S\n]*"
_ROW = rf"{_BLANK}\|[^\n]*\|{_BLANK}(?=\n|\z)"
_SEPARATOR = rf"{_BLANK}\|+{_BLANK}:?-{{3,}}:?{_BLANK}(?:\|{_BLANK}:?-{{3,}}:?{_BLANK})*\|+{_BLANK}(?=\n|\z)"
# A pipe row before a separator starts a table, which takes all pipe rows that follow.
TABLE = rf"(?md)^{_ROW}\n{_SEPARATOR}(?:\n{_ROW})*+"
# The grammar of audits: two dashes make a separator, and a row may lack its closing pipe.
_OPEN_ROW = rf"{_BLANK}\|[^\n]*(?=\n|\z)"
_OPEN_SEPARATOR = rf"{_BLANK}\|{_BLANK}:?-{{2,}}:?{_BLANK}(?:\|{_BLANK}:?-{{2,}}:?{_BLANK})*\|?{_BLANK}(?=\n|\z)"
OPEN_TABLE = rf"(?md)^{_OPEN_ROW}\n{_OPEN_SEPARATOR}(?:\n{_OPEN_ROW})*+"


def unix_lines(text) -> Column:
    return F.regexp_replace(col(text), LINE_BREAK, "\n")


def pipe_cells(line) -> Column:
    """Cells of a table row."""
    inner = F.btrim(F.trim(col(line)), F.lit("|"))
    return F.transform(F.split(inner, r"\|", -1), lambda x: F.trim(x))


def markdown_tables(texts: DataFrame, keys: list[str], text: str = "text", audit: bool = False) -> DataFrame:
    """Cells of all tables: table, row (0 is the header), column, text. Short rows are
    padded to the table's width. Rows of a text are taken apart in place, without a shuffle.

    ``audit`` takes the wider grammar of audits and adds ``header``, the cell at the head of the column."""
    found = F.regexp_extract_all(unix_lines(text), F.lit(OPEN_TABLE if audit else TABLE), F.lit(0))
    tables = texts.filter(F.col(text).contains("|")).select(*keys, F.posexplode(found).alias("_t", "_table"))
    rows = F.transform(F.filter(F.split("_table", "\n"), lambda r: ~r.rlike(rf"^{_OPEN_SEPARATOR if audit else _SEPARATOR}")), pipe_cells)
    tables = tables.select(*keys, (F.col("_t") + 1).alias("table_no"), rows.alias("_rows"))
    width = F.array_max(F.transform("_rows", lambda r: F.size(r)))
    rows = tables.select(*keys, "table_no", width.alias("_w"), F.get("_rows", F.lit(0)).alias("_head"), F.posexplode("_rows").alias("row_no", "_cells"))
    padded = F.concat("_cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("_cells")))
    cells = rows.select(*keys, "table_no", "row_no", "_head", F.posexplode(padded).alias("col_no", "cell"))
    header = [F.coalesce(F.get("_head", F.col("col_no")), F.lit("")).alias("header")] if audit else []
    return cells.select(*keys, "table_no", "row_no", "col_no", "cell", *header)


def line_kind(line) -> Column:
    line = col(line)
    return (
        F.when(line == "", "blank")
        .when(line.rlike(r"^!\[[^\]]*\]\([^)]+\)$"), "image")
        .when(line.rlike(r"^#{1,4}\s+\S"), "heading")
        .when(line.rlike(r"^第[一二三四五六七八九十百\d]+[章节][、\s：:]"), "heading")
        .when(line.rlike(r"^[一二三四五六七八九十]+[、.．]"), "heading")
        .when(line.rlike(r"^[-*]\s+") | line.rlike(r"^\d+[.)、]\s+\S"), "list")
        .otherwise("paragraph")
    )


def markdown_heading_level(line) -> Column:
    line = col(line)
    return (
        F.when(line.rlike(r"^#{1,4}\s+\S"), F.length(F.regexp_extract(line, "^(#{1,4})", 1)))
        .when(line.rlike(r"^第[一二三四五六七八九十百\d]+章[、\s：:]"), 1)
        .when(line.rlike(r"^第[一二三四五六七八九十百\d]+节[、\s：:]"), 2)
        .when(line.rlike(r"^[一二三四五六七八九十]+[、.．]"), 3)
    )


def markdown_stats(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Headings, tables, lists, paragraphs and images per text."""
    parts = texts.select(*keys, unix_lines(text).alias("_t")).select(
        *keys, F.regexp_count("_t", F.lit(TABLE)).alias("tables"),
        F.transform(F.split(F.regexp_replace("_t", TABLE, ""), "\n"), lambda x: line_kind(F.trim(x))).alias("_kinds"))
    count = lambda k: F.size(F.filter("_kinds", lambda x: x == k))
    return parts.select(*keys, count("heading").alias("headings"), "tables", count("list").alias("lists"),
                        count("paragraph").alias("paragraphs"), count("image").alias("images"))


def number_headings(headings: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Chapter numbering: a heading's counter restarts when a shallower one has come.
    Input is one document's headings per key: ``level, title`` in ``order``."""
    level = F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(4))
    w = Window.partitionBy(*keys).orderBy(order)
    rows = headings.withColumn("_l", level)
    for n in (2, 3, 4):
        rows = rows.withColumn(f"_r{n}", F.sum((F.col("_l") < n).cast("int")).over(w))
    restart = F.when(F.col("_l") == 1, 0).when(F.col("_l") == 2, F.col("_r2")).when(F.col("_l") == 3, F.col("_r3")).otherwise(
        F.col("_r4"))
    rows = rows.withColumn("_restart", restart)
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy(*keys, "_l", "_restart").orderBy(order)))
    bare = strip_heading_number("title")
    numeral = chinese_number("number")
    text = (
        F.when(F.col("_l") == 1, F.concat(F.lit("第"), numeral, F.lit("章 "), bare))
        .when(F.col("_l") == 2, F.concat(F.lit("第"), numeral, F.lit("节 "), bare))
        .when(F.col("_l") == 3, F.concat(numeral, F.lit("、"), bare))
        .otherwise(F.concat(F.col("number").cast("string"), F.lit("、"), bare))
    )
    return rows.select(*headings.columns, "number", text.alias("numbered_title"))


def extract_claims(texts: DataFrame, keys: list[str], text: str = "text", quantity: str = config.QUANTITY,
                   citation: str = config.CLAUSE_CITATION) -> DataFrame:
    """Quantities and clause citations with their place in the text."""
    with_kind = lambda pattern, kind: F.transform(
        find_all(text, pattern), lambda h: F.struct(F.lit(kind).alias("kind"), h["start"].alias("start"), h["full"].alias("token")))
    hits = F.concat(with_kind(quantity, "quantity"), with_kind(citation, "citation"))
    some = col(text).rlike(quantity) | col(text).rlike(citation)
    return texts.filter(some).select(*keys, F.explode(hits).alias("h")).select(
        *keys, "h.kind", "h.start", (F.col("h.start") + F.length("h.token")).alias("end"), "h.token")
