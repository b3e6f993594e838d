"""Files as rows: scan, text decoding, worksheets and web pages as located blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceframe import config
from traceframe.functions.text import file_name, file_suffix, strings


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix.lstrip("."))


def scan_files(spark: SparkSession, root: str, suffixes=config.DOCUMENT_SUFFIXES, ignored=config.IGNORED_DIRS) -> DataFrame:
    """All document files under ``root`` with size and SHA-256. Unwanted suffixes are
    dropped while listing, before any content is read."""
    glob = "*.{" + ",".join(_any_case(s) for s in suffixes) + "}"
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    )
    return describe_files(raw, suffixes, ignored)


def describe_files(raw: DataFrame, suffixes=config.DOCUMENT_SUFFIXES, ignored=config.IGNORED_DIRS) -> DataFrame:
    """File records from ``path, length, content``."""
    parts = F.split("path", "/")
    return raw.filter(file_suffix("path").isin(list(suffixes)) & ~F.arrays_overlap(parts, strings(ignored))).select(
        "path", file_name("path").alias("name"), file_suffix("path").alias("suffix"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"))


def decode_text(content: Column, charset: str | None = None) -> Column:
    """UTF-8 with or without byte order mark, then ``charset``, then UTF-8 without the
    bytes that do not fit."""
    text = content.cast("string")
    lossy = F.regexp_replace(F.make_valid_utf8(text), "�", "")
    if charset:
        other = F.decode(content, charset)
        lossy = F.when(other.contains("�"), lossy).otherwise(other)
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(lossy)
    return F.regexp_replace(decoded, "^﻿", "")


def read_text_blocks(spark: SparkSession, path: str, suffixes=config.TEXT_SUFFIXES) -> DataFrame:
    """One block per text file. Chinese legacy files need ``spark.sql.legacy.javaCharsets``
    and ``spark.sql.legacy.codingErrorAction``, which let Spark decode GB18030 and go on
    after bytes that do not fit."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    needed = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    charset = "GB18030" if all(spark.conf.get(n, "false") == "true" for n in needed) else None
    return text_blocks(raw.filter(file_suffix("path").isin(list(suffixes))), charset)


def text_blocks(raw: DataFrame, charset: str | None = None) -> DataFrame:
    return raw.select("path", F.lit(0).alias("block_ord"), F.lit(None).cast("int").alias("page"),
                      decode_text(F.col("content"), charset).alias("text"))


def tabular_blocks(rows: DataFrame, columns: list[str], sheet: str, row_no: str, max_rows: int | None = None,
                   separator: str = " | ") -> DataFrame:
    """Worksheet rows as blocks. ``row_no`` is the 1-based row in its sheet and comes with
    the source; empty cells and empty rows are left out."""
    cells = F.array(*[F.trim(F.col(c).cast("string")) for c in columns])
    text = F.array_join(F.filter(cells, lambda x: x.isNotNull() & (x != "")), separator)
    kept = rows if max_rows is None else rows.filter(F.col(row_no) <= max_rows)
    return kept.select(
        *[c for c in ("project", "doc_id", "path") if c in rows.columns], F.col(sheet).alias("sheet"),
        F.concat(F.lit("A"), F.col(row_no).cast("string")).alias("cell"), F.col(row_no).alias("block_ord"),
        F.lit(None).cast("int").alias("page"), text.alias("text"),
    ).filter("text <> ''")


def page_blocks(pages: DataFrame, keys: list[str], html: str = "html", max_blocks: int | None = None) -> DataFrame:
    """Headings, paragraphs, list items and table rows of a web page as blocks, without
    scripts, styles and comments. The cells of a table row are joined by a pipe."""
    clean = F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    pattern = r"(?is)<(?:h[1-6]|p|li|tr)\b[^>]*>(.*?)(?=</(?:h[1-6]|p|li|tr)>|<(?:h[1-6]|p|li|tr)\b|\z)"
    found = F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))
    if max_blocks is not None:
        found = F.slice(found, 1, max_blocks)
    exploded = pages.select(*keys, F.posexplode(found).alias("_i", "_t"))
    text = F.regexp_replace("_t", r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>", " | ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return exploded.select(*keys, F.col("_i").alias("block_ord"), (F.col("_i") + 1).alias("page"), F.trim(text).alias("text"))
