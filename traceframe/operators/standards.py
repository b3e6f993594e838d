"""Standards cited in documents, their clauses, and the check of an attached original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceframe import config
from traceframe.functions.text import col, collapse, compact_text, contains_any, official_source, remove_space, split_lines, strings
from traceframe.operators.keyed import in_order, number_rows, salted_lookup, top_n, unfold
from traceframe.operators.lines import DOC, block_chunk, raw_lines


def extract_standards(blocks: DataFrame, words=config.STANDARD_WORDS, pattern: str = config.STANDARD_CODE,
                      sources=config.OFFICIAL_SOURCES) -> DataFrame:
    """First mention of every standard code per document, from lines with one of ``words``."""
    codes = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
    hits = (
        raw_lines(blocks).filter(contains_any("line", words) & F.col("line").rlike(pattern))
        .select(*DOC, "path", "block_ord", "page", "line_no", "line", F.posexplode(codes).alias("match_ord", "raw"))
        .withColumn("code", F.trim(F.regexp_replace(F.upper("raw"), r"(?U)\s+", " ")))
    )
    first = top_n(hits, [*DOC, "code"], ["block_ord", "line_no", "match_ord"])
    book = F.trim(F.regexp_extract("line", config.BOOK_TITLE, 1))
    return (
        first.withColumn("title", F.when(F.col("line").rlike(config.BOOK_TITLE), book).otherwise(compact_text("line", 100)))
        .withColumn("_s", official_source("code", sources))
        .select(
            *DOC, "path", "block_ord", "line_no", "match_ord", "code", "title",
            F.regexp_extract("code", r"[-—–](\d{4})$", 1).alias("version"), F.col("page").alias("source_page"),
            F.col("_s.platform").alias("official_platform"), F.col("_s.url").alias("official_url"),
            F.concat_ws(" ", "code", "title", F.lit("官方 PDF")).alias("search_query"),
            F.lit("pending_download").alias("status"),
        )
    )


def map_standard_sections(standards: DataFrame, sections: DataFrame, rules=config.STANDARD_SECTION_RULES,
                          per_rule: int = 2) -> DataFrame:
    """Chapters a standard affects: each rule whose words occur in code or title adds the
    first chapters with one of its title words; the first chapter if no rule adds any.
    ``sections`` is ``project, ord, title``."""
    titles = sections.groupBy("project").agg(in_order(F.col("title"), F.col("ord")).alias("_titles"))
    picked = [_first_with("_titles", words, per_rule) for _, words in rules]
    row = titles.select("project", *[p.alias(f"_r{i}") for i, p in enumerate(picked)],
                        F.slice("_titles", 1, 1).alias("_first"))
    blob = F.concat_ws(" ", "code", "title")
    joined = salted_lookup(standards, row, ["project"])
    none = strings([])
    hits = [F.when(contains_any(blob, words), F.col(f"_r{i}")).otherwise(none) for i, (words, _) in enumerate(rules)]
    all_ = F.array_distinct(F.concat(*hits))
    return joined.withColumn("_all", all_).select(
        *standards.columns,
        F.coalesce(F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.col("_first")), none).alias("affected_sections"))


def _first_with(titles: str, words, n: int) -> Column:
    return F.slice(F.filter(titles, lambda t: contains_any(t, words)), 1, n)


def extract_clauses(blocks: DataFrame, pattern: str = config.CLAUSE_START, strong=config.CLAUSE_STRONG_WORDS,
                    max_clauses: int | None = None, follow: int | None = None, follow_length: int | None = None, limit: int | None = None) -> DataFrame:
    """Numbered clauses with their continuation lines (with ``follow`` so many at most, with ``follow_length`` only lines up to that
    length). A blank line or the next clause ends one; a clause never crosses a block. First text per clause id and page.
    A block is folded inside its row, so that only clauses are shuffled, never lines."""
    lines = blocks.withColumn("_lines", F.transform(split_lines("text"), collapse)).drop("text")
    breaks = F.filter(F.transform("_lines", lambda line, i: F.struct(i.alias("at"), line.rlike(pattern).alias("start"), (line == "").alias("blank"))),
                      lambda x: x["start"] | x["blank"])
    rows = lines.withColumn("_breaks", breaks)
    spans = F.filter(F.transform("_breaks", lambda x, k: F.struct(
        x["at"].alias("at"), x["start"].alias("start"), F.coalesce(F.get("_breaks", k + 1)["at"], F.size("_lines")).alias("end"))), lambda x: x["start"])

    def clause(x):
        more = F.slice("_lines", x["at"] + 2, x["end"] - x["at"] - 1)
        if follow_length is not None:
            more = F.filter(more, lambda line: F.length(line) <= follow_length)
        if follow is not None:
            more = F.slice(more, 1, follow)
        first = F.get("_lines", x["at"])
        name = F.coalesce(*[F.nullif(F.regexp_extract(first, pattern, g), F.lit("")) for g in (1, 2)], F.lit(""))
        body = F.concat(F.array(F.trim(F.regexp_extract(first, pattern, 3))), more)
        return F.struct((x["at"] + 1).alias("line_no"), F.regexp_replace(name, " ", "").alias("clause_id"),
                        compact_text(F.array_join(body, " "), limit).alias("text"))

    clauses = unfold(rows, [*DOC, "path", "block_ord", "page"], F.transform(spans, clause), "c").select(
        *DOC, "path", "block_ord", "page", "c.*").filter("text <> ''")
    unique = top_n(clauses, [*DOC, "clause_id", "page"], ["block_ord", "line_no"])
    if max_clauses is None:
        kept = number_rows(unique, DOC, ["block_ord", "line_no"], "clause_no", block_chunk())
    else:
        kept = top_n(unique, DOC, ["block_ord", "line_no"], max_clauses, "clause_no")
    return kept.select(
        *DOC, "path", "block_ord", "line_no", F.col("clause_no").cast("int").alias("clause_no"), "clause_id", "text", "page",
        F.when(contains_any("text", strong), "mandatory").otherwise("unknown").alias("mandatory_level"),
        F.lit("verified_local_source").alias("verification_status"),
    )


def normal_code(c) -> Column:
    return F.translate(F.upper(remove_space(col(c))), "—–", "--")


def verify_standards(attached: DataFrame, blocks: DataFrame, clauses: DataFrame, longest_code: int = 64) -> DataFrame:
    """Check each attached original (``project, doc_id, code``): its code must occur in the
    document's text without spaces, also across a block border; count its clauses."""
    codes = attached.select(*DOC, F.struct("code", normal_code("code").alias("_code")).alias("c")).groupBy(*DOC).agg(F.collect_set("c").alias("_codes"))
    held = lambda t: F.transform(F.filter("_codes", lambda c: F.contains(t, c["_code"])), lambda c: c["code"])
    ends = lambda t: F.struct(
        held(t).alias("held"), F.left(t, F.lit(longest_code)).alias("start"), F.right(t, F.lit(longest_code)).alias("end"))
    # a text is normalised once, behind the join, and only its ends and the codes found travel on
    parts = unfold(blocks.join(codes, DOC), [*DOC, "block_ord", "_codes"],
                   F.transform(F.filter(F.array(normal_code("text")), lambda t: t != ""), ends), "_b")
    # the end of what precedes a block, so that a code cut by a page break is found
    w = Window.partitionBy(*DOC).orderBy("block_ord")
    seam = F.concat(F.right(F.concat_ws("", F.lag("_b.end", 2).over(w), F.lag("_b.end").over(w)), F.lit(longest_code)), F.col("_b.start"))
    seams = parts.select(*DOC, "_codes", F.col("_b.held").alias("_held"), seam.alias("_seam"))
    seen = unfold(seams, DOC, F.array_union("_held", held(F.col("_seam"))), "code").distinct().withColumn("_hit", F.lit(True))
    counts = clauses.groupBy(*DOC).agg(F.count(F.lit(1)).alias("_n"))
    out = attached.join(seen, [*DOC, "code"], "left").join(counts, DOC, "left")
    verified = F.coalesce("_hit", F.lit(False))
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return out.select(
        *attached.columns, verified.alias("identity_verified"), n.alias("clause_count"),
        F.when(verified, "available").otherwise("needs_confirmation").alias("status"),
        F.when(n > 0, "ready").otherwise("needs_confirmation").alias("clause_parse_status"),
    )


def attachment_review(verified: DataFrame) -> DataFrame:
    """Review rows for originals without clauses or without their own code."""
    row = lambda category, title, detail, action: F.struct(
        F.lit(category).alias("category"), F.concat("code", F.lit(title)).alias("title"), F.lit(detail).alias("detail"),
        F.lit("high").alias("severity"), F.lit("open").alias("status"), F.lit(action).alias("recommended_action"))
    rows = F.array_compact(F.array(
        F.when(F.col("clause_count") == 0, row(
            "规范解析待确认", "未识别到可定位条款", "规范原文已保存，但未识别到编号条款。请确认文件是否为扫描件或目录页。",
            "上传可检索PDF/DOCX，或执行视觉资料分析后人工确认条款。")),
        F.when(~F.col("identity_verified"), row(
            "规范版本待确认", "原文身份未核验",
            "上传文件的可检索文字中未发现招标引用的完整标准编号，可能是扫描件、错误版本或错误文件。",
            "人工核对封面和版本；扫描件可运行千问视觉分析后再确认。")),
    ))
    return verified.select("project", "doc_id", "code", F.explode(rows).alias("r")).select("project", "doc_id", "code", "r.*")


def replace_clauses(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """New clauses of a standard take the place of all its former ones."""
    key = F.regexp_replace("standard_code", " ", "")
    codes = fresh.select("project", key.alias("_c")).distinct()
    kept = existing.withColumn("_c", key).join(codes, ["project", "_c"], "left_anti").drop("_c")
    return kept.unionByName(fresh)
