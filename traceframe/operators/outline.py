"""Outlines, case patterns and located excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from traceframe import config
from traceframe.functions.text import compact_text, contains_any, heading_level, remove_space, strings
from traceframe.operators.keyed import counted_pairs, number_rows, salted_lookup, top_n
from traceframe.operators.lines import DOC, block_chunk, meaningful_lines


def extract_outline(blocks: DataFrame, pattern: str = config.HEADING, max_items: int | None = None, title_length: int | None = None,
                    default=config.STANDARD_OUTLINE) -> DataFrame:
    """Headings of each document in reading order (with ``title_length`` only titles up to it, with ``max_items`` the first ones);
    documents without any get the default."""
    heads = (
        meaningful_lines(blocks).filter(F.col("line").rlike(pattern))
        .select(*DOC, "block_ord", "line_no", heading_level("line").alias("level"),
                F.trim(F.regexp_extract("line", pattern, 6)).alias("title"))
    )
    if title_length is not None:
        heads = heads.filter(F.length("title") <= title_length)
    if max_items is None:
        kept = number_rows(heads, DOC, ["block_ord", "line_no"], "ord", block_chunk())
    else:
        kept = top_n(heads, DOC, ["block_ord", "line_no"], max_items, "ord")
    kept = kept.select(
        *DOC, F.col("ord").cast("int").alias("ord"), "level", "title", F.col("line_no").alias("source_line"))
    empty = blocks.select(*DOC).distinct().join(kept.select(*DOC).distinct(), DOC, "left_anti")
    filled = empty.select(*DOC, F.posexplode(strings(default)).alias("_i", "title")).select(
        *DOC, (F.col("_i") + 1).alias("ord"), F.lit(1).alias("level"), "title", F.lit(0).alias("source_line"))
    return kept.unionByName(filled)


def generate_outline(projects: DataFrame, reqs: DataFrame, base=config.STANDARD_OUTLINE, themes=config.OUTLINE_THEMES,
                     position: int = config.OUTLINE_THEME_POSITION) -> DataFrame:
    """Standard chapters plus a chapter for each theme that occurs in the project type or
    its requirements. Later themes go in front of earlier ones."""
    flags = [F.max(contains_any("requirement", words)).alias(f"_t{i}") for i, (words, _) in enumerate(themes)]
    seen = reqs.groupBy("project").agg(*flags)
    rows = projects.join(seen, "project", "left")
    extra = []
    for i, (words, title) in reversed(list(enumerate(themes))):
        hit = F.coalesce(F.col(f"_t{i}"), F.lit(False)) | contains_any("project_type", words)
        extra.append(F.when(hit, strings([title])).otherwise(strings([])))
    titles = F.concat(strings(base[:position]), *extra, strings(base[position:]))
    return rows.select("project", F.posexplode(titles).alias("_i", "title")).select(
        "project", F.lit(1).alias("level"), "title", (F.col("_i") + 1).alias("ord"))


def scene_terms(blocks: DataFrame, terms: list[str], key: str = "project") -> DataFrame:
    """Distinct terms of a list that occur in a case's texts, with their sorted rank."""
    ranked = sorted(set(terms))
    found = F.filter(strings(ranked), lambda t: F.contains(F.col("text"), t))
    hits = blocks.select(key, F.explode(found).alias("term")).distinct()
    per_case = hits.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("_terms"))  # bounded by the list
    return per_case.select(key, F.posexplode("_terms").alias("_i", "term")).select(
        key, "term", (F.col("_i") + 1).alias("term_no"))


def case_snippets(terms: DataFrame, bid_blocks: DataFrame, words: list[str], key: str = "project", first_terms: int = 20,
                  shortest: int = 18, longest: int = 260, limit: int = 220, at_most: int = 30) -> DataFrame:
    """For a case's first terms, the first line of a fitting length that contains it."""
    fitting = meaningful_lines(bid_blocks).filter(F.length("line").between(shortest, longest))
    found = F.filter(strings(sorted(set(words))), lambda t: F.contains(F.col("line"), t))
    hits = fitting.select(key, "doc_id", "block_ord", "line_no", "line", F.explode(found).alias("term"))
    first = hits.groupBy(key, "term").agg(F.min_by("line", F.struct("doc_id", "block_ord", "line_no")).alias("line"))
    wanted = terms.filter(F.col("term_no") <= min(first_terms, at_most))
    return wanted.join(first, [key, "term"]).select(
        key, "term_no", F.col("term").alias("keyword"), compact_text("line", limit).alias("text"))


def case_patterns(tender: DataFrame, bid: DataFrame, lexicon=config.REQUIREMENT_LEXICON,
                  categories=config.SCENE_CATEGORIES, notes=config.CASE_STYLE_NOTES, outline_items: int = 40):
    """What a case teaches, as tables: scene terms, snippets, style notes and outline."""
    words = [w for c in categories for w in lexicon.get(c, [])]
    cols = ["project", "doc_id", "block_ord", "text"]
    terms = scene_terms(tender.select(*cols).unionByName(bid.select(*cols)), words)
    style = terms.select("project").distinct().select("project", F.posexplode(strings(notes)).alias("note_no", "note"))
    return {
        "scene_terms": terms,
        "snippets": case_snippets(terms, bid, words),
        "style_notes": style,
        "outline": extract_outline(bid).filter(F.col("ord") <= outline_items),
    }


def locate_excerpts(items: DataFrame, blocks: DataFrame, item: str = "item_id", text: str = "text", prefix: int | None = None,
                    on: list[str] = ()) -> DataFrame:
    """First block (in document order) that contains an item, or its first ``prefix`` characters, spaces aside."""
    needles = items.select(*on, item, remove_space(F.substring(text, 1, prefix) if prefix else text).alias("_needle"))
    heap = blocks.select(*on, "doc_id", "block_ord", "page", remove_space("text").alias("_text"))
    # equal starts are searched once; the items join the answer
    hits = counted_pairs(needles.select(*on, "_needle").distinct(), heap, "_needle", "_text", list(on))
    first = hits.groupBy(*on, "_needle").agg(
        F.min(F.struct("doc_id", "block_ord", "page")).alias("_at"))
    return salted_lookup(needles, first, [*on, "_needle"], "inner", by=[item]).select(
        *on, item, "_at.doc_id", "_at.block_ord", "_at.page")
