"""Requirements of a document: classification, extraction, cross references, matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceframe import config
from traceframe.functions.references import is_reference_only, parse_reference
from traceframe.functions.text import compact_text, contains_any, lookup, remove_space, strings
from traceframe.operators.keyed import kept, maybe_in, number_rows, salted_lookup, top_n
from traceframe.operators.lines import DOC, block_chunk, document_line_numbers, meaningful_lines


def classify(line, lexicon: dict[str, list[str]] = config.REQUIREMENT_LEXICON) -> Column:
    """Category with most distinct keywords in the line; ties go to the earlier category."""
    line = F.col(line) if isinstance(line, str) else line
    # score and place in one number, the largest of which tells the category, in plain columns that compile
    size, scores = len(lexicon), []
    for place, words in enumerate(lexicon.values()):
        score = F.lit(0)
        for word in dict.fromkeys(words):
            score = score + line.contains(word).cast("int")
        scores.append(score * size + (size - 1 - place))
    best = F.greatest(*scores) if size > 1 else scores[0]
    return F.when(best < size, F.lit("general")).otherwise(F.element_at(strings(lexicon), (size - best % size).cast("int")))


def suggest_section(category, mapping=config.SECTION_BY_CATEGORY, default: str = config.DEFAULT_SECTION) -> Column:
    return lookup(category, mapping, default)


def is_pointer(line) -> Column:
    """Nothing but a reference follows the first colon."""
    line = F.col(line) if isinstance(line, str) else line
    after = F.regexp_extract(line, r"(?s)^[^：:]*[：:](.*)$", 1)
    return is_reference_only(F.when(line.rlike("[：:]"), after).otherwise(line))


def requirement_candidates(blocks: DataFrame, lexicon=config.REQUIREMENT_LEXICON, markers=config.MANDATORY_MARKERS) -> DataFrame:
    """Lines with a keyword or a mandatory marker, with category and reference."""
    words = [w for ws in lexicon.values() for w in ws] + list(markers)
    lines = meaningful_lines(blocks).filter(contains_any("line", words))
    return lines.withColumn("category", classify("line", lexicon)).withColumn("reference", parse_reference("line"))


def requirement_links(candidates: DataFrame, blocks: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """One edge per candidate line that refers to another place. With ``blocks`` the line
    number runs over the document."""
    found = candidates.filter(F.col("reference").isNotNull())
    if blocks is not None:
        found = document_line_numbers(blocks, found, starts=starts)
    return found.select(
        *DOC, "path", "block_ord", F.lit("requirement_reference").alias("kind"), "category",
        F.col("page").alias("source_page"), F.col("line_no").alias("source_line"),
        compact_text("line").alias("source_excerpt"), "reference.*",
    )


def extract_requirements(
    blocks: DataFrame,
    lexicon=config.REQUIREMENT_LEXICON,
    markers=config.MANDATORY_MARKERS,
    sections=config.SECTION_BY_CATEGORY,
    default_section: str = config.DEFAULT_SECTION,
    located: bool = True,
    limit: int | None = None,
    context: int | None = 500,
    candidates: DataFrame | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Requirement rows, numbered per document in reading order.

    Pure pointers are left out; equal lines count once. Texts are whole unless ``limit`` is given.
    With ``located`` the line number runs over the document; ``source_context`` is an excerpt of the block (``context``
    characters, whole with None) and ``context_tables`` the names of all tables that the whole block mentions, both joined back for the kept
    rows only. ``candidates`` (``requirement_candidates``) and ``starts`` (``block_starts``) are taken where they are at hand."""
    found = requirement_candidates(blocks, lexicon, markers) if candidates is None else candidates
    kept = found.filter(F.col("reference").isNull() | ~is_pointer("line"))
    first = top_n(
        kept, [*DOC, "line"], ["block_ord", "line_seq"]
    ).drop("reference")
    numbered = number_rows(first, DOC, ["block_ord", "line_seq"], "req_no", block_chunk() if located else None)
    if located:
        numbered = document_line_numbers(blocks, numbered, starts=starts, source_context=compact_text("text", context), context_tables=table_forms(F.col("text")))
    else:
        numbered = numbered.withColumn("source_context", compact_text("line", context)).withColumn("context_tables", table_forms(F.col("line")))
    return numbered.select(
        *DOC, "path", "block_ord", F.col("req_no").cast("int").alias("req_no"),
        F.concat(F.lit("REQ-"), _padded("req_no", 3)).alias("id"),
        "category", compact_text("line", limit).alias("requirement"), F.col("line_no").alias("source_line"),
        F.col("page").alias("source_page"), "source_context", "context_tables",
        suggest_section(F.col("category"), sections, default_section).alias("suggested_section"),
        F.lit("needs_response").alias("status"),
    )


def _padded(name: str, width: int) -> Column:
    """Zero-padded number that is never cut."""
    text = F.col(name).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def table_forms(context: Column) -> Column:
    """The empty name and every table name that occurs in a text, in every shortened form,
    so that "the text contains the named table" becomes an equi-join."""
    names = F.regexp_extract_all(remove_space(context), F.lit(f"(?=({config.REFERENCE_TABLE}))"), F.lit(1))
    forms = F.transform(names, lambda m: F.transform(  # a name has two letters at least
        F.sequence(F.lit(2), F.length(m)), lambda n: F.substring(m, F.lit(1), n)))
    return F.array_distinct(F.concat(strings([""]), F.flatten(forms)))


def resolve_requirement_links(links: DataFrame, reqs: DataFrame) -> DataFrame:
    """Requirements each link points at: same category, narrowed by page and then by table
    where that leaves any; resolved if something located was found or only one candidate
    exists. Candidates and questions are one table with a row per page and table; equal questions are answered once. Candidates of
    categories and tables that no link asks for are dropped before they are shuffled; nulls in document or category match nothing."""
    cat = [*DOC, "category"]
    found = reqs.dropna(subset=cat).select(
        *cat, F.struct("req_no", "id", F.col("source_page").alias("page")).alias("item"), F.col("source_page").alias("page"),
        F.explode(F.col("context_tables") if "context_tables" in reqs.columns else table_forms(F.col("source_context"))).alias("table"))
    asked = links.select(
        *cat, F.struct(F.col("target_page").alias("page"), F.col("target_table").alias("table")).alias("asker"), F.col("target_page").alias("page"),
        F.explode(F.array_distinct(F.array(F.lit(""), F.col("target_table")))).alias("table")).dropna(subset=[*cat, "table"])
    found = maybe_in(found, asked, ["category", "table"])
    pages = kept(found.unionByName(asked, allowMissingColumns=True).groupBy(*cat, "table", "page").agg(
        F.array_sort(F.collect_list("item")).alias("items"), F.collect_set("asker").alias("askers")))
    # Over all pages: how many candidates, all that name a table, and the one that may be alone.
    named = F.col("table") != ""
    wide = pages.groupBy(*cat, "table").agg(
        F.sum(F.size("items")).alias("n"), F.flatten(F.collect_list(F.when(named, F.col("items")))).alias("all"), F.min(F.get("items", F.lit(0))).alias("one"))
    told = pages.filter(F.size("askers") > 0).select(*cat, "table", "items", F.explode("askers").alias("asker")).join(wide, [*cat, "table"])
    here = F.when(F.col("asker.page").isNotNull() & (F.size("items") > 0), F.col("items"))
    far = F.when(named & (F.col("n") > 0), F.array_sort("all")).when(~named & (F.col("n") == 1), F.array("one"))
    best = told.select(*cat, "asker", named.alias("named"), here.alias("here"), far.alias("far")).groupBy(*cat, "asker").agg(
        *[F.first(F.when(F.col("named") == yes, F.col(c)), True).alias(f"{c}{int(yes)}") for c in ("here", "far") for yes in (True, False)])
    best = best.select(*[F.col(c).alias(f"_{c}") for c in cat], F.col("asker.page").alias("_page"), F.col("asker.table").alias("_table"),
                       F.coalesce("here1", "here0", "far1", "far0").alias("_items"))
    same = [F.col(c) == F.col(f"_{c}") for c in cat] + [F.col(f"target_{c}").eqNullSafe(F.col(f"_{c}")) for c in ("page", "table")]
    items = F.col("_items")
    return links.join(best, same, "left").select(
        *links.columns,
        F.when(items.isNull(), "unresolved").otherwise("resolved").alias("status"),
        F.coalesce(F.transform(items, lambda x: x["id"]), strings([])).alias("resolved_ids"),
        F.coalesce(
            F.array_sort(F.array_distinct(F.array_compact(F.transform(items, lambda x: x["page"])))),
            F.array().cast("array<int>")).alias("resolved_pages"),
    )


def reference_chain(resolved: DataFrame) -> DataFrame:
    """Requirement to link edges: which references lead to a requirement."""
    return resolved.filter(F.col("status") == "resolved").select(
        *DOC, F.explode("resolved_ids").alias("id"), "path", "source_page", "source_line", "source_excerpt",
        "target_page", "target_table",
    )


def requirement_summary(reqs: DataFrame, links: DataFrame | None = None, checks=config.HUMAN_CHECK_ITEMS,
                        mode: str = "pass_fail", shown: int = 20) -> DataFrame:
    """Per document: detected mode, count and the human check list (fixed items, then the
    first unresolved references)."""
    out = reqs.groupBy(*DOC).agg(
        F.when(F.max(F.col("category") == mode), mode).otherwise("unknown").alias("detected_mode"),
        F.count(F.lit(1)).alias("requirement_count"),
    )
    if links is None:
        return out.withColumn("human_checks", strings(checks))
    open_ = top_n(links.filter(F.col("status") != "resolved"), DOC, ["block_ord", "source_line"], shown, "_rank")
    listed = open_.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("_rank", "source_excerpt"))).alias("_open"))
    texts = F.transform("_open", lambda x: F.concat(F.lit("核对未解析的招标引用："), x["source_excerpt"]))
    return out.join(listed, DOC, "left").select(
        *out.columns, F.concat(strings(checks), F.coalesce(texts, strings([]))).alias("human_checks"))


def best_title(values: DataFrame, titles: DataFrame, on: list[str], value: str, title: str = "title", ord_: str = "ord",
               chars: str = "(?s).") -> DataFrame:
    """For each distinct value the title sharing most distinct characters, first on ties; no
    row where none is shared. The titles of a project travel as one array with their characters as bits of its own
    alphabet, and every value is scored against them inside its row: no pairs, no join on characters."""
    keys = on or ["_one"]
    own = (lambda df: df) if on else (lambda df: df.withColumn("_one", F.lit(1)))
    letters = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(chars), F.lit(0)))
    listed = own(titles.select(*on, F.struct(F.col(ord_).alias("ord"), F.col(title).alias("title"), letters(F.col(title)).alias("letters")).alias("t")))
    packs = listed.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("_t"))
    packs = packs.withColumn("_abc", F.array_distinct(F.flatten(F.transform("_t", lambda t: t["letters"]))))

    def bits(of: Column) -> Column:
        """The alphabet's letters that occur in ``of``, 63 to a number."""
        words = F.sequence(F.lit(0), F.greatest(F.floor((F.size("_abc") - 1) / 63), F.lit(0)).cast("int"))
        return F.transform(words, lambda w: F.aggregate(
            F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("bigint"),
            lambda s, i: s + F.when(F.array_contains(of, F.get("_abc", w * 63 + i)), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(0)))

    packs = packs.withColumn("_t", F.transform("_t", lambda t: F.struct(t["ord"].alias("ord"), t["title"].alias("title"), bits(t["letters"]).alias("bits"))))
    left = own(values.select(*on, F.col(value).alias("_value")).distinct())
    rows = salted_lookup(left, packs, keys, "inner", by=["_value"]).withColumn("_bits", bits(letters(F.col("_value"))))
    shared = lambda t: F.aggregate(F.zip_with(t["bits"], "_bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)
    scored = F.transform("_t", lambda t: F.struct(shared(t).cast("bigint").alias("score"), (-t["ord"]).alias("less"), t["title"].alias("title"), t["ord"].alias("ord")))
    best = rows.select(*on, F.col("_value").alias(value), F.array_max(scored).alias("_b")).filter("_b.score > 0")
    return best.select(*on, value, F.col("_b.title").alias("matched_title"), F.col("_b.ord").alias("matched_ord"), F.col("_b.score").alias("score"))


def best_outline_match(values: DataFrame, titles: DataFrame, on: list[str] = (), value: str = "section",
                       title: str = "title", ord_: str = "ord") -> DataFrame:
    """Closest outline title of each distinct value; the value itself if none is close."""
    on = list(on)
    best = best_title(values, titles, on, value, title, ord_)
    return values.select(*on, value).distinct().join(best, [*on, value], "left").select(
        *on, value, F.coalesce("matched_title", value).alias("matched_title"), F.coalesce("score", F.lit(0)).alias("score"))


def response_matrix(reqs: DataFrame, outline: DataFrame | None = None, strategies=config.RESPONSE_STRATEGIES,
                    default_strategy: str = config.DEFAULT_STRATEGY, checked=config.HUMAN_CHECK_CATEGORIES) -> DataFrame:
    """One row per requirement with its chapter and response strategy. ``outline`` is
    ``project, title, ord``; the chapter is then the closest outline title, found once per
    distinct suggested chapter."""
    rows = reqs
    target = F.col("suggested_section")
    if outline is not None:
        match = best_outline_match(
            reqs.select("project", "suggested_section"), outline, ["project"], "suggested_section"
        ).drop("score")
        rows = salted_lookup(reqs, match, ["project", "suggested_section"], by=["doc_id", "req_no"])
        target = F.col("matched_title")
    return rows.select(
        *DOC, F.col("req_no"), F.col("id").alias("requirement_id"), "category", "requirement", "source_line",
        "source_page", "path", target.alias("target_section"),
        lookup("category", strategies, default_strategy).alias("response_strategy"),
        F.lit("pending").alias("draft_status"), F.col("category").isin(list(checked)).alias("human_check"),
    )


def apply_coverage(matrix: DataFrame, missing: DataFrame) -> DataFrame:
    """draft_status from the ids (``doc_id, requirement_id``) whose text was not found."""
    flags = missing.select(*DOC, "requirement_id").distinct().withColumn("_missing", F.lit(True))
    return matrix.join(flags, [*DOC, "requirement_id"], "left").withColumn(
        "draft_status", F.when(F.col("_missing"), "missing").otherwise("covered")).drop("_missing")
