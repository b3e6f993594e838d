"""Project facts: extraction, references between mentions, merging and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from traceframe import config
from traceframe.functions.references import (
    is_reference_only,
    normalize_fact_value,
    parse_reference,
    strip_reference_tail,
)
from traceframe.functions.text import compact_text, file_name, file_suffix, find_all, match_excerpt, strings
from traceframe.operators.keyed import kept, known_around, maybe_in, number_by_range, top_n, unfold
from traceframe.operators.lines import DOC
from traceframe.operators.requirements import table_forms

ORDER = ["doc_id", "block_ord", "pattern_ord", "match_ord"]


def fact_matches(blocks: DataFrame, patterns=config.FACT_PATTERNS, context: int | None = 800, excerpts: bool = True) -> DataFrame:
    """Every match of every pattern in every block, with the parsed reference, an excerpt of the block (``context`` characters, whole with
    None) and the names of all tables that the whole block mentions. Without ``excerpts`` there are none of the match and the block, for
    callers that keep the matches and show no excerpts."""

    def hits_of(number, key, pattern, has_unit):
        return F.transform(find_all("text", pattern, 2 if has_unit else 1, starts=excerpts), lambda h, j: F.struct(
            F.lit(key).alias("key"), F.lit(number).alias("pattern_ord"), j.alias("match_ord"), *[h["start"].alias("start")] * excerpts,
            h["full"].alias("full"), F.trim(h["g1"]).alias("raw_value"),
            (h["g2"] if has_unit else F.lit("")).alias("unit"),
        ))

    per_pattern = [hits_of(i, *spec) for i, spec in enumerate(patterns)]
    # the text itself travels on only for blocks with a match
    some = F.lit(False)
    for _, pattern, _ in patterns:
        some = some | F.col("text").rlike(pattern)
    keep = [c for c in blocks.columns if c != "text"]
    hit = F.col("hit")
    shown = [
        match_excerpt("text", hit["start"], hit["start"] + F.length(hit["full"])).alias("source_excerpt"),
        compact_text("text", context).alias("source_block_excerpt"),
    ] if excerpts else []
    return (
        unfold(blocks.filter(some), [*keep, "text", table_forms(F.col("text")).alias("block_tables")], F.concat(*per_pattern), "hit")
        .select(
            *keep, "hit.*", "block_tables", *shown,
        )
        .withColumn("reference", parse_reference("full"))
        .withColumn("is_pointer", F.col("reference").isNotNull() & is_reference_only("raw_value"))
    )


def extract_facts(blocks: DataFrame, patterns=config.FACT_PATTERNS, matches: DataFrame | None = None,
                  confidence: float = 0.86) -> DataFrame:
    """Facts with value, unit and place; equal values of one page count once."""
    found = fact_matches(blocks, patterns) if matches is None else matches
    facts = (
        found.filter(~F.col("is_pointer")).withColumn("value", strip_reference_tail("raw_value"))
        .filter(F.col("value") != "")
    )
    first = top_n(facts, [*DOC, "key", "value", "page"], ["block_ord", "pattern_ord", "match_ord"])
    extra = [c for c in ("sheet", "cell", "source_excerpt", "source_block_excerpt") if c in first.columns]
    return first.select(
        *DOC, "path", "block_ord", "pattern_ord", "match_ord", "key", "value", "unit",
        F.col("page").alias("source_page"), *extra, "block_tables",
        F.lit(confidence).alias("confidence"), F.lit("extracted").alias("status"),
        normalize_fact_value("key", F.col("value"), F.col("unit")).alias("norm"),
    )


def fact_links(matches: DataFrame) -> DataFrame:
    """Matches whose value only points to another place."""
    extra = [c for c in ("sheet", "cell") if c in matches.columns]
    return matches.filter("is_pointer").select(
        *DOC, "path", "block_ord", "pattern_ord", "match_ord", F.lit("fact_reference").alias("kind"),
        F.col("key").alias("fact_key"), F.col("page").alias("source_page"), *extra,
        compact_text("full").alias("source_excerpt"), "reference.*",
    )


def resolve_fact_links(links: DataFrame, facts: DataFrame, chunk: int = 256) -> DataFrame:
    """Value each link points at: facts of the same key and document, narrowed by page and
    then by a table named in their block, if all candidates agree on one value. Among them
    the page nearest to the target counts, then the first in order.

    Candidates and questions are one table with a row per page; nearest pages are an as-of lookup along it, cut every ``chunk`` pages.
    Candidates of keys and tables that no link asks for are dropped before they are shuffled; nulls in document or key match nothing."""
    key, pool = [*DOC, "key"], [*DOC, "key", "table"]
    found = facts.dropna(subset=key).select(
        *key, F.col("source_page").alias("page"), "norm", F.struct("block_ord", "pattern_ord", "match_ord").alias("pos"), "value",
        F.explode(F.col("block_tables") if "block_tables" in facts.columns else table_forms(F.col("source_block_excerpt"))).alias("table"))
    pick = F.when(F.col("pos").isNotNull(), F.struct("value", "page", "pos"))
    asked = links.select(
        *DOC, F.col("fact_key").alias("key"), F.struct(F.col("target_page").alias("page"), F.col("target_table").alias("table")).alias("asker"),
        F.explode(F.array_distinct(F.array(F.lit(""), F.col("target_table")))).alias("table")).dropna(subset=pool)
    found = maybe_in(found, asked, ["key", "table"])
    both = found.withColumn("pick", pick).withColumn("p", F.coalesce("page", F.lit(0))).drop("value").unionByName(
        asked.withColumn("p", F.coalesce("asker.page", F.lit(0))), allowMissingColumns=True)
    # One row per page of a pool: what stands there and who asks for it.
    paged = F.col("page").isNotNull()
    pages = kept(both.groupBy(*pool, "p").agg(
        F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.min_by("pick", "pos").alias("c"),
        F.min(F.when(paged, F.col("norm"))).alias("page_lo"), F.max(F.when(paged, F.col("norm"))).alias("page_hi"),
        F.min_by("pick", F.when(paged, F.col("pos"))).alias("page_pick"), F.collect_set("asker").alias("askers")))
    around = known_around(pages, pool, "p", "c", F.floor(F.col("p") / chunk).cast("bigint"), {"lo": F.min("lo"), "hi": F.max("hi")})
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.coalesce(F.col(c)["page"], F.lit(0)) - F.col("p")).alias("gap"), F.col(c)["pos"].alias("pos"), F.col(c).alias("c")))
    near = F.when(F.col("all_lo") == F.col("all_hi"), F.array_min(F.array_compact(F.array(gap("below"), gap("above"))))["c"])
    answer = F.struct(
        (F.col("page_lo").isNotNull() & F.col("asker.page").isNotNull()).alias("hit"), F.when(F.col("page_lo") == F.col("page_hi"), F.col("page_pick")).alias("pick"),
        F.col("all_lo").isNotNull().alias("known"), near.alias("near"))
    told = around.filter(F.size("askers") > 0).select(*pool, "p", "lo", "hi", "page_lo", "page_hi", "page_pick", "all_lo", "all_hi", "below", "above", F.explode("askers").alias("asker"))
    told = told.select(*key, "table", "asker", answer.alias("a"))
    named = (F.col("table") != "") & (F.col("table") == F.col("asker.table"))
    best = told.groupBy(*key, "asker").agg(
        F.first(F.when(named, F.col("a")), True).alias("own"), F.first(F.when(F.col("table") == "", F.col("a")), True).alias("any"))
    chosen = F.when(F.col("own.hit"), F.col("own.pick")).when(F.col("any.hit"), F.col("any.pick")).when(F.col("own.known"), F.col("own.near")).otherwise(F.col("any.near"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("asker.page").alias("_page"), F.col("asker.table").alias("_table"), chosen.alias("_pick"))
    same = [F.col(c) == F.col(f"_{k}") for c, k in zip([*DOC, "fact_key"], key, strict=True)]
    same += [F.col(f"target_{c}").eqNullSafe(F.col(f"_{c}")) for c in ("page", "table")]
    return links.join(best, same, "left").select(
        *links.columns, F.when(F.col("_pick").isNull(), "unresolved").otherwise("resolved").alias("status"),
        F.coalesce("_pick.value", F.lit("")).alias("resolved_value"), F.col("_pick.page").alias("resolved_page"))


def apply_resolved_links(facts: DataFrame, resolved: DataFrame, floor: float = 0.95) -> DataFrame:
    """Raise the confidence of facts that links lead to and count those links."""
    on = [*DOC, "key", "value", "source_page"]
    hits = resolved.filter(F.col("status") == "resolved").groupBy(
        *DOC, F.col("fact_key").alias("key"), F.col("resolved_value").alias("value"),
        F.col("resolved_page").alias("source_page"),
    ).agg(F.count(F.lit(1)).alias("_links"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"h.{c}")) for c in on]
    return facts.alias("f").join(hits.alias("h"), same, "left").select(
        *[F.col(f"f.{c}") for c in facts.columns if c not in ("confidence", "chain_count")],
        F.when(F.col("h._links").isNotNull(), F.greatest(F.col("f.confidence"), F.lit(floor))).otherwise(
            F.col("f.confidence")).alias("confidence"),
        F.coalesce("h._links", F.lit(0)).cast("bigint").alias("chain_count"),
    )


def merge_facts(facts: DataFrame, keys=("project", "key", "norm"), order=tuple(ORDER)) -> DataFrame:
    """One row per key and normalised value: the mention with a chain, then highest
    confidence, then a page, then first. Mentions stay in ``fact_mentions``."""
    keys, order = list(keys), list(order)
    if "chain_count" not in facts.columns:
        facts = facts.withColumn("chain_count", F.lit(0).cast("bigint"))
    rest = [c for c in facts.columns if c not in keys and c != "chain_count"]
    rank = F.struct(
        (F.col("chain_count") == 0).cast("int").alias("r0"), (-F.col("confidence")).alias("r1"),
        F.coalesce(F.col("source_page"), F.lit(0)).eqNullSafe(0).cast("int").alias("r2"), *order)
    return (
        facts.groupBy(*keys)
        .agg(
            F.min_by(F.struct(*rest), rank).alias("_p"), F.count(F.lit(1)).alias("mention_count"),
            F.sum("chain_count").alias("chain_count"), F.min(F.struct(*order)).alias("first_seen"),
        )
        .select(*keys, "_p.*", "mention_count", "chain_count", "first_seen")
    )


def fact_mentions(facts: DataFrame, keys=("project", "key", "norm")) -> DataFrame:
    """Mentions of merged facts as an edge table."""
    extra = [c for c in ("sheet", "cell") if c in facts.columns]
    return facts.select(*keys, *[c for c in ORDER if c in facts.columns], "path", "source_page", *extra, "source_excerpt")


def conflict_variants(facts: DataFrame, order=tuple(ORDER)) -> DataFrame:
    """Distinct normalised values of the keys that have more than one, in first-seen order,
    each with a label of its first mention. They are numbered in sampled ranges, whatever the ids are like."""
    order = list(order)
    label = F.concat(
        F.col("value"), F.coalesce("unit", F.lit("")), F.lit("（"), file_name("path"),
        F.when(F.coalesce("source_page", F.lit(0)) != 0, F.concat(F.lit(" 第"), F.col("source_page").cast("string"), F.lit("页")))
        .otherwise(""), F.lit("）"),
    )
    seen = (
        facts.filter(F.trim("value") != "")
        .groupBy("project", "key", "norm")
        .agg(F.min_by(label, F.struct(*order)).alias("label"), F.min(F.struct(*order)).alias("seen"))
    )
    many = seen.groupBy("project", "key").agg(F.count(F.lit(1)).alias("variant_count")).filter("variant_count > 1")
    rows = seen.join(many, ["project", "key"])
    return number_by_range(rows, ["project", "key"], [F.col("seen")], "variant_no")


def detect_conflicts(facts: DataFrame, order=tuple(ORDER), sections=("工程概况与施工条件", "施工进度计划及保证措施"),
                     part_size: int = 500) -> DataFrame:
    """Review rows for keys with different values. The detail lists all values; a key with
    more than ``part_size`` of them gets several rows."""
    rows = conflict_variants(facts, order).withColumn(
        "part", F.floor((F.col("variant_no") - 1) / part_size).cast("int") + 1)
    return (
        rows.groupBy("project", "key", "part")
        .agg(F.max("variant_count").alias("variant_count"),
             F.array_sort(F.collect_list(F.struct("variant_no", "label"))).alias("_l"))
        .select(
            "project", "key", "part", "variant_count", F.lit("资料冲突").alias("category"),
            F.concat("key", F.lit("存在不一致")).alias("title"),
            F.array_join(F.transform("_l", lambda x: x["label"]), "；").alias("detail"),
            F.lit("high").alias("severity"), strings(sections).alias("affected_sections"),
            F.lit("open").alias("status"), F.lit("核对招标文件、补遗和设计资料并确认采用值。").alias("recommended_action"),
        )
    )


def analysable_files(files: DataFrame, suffixes=config.FACT_SUFFIXES) -> DataFrame:
    """Files facts are read from: no duplicates, readable kinds."""
    return files.filter(~F.col("is_duplicate") & file_suffix("path").isin(list(suffixes)))
