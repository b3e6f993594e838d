"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host the number of distinct documents that hold a
line is counted; lines above the limit are removed, and a document that is left with too
little is rejected. Copies of one document must not turn its own lines into boilerplate, so a
document is told apart by its whole set of normalised lines. A line that only copies share counts as
one document.

Large groups: a (host, line) group is first reduced to distinct documents, which spreads it over
tasks, and then only counted. Rows go back to their documents by joins on hashed keys.

Defined results: a null text is empty and fails the base rules; a null host is a host of its
own; repeated rows and repeated ids each get their own result; an empty table gives an empty
table; further columns are ignored (``decide``) or kept (``clean``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceframe.llm.columns import let, text_of, words_of
from traceframe.llm.folders import scratch

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SMALL_BYTES = 32 << 20
MAX_DOCS_PER_HOST = 100
MIN_LEFT_PERCENT = 30


def window_hashes(hashes: Column, size: int = WINDOW) -> Column:
    """A hash of each window of ``size`` words, from the hashes of the words."""
    windows = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, size)]))
    return F.slice(windows, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))


def covered_words(windows: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows whose hash occurs twice or more: equal hashes are neighbours once sorted."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: let(
        F.sort_array(F.transform(
            F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, j + 1)["h"]).eqNullSafe(True)),
            lambda x: x["i"])),
        lambda at: F.aggregate(
            at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + size).alias("end"), (a["n"] + i + size - F.greatest(a["end"], i)).alias("n")),
            lambda a: a["n"])))


def normal_lines(text: Column) -> Column:
    """The text's lines in lower case, digits as 0, white space as one space, trimmed."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " "), "[1-9]", "0")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def with_word_figures(docs: DataFrame, text: Column) -> DataFrame:
    """Adds _words, n_words, word_chars and n_repeat_words. Each step is a projection of its own, so that
    arrays that are used more than once are computed once."""
    words = docs.withColumn("_words", words_of(text))
    hashed = words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = hashed.withColumn("_windows", window_hashes(F.col("_hashes")))
    once = windows.withColumn("_once", F.size(F.array_distinct("_windows")) == F.size("_windows"))
    return once.withColumns({
        "n_words": F.size("_words").cast("bigint"), "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_repeat_words": F.when(F.col("_once"), F.lit(0)).otherwise(covered_words(F.col("_windows"))).cast("bigint"),
    }).drop("_words", "_hashes", "_windows", "_once")


def line_figures(text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    }


def host_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\x01"))


def row_key(text: str, host: str) -> Column:
    """Rows with equal host and text share their verdict, so that is what rows are joined on."""
    return F.sha2(F.concat_ws("\x00", host_of(host), text_of(text)), 256)


def line_lists(docs: DataFrame, text: str, host: str) -> DataFrame:
    """_key, _host, _line (hashes of the normalised lines with words, in order)."""
    hashes = F.array_remove(F.transform(normal_lines(text_of(text)), lambda x: F.md5(x)), F.md5(F.lit("")))
    return docs.select(row_key(text, host).alias("_key"), host_of(host).alias("_host"), hashes.alias("_lines"))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """Lines (_host, _line, n_docs) of more than ``max_docs`` distinct documents of one host. A document counts as
    the hash of its set of lines, so that copies count once."""
    sets = line_lists(docs, text, host).select("_host", F.array_sort(F.array_distinct("_lines")).alias("_set"))
    each = sets.select("_host", F.md5(F.array_join("_set", "")).alias("_doc"), F.explode("_set").alias("_line"))
    once = each.groupBy("_host", "_line", "_doc").agg(F.lit(1).alias("_one"))
    return once.groupBy("_host", "_line").agg(F.sum("_one").alias("n_docs")).filter(F.col("n_docs") > max_docs)


def removed_lines(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """_key, _gone (hashes of the lines to remove), n_removed_words: for the texts that have such lines."""
    lines = F.transform(normal_lines(text_of(text)), lambda x, i: F.struct(F.md5(x).alias("_line"), F.size(F.split(x, " ")).alias("_n"), i.alias("_at")))
    each = docs.select(row_key(text, host).alias("_key"), host_of(host).alias("_host"), F.explode(lines).alias("_x")).select("_key", "_host", "_x.*")
    found = each.join(frequent_lines(docs, text, host, max_docs), ["_host", "_line"], "left_semi")
    once = found.groupBy("_key", "_at").agg(F.first("_line").alias("_line"), F.first("_n").alias("_n"))  # of equal rows
    return once.groupBy("_key").agg(F.collect_set("_line").alias("_gone"), F.sum("_n").alias("n_removed_words"))


def verdict(n_words: Column, repeats: Column, gone: Column, min_words: int, max_repeat_percent: int, min_left_percent: int) -> dict[str, Column]:
    failed = (n_words < min_words) | (100 * repeats > max_repeat_percent * n_words)
    left = n_words - gone
    depleted = (left < min_words) | (100 * left < min_left_percent * n_words)
    return {"base_failed": failed, "kept": ~failed & ~depleted}


def decide(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST,
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """One row per document: the base figures, the words on removed lines and the verdict. No text is shuffled.

    A document is depleted when fewer than ``min_words`` words, or less than ``min_left_percent`` of its
    words, are left."""
    body = text_of(text)
    figures = with_word_figures(
        docs.select(F.col(doc_id).alias("doc_id"), row_key(text, host).alias("_key"), body.alias("_body")), F.col("_body")
    ).withColumns(line_figures(F.col("_body"))).drop("_body")
    judged = figures.join(removed_lines(docs, text, host, max_docs), "_key", "left")
    gone = F.coalesce("n_removed_words", F.lit(0)).cast("bigint")
    said = verdict(F.col("n_words"), F.col("n_repeat_words"), gone, min_words, max_repeat_percent, min_left_percent)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *[c.alias(n) for n, c in said.items()], gone.alias("n_removed_words"))


def clean(
    docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST,
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """The documents that pass, without their frequent lines; all columns stay.

    Verdicts are made without texts and written for the texts that are rejected or lose lines. They go to every task when they are counted
    to be small (``SMALL_BYTES``), so that no text moves; else each document is shuffled once, with its text in it once."""
    spark = docs.sparkSession
    limits = (min_words, max_repeat_percent, min_left_percent)
    figures = with_word_figures(docs.select(row_key(text, host).alias("_key"), text_of(text).alias("_body")), F.col("_body")).drop("_body")
    joined = figures.join(removed_lines(docs, text, host, max_docs), "_key", "left")
    kept = verdict(F.col("n_words"), F.col("n_repeat_words"), F.coalesce("n_removed_words", F.lit(0)), *limits)["kept"]
    path = scratch(spark, "verdicts")
    told = joined.select("_key", kept.alias("_kept"), "_gone").filter("NOT _kept OR _gone IS NOT NULL")
    told.groupBy("_key").agg(F.first("_kept").alias("_kept"), F.first(F.when(F.col("_kept"), F.col("_gone"))).alias("_gone")).write.parquet(path)
    told = spark.read.schema("_key string, _kept boolean, _gone array<string>").parquet(path)
    size = told.agg(F.sum(F.lit(100) + 40 * F.coalesce(F.size("_gone"), F.lit(0)))).first()[0] or 0
    rows = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_key", row_key(f"_row.{text}", f"_row.{host}"))
    found = rows.join(F.broadcast(told) if size <= SMALL_BYTES else told, "_key", "left").filter(F.coalesce("_kept", F.lit(True)))
    body = text_of(f"_row.{text}")
    left = F.array_join(let(normal_lines(body), lambda norm: F.filter(
        F.split(body, "\n", -1), lambda x, i: ~F.array_contains("_gone", F.md5(F.get(norm, i))))), "\n")
    new = F.when(F.col("_gone").isNull(), F.col("_row")[text]).otherwise(left)
    return found.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
