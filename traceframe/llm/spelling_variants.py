"""Spelling variants of a corpus: words that differ by one edit, and the most frequent form each word leads to.

1. Runs of letters become words and are counted with map-side aggregation; the distinct frequent words are the vocabulary.
2. Letters are hashed to a few symbols, more of them the larger the vocabulary is, so that reduced words stay selective. Words that are one edit apart have reduced words that are equal or one edit apart.
3. Each word generates the full one-edit neighbourhood of its reduced word: itself, every deletion, replacement and
   insertion over the few symbols, as 64-bit keys, each once. Keys that no reduced word has are dropped by a bitmap of fixed size
   (``FILTER_BITS``, without false negatives) before anything is shuffled.
4. What is left meets the reduced vocabulary in an equi-join, and the original strings are verified. A pair of words
   is met exactly once from each side, so that the links of a word need no second pass.
5. Roots follow the forms by pointer jumping. Counts double with every step, so few rounds are needed at any size.

Defined results: null and empty texts hold no words; a null id is written as empty text before the colon; repeated
rows count as often as they stand; an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from traceframe.llm.folders import settled, shared_folder
from traceframe.llm.hashing import ODD, mix

#: Letters of words (fixed value).
RUNS = "[A-Za-zÀ-ÿ]+"
SYMBOLS = 8
FILTER_BITS = 1 << 25
BACK = np.uint64(pow(int(ODD), -1, 1 << 64))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """word: one row for each run of letters. Runs whose crc32 with the id is a multiple of ``every`` lose one letter."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    name = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(name.alias("name"), F.explode(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0))).alias("run"))
    h = runs.select("run", F.crc32(F.concat("name", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return h.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def reduced(words: pa.Array, symbols: int = SYMBOLS):
    """The words' letters as symbols in one row of numbers from 1, and the bounds of the words in it."""
    texts = words.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    return mix(points * ODD) % np.uint64(symbols) + np.uint64(1), bounds


def prefix_sums(letters: np.ndarray, bounds: np.ndarray):
    """For each letter: its place, the powers of the place, the polynomial hash before it; for each word: its whole hash."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(letters)) - bounds[owner]
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(place.max(initial=0)) + 1, ODD)])
    terms = np.r_[np.uint64(0), np.cumsum(letters * powers[place], dtype=np.uint64)]
    return owner, place, powers, terms[:-1] - terms[bounds[owner]], terms[bounds[1:]] - terms[bounds[:-1]]


def finish(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(sums + lengths.astype(np.uint64) * BACK)


def keys(words: pa.Array, symbols: int = SYMBOLS) -> np.ndarray:
    """The key of each word's reduced word."""
    letters, bounds = reduced(words, symbols)
    return finish(prefix_sums(letters, bounds)[4], np.diff(bounds))


def neighbourhoods(words: pa.Array, symbols: int = SYMBOLS):
    """Word numbers and keys of all reduced words within one edit, each key once for a word."""
    letters, bounds = reduced(words, symbols)
    owner, place, powers, before, whole = prefix_sums(letters, bounds)
    sizes, every = np.diff(bounds), np.arange(len(bounds) - 1)
    rest = whole[owner] - before  # from the letter on
    parts = [(every, finish(whole, sizes)), (owner, finish(before + (rest - letters * powers[place]) * BACK, sizes[owner] - 1))]
    for s in range(1, symbols + 1):
        c = np.uint64(s)
        parts.append((owner, finish(whole[owner] + (c - letters) * powers[place], sizes[owner])))
        parts.append((owner, finish(before + c * powers[place] + rest * ODD, sizes[owner] + 1)))
        parts.append((every, finish(whole + c * powers[sizes], sizes + 1)))
    of, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    first = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])] if len(of) else np.zeros(0, bool)
    return of[first], key[first]


def with_keys(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """other, other_n, key: the reduced vocabulary."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys(batch.column(0), symbols).view(np.int64))], names=["other", "other_n", "key"])
    return vocab.select("word", "n").mapInArrow(run, "other string, other_n bigint, key bigint")


def present(reduced_words: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the keys, merged in Spark: at most bits / 64 rows come to the driver at any size of the vocabulary."""
    slot = F.pmod(F.col("key"), F.lit(bits))
    merged = reduced_words.select(F.shiftright(slot, 6).alias("i"), F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) & 63 as int))").alias("b")).groupBy(
        "i").agg(F.bit_or("b").alias("b")).toArrow()
    grid = np.zeros(bits >> 6, np.int64)
    grid[merged.column("i").to_numpy()] = merged.column("b").to_numpy()
    return grid


def candidates(vocab: DataFrame, grid: np.ndarray, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, key: the keys around each word that some reduced word may have."""
    shared = vocab.sparkSession.sparkContext.broadcast(grid)
    bits = len(grid) << 6

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                of, key = neighbourhoods(part.column(0), symbols)
                slot = (key % np.uint64(bits)).astype(np.int64)
                kept = (shared.value[slot >> 6] >> (slot & 63)) & 1 == 1
                rows = pa.array(of[kept])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(key[kept].view(np.int64))], names=["word", "n", "key"])
    return vocab.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint")


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet; results are the same with any number."""
    return max(SYMBOLS, math.ceil(words ** 0.2))


def links(vocab: DataFrame, symbols: int | None = None) -> DataFrame:
    """word, n, other, other_n: all pairs of words that differ by exactly one code point inserted, deleted or replaced, both ways."""
    symbols = symbols or symbols_for(vocab.count())
    known = with_keys(vocab, symbols)
    around = candidates(vocab, present(known), symbols)
    return around.join(known, "key").filter(one_edit(F.col("word"), F.col("other"))).select("word", "n", "other", "other_n")


def forms(vocab: DataFrame, near: DataFrame, times: int = 2) -> DataFrame:
    """word, n, form, form_n, n_near: the most frequent near word, where it is at least ``times`` as frequent as the word."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    strong = -F.col("top.less") >= F.col("n") * times
    return vocab.join(best, "word", "left").select(
        "word", "n", F.when(strong, F.col("top.other")).alias("form"), F.when(strong, -F.col("top.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the last word when forms are followed."""
    step = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    step = settled(step, "forms")
    while True:
        jump = step.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = step.join(jump, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        step = settled(step, "roots")
        if step.filter("moved").limit(1).count() == 0:
            return step.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    shared_folder(docs.sparkSession)
    vocab = vocabulary(occurrences(docs, doc_id, text)).checkpoint()
    formed = forms(vocab, links(vocab)).checkpoint()
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
