"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 8 bytes cuts texts where it is largest among the ``REACH`` bytes before and behind, so
chunks vary in size, their borders depend on their own neighbourhood only, and an insertion shifts nothing behind it; cuts move
on to the next word start. Every two successive chunks have a 64-bit digest of their words; the first occurrence of a
digest (smallest doc_id, then place) stays. Runs of repeated chunks that follow one another in their first occurrence, too, are
seeds of a repeated passage; a seed is extended over the chunks at its ends by comparing their words with the words around
the first occurrence. Passages of at least ``MIN_WORDS`` words are repeated passages and cut out.

A passage is found when it holds two whole chunks; chunks have 33 bytes on average and are never shorter than ``REACH`` but for
texts of a short period, so passages of 50 words hold about eight. A false match of two digests is harmless: words beyond the seed are compared.

Large groups: only 64-bit keys are counted, once for each block of text, with partial aggregation; keys seen once end there.
Only the chunks of keys seen again move on, in rows of numbers. They meet their first occurrence in an equi-join that
adaptive execution can split. Seeds and spans go to the texts (broadcast) up to ``FEW`` counted places, else texts and places are shuffled.

Defined results: null and empty texts have no chunks and stay as they are; repeated rows and ids are told apart by a
hash of the text, and equal rows share their verdict (a whole text that occurs first in its own row stays); null ids come
last; an empty table gives an empty table; other columns stay (``clean``) or are ignored (``passages``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceframe.llm.folders import scratch
from traceframe.llm.hashing import BYTE_TABLE, ODD, mix, slices, word_hashes

MIN_WORDS = 50
REACH = 20
GEAR = (BYTE_TABLE >> np.uint64(32)).astype(np.uint32)
CONTEXT = 40
FEW = 1_000_000
SPARSE = 25
BLOCK = 4 << 20


def cuts(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Numbers of the words that begin a chunk."""
    rolled = GEAR[data]
    for shift in (1, 2, 4):  # the sum over the last 8 bytes, each shifted by its age
        rolled[shift:] += rolled[:-shift] << np.uint32(4 * shift)
    before, behind, seen = rolled.copy(), rolled.copy(), 0
    while seen < reach:  # the largest of the bytes around; ends of the data bound them
        shift = min(seen + 1, reach - seen)
        before[shift:] = np.maximum(before[shift:], before[:-shift])
        behind[:-shift] = np.maximum(behind[:-shift], behind[shift:])
        seen += shift
    own = np.flatnonzero((rolled == before) & (rolled == behind))
    found = np.searchsorted(starts, own, "right")
    first = np.searchsorted(starts, bounds)
    return np.unique(np.r_[found[found < len(starts)], first[:-1][first[:-1] < first[1:]]])


def chunked(data: np.ndarray, bounds: np.ndarray):
    """For each chunk that gets a row: row, word (number of its first word in the row), step (its words), words (with the next chunk's), key (digest of
    both); and for each row its mark (hash of all its words)."""
    hashes, starts, _, first = word_hashes(data, bounds, lower=False)
    at = cuts(data, bounds, starts)
    step = np.diff(np.r_[at, len(starts)])
    row = np.searchsorted(first, at, "right") - 1
    place = np.arange(len(starts)) - np.repeat(at, step)
    sums = np.r_[np.uint64(0), np.cumsum(mix(hashes + place.astype(np.uint64) * ODD))]
    own = mix(sums[at + step] - sums[at] + step.astype(np.uint64))
    pair = np.r_[row[1:] == row[:-1], False] if len(row) else np.zeros(0, bool)
    behind = np.where(pair, mix(np.r_[own[1:], own[:1]]), np.uint64(0))
    words = step + np.where(pair, np.r_[step[1:], step[:1]], 0)
    keys = mix(own + behind * ODD)
    kept = spaced(row, at, keys)
    return row[kept], (at - first[row])[kept], step[kept], words[kept], keys[kept], marks_of(hashes, first)


def spaced(row: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the chunks that get a row: of equal ones that follow one another (texts of a short period), one for each SPARSE words,
    which is less than the words around a seed that are compared."""
    if len(row) == 0:
        return np.zeros(0, np.int64)
    new = np.r_[True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])]
    inside = (at - np.maximum.accumulate(np.where(new, at, 0))) // SPARSE
    return np.flatnonzero(new | np.r_[True, inside[1:] != inside[:-1]])


def marks_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.r_[np.uint64(0), np.cumsum(mix(hashes))]
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def key_rows(batches):
    """The distinct keys of each block of text and how often they occur there."""
    for _, data, bounds in slices(batches, BLOCK):
        keys, n = np.unique(chunked(data, bounds)[4], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])


def place_rows(batches):
    """A row per chunk: key, doc_id, mark, word, step, words."""
    for part, data, bounds in slices(batches, BLOCK):
        row, word, step, words, keys, marks = chunked(data, bounds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array(marks[row].view(np.int64)), pa.array(word.astype(np.int32)),
             pa.array(step.astype(np.int32)), pa.array(words.astype(np.int32))], names=["key", "doc_id", "mark", "word", "step", "words"])


PLACES = "key bigint, doc_id bigint, mark bigint, word int, step int, words int"


def order_of(prefix: str = "") -> list:
    return [F.coalesce(F.col(prefix + "doc_id"), F.lit((1 << 63) - 1)), F.col(prefix + "mark")]


def repeated_chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Chunks that are not the first of their digest: doc_id, mark, word, step, words and the first occurrence's place f (i, m, w)."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    keys = given.select("text").mapInArrow(key_rows, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    path = scratch(docs.sparkSession, "again")
    given.mapInArrow(place_rows, PLACES).join(keys, "key", "left_semi").write.parquet(path)
    again = docs.sparkSession.read.parquet(path)
    mine = F.struct(*[c.alias(n) for c, n in zip(order_of(), ("i", "m"), strict=True)], F.col("word").alias("w"))
    firsts = again.groupBy("key").agg(F.min(mine).alias("f"))
    return again.join(firsts, "key").filter(mine != F.col("f")).select("doc_id", "mark", "word", "step", "words", "f")


def runs_of(table: pa.Table) -> list[tuple]:
    """Seeds of one document: (word, words, f) where repeated chunks follow one another in both places."""
    rows = sorted(zip(table["word"], table["step"], table["words"], [(f["i"], f["m"], f["w"]) for f in table["f"]], strict=True))
    out: list[list] = []
    next_word, last = -1, -1
    for word, step, words, f in rows:
        if word == last:
            continue
        if out and next_word == word and out[-1][2][:2] == f[:2] and out[-1][2][2] + word - out[-1][0] == f[2]:
            out[-1][1] = word - out[-1][0] + words
        else:
            out.append([word, words, f])
        next_word, last = word + step, word
    return [tuple(x) for x in out]


def seed_rows(docs_chunks: pa.Table) -> pa.Table:
    rows = runs_of(docs_chunks.select(["word", "step", "words", "f"]).to_pydict())
    n = len(rows)
    return pa.table({
        "doc_id": pa.array([docs_chunks["doc_id"][0].as_py()] * n, pa.int64()), "mark": pa.array([docs_chunks["mark"][0].as_py()] * n, pa.int64()),
        "word": pa.array([r[0] for r in rows], pa.int32()), "words": pa.array([r[1] for r in rows], pa.int32()),
        "f_id": pa.array([r[2][0] for r in rows], pa.int64()), "f_mark": pa.array([r[2][1] for r in rows], pa.int64()), "f_word": pa.array([r[2][2] for r in rows], pa.int32())})


SEEDS = "doc_id bigint, mark bigint, word int, words int, f_id bigint, f_mark bigint, f_word int"


def around_rows(batches):
    """Word hashes around asked places: for each row (id, mark, text, asked = list of (from word, to word)) the hashes before and behind."""
    for part, data, bounds in slices(batches, 1 << 20):
        hashes, _, _, first = word_hashes(data, bounds, lower=False)
        out: list[list] = [[], [], [], [], []]
        for i, asked in enumerate(part.column("asked").to_pylist()):
            own = hashes[first[i]:first[i + 1]].view(np.int64)
            for a in {(x["a"], x["b"]) for x in asked}:
                out[0].append(i)
                out[1].append(a[0])
                out[2].append(a[1])
                out[3].append(own[max(0, a[0] - CONTEXT):a[0]][::-1])
                out[4].append(own[a[1]:a[1] + CONTEXT])
        at = pa.array(out[0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("i").take(at), part.column("mark").take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
             pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64()))], names=["i", "mark", "a", "b", "before", "behind"])


AROUND = "i bigint, mark bigint, a int, b int, before array<bigint>, behind array<bigint>"


def mark_rows(batches):
    """Each document with the hash of its text's words, as ``place_rows`` makes it."""
    for part, data, bounds in slices(batches, 1 << 20):
        hashes, _, _, first = word_hashes(data, bounds, lower=False)
        marks = marks_of(hashes, first)
        yield part.append_column("mark", pa.array(marks.view(np.int64)))


def same_length(x: str, y: str):
    """Length of the common start of two arrays."""
    pairs = F.zip_with(F.col(x), F.col(y), lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    return F.when(F.array_position(pairs, False) > 0, F.array_position(pairs, False) - 1).otherwise(F.size(pairs)).cast("int")


def beside(texts: DataFrame, places: DataFrame, listed: str, how: str) -> DataFrame:
    """``texts`` with the ``places`` of their rows. The number of listed places bounds what is broadcast."""
    path = scratch(texts.sparkSession, "places")
    places.write.parquet(path)
    places = texts.sparkSession.read.parquet(path)
    n = places.agg(F.sum(F.size(listed) + 2)).first()[0] or 0
    return texts.join(F.broadcast(places) if n <= FEW else places, ["i", "mark"], how)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Repeated passages: doc_id, mark, word, words (to cut out), first_id (document of the first occurrence)."""
    spark = docs.sparkSession
    path = scratch(spark, "seeds")
    seeds = repeated_chunks(docs, doc_id, text).groupBy("doc_id", "mark").applyInArrow(seed_rows, SEEDS)
    seeds.write.parquet(path)
    seeds = spark.read.parquet(path).withColumn("i", order_of()[0])
    asked = seeds.select("i", "mark", F.col("word").alias("a"), (F.col("word") + F.col("words")).alias("b")).unionByName(
        seeds.select(F.col("f_id").alias("i"), F.col("f_mark").alias("mark"), F.col("f_word").alias("a"), (F.col("f_word") + F.col("words")).alias("b"))
    ).distinct().groupBy("i", "mark").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    marked = given.mapInArrow(mark_rows, "doc_id bigint, text string, mark bigint").withColumn("i", order_of()[0]).drop("doc_id")
    around = beside(marked, asked, "asked", "inner").mapInArrow(around_rows, AROUND).dropDuplicates(["i", "mark", "a", "b"])
    own = around.select("i", "mark", F.col("a").alias("word"), F.col("b").alias("_b"), F.col("before").alias("p"), F.col("behind").alias("q"))
    source = around.select(F.col("i").alias("f_id"), F.col("mark").alias("f_mark"), F.col("a").alias("f_word"), F.col("b").alias("_fb"), F.col("before").alias("r"), F.col("behind").alias("s"))
    both = seeds.withColumns({"_b": F.col("word") + F.col("words"), "_fb": F.col("f_word") + F.col("words")}).join(own, ["i", "mark", "word", "_b"]).join(
        source, ["f_id", "f_mark", "f_word", "_fb"])
    grown = both.withColumns({"back": same_length("p", "r"), "on": same_length("q", "s")})
    whole = F.col("words") + F.col("back") + F.col("on")
    return grown.filter(whole >= min_words).select("doc_id", "mark", (F.col("word") - F.col("back")).alias("word"), whole.alias("words"), F.col("f_id").alias("first_id"))


def cut_batches(batches):
    """Texts without their passages: columns doc_id, text, mark, spans (word, words), and what else is there."""
    for part, data, bounds in slices(batches, 1 << 20):
        _, starts, ends, first = word_hashes(data, bounds, lower=False)
        texts, words, gone, cut = [], [], [], []
        raw = data.tobytes()
        for i, spans in enumerate(part.column("spans").to_pylist()):
            lo, hi = int(first[i]), int(first[i + 1])
            drop = np.zeros(hi - lo, bool)
            for s in spans or ():
                drop[s["word"]:s["word"] + s["words"]] = True
            edges = np.flatnonzero(np.diff(np.r_[False, drop, False]))
            pieces, at, places = [], int(bounds[i]), []
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                pieces.append(raw[at:starts[lo + a]])
                at = int(starts[lo + b]) if lo + b < hi else int(ends[lo + b - 1])
                places.append({"start": len(raw[bounds[i]:starts[lo + a]].decode()), "length": len(raw[starts[lo + a]:ends[lo + b - 1]].decode())})
            pieces.append(raw[at:bounds[i + 1]])
            texts.append(b"".join(pieces).decode())
            words.append(hi - lo)
            gone.append(int(drop.sum()))
            cut.append(places)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in part.schema.names if c not in ("text", "spans")], pa.array(texts, pa.string()), pa.array(words, pa.int64()),
             pa.array(gone, pa.int64()), pa.array(cut, kind)],
            names=[*[c for c in part.schema.names if c not in ("text", "spans")], "text", "n_words", "n_cut_words", "cuts"])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, text without repeated passages, n_words, n_cut_words, cuts (start and length in code points), first_ids."""
    found = passages(docs, doc_id, text, min_words).withColumn("i", order_of()[0]).groupBy("i", "mark").agg(
        F.collect_set(F.struct("word", "words")).alias("spans"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    marked = given.mapInArrow(mark_rows, "doc_id bigint, text string, mark bigint").withColumn("i", order_of()[0])
    joined = beside(marked, found, "spans", "left").select("doc_id", "first_ids", F.col("text"), "spans")
    return joined.mapInArrow(
        cut_batches, "doc_id bigint, first_ids array<bigint>, text string, n_words bigint, n_cut_words bigint, cuts array<struct<start:bigint,length:bigint>>")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated passages, with all their columns; documents of which no word is left go."""
    others = [c for c in docs.columns if c not in (doc_id, text)]
    found = passages(docs, doc_id, text, min_words).withColumn("i", order_of()[0]).groupBy("i", "mark").agg(F.collect_set(F.struct("word", "words")).alias("spans"))
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.struct(F.col(doc_id).alias("_id"), *others).alias("others"))
    kinds = f"struct<{','.join(f'`{n}`:{t}' for n, t in given.select('others.*').dtypes)}>"
    marked = given.mapInArrow(mark_rows, f"doc_id bigint, text string, others {kinds}, mark bigint").withColumn("i", order_of()[0])
    joined = beside(marked, found, "spans", "left").select("others", F.col("text"), "spans")
    done = joined.mapInArrow(cut_batches, f"others {kinds}, text string, n_words bigint, n_cut_words bigint, cuts array<struct<start:bigint,length:bigint>>")
    left = done.filter((F.col("n_cut_words") < F.col("n_words")) | (F.col("n_words") == 0))
    return left.select(*[F.col("text").alias(c) if c == text else F.col("others._id").alias(c) if c == doc_id else F.col("others")[c].alias(c) for c in docs.columns])
