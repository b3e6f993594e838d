"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model over words with absolute discounting, interpolated with the add-0.1 unigrams; bigrams seen at least
twice in training are states' arcs, everything else is reached over failure arcs. States are words (and the start of a text):
an arc h -> w weighs log10((c(h,w) - D) / c(h) + g(h) * p(w)), the failure arc of h weighs log10 g(h) and leads to
the empty state, whose arc w weighs log10 p(w). g(h) is what discounting and the cutoff leave, so that each state's
probabilities sum to one. A text is scored in one pass from left to right: the state is the last word.

No task ever holds the whole model. Documents are dealt into blocks of about ``BLOCK_BYTES`` of text. A block sends its distinct bigrams
(sorted 64-bit hashes with training counts, in byte planes) to range buckets; a bucket adds the counts of all blocks up and answers each
block with the totals of the bigrams it has, in the block's order and without the keys; the same is done for words. A block then has the part of the
automaton that its own texts can reach, and no more. Counts cover all training documents. A frequent word or pair is
one entry for each block, however often it occurs, so no group is hot.

Words and pairs are compared by 64-bit hashes. Defined results: null and empty texts are the end token alone; a null doc_id counts as
the empty string in the split; repeated rows each count and get their row; an empty table gives an
empty table; other columns are ignored."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceframe.llm.folders import settled
from traceframe.llm.hashing import mix, slices, word_hashes

#: Text of a block, and blocks for each bucket, so that a bucket holds about as much.
BLOCK_BYTES, BLOCKS_A_BUCKET = 12 << 20, 2
DISCOUNT = 0.75
LEAST = 2
ADD = 0.1
FOLDS = 10
START, END = np.uint64(1), np.uint64(2)
BLOB = "block int, ids binary, held binary, lengths binary, tokens binary, vocabulary binary"
ENTRIES = "bucket int, block int, keys binary, counts binary, rest binary"


def planes(a: np.ndarray) -> bytes:
    """Sorted numbers as byte planes, which compress well."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes(), 1) if len(a) else b""


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel() if b else np.zeros(0, np.uint64)


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted keys fall into equal ranges: the border places of each bucket."""
    step = -(-(1 << 64) // buckets)
    borders = np.array([i * step for i in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(keys, borders), len(keys)]


def tokens_of(table: pa.Table):
    """Token hashes (words, then the end) of a block's documents in order, and their numbers of tokens."""
    every, lengths = [], []
    for part, data, bounds in slices(table.select(["text"]).to_batches(), 2 << 20):
        words, _, _, first = word_hashes(data, bounds)
        every.append(np.insert(words, first[1:], END))
        lengths.append(np.diff(first) + 1)
    return np.concatenate(every), np.concatenate(lengths).astype(np.int64)


def histories(tokens: np.ndarray, lengths: np.ndarray, start) -> np.ndarray:
    """The state before each token."""
    before = np.r_[tokens[:1], tokens[:-1]]
    before[np.cumsum(lengths) - lengths] = start
    return before


def block_blob(table: pa.Table) -> pa.Table:
    """A block as one row: ids, who is held out, lengths, tokens as numbers of the block's own vocabulary."""
    tokens, lengths = tokens_of(table)
    vocabulary, numbers = np.unique(tokens, return_inverse=True)
    ids = table["doc_id"]
    held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0 for i in ids.to_pylist()])
    some = np.array([i is not None for i in ids.to_pylist()])
    return pa.table({
        "block": pa.array([table["block"][0].as_py()], pa.int32()),
        "ids": [pack(np.r_[ids.fill_null(0).to_numpy(), some.astype(np.int64)])], "held": [pack(held)], "lengths": [pack(lengths)],
        "tokens": [pack(numbers.astype(np.uint32))], "vocabulary": [planes(vocabulary)]}, schema=pa.schema(
            [("block", pa.int32()), *[(c, pa.binary()) for c in ("ids", "held", "lengths", "tokens", "vocabulary")]]))


class Block:
    def __init__(self, row: dict):
        self.lengths, self.held = unpack(row["lengths"], np.int64), unpack(row["held"], bool)
        self.vocabulary, self.numbers = from_planes(row["vocabulary"]), unpack(row["tokens"], np.uint32)
        self.tokens = self.vocabulary[self.numbers]
        self.before = histories(self.tokens, self.lengths, START)
        self.train = np.repeat(~self.held, self.lengths)


def entries(block: int, keys: np.ndarray, counts: np.ndarray, rest: np.ndarray | None, buckets: int) -> list[dict]:
    at = buckets_of(keys, buckets)
    return [{"bucket": i, "block": block, "keys": planes(keys[a:b]), "counts": pack(counts[a:b]), "rest": None if rest is None else pack(rest[a:b])}
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]


ENTRY_TYPE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("rest", pa.binary())])


def pair_entries(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                keys, where = np.unique(pair_keys(b.before, b.tokens), return_inverse=True)
                counts = np.bincount(where, b.train, len(keys)).astype(np.uint32)
                for part in entries(row["block"], keys, counts, None, buckets):
                    yield pa.RecordBatch.from_pylist([part], schema=ENTRY_TYPE)
    return run


def add_up(table: pa.Table):
    """All keys of a bucket with their summed counts, and where each block's keys are among them."""
    rows = table.to_pylist()
    each = [from_planes(r["keys"]) for r in rows]
    keys = np.unique(np.concatenate(each))
    counts, rest, owner = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.full(len(keys), -1)
    places = [np.searchsorted(keys, k) for k in each]
    for r, at in sorted(zip(rows, places, strict=True), key=lambda x: x[0]["block"]):
        counts[at] += unpack(r["counts"], np.uint32)
        owner[at[owner[at] < 0]] = r["block"]
        if r["rest"] is not None:
            rest[at] += unpack(r["rest"], np.float64)
    return rows, each, places, counts, rest, owner


def merge_pairs(table: pa.Table) -> pa.Table:
    """Answers without keys, as the block has them in the same order: totals of its pairs that are arcs, 0 for others; ``rest`` is 1 where this
    block is the first that has the arc."""
    rows, _, places, counts, _, owner = add_up(table)
    out = []
    for r, at in zip(rows, places, strict=True):
        arc = counts[at] >= LEAST
        out.append({"bucket": r["bucket"], "block": r["block"], "keys": b"", "counts": pack(np.where(arc, counts[at], 0).astype(np.uint32)),
                    "rest": pack(arc & (owner[at] == r["block"]))})
    return pa.Table.from_pylist(out, schema=ENTRY_TYPE)


def answered(rows: list[dict], kind):
    """Counts and ``rest`` of a block's sorted keys: buckets are ranges of keys, so their answers one after another are in order."""
    rows = sorted(rows, key=lambda r: r["bucket"])
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(0, kind)
    return tuple(np.concatenate(x) for x in zip(*[(unpack(r["counts"], np.uint32), unpack(r["rest"], kind)) for r in rows], strict=True))


def word_entries(buckets: int):
    """Per block: training counts of its words (and of the start), and the discounted mass of arcs it owns, by state."""
    def run(blob: pa.Table, answers: pa.Table) -> pa.Table:
        row = blob.to_pylist()[0]
        b, (counts, own) = Block(row), answered(answers.to_pylist(), bool)
        words = np.unique(np.r_[b.vocabulary, START])
        n = np.bincount(np.searchsorted(words, b.tokens), b.train, len(words)).astype(np.uint32)
        n[words == START] = (~b.held).sum()
        _, first = np.unique(pair_keys(b.before, b.tokens), return_index=True)
        mass = np.bincount(np.searchsorted(words, b.before[first[own]]), counts[own] - DISCOUNT, len(words))
        return pa.Table.from_pylist(entries(row["block"], words, n, mass, buckets), schema=ENTRY_TYPE)
    return run


def merge_words(table: pa.Table) -> pa.Table:
    """Answers by block, without keys like those of the pairs, and as block -1 the bucket's own N and V (in ``counts``)."""
    rows, each, places, counts, rest, _ = add_up(table)
    out = [{"bucket": r["bucket"], "block": r["block"], "keys": b"", "counts": pack(counts[at].astype(np.uint32)), "rest": pack(rest[at])}
           for r, at in zip(rows, places, strict=True)]
    keys = np.unique(np.concatenate(each))
    real = keys != START
    out.append({"bucket": rows[0]["bucket"], "block": -1, "keys": b"", "counts": pack(np.array([counts[real].sum(), (counts[real] > 0).sum()], np.int64)), "rest": None})
    return pa.Table.from_pylist(out, schema=ENTRY_TYPE)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_block(total: int, distinct: int):
    def run(blob: pa.Table, answers: pa.Table) -> pa.Table:
        row = blob.to_pylist()[0]
        rows = answers.to_pylist()
        b = Block(row)
        arc_counts, _ = answered([r for r in rows if r["kind"] == 0], bool)
        counts, mass = answered([r for r in rows if r["kind"] == 1], np.float64)
        counts, words = counts.astype(np.float64), np.unique(np.r_[b.vocabulary, START])
        plain = (counts + ADD) / (total + ADD * (distinct + 1))
        left = np.where(counts > 0, 1 - mass / np.maximum(counts, 1), 1.0)  # weight of each state's failure arc
        w, h = np.searchsorted(words, b.tokens), np.searchsorted(words, b.before)
        arcs = arc_counts[np.unique(pair_keys(b.before, b.tokens), return_inverse=True)[1]]
        hit = arcs > 0
        p = left[h] * plain[w]
        p[hit] += (arcs[hit] - DISCOUNT) / counts[h[hit]]
        ends = np.cumsum(b.lengths) - b.lengths
        add = lambda x: np.add.reduceat(x, ends)
        ids = unpack(row["ids"], np.int64)
        n = len(b.lengths)
        return pa.table({
            "doc_id": pa.array(ids[:n], pa.int64(), mask=ids[n:] == 0), "held_out": b.held, "n_tokens": b.lengths,
            "n_known": add((counts[w] > 0).astype(np.int64)), "train_tokens": np.full(n, total, np.int64),
            "base_score": add(np.log10(plain)[w]), "score": add(np.log10(p))})
    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = given.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    buckets = math.ceil(blocks / BLOCKS_A_BUCKET)
    dealt = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    # Each step's shuffle files go before the next one makes its own.
    blobs = settled(dealt.groupBy("block").applyInArrow(block_blob, BLOB), "blocks")
    spread = blobs.mapInArrow(pair_entries(buckets), ENTRIES)
    pairs = settled(spread.groupBy("bucket").applyInArrow(merge_pairs, ENTRIES), "pairs")
    words = blobs.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(word_entries(buckets), ENTRIES)
    counted = settled(words.groupBy("bucket").applyInArrow(merge_words, ENTRIES), "words")
    sums = [unpack(bytes(r["counts"]), np.int64) for r in counted.filter("block = -1").select("counts").toLocalIterator()]  # two numbers for each bucket
    total, distinct = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0)
    answers = pairs.withColumn("kind", F.lit(0)).unionByName(counted.filter("block >= 0").withColumn("kind", F.lit(1)))
    return blobs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_block(total, distinct), SCORES)
