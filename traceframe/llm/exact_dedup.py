"""Exact deduplication with counting quotient filters.

A document's fingerprint is a 64-bit hash of its text without white space. Every partition builds a counting quotient
filter of its fingerprints: the leading bits of a fingerprint (quotient) name a slot, the other bits
(remainder) are kept sorted inside the slot with their counts. A filter is stored as one row for each block of
consecutive slots. Filters merge without loss: equal blocks meet, and their sorted remainders are merged and their
counts added. Fingerprints counted once are unique documents. Those counted more often
route their documents to verification, which groups by the bytes of the normalised text itself.

Large groups: a hot fingerprint is one remainder with a count in every partial filter; verification aggregates partially,
so a map task sends each distinct text once; the way back is an equi-join that adaptive execution can split.

Defined results: null text is empty; empty texts are equal; ties on code points fall to the smallest doc_id, null last;
repeated rows count as documents of their own; an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from traceframe.llm.columns import text_of, without_space

#: Bits of a fingerprint that name a slot, and those of them that name the block a slot lies in.
QUOTIENT_BITS = 40
BLOCK_BITS = 12
FLUSH_ROWS = 1 << 20
FILTER_SCHEMA = "block int, quotients binary, remainders binary, counts binary"
REMAINDER_BITS = 64 - QUOTIENT_BITS


def filter_rows(prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A counting quotient filter of sorted, distinct fingerprints: a row for each block of slots. The runs of a
    slot are its sorted remainders; the slot numbers are kept in the order of the remainders."""
    blocks = (prints >> np.uint64(64 - BLOCK_BITS)).astype(np.int32)
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.array([], np.int64)
    ends = np.r_[starts[1:], len(blocks)]
    slots = ((prints << np.uint64(BLOCK_BITS)) >> np.uint64(64 - QUOTIENT_BITS + BLOCK_BITS)).astype(np.uint32)
    remainders = (prints & np.uint64((1 << REMAINDER_BITS) - 1)).astype(np.uint32)
    cut = lambda a: [a[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks[starts], pa.int32()), pa.array(cut(slots), pa.binary()), pa.array(cut(remainders), pa.binary()),
         pa.array(cut(counts.astype(np.uint64)), pa.binary())], names=["block", "quotients", "remainders", "counts"])


def prints_of(block: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    slots = np.frombuffer(quotients, np.uint32).astype(np.uint64)
    return (np.uint64(block) << np.uint64(64 - BLOCK_BITS)) | (slots << np.uint64(REMAINDER_BITS)) | np.frombuffer(remainders, np.uint32)


def add_up(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with their summed counts."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    starts = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.array([], np.int64)
    return prints[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def build_filters(batches):
    """Filters of one partition; a filter is closed when it holds FLUSH_ROWS rows, so memory is bounded."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        n += batch.num_rows
        if n >= FLUSH_ROWS:
            yield filter_rows(*add_up(np.concatenate(held), np.ones(n, np.uint64)))
            held, n = [], 0
    if n:
        yield filter_rows(*add_up(np.concatenate(held), np.ones(n, np.uint64)))


def merge_block(rows: pa.Table) -> pa.Table:
    """Merge the filters of one block and give the fingerprints that are counted more than once."""
    rows = rows.to_pydict()
    prints = np.concatenate([prints_of(*x) for x in zip(rows["block"], rows["quotients"], rows["remainders"], strict=True)])
    prints, counts = add_up(prints, np.concatenate([np.frombuffer(x, np.uint64) for x in rows["counts"]]))
    more = counts > 1
    return pa.table({"print": pa.array(prints[more].view(np.int64), pa.int64()), "n": pa.array(counts[more].astype(np.int64), pa.int64())})


def repeated_prints(prints: DataFrame) -> DataFrame:
    """print, n: the fingerprints of a one-column table that occur more than once."""
    filters = prints.mapInArrow(build_filters, FILTER_SCHEMA)
    return filters.groupBy("block").applyInArrow(merge_block, "print bigint, n bigint")


def fingerprint(normal: Column) -> Column:
    return F.xxhash64(normal)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    normal = without_space(text_of(text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), fingerprint(normal).alias("print"), F.length(text_of(text)).alias("n"),
        F.sha2(normal, 256).alias("text_sha256"))
    repeated = repeated_prints(docs.select(fingerprint(normal).alias("print"))).select("print")
    suspects = docs.select(
        F.col(doc_id).alias("doc_id"), fingerprint(normal).alias("print"), F.length(text_of(text)).alias("n"), normal.alias("normal"))
    verified = (
        suspects.join(repeated, "print", "left_semi").groupBy("print", "normal")
        .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("n", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("low"))).alias("best"))
        .select(F.sha2("normal", 256).alias("text_sha256"), (-F.col("best.low")).alias("keep_id"), F.col("best.n").alias("best_n"), "size"))
    joined = rows.join(verified, "text_sha256", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("best_n")))).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of repeated equal rows one stays."""
    normal = without_space(text_of(text))
    keyed = docs.withColumn("_print", fingerprint(normal))
    repeated = repeated_prints(keyed.select("_print")).select(F.col("print").alias("_print"))
    single = keyed.join(repeated, "_print", "left_anti")
    best = F.struct(F.length(text_of(text)), F.col(doc_id).isNotNull(), -F.col(doc_id))
    several = (
        keyed.join(repeated, "_print", "left_semi").withColumn("_normal", normal)
        .groupBy("_print", "_normal").agg(F.max_by(F.struct(*docs.columns), best).alias("_row")))
    return single.select(*docs.columns).unionByName(several.select("_row.*"))
