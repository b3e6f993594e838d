"""Hierarchical packing into several context sizes.

Every document is tokenised once. Its full windows of the largest tier stand alone; the rest is routed to the smallest
tier (a power of two) that holds it and opens a window there. From the longest tier down, the gaps of a tier's windows,
laid end to end, are filled with the documents of shorter tiers, shortest first, also laid end to end; a
document is cut where a gap ends. When the shorter tiers are used up, the remaining documents of the
tier are laid end to end in its windows. Only the last window of a tier can be short. Step groups get an equal share of
each tier's windows, so that steps hold the same number of tokens.

Positions are running totals: documents are dealt into ``BUCKETS`` hash buckets; only the
totals of (tier, bucket) are summed along the whole table, and they are few whatever the input. Gaps and fillers meet by blocks of
positions, each block in one task; a block holds at most ``BLOCK`` tokens.

Defined results: null and empty texts are the end token alone; repeated rows and null ids are documents of their own, in
the order of their text; an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from traceframe.llm.bpe import KEPT_WORDS, coder
from traceframe.llm.folders import scratch
from traceframe.llm.hashing import slices

TIERS = (2048, 1024, 512, 256)
BUCKETS = 2048
BLOCK = 1 << 16
END_ID = 1
STEP_TOKENS = 64 * 2048


def token_rows(path: str, end_id: int):
    """doc_id, ids (little-endian, two bytes each), n_tokens, order (hash of the text)."""
    def run(batches):
        splitter, bpe = coder(path)
        tokenizer, model = splitter.tokenizer, splitter.tokenizer.model
        end = np.array([end_id], "<u2").tobytes()
        known: dict[str, bytes] = {}  # ids of pieces
        coded: dict[str, bytes] = {}  # ids of words
        for part, _, _ in slices(batches, 2 << 20):
            known, coded = ({} if len(x) > KEPT_WORDS else x for x in (known, coded))
            texts = part.column("text").to_pylist()
            read = [splitter.pieces(t or "") for t in texts]
            for piece in set().union(*[pieces for pieces in read if pieces]) - known.keys():
                words = splitter.words(piece)
                for w in words:
                    if w not in coded:
                        coded[w] = b"".join([t.id.to_bytes(2, "little") for t in model.tokenize(bpe.byte_level(w))])
                known[piece] = coded[words[0]] if len(words) == 1 else b"".join([coded[w] for w in words])
            rows = []
            for text, pieces in zip(texts, read, strict=True):
                if pieces is None:  # unusual characters or special tokens: the library takes the whole text
                    rows.append(np.array([*tokenizer.encode(text, add_special_tokens=False).ids, end_id], "<u2").tobytes())
                else:
                    rows.append(b"".join(map(known.__getitem__, pieces)) + end)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(rows, pa.binary()), pa.array([len(r) // 2 for r in rows], pa.int64()),
                 pa.array([zlib.crc32(r) for r in rows], pa.int64())], names=["doc_id", "ids", "n_tokens", "mark"])
    return run


def placed(rows: DataFrame, size: Column, groups: list[str]) -> DataFrame:
    """Adds at: the running total of ``size`` before a row within ``groups``, and no: its number. Rows are in the order of hash buckets."""
    dealt = rows.withColumns({"_b": F.pmod(F.xxhash64("doc_id", "mark"), F.lit(BUCKETS)).cast("int"), "_s": size})
    inner = Window.partitionBy(*groups, "_b").orderBy("doc_id", "mark", "f", "r").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*groups, "_b").agg(F.sum("_s").alias("_t"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_k"))
    return (
        dealt.withColumns({"_i": F.coalesce(F.sum("_s").over(inner), F.lit(0)), "_j": F.coalesce(F.count(F.lit(1)).over(inner), F.lit(0))})
        .join(F.broadcast(offsets), [*groups, "_b"])  # at most BUCKETS rows for each tier
        .withColumns({"at": (F.col("_o") + F.col("_i")).cast("bigint"), "no": (F.col("_k") + F.col("_j")).cast("bigint")}).drop("_b", "_s", "_i", "_j", "_o", "_k"))


PIECES = "f bigint, r bigint, start bigint, length bigint, tier int, window bigint, offset bigint"
PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def piece_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(PIECE_NAMES, columns, kinds, strict=True)})


def cut_runs(runs: DataFrame) -> DataFrame:
    """Pieces of documents that lie on a line of windows: columns f, r, skip (tokens before the run), take, tier, at
    (position on the line), base (number of the line's first window)."""
    each = runs.filter("take > 0").withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / F.col("tier")), F.floor((F.col("at") + F.col("take") - 1) / F.col("tier")))))
    lo, hi = F.greatest("at", F.col("k") * F.col("tier")), F.least(F.col("at") + F.col("take"), (F.col("k") + 1) * F.col("tier"))
    return each.select(
        "f", "r", (F.col("skip") + lo - F.col("at")).cast("bigint").alias("start"), (hi - lo).cast("bigint").alias("length"), "tier",
        (F.col("base") + F.col("k")).cast("bigint").alias("window"), (lo - F.col("k") * F.col("tier")).cast("bigint").alias("offset"))


def fill_block(gaps: pa.Table, fillers: pa.Table) -> pa.Table:
    """Pieces of one block of positions: gaps (lo, hi, tier, window, first) and fillers (f, r, skip, lo, hi)."""
    if not gaps.num_rows or not fillers.num_rows:
        return piece_table([])
    gaps, fillers = gaps.sort_by("lo").to_pydict(), fillers.sort_by("lo").to_pydict()
    block = gaps["block"][0]
    g, f, rows = 0, 0, []
    while g < len(gaps["lo"]) and f < len(fillers["lo"]):
        lo, hi = max(gaps["lo"][g], fillers["lo"][f], block * BLOCK), min(gaps["hi"][g], fillers["hi"][f], (block + 1) * BLOCK)
        if lo < hi:
            rows.append((fillers["f"][f], fillers["r"][f], fillers["skip"][f] + lo - fillers["lo"][f], hi - lo, gaps["tier"][g], gaps["window"][g],
                         gaps["first"][g] + lo - gaps["lo"][g]))
        if gaps["hi"][g] <= fillers["hi"][f]:
            g += 1
        else:
            f += 1
    return piece_table(rows)


def with_crc(batches):
    """The pieces of each document with the CRC-32 of their ids: columns doc_id, ids, n_tokens, pieces."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for doc_id, ids, n, pieces in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "ids", "n_tokens", "pieces")], strict=True):
            numbers = np.frombuffer(ids, "<u2").astype("<u4")
            for p in pieces:
                crc = zlib.crc32(numbers[p["start"]:p["start"] + p["length"]].tobytes())
                for column, value in zip(out, (doc_id, p["start"], p["length"], crc, n, p["tier"], p["window"], p["offset"]), strict=True):
                    column.append(value)
        kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                         names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tier", "window", "offset"])


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))))


def written_rows(rows: DataFrame, name: str) -> DataFrame:
    """Rows of numbers, written and read again: they are used several times, and plans stay short."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID,
         step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    kept = scratch(spark, "tokens")
    given.mapInArrow(token_rows(path, end_id), "doc_id bigint, ids binary, n_tokens bigint, mark bigint").write.parquet(kept)
    rest = F.col("n_tokens") % tiers[0]
    tier = F.lit(0)
    for t in sorted(tiers, reverse=True):
        tier = F.when(rest <= t, F.lit(t)).otherwise(tier)
    # A written row is known by its file and its place there, so that only numbers move until the ids are joined once.
    written = spark.read.parquet(kept).select("*", F.xxhash64("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r"))
    tokens = written.drop("ids").withColumns({"rest": rest, "tier": F.when(rest > 0, tier).otherwise(F.lit(0)).cast("int")})
    whole = placed(tokens.filter(F.col("n_tokens") >= tiers[0]).withColumn("_g", F.lit(0)), F.floor(F.col("n_tokens") / tiers[0]).cast("bigint"), ["_g"])
    runs = [whole.select("f", "r", F.lit(0).cast("bigint").alias("skip"), (F.col("n_tokens") - F.col("rest")).alias("take"),
                         F.lit(tiers[0]).alias("tier"), (F.col("at") * tiers[0]).alias("at"), F.lit(0).cast("bigint").alias("base"))]
    short = tokens.filter("rest > 0")
    found = {r["tier"]: (r["n"], r["s"]) for r in short.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("s")).collect()}  # a row per tier
    next_window = {t: 0 for t in tiers}
    next_window[tiers[0]] = (tokens.agg(F.sum(F.floor(F.col("n_tokens") / tiers[0]))).first()[0]) or 0
    lines = written_rows(placed(short, F.col("rest"), ["tier"]), "lines")
    line_at = {}  # first position of each tier's documents on the filler line: shortest tier first
    total = 0
    for t in sorted(tiers):
        line_at[t] = total
        total += found.get(t, (0, 0))[1]
    # Longest tier first: its documents open windows while the shorter documents can fill the gaps.
    pieces, placed_lines, used = [], lines, 0
    for t in tiers:
        n, s = found.get(t, (0, 0))
        if n == 0:
            continue
        mine = placed_lines.filter(F.col("tier") == t).withColumn("gone", F.least("rest", F.greatest(F.lit(used - line_at[t]) - F.col("at"), F.lit(0))))
        whole_docs = mine.filter("gone = 0")
        left = max(line_at[t] - used, 0)  # tokens of shorter tiers that are still free
        opened = written_rows(placed(whole_docs.drop("no", "at"), F.lit(t) - F.col("rest"), ["tier"]), "opened")
        opens = (F.col("at") + t - F.col("rest")) <= left
        openers = opened.filter(opens)
        stat = openers.agg(F.count(F.lit(1)).alias("n"), F.sum(t - F.col("rest")).alias("g")).first()
        k, gap = stat["n"], stat["g"] or 0
        runs.append(openers.select("f", "r", (F.col("n_tokens") - F.col("rest")).alias("skip"), F.col("rest").alias("take"),
                                   F.lit(t).alias("tier"), (F.col("no") * t).alias("at"), F.lit(next_window[t]).cast("bigint").alias("base")))
        if gap:
            pieces.append(openers.filter(F.col("rest") < t).select(
                (F.lit(used) + F.col("at")).alias("lo"), (F.lit(used) + F.col("at") + t - F.col("rest")).alias("hi"), F.lit(t).alias("tier"),
                (F.col("no") + next_window[t]).alias("window"), F.col("rest").alias("first")))
        # What cannot open a window with a full gap is laid end to end: the rest of this tier, and of the document that longer tiers cut.
        tail = opened.filter(~opens).select("doc_id", "mark", "f", "r", "n_tokens", "rest", "tier", F.lit(0).cast("bigint").alias("gone"))
        cut = mine.filter((F.col("gone") > 0) & (F.col("gone") < F.col("rest"))).select("doc_id", "mark", "f", "r", "n_tokens", "rest", "tier", "gone")
        laid = placed(tail.unionByName(cut), F.col("rest") - F.col("gone"), ["tier"])
        runs.append(laid.select("f", "r", (F.col("n_tokens") - F.col("rest") + F.col("gone")).alias("skip"), (F.col("rest") - F.col("gone")).alias("take"),
                                F.lit(t).alias("tier"), "at", F.lit(next_window[t] + k).cast("bigint").alias("base")))
        used += gap
    fillers = placed_lines.withColumn("_first", F.col("at") + F.element_at(F.create_map(*[x for t in tiers for x in (F.lit(t), F.lit(line_at[t]))]), F.col("tier")))
    lying = fillers.filter(F.col("_first") < used).select(
        "f", "r", (F.col("n_tokens") - F.col("rest")).alias("skip"), F.col("_first").alias("lo"), F.least(F.col("_first") + F.col("rest"), F.lit(used)).alias("hi"))
    cut_pieces = cut_runs(runs[0])
    for r in runs[1:]:
        cut_pieces = cut_pieces.unionByName(cut_runs(r))
    if pieces:
        gap_rows = pieces[0]
        for p in pieces[1:]:
            gap_rows = gap_rows.unionByName(p)
        filled = in_blocks(gap_rows).groupBy("block").cogroup(in_blocks(lying).groupBy("block")).applyInArrow(fill_block, PIECES)
        cut_pieces = cut_pieces.unionByName(filled)
    # Window w of tier number i has the id w * number of tiers + i; steps deal each tier's windows evenly.
    place = F.element_at(F.create_map(*[x for i, t in enumerate(tiers) for x in (F.lit(t), F.lit(i))]), F.col("tier"))
    tokens_all = total + next_window[tiers[0]] * tiers[0]
    steps = max(1, -(-tokens_all // step_tokens))
    grouped = cut_pieces.groupBy("f", "r").agg(F.collect_list(F.struct("start", "length", "tier", "window", "offset")).alias("pieces"))
    joined = written.join(grouped, ["f", "r"]).select("doc_id", "ids", "n_tokens", "pieces")
    summed = joined.mapInArrow(with_crc, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, tier int, window bigint, offset bigint")
    return summed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("window") * len(tiers) + place).cast("bigint").alias("sequence_id"), "offset",
        "tier", (F.col("window") % steps).cast("bigint").alias("step_id"))
