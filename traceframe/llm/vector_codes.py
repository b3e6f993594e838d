"""Vector code compression: one codebook per part of a vector, fitted with Drake-Hamerly adaptive bounds.

1. Components become integers, floor(256 x). The codebooks start as the parts of the smallest ids.
2. The first pass measures all entries of every part. It keeps the assigned entry, the ``b`` closest other entries with ordered
   lower bounds on their distances, and one outer bound for all the rest. This state is written with the rows.
3. When entries have moved, each lower bound falls by its entry's movement and the outer bound by the largest one. The distance to
   the assigned entry is measured; entries whose bound lies above it can't win. The few below, a prefix of the ordered
   bounds, are measured; only when the outer bound lies below are all entries measured again.
4. Every decision rests on exact integer distances: bounds are rounded down and movements up, so they only leave out what can't win or tie.
5. ``b`` follows the prefixes that were needed, counted over all rows for each part, and shrinks where fewer entries do.

Sums for the new entries are added up in each task, written beside the rows, and reduced by Spark; only codebooks
(``parts`` x ``entries``) come to the driver.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped. Shorter vectors count as
filled up with zeros to the longest one, and that to a multiple of ``parts``. With fewer rows than entries there are as many entries as
rows; repeated rows count as often as they stand; null ids come last, equal ids in the order of their vectors. Integers too large for
exact floating-point arithmetic take a slower path of the same results; errors beyond 64 bits are null. An empty table
gives an empty table; other columns are ignored."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceframe.llm.folders import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The smallest b, and the share of a part's rows that may need more entries than are kept.
LEAST_NEAR, MORE = 2, 0.01
LIMB = 30
STATE = "assigned binary, near binary, low binary, error bigint, sums binary"


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """_id, _label, _vector of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.filter(x.isNotNull() & fine).select(F.col(vec_id).cast("bigint").alias("_id"), F.col(label).alias("_label"), x.alias("_vector"))


def grid_of(column, dims: int) -> np.ndarray:
    """The vectors as rows of doubles, shorter ones filled up with zeros."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def whole_number(x: float) -> int:
    return math.floor(Fraction(x) * SCALE)


def integers(grid: np.ndarray, wide: bool) -> np.ndarray:
    """floor(256 x): doubles that hold integers, or Python integers."""
    if not wide:
        return np.floor(grid * SCALE)
    return np.array([whole_number(x) for x in grid.ravel().tolist()], object).reshape(grid.shape)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, p) to entries (k, p)."""
    if x.dtype == object:
        return ((x[:, None, :] - book[None]) ** 2).sum(2)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def down(squared: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances."""
    return np.nextafter((np.sqrt(squared) * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def measure(x: np.ndarray, book: np.ndarray, b: int):
    """All entries: the assigned one and its squared distance, the b next ones with bounds, and the bound of the rest."""
    key = squares(x, book) * len(book) + np.arange(len(book))  # the order of ties
    if x.dtype == object:
        best = key.min(1)
        return (best % len(book)).astype(np.uint8), best // len(book), np.zeros((len(x), b), np.uint8), np.zeros((len(x), b), np.float32), np.zeros(len(x), np.float32)
    want = min(b + 2, len(book))
    key = np.sort(np.partition(key, want - 1, axis=1)[:, :want], axis=1)
    far, which = key // len(book), (key % len(book)).astype(np.uint8)
    outer = down(far[:, b + 1]) if want > b + 1 else np.full(len(x), np.inf, np.float32)
    return which[:, 0], far[:, 0], which[:, 1:b + 1], down(far[:, 1:b + 1]), outer


def settle(x, book, assigned, near, low, outer, moved, b):
    """One part's rows after its entries moved by at most ``moved``: as ``measure``, and how many entries each row needed beside its own
    (b + 1: all)."""
    kept = near.shape[1]
    rows, k = np.arange(len(x)), len(book)
    low = low - moved[near].astype(np.float32) * np.float32(1 + 1e-6)
    order = np.argsort(low, axis=1, kind="stable")
    near, low = near[rows[:, None], order], np.nextafter(low[rows[:, None], order], np.float32(-np.inf))
    outer = np.nextafter(outer - np.float32(moved.max(initial=0)) * np.float32(1 + 1e-6), np.float32(-np.inf))
    if b < kept:
        outer, near, low = np.minimum(outer, low[:, b]), near[:, :b].copy(), low[:, :b].copy()
    own = ((x - book[assigned]) ** 2).sum(1)
    reach = np.sqrt(own) * (1 + 1e-12)
    full = outer <= reach
    needed = np.where(full, b + 1, (low <= reach[:, None]).sum(1))
    best, place = own * k + assigned, np.full(len(x), -1)
    for c in range(b):
        r = np.flatnonzero((needed > c) & ~full)
        if not len(r):
            break
        far = ((x[r] - book[near[r, c]]) ** 2).sum(1)
        low[r, c] = down(far)
        key = far * k + near[r, c]
        wins = key < best[r]
        best[r[wins]], place[r[wins]] = key[wins], c
    r = np.flatnonzero(place >= 0)  # the old entry takes the place of the new one
    near[r, place[r]], low[r, place[r]] = assigned[r], down(own[r])
    assigned, error = (best % k).astype(np.uint8), best // k
    r = np.flatnonzero(full)
    if len(r):
        assigned[r], error[r], near[r], low[r], outer[r] = measure(x[r], book, b)
    order = np.argsort(low, axis=1, kind="stable")
    return assigned, error, near[rows[:, None], order], low[rows[:, None], order], outer, needed


def packed_sums(sums: list, counts: np.ndarray, needed: np.ndarray) -> bytes:
    """Sums as limbs of 30 bits, so that Spark can add them up whatever their size."""
    values = [v for part in sums for v in part]
    limbs = max(1, max((abs(v).bit_length() for v in values), default=0) // LIMB + 1)
    table = [[(-1 if v < 0 else 1) * (abs(v) >> LIMB * j & (1 << LIMB) - 1) for j in range(limbs)] for v in values]
    return np.r_[limbs, counts.size, len(values), counts.ravel(), needed.ravel(), np.array(table, np.int64).ravel()].astype(np.int64).tobytes()


def opened_sums(batches):
    """kind, place, limb, value of the tasks' sums. Kinds: counts, needed prefixes, sums of components."""
    for batch in batches:
        for cell in batch.column(0).to_pylist():
            limbs, n, m, *_ = head = np.frombuffer(cell, np.int64)
            body, more = head[3:], len(head) - 3 - n - m * limbs
            kind = np.repeat([0, 1, 2], [n, more, m * limbs])
            place = np.r_[np.arange(n), np.arange(more), np.repeat(np.arange(m), limbs)]
            limb = np.r_[np.zeros(n + more, np.int64), np.tile(np.arange(limbs), m)]
            some = body != 0
            yield pa.RecordBatch.from_arrays([pa.array(v[some].astype(np.int64)) for v in (kind, place, limb, body)], names=["kind", "place", "limb", "value"])


def assignment(books: np.ndarray, dims: int, wide: bool, near: list[int], before: list[int] | None, moved: np.ndarray | None, last: bool):
    """The task of one pass. near: b of each part; before: b of each part in the state that is read (none in the first pass)."""
    parts, k, p = books.shape

    def run(batches):
        counts, needed = np.zeros((parts, k), np.int64), np.zeros((parts, k + 2), np.int64)
        sums = np.zeros((parts, k, p), object if wide else np.int64)
        names = None
        for batch in batches:
            names = batch.schema
            n = batch.num_rows
            x = integers(grid_of(batch.column("_vector"), dims), wide).reshape(n, parts, p)
            codes, total = np.zeros((n, parts), np.uint8), np.zeros(n, object if wide else np.float64)
            nears, lows = [], []
            if before is not None and not wide:
                read = lambda name, kind, width: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, width)
                old, old_near, old_low = read("assigned", np.uint8, parts), read("near", np.uint8, sum(before)), read("low", np.float32, sum(before) + parts)
            at = 0
            for i in range(parts):
                y = np.ascontiguousarray(x[:, i])
                if before is None or wide:
                    a, error, ids, low, outer = measure(y, books[i], near[i])
                else:
                    to = at + before[i]
                    a, error, ids, low, outer, used = settle(
                        y, books[i], old[:, i], old_near[:, at:to], old_low[:, at + i:to + i], old_low[:, to + i], moved[i], near[i])
                    needed[i] += np.bincount(used, minlength=k + 2)
                    at = to
                codes[:, i] = a
                total += error
                nears.append(ids)
                lows += [low, outer[:, None]]
                counts[i] += np.bincount(a, minlength=k)
                if not last:
                    if wide:
                        np.add.at(sums[i], a, y)
                    else:
                        sums[i] += np.stack([np.bincount(a, y[:, c], k) for c in range(p)], 1).astype(np.int64)
            raw = lambda table: pa.array([r.tobytes() for r in table], pa.binary())
            errors = pa.array([int(e) if e < 1 << 63 else None for e in total.tolist()], pa.int64())
            state = [pa.nulls(n, pa.binary())] * 2 if last else [raw(np.hstack(nears)), raw(np.hstack(lows).astype(np.float32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.nulls(n, batch.schema.field("_vector").type) if last else batch.column("_vector"),
                 raw(codes), *state, errors, pa.nulls(n, pa.binary())],
                names=["_id", "_label", "_vector", "assigned", "near", "low", "error", "sums"])
        if names is not None and not last:
            cell = packed_sums([[int(v) for v in s.ravel()] for s in sums], counts, needed)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, names.field(c).type) for c in ("_id", "_label", "_vector")] + [pa.nulls(1, pa.binary())] * 3
                + [pa.nulls(1, pa.int64()), pa.array([cell], pa.binary())],
                names=["_id", "_label", "_vector", "assigned", "near", "low", "error", "sums"])
    return run


def moved_books(books: np.ndarray, state: DataFrame):
    """The next codebooks, a bound of each entry's movement, and for each part how many rows needed how many entries."""
    parts, k, p = books.shape
    found = state.filter("sums IS NOT NULL").select("sums").mapInArrow(opened_sums, "kind bigint, place bigint, limb bigint, value bigint").groupBy(
        "kind", "place", "limb").agg(F.sum("value").alias("value")).collect()
    counts, needed, sums = np.zeros(parts * k, np.int64), np.zeros(parts * (k + 2), np.int64), [0] * books.size
    for kind, place, limb, value in found:
        if kind == 0:
            counts[place] = value
        elif kind == 1:
            needed[place] = value
        else:
            sums[place] += value << LIMB * limb
    after = np.array([v if counts[j // p] == 0 else s // int(counts[j // p]) for j, (v, s) in enumerate(zip((int(b) for b in books.ravel()), sums, strict=True))], object)
    shift = [sum((int(u) - int(v)) ** 2 for u, v in zip(x, y, strict=True)) for x, y in zip(after.reshape(-1, p), books.reshape(-1, p), strict=True)]
    after = after.reshape(books.shape)
    bound = np.array([math.sqrt(min(s, 1 << 200)) * (1 + 1e-12) for s in shift]).reshape(parts, k)  # larger ones only on the slower path
    return after.astype(books.dtype), bound, needed.reshape(parts, k + 2)


def adapted(near: list[int], needed: np.ndarray) -> list[int]:
    """b for the next pass: as few entries as all but a small share of the rows that the list settled needed."""
    out = []
    for b, counts in zip(near, needed, strict=True):
        beyond = np.cumsum(counts[:b + 1][::-1])[::-1]  # rows that needed at least so many, of those settled by the list
        enough = next((j for j in range(b) if beyond[j + 1] <= MORE * counts.sum()), b) if counts.sum() else b
        out.append(min(b, max(enough, LEAST_NEAR)))
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """The codebooks and the last assignments (_id, _label, assigned, error); None for a table without rows."""
    spark = rows.sparkSession
    size = rows.agg(F.max(F.size("_vector")), F.max(F.array_max(F.transform("_vector", lambda c: F.abs(c.cast("double")))))).first()
    if size[0] is None:
        return None
    p = max(1, -(-size[0] // parts))
    dims, most = p * parts, abs(whole_number(-(size[1] or 0.0)))
    wide = p * (2 * most) ** 2 * entries >= 1 << 52
    first = rows.select("_id", "_vector").orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).toArrow().column("_vector").combine_chunks()
    books = np.ascontiguousarray(integers(grid_of(first, dims), wide).reshape(-1, parts, p).transpose(1, 0, 2))
    near, before, moved, given = [min(max(LEAST_NEAR, entries // 8), books.shape[1] - 1)] * parts, None, None, rows
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"_id bigint, _label {kinds['_label']}, _vector {kinds['_vector']}, {STATE}"
    for r in range(rounds + 1):
        last = r == rounds
        path = scratch(spark, f"codes{r}")
        given.mapInArrow(assignment(books, dims, wide, near, before, moved, last), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        given, before = state.filter("sums IS NULL").drop("error", "sums"), near
        if not last:
            books, moved, needed = moved_books(books, state)
            near = adapted(near, needed)
    return books, state.select("_id", "_label", "assigned", "error")


def codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row kept: vec_id, code, error, label_error, codebooks_sha256."""
    found = fit(usable(vectors, vec_id, vector, label))
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books, rows = found
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    # A sum that misses an error of over 64 bits, or is longer itself, is null.
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(19,0)")))
    totals = rows.groupBy("_label").agg(total.alias("total")).select(
        F.col("_label").alias("_of"), F.expr("try_cast(total AS bigint)").alias("label_error"))
    return rows.join(totals, F.col("_label").eqNullSafe(F.col("_of")), "left").select(
        F.col("_id").alias("vec_id"), F.lower(F.hex("assigned")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
