"""Near-duplicate detection with bottom-k sketches of one hash function.

1. Each text becomes its set of five-word shingles; equal sets become one class with a sketch, its ``SKETCH`` smallest
   hash values.
2. Document frequencies of retained values give a global order, rare values first. Classes with similarity of at least
   the threshold differ in few retained values, so each class is filed under its first values only
   (prefix filter); values that occur once need no list, and a class with enough of them has no partner.
3. In each inverted list every class meets the list's leader, the class whose values are the most frequent: the original
   of a family of copies. Lists whose members are then all connected are done. In the others, members of
   different components meet in blocks inside tasks, until nothing is left. No list emits all its pairs.
4. The sketch of the union estimates the similarity of a pair, and the parities of two sets (a bit for each place: whether it holds an odd number
   of values) differ in no more places than the sets in values, so that no link is lost by them; what may reach the threshold is verified on full sets.
   One text of each class that has candidates is written packed, which takes a third of its set's size; the pairs carry packed texts, and tasks make the sets of them.

Sets whose partners have at most ``SKETCH`` shingles (up to 40 shingles at 85, 38 at 80) lose no link; of larger ones a link is lost
with a probability of at most ``LOSS``: of the 48 smallest values of the union at most 7.2 are not in both sets on average (9.6 at 80), 24 (27) are
allowed, and prefix and estimates rest on that one bound. Shingles are compared by 64-bit hashes.

Defined results: null and empty texts have no shingles and are alone; equal texts are one class; repeated ids
are one document with several texts; null ids never stand for a component unless all are null; an empty table gives an
empty table; other columns are ignored."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceframe.llm.folders import settled, shared_folder
from traceframe.llm.hashing import shingles, slices, word_hashes

SKETCH = 48
LOSS = 1e-8
BROADCAST_CLASSES = 500_000
THRESHOLD = 85
BLOCK, TABLE_ROWS = 256, 20_000
PAIRS_AT_ONCE, PARITIES_AT_ONCE, MEETINGS_AT_ONCE = 64, 1 << 20, 1 << 19
NO_VALUE = np.uint64((1 << 64) - 1)
PARITY_BITS = 16  # parities have a place for each value, up to 2 ** PARITY_BITS places
SET_SCHEMA = "doc_id bigint, n_shingles bigint, cls binary, sketch array<bigint>, parity binary"


def sets_of(data: np.ndarray, bounds: np.ndarray):
    """The set of each text, in order."""
    words, _, _, first = word_hashes(data, bounds)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        yield np.unique(shingles(words[lo:hi]))


def class_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def shingle_sets(batches):
    for part, data, bounds in slices(batches, 2 << 20):
        sizes, classes, sketches, odd = [], [], [], []
        for own in sets_of(data, bounds):
            sizes.append(len(own))
            classes.append(class_of(own))
            sketches.append(own[:SKETCH].view(np.int64))
            odd.append(parity_of(own).tobytes())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(odd, pa.binary())],
            names=["doc_id", "n_shingles", "cls", "sketch", "parity"])


def parity_of(own: np.ndarray) -> np.ndarray:
    """A bit for each place, set where an odd number of the set's values lie. Places are powers of two, so that a longer parity folds
    to a shorter one."""
    places = 1 << min(max(len(own) - 1, 63).bit_length(), PARITY_BITS)
    odd = np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def close(parities: list[np.ndarray], p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of rows (p, q) may reach the threshold by their parities and the sizes of their sets (n, m). Linked sets differ in at
    most (100 - threshold) / (100 + threshold) of n + m values, and their parities in no more places."""
    words = np.array([len(x) for x in parities], np.int64)
    least, keep = np.minimum(words[p], words[q]), np.zeros(len(p), bool)
    for w in np.unique(least).tolist():
        mine = np.flatnonzero(least == w)
        rows, at = np.unique(np.r_[p[mine], q[mine]], return_inverse=True)
        grid = np.stack([np.bitwise_xor.reduce(parities[r].reshape(-1, w), axis=0) for r in rows.tolist()])
        one, other, step = at[:len(mine)], at[len(mine):], max(1, PARITIES_AT_ONCE // w)
        for k in range(0, len(mine), step):
            differ = np.bitwise_count(grid[one[k:k + step]] ^ grid[other[k:k + step]]).sum(1, dtype=np.int64)
            some = mine[k:k + step]
            keep[some] = (100 + threshold) * differ <= (100 - threshold) * (n[some] + m[some])
    return keep


def packed_texts(batches):
    for _, data, bounds in slices(batches, 2 << 20):
        classes = [class_of(own) for own in sets_of(data, bounds)]
        texts = [zlib.compress(data[lo:hi], 1) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(texts, pa.binary())], names=["cls", "packed"])


def unpacked(packed: dict, known: dict) -> dict:
    """The sets of packed texts by class; those that are known are not made again."""
    new = [c for c in packed if c not in known]
    texts = [zlib.decompress(packed[c]) for c in new]
    data = np.frombuffer(b"".join(texts), np.uint8)
    made = dict(zip(new, sets_of(data, np.cumsum([0, *map(len, texts)])), strict=True))
    return {c: made[c] if c in made else known[c] for c in packed}


def loss_of(prefix: int, threshold: int) -> float:
    """Bound of the probability that ``prefix`` or more of the ``SKETCH`` smallest values of the union of two linked sets are not
    in both. Else the sketches, too, have more than ``SKETCH - prefix`` values in common."""
    one = threshold / 100
    return math.fsum(math.comb(SKETCH, k) * (1 - one) ** k * one ** (SKETCH - k) for k in range(prefix, SKETCH + 1))


def prefix_of(threshold: int) -> int:
    """The shortest prefix that loses a link with a probability of at most ``LOSS``."""
    return next(p for p in range(1, SKETCH + 2) if loss_of(p, threshold) <= LOSS)


def least_common(threshold: int) -> int:
    """Common values of whole sketches of linked sets; of shorter ones the same share."""
    return SKETCH + 1 - prefix_of(threshold)


def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs may reach the threshold by the sizes of their sets (n, m) and the sketches of their unions. Rows of x and y: sketches of unsigned
    numbers, filled up with ``NO_VALUE``."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    real = both != NO_VALUE
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    place = np.cumsum(real & ~again, axis=1)
    common = (again & (place <= SKETCH)).sum(1)
    union = np.minimum(place[:, -1], SKETCH)
    return (SKETCH * common >= least_common(threshold) * union) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))


def filled_up(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches as rows of equal length."""
    grid = np.full((len(sizes), SKETCH), NO_VALUE, np.uint64)
    grid[np.arange(SKETCH) < sizes[:, None]] = values.view(np.uint64)
    return grid


def parities(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def flat(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - np.asarray(column.offsets)[0]


def links_of(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Verified pairs (a, b): first the estimates from sketches and parities, then the full sets of the pairs that are left."""
    least = least_common(threshold)
    side = lambda df, key, value, name: df.select(F.col("cls").alias(key), F.col(value).alias(name))

    def estimate(batches):
        for batch in batches:
            (x, at), (y, to) = (flat(batch.column(c)) for c in ("x", "y"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            keep = alike(filled_up(x, np.diff(at)), filled_up(y, np.diff(to)), n, m, threshold)
            own, k = parities(batch.column("v")) + parities(batch.column("w")), np.arange(batch.num_rows)
            keep &= close(own, k, k + batch.num_rows, n, m, threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = (sketches.select(F.col("cls").alias(key), F.col("sketch").alias(x), F.col("n_shingles").alias(n), F.col("parity").alias(v))
                  for key, x, n, v in (("a", "x", "n", "v"), ("b", "y", "m", "w")))
    likely = settled(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y", "n", "m", "v", "w").mapInArrow(estimate, "a binary, b binary"), "likely")
    if 2 * likely.count() <= BROADCAST_CLASSES:  # only the texts of these pairs are moved
        sets = sets.join(F.broadcast(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "cls", "left_semi")

    def verify(batches):
        known: dict = {}
        for batch in (b.slice(at, PAIRS_AT_ONCE) for b in batches for at in range(0, b.num_rows, PAIRS_AT_ONCE)):
            keep = []
            ours, others, left, right = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            known = unpacked(dict(zip(ours + others, left + right, strict=True)), known)
            for x, y in zip(map(known.get, ours), map(known.get, others), strict=True):
                union = np.union1d(x[:SKETCH], y[:SKETCH])[:SKETCH]
                both = np.isin(union, x[:SKETCH], assume_unique=True) & np.isin(union, y[:SKETCH], assume_unique=True)
                if SKETCH * both.sum() < least * len(union):
                    keep.append(False)
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= threshold * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = likely.join(side(sets, "a", "packed", "x"), "a").join(side(sets, "b", "packed", "y"), "b")
    return full.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """cls, root: the smallest class of each component, by label spreading with pointer jumping over written tables."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settled(both, "edges")
    labels = settled(nodes.select("cls", F.col("cls").alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.cls).groupBy("a").agg(F.min("root").alias("low"))
        moved = labels.join(near, labels.cls == near.a, "left").select("cls", F.least("root", "low").alias("root"), F.col("root").alias("old"))
        jump = moved.select(F.col("cls").alias("root"), F.col("root").alias("up"))
        after = settled(moved.join(jump, "root", "left").select("cls", F.least("root", "up").alias("root"), "old"), "labels")
        if after.filter(F.col("root") != F.col("old")).limit(1).count() == 0:
            return after.select("cls", "root")
        labels = after.select("cls", "root")


def prefix_values(classes: DataFrame, threshold: int) -> DataFrame:
    """value, cls, pop: the values a class is filed under. pop: the sum of the frequencies of its values."""
    rows = classes.select("cls", F.explode("sketch").alias("value"))
    shared = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    mine = rows.join(shared, "value").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v")).join(
        classes.select("cls", "n_shingles"), "cls")
    kept = F.least("n_shingles", F.lit(SKETCH))
    exact = F.col("n_shingles") - F.ceil(F.col("n_shingles") * threshold / 100) + 1
    allowed = F.least(kept, F.when(F.col("n_shingles") <= SKETCH * threshold // 100, exact).otherwise(F.greatest(exact, F.lit(prefix_of(threshold))))
                      .cast("bigint"), F.lit(SKETCH))
    take = (allowed - (kept - F.size("v"))).cast("int")
    return mine.withColumn("take", take).filter("take > 0").select(
        "cls", F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x["df"]).alias("pop"), F.explode(F.slice("v", F.lit(1), F.col("take"))["value"]).alias("value"))


def meetings(edge: np.ndarray):
    """All pairs of rows of the same group, in parts; ``edge``: the first row of each group, and the number of rows."""
    own = np.arange(edge[-1])
    behind = np.repeat(edge[1:], np.diff(edge)) - own - 1  # rows that a row still has to meet
    total = np.r_[0, np.cumsum(behind)]
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(total, total[at] + MEETINGS_AT_ONCE, "right")) - 1)
        p = np.repeat(own[at:to], behind[at:to])
        yield p, p + 1 + np.arange(len(p)) - (total[p] - total[at])
        at = to


def rest_pairs(open_rows: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different components that share a list, of all lists that are still open. Members are dealt into
    blocks; each pair of blocks is one task's work, which gives only the pairs whose sizes and parities may reach the threshold."""
    sized = open_rows.join(open_rows.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "value")
    filed = sized.join(open_rows.groupBy("cls").agg(F.sort_array(F.collect_list("value")).alias("lists")), "cls")  # at most SKETCH of a class
    dealt = filed.withColumn("own", F.pmod(F.xxhash64("cls", "value"), F.col("blocks")).cast("int")).join(sketches.drop("sketch"), "cls")
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "root", "n_shingles", "parity", "lists")
    # Pairs of blocks are small; many of them make one task's table.
    rows = open_rows.groupBy("value").count().agg(F.sum(F.col("count") * F.ceil(F.col("count") / BLOCK))).first()[0] or 0
    tables = max(1, math.ceil(rows / TABLE_ROWS))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("value", "ascending"), ("i", "ascending"), ("j", "ascending")])
        value, i, j, own, size = (table.column(c).to_numpy() for c in ("value", "i", "j", "own", "n_shingles"))
        cls = table.column("cls").to_pylist()
        _, root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)
        odd = parities(table.column("parity"))
        filed, to = flat(table.column("lists"))
        edge = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        found: set[tuple] = set()
        for p, q in meetings(edge):
            may = (root[p] != root[q]) & ((i[p] == j[p]) | (own[p] != own[q])) & (100 * np.minimum(size[p], size[q]) >= threshold * np.maximum(size[p], size[q]))
            p, q = p[may], q[may]
            may = close(odd, p, q, size[p], size[q], threshold)
            for x, y in zip(p[may].tolist(), q[may].tolist(), strict=True):
                # A pair is given by the first list that both are filed under, and by no other.
                if np.intersect1d(filed[to[x]:to[x + 1]], filed[to[y]:to[y + 1]], assume_unique=True)[0] == value[x]:
                    found.add((min(cls[x], cls[y]), max(cls[x], cls[y])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    bucket = F.pmod(F.xxhash64("value", "i", "j"), F.lit(tables)).alias("t")
    return spread.select(bucket, "*").groupBy("t").applyInArrow(lambda table: meet(table.drop_columns(["t"])), "a binary, b binary")


def class_texts(given: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """cls, packed: one text of each wanted class (cls, rep), of a row with the id ``rep``. ``few``: the keys go to every task, so that other
    texts are never moved."""
    ids, keys = wanted.select("rep").distinct(), wanted.select("cls")
    ids, keys = (F.broadcast(ids), F.broadcast(keys)) if few else (ids, keys)
    rows = given.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    found = settled(rows.mapInArrow(packed_texts, "cls binary, packed binary").join(keys, "cls", "left_semi"), "texts")
    # Only repeated or null ids give a class more than one row.
    return found if found.count() == wanted.count() else settled(found.dropDuplicates(["cls"]), "texts")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    shared_folder(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = settled(given.mapInArrow(shingle_sets, SET_SCHEMA), "sketches")
    classes = settled(rows.filter("n_shingles > 0").groupBy("cls").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"), F.min("doc_id").alias("rep")), "classes")
    filed = settled(prefix_values(classes, threshold), "filed")
    # The classes that have candidates. Up to BROADCAST_CLASSES keys (of 16 bytes and an id, counted) go to every task; more keys are
    # joined by a shuffle.
    wanted = settled(classes.select("cls", "rep").join(filed.select("cls").distinct(), "cls"), "wanted")
    few = wanted.count() <= BROADCAST_CLASSES
    sets = class_texts(given, wanted, few)
    wanted = wanted.select("cls")
    sketches = classes.select("cls", "sketch", "n_shingles", "parity").join(F.broadcast(wanted) if few else wanted, "cls", "left_semi")
    leaders = filed.groupBy("value").agg(F.max(F.struct("pop", F.col("cls").alias("lead"))).alias("top"))
    stars = filed.join(leaders.select("value", "top.lead"), "value").filter(F.col("cls") != F.col("lead")).select(
        F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
    links = settled(links_of(stars, sketches, sets, threshold), "stars")
    roots = components(links, wanted)
    rooted = filed.join(roots, "cls")
    unfinished = rooted.groupBy("value").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p != q").select("value")
    open_rows = rooted.join(unfinished, "value", "left_semi").select("value", "cls", "root")
    open_rows = settled(open_rows, "open")
    # Pairs and their verification are computed once and written; what follows reads them several times.
    more = settled(rest_pairs(open_rows, sketches, threshold), "pairs")
    roots = components(links.unionByName(settled(links_of(more, sketches, sets, threshold), "links")), wanted)
    named = classes.select("cls", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    names = named.groupBy("root").agg(F.min("rep").alias("component"))
    found = rows.join(named.join(names, "root").select("cls", "component"), "cls", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group with all its columns: the one with the smallest id. Documents without words and rows without an
    id stay; of several rows of one id all stay that have a kept id."""
    gone = near_groups(docs, doc_id, text, threshold).filter("NOT kept AND n_shingles > 0").select("doc_id").distinct()
    ids = gone.select(F.col("doc_id").alias("_gone"))
    return docs.join(ids, F.col(doc_id) == F.col("_gone"), "left_anti")
