"""Approximate nearest neighbours by largest inner product: NN-descent builds a neighbour graph, queries search it greedily.

1. Equal vectors become one node with its smallest ids, so that a vector that very many rows share is one node. Nodes are scaled by the
   largest norm and filled up to unit length with one more component, which turns the largest inner product into the
   smallest angle; the graph works on these units in half precision.
2. Nodes are numbered along signs of hyperplanes between sampled vectors. Every run of neighbouring numbers, and every run of a
   second, random order, gives each node its first list of ``K`` neighbours.
3. A round of NN-descent joins neighbours of neighbours. Lists meet their reverse lists (a fresh sample of up to ``K`` each round, which
   is the method's own), the wanted vectors come once for each block of nodes by an equi-join, and all pairs of a node's
   members with a new link are compared. Nodes are numbered without gaps and a block is a run of numbers, so blocks do not depend on partitions: there are
   ``BLOCKS`` of them up to ``BLOCKS * BLOCK`` nodes, so a vector goes to at most that many; above that, blocks have ``BLOCK`` nodes and each wants at most
   ``2 * K`` vectors a node. Pairs better than the worst entry of a list update it, merged by block. Rounds end
   when few entries are new.
4. The search graph holds the best links of every node and the best ones that lead to it. Queries keep a pool of the ``POOL`` best nodes
   found. Each round expands the best ``EXPAND`` nodes not expanded before, by joins with
   the graph, until every pool is expanded.
5. Pools are measured again on the original vectors in double precision and opened into rows.

No step needs memory that grows with the table: tasks hold blocks, and nothing but counts, the largest norm and ``SAMPLE`` vectors
comes to the driver.

Defined results: null ids, and vectors that are null, zero or hold null or non-finite components take no part, neither as queries nor as
candidates. Equal rows count once; rows that share an id but not the vector are queries of their own and never each other's
candidates. Shorter vectors count as filled up with zeros. An empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from traceframe.llm.folders import scratch
from traceframe.llm.vector_codes import grid_of
from traceframe.operators.keyed import salted_lookup, top_n

#: Entries of a list, nodes of a run, the least number of blocks and the most nodes of one, the share of new entries at which rounds end, and their bound.
K, RUN, BLOCKS, BLOCK, FEW_NEW, MOST_ROUNDS = 48, 2048, 16, 4096, 0.05, 15
POOL, EXPAND, DEGREE = 96, 24, 32
SAMPLE, PLANES = 64, 32
NODES_A_PARTITION, MOST_PARTITIONS = 3500, 20_000
LIST = "nb array<bigint>, sc array<float>"


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, vector of the rows that take part, each once; negative zeros become zeros."""
    x, kind = F.col(vector), dict(vectors.dtypes)[vector]
    one = lambda c: c.cast("double")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(one(c)) & (F.abs(one(c)) < float("inf"))) & F.exists(x, lambda c: one(c) != 0)
    return vectors.filter(x.isNotNull() & F.col(vec_id).isNotNull() & fine).select(
        F.col(vec_id).cast("bigint").alias("id"), F.transform(x, lambda c: one(c) + F.lit(0.0)).cast(kind).alias("vector")).distinct()


def hash_key() -> list:
    return [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), F.col("vector")).alias("h2")]


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """vector, ids: the distinct vectors with their smallest ids in order."""
    first = top_n(rows, ["vector"], [F.col("id")], ids)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def units(column, dims: int, largest: float, norm: float) -> np.ndarray:
    """The vectors scaled to norms of at most one, with a last component that makes it one."""
    x = grid_of(column, dims) / largest / norm
    rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
    return np.c_[x, rest].astype(np.float16)


def cells(grid: np.ndarray) -> pa.Array:
    """Rows of an array as binary cells."""
    raw = np.ascontiguousarray(grid)
    width = raw.shape[1] * raw.itemsize
    bounds = np.arange(len(raw) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


#: Rows of unions that lack a column hold an empty value there: Spark's Arrow writer goes back over a run of nulls for every row.
NO_BYTES, NO_IDS, NO_SCORES, NO_FLAGS = (
    lambda: F.lit(bytearray()), lambda: F.array().cast("array<bigint>"), lambda: F.array().cast("array<float>"), lambda: F.array().cast("array<boolean>"))


def filled(column) -> np.ndarray:
    return pc.greater(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def grid_from(column, kind) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def lists(bounds: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def opened(column):
    """Row numbers and values of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds = np.asarray(column.offsets)
    return np.repeat(np.arange(len(column)), np.diff(bounds)), column.flatten().to_numpy(zero_copy_only=False)


def best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int):
    """Places of the k best distinct others of each owner, owners in order, best first; of equal pairs the first one counts."""
    if not len(owner):
        return np.zeros(0, np.int64)
    order = np.lexsort((other, owner))
    same = np.r_[False, (owner[order][1:] == owner[order][:-1]) & (other[order][1:] == other[order][:-1])]
    kept = order[~same]
    kept = kept[np.lexsort((other[kept], -score[kept], owner[kept]))]
    own = owner[kept]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return kept[rank < k]


def runs_of(batches, size: int = RUN):
    """The rows of a partition in runs of ``size``, the last ones a half to one and a half times as long, if there are as many."""
    held = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= 2 * size:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table.slice(0, size)
            held = table.slice(size).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        cut = table.num_rows if table.num_rows <= 1.5 * size else table.num_rows // 2
        yield table.slice(0, cut)
        if cut < table.num_rows:
            yield table.slice(cut)


def first_lists(unit: np.ndarray, idx: np.ndarray, k: int):
    """The k nearest others of every row inside a run."""
    x = unit.astype(np.float32)
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    k = min(k, len(x) - 1)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(x), 0), np.int64)
    score = np.take_along_axis(near, top, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    bounds = np.arange(len(x) + 1) * k
    return lists(bounds, idx[np.take_along_axis(top, order, 1)].ravel(), pa.int64()), lists(bounds, np.take_along_axis(score, order, 1).ravel(), pa.float32())


def numbered(found: DataFrame, path: str, k: int):
    """Nodes written to ``path``: idx, ids, vector, unit and their first lists nb, sc. Returns their number, too."""
    n, dims, largest = found.agg(
        F.count(F.lit(1)), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda c: F.abs(c.cast("double")))))).first()
    if not n:
        return 0
    norm = found.agg(F.max(F.aggregate(F.transform("vector", lambda c: c.cast("double") / largest), F.lit(0.0), lambda s, c: s + c * c))).first()[0] ** 0.5
    sample = found.orderBy(F.xxhash64("ids"), F.col("ids")[0]).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    anchors = units(sample, dims, largest, norm).astype(np.float32)
    pairs = np.random.default_rng(1).integers(0, len(anchors), (2, PLANES))
    planes = anchors[pairs[0]] - anchors[pairs[1]]
    level = (planes * (anchors[pairs[0]] + anchors[pairs[1]])).sum(1) / 2
    weights = 1 << np.arange(PLANES, dtype=np.int64)[::-1]

    def code(batches):
        for batch in batches:
            unit = units(batch.column("vector"), dims, largest, norm)
            signs = (unit.astype(np.float32) @ planes.T > level) @ weights
            yield pa.RecordBatch.from_arrays(
                [pa.array(signs, pa.int64()), batch.column("ids"), batch.column("vector"), cells(unit)], names=["code", "ids", "vector", "unit"])

    def number(batches):
        at = TaskContext.get().partitionId() << 32
        for table in runs_of(batches):
            idx = np.arange(at, at + table.num_rows)
            at += table.num_rows
            nb, sc = first_lists(grid_from(table.column("unit"), np.float16), idx, k)
            yield from pa.table({"idx": pa.array(idx, pa.int64()), "ids": table.column("ids"), "vector": table.column("vector"),
                                 "unit": table.column("unit"), "nb": nb, "sc": sc}).to_batches()

    kind = dict(found.dtypes)["vector"]
    parts = min(MOST_PARTITIONS, math.ceil(n / NODES_A_PARTITION))
    coded = found.select("ids", "vector").mapInArrow(code, f"code bigint, ids array<bigint>, vector {kind}, unit binary").withColumn("low", F.col("ids")[0])
    dealt = coded.repartitionByRange(parts, "code", "low", F.xxhash64("vector")).sortWithinPartitions("code", "low", F.xxhash64("vector"))
    first = f"{path}-dealt"
    dealt.select("ids", "vector", "unit").mapInArrow(number, f"idx bigint, ids array<bigint>, vector {kind}, unit binary, {LIST}").write.parquet(first)
    without_gaps(found.sparkSession.read.parquet(first)).write.parquet(path)
    return n


def without_gaps(nodes: DataFrame) -> DataFrame:
    """Numbers of the form (partition, place) become places among all nodes, in lists, too. Lists do not leave their partition, and the counts of
    at most ``MOST_PARTITIONS`` partitions come to the driver."""
    part = F.shiftright("idx", 32).cast("int")
    counts = sorted((r["part"], r["count"]) for r in nodes.groupBy(part.alias("part")).count().collect())
    less, before = [], 0
    for at, n in counts:
        less.append((at, (at << 32) - before))
        before += n
    shifts = nodes.sparkSession.createDataFrame(less, "part int, less bigint")
    return nodes.withColumn("part", part).join(F.broadcast(shifts), "part").select(
        (F.col("idx") - F.col("less")).alias("idx"), "ids", "vector", "unit", F.transform("nb", lambda c: c - F.col("less")).alias("nb"), "sc")


def block_of(n: int) -> int:
    """Nodes of a block."""
    return max(1, min(BLOCK, math.ceil(n / BLOCKS)))


def random_lists(nodes: DataFrame, n: int, k: int) -> DataFrame:
    """Updates b, owner, nb, sc: the best of runs in a random order, which link what the planes keep apart."""
    def run(batches):
        for table in runs_of(batches):
            idx = table.column("idx").to_numpy()
            nb, sc = first_lists(grid_from(table.column("unit"), np.float16), idx, k)
            yield from pa.table({"idx": table.column("idx"), "nb": nb, "sc": sc}).to_batches()

    parts = min(MOST_PARTITIONS, math.ceil(n / NODES_A_PARTITION))
    by = F.xxhash64("idx", F.lit(3))
    found = nodes.select("idx", "unit").repartitionByRange(parts, by).sortWithinPartitions(by).mapInArrow(run, f"idx bigint, {LIST}")
    return found.select(block("idx", block_of(n)).alias("b"), F.array_repeat("idx", F.size("nb")).alias("owner"), "nb", "sc")


def block(idx: str, size: int):
    return F.expr(f"{idx} div {size}")


def merge(k: int):
    """Lists of one block with their updates: the k best distinct neighbours, new ones marked."""
    def run(table: pa.Table) -> pa.Table:
        node = filled(table.column("unit"))
        ids = table.column("idx").to_numpy()
        own = np.sort(ids[node])
        row, nb = opened(table.column("nb"))
        _, sc = opened(table.column("sc"))
        old = node[row]
        owner = ids[row]
        owner[~old] = opened(table.column("owner"))[1]
        order = np.argsort(~old, kind="stable")  # entries of the lists stand before the updates
        owner, other, score, fresh = np.searchsorted(own, owner)[order], nb[order], sc[order], ~old[order]
        top = best(owner, other, score, k)
        bounds = np.searchsorted(owner[top], np.arange(len(own) + 1))
        units_of = table.column("unit").filter(pa.array(node)).combine_chunks().take(pa.array(np.argsort(ids[node], kind="stable")))
        return pa.table({"idx": pa.array(own), "unit": units_of, "nb": lists(bounds, other[top], pa.int64()), "sc": lists(bounds, score[top], pa.float32()),
                         "fresh": lists(bounds, fresh[top], pa.bool_())})
    return run


def merged(graph: DataFrame, updates: DataFrame, k: int, path: str, size: int) -> DataFrame:
    """The graph with its updates (b, owner, nb, sc: parallel lists for nodes of one block), written to ``path``."""
    both = graph.select(block("idx", size).alias("b"), "idx", "unit", NO_IDS().alias("owner"), "nb", "sc").unionByName(
        updates.select("b", F.lit(-1).cast("bigint").alias("idx"), NO_BYTES().alias("unit"), "owner", "nb", "sc"))
    schema = f"idx bigint, unit binary, {LIST}, fresh array<boolean>"
    both.groupBy("b").applyInArrow(merge(k), schema).write.parquet(path)
    return graph.sparkSession.read.schema(schema).parquet(path)


def local_join(k: int, size: int, chunk: int = 64):
    """Compares the members of every node of a block and returns what may improve their lists."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        known = filled(table.column("unit"))
        order = np.argsort(ids[known], kind="stable")
        node = ids[known][order]
        unit = grid_from(table.column("unit").filter(pa.array(known)), np.float16)[order].astype(np.float32)
        least = table.column("least").filter(pa.array(known)).to_numpy()[order]
        part = table.filter(table.column("home"))
        row, nb = opened(part.column("nb"))
        _, fresh = opened(part.column("fresh"))
        home = np.searchsorted(node, part.column("id").to_numpy())
        own = np.unique(home)
        owner, member = np.r_[home[row], own], np.r_[np.searchsorted(node, nb), own]
        new = np.r_[fresh.astype(bool), np.zeros(len(own), bool)]
        order = np.lexsort((~new, member, owner))
        owner, member, new = owner[order], member[order], new[order]
        first = np.r_[True, (owner[1:] != owner[:-1]) | (member[1:] != member[:-1])]
        owner, member, new = owner[first], member[first], new[first]
        busy = np.isin(owner, owner[new])  # lists without a new link have been compared before
        owner, member, new = owner[busy], member[busy], new[busy]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[start, len(owner)])
        found = []
        for at in range(0, len(start), chunk):
            s, z = start[at:at + chunk], sizes[at:at + chunk]
            lanes = np.arange(z.max())
            valid = lanes < z[:, None]
            place = np.where(valid, s[:, None] + lanes, s[:, None])
            who, isnew = member[place], new[place] & valid
            x = unit[who]
            near = x @ x.transpose(0, 2, 1)
            good = (near > least[who][:, :, None]) & (isnew[:, :, None] | isnew[:, None, :]) & valid[:, :, None] & valid[:, None, :]
            good[:, lanes, lanes] = False
            i, a, c = np.nonzero(good)
            found.append((who[i, a], who[i, c], near[i, a, c]))
            if sum(len(f[0]) for f in found) > 4_000_000:
                found = [shrink(found, k)]
        a, c, s = shrink(found, k)
        owner = node[a]  # in order, so that those of a block stand together
        blocks, bounds = np.unique(owner // size, return_index=True)
        bounds = np.r_[bounds, len(a)]
        return pa.table({"b": pa.array(blocks, pa.int64()), "owner": lists(bounds, owner, pa.int64()), "nb": lists(bounds, node[c], pa.int64()),
                         "sc": lists(bounds, s, pa.float32())})
    return run


def shrink(found: list, k: int):
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    a, c, s = (np.concatenate([f[j] for f in found]) for j in range(3))
    top = best(a, c, s, k)
    return a[top], c[top], s[top]


def round_of(graph: DataFrame, k: int, turn: int, size: int) -> DataFrame:
    """b, owner, nb, sc: updates from one round of joining neighbours of neighbours."""
    links = graph.select(F.col("idx").alias("v"), F.explode(F.arrays_zip("nb", "fresh")).alias("e")).select("v", F.col("e.nb").alias("u"), F.col("e.fresh").alias("fresh"))
    back = top_n(links, ["u"], [F.xxhash64("u", "v", F.lit(turn)), F.col("v")], k)
    least = F.when(F.size("sc") >= k, F.element_at("sc", -1)).otherwise(F.lit(-2.0)).cast("float").alias("least")
    wanted = links.select(block("v", size).alias("b"), "u").unionByName(back.select(block("u", size).alias("b"), F.col("v").alias("u"))).filter(
        F.col("b") != block("u", size)).distinct()
    home = lambda yes: F.lit(yes).alias("home")
    vectors = wanted.join(graph.select(F.col("idx").alias("u"), "unit", least), "u").select(
        "b", F.col("u").alias("id"), home(False), "unit", "least", NO_IDS().alias("nb"), NO_FLAGS().alias("fresh"))
    forward = graph.select(block("idx", size).alias("b"), F.col("idx").alias("id"), home(True), "unit", least, "nb", "fresh")
    backward = back.groupBy("u").agg(F.collect_list(F.struct("v", "fresh")).alias("l")).select(
        block("u", size).alias("b"), F.col("u").alias("id"), home(True), NO_BYTES().alias("unit"), F.lit(0.0).cast("float").alias("least"), F.col("l.v").alias("nb"),
        F.col("l.fresh").alias("fresh"))
    return vectors.unionByName(forward).unionByName(backward).groupBy("b").applyInArrow(local_join(k, size), f"b bigint, owner array<bigint>, {LIST}")


def descend(nodes: DataFrame, n: int, k: int = K) -> DataFrame:
    """The neighbour graph: idx, unit, nb, sc (best first), fresh."""
    spark, size = nodes.sparkSession, block_of(n)
    graph = merged(nodes, random_lists(nodes, n, k), k, scratch(spark, "graph"), size)
    # Entries of the first lists are all new.
    graph = graph.withColumn("fresh", F.transform("nb", lambda _: F.lit(True)))
    for turn in range(MOST_ROUNDS):
        graph = merged(graph, round_of(graph, k, turn, size), k, scratch(spark, "graph"), size)
        new, all_of = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("nb"))).first()
        if new <= FEW_NEW * all_of:
            break
    return graph


def both_ways(graph: DataFrame, degree: int = DEGREE) -> DataFrame:
    """idx, unit, nb: the ``degree`` best links of every node and the ``degree`` best ones that lead to it, so that nodes in nobody's list
    are found, too."""
    links = graph.select("idx", F.posexplode(F.arrays_zip("nb", "sc")).alias("at", "e")).select(
        "idx", "at", F.col("e.nb").alias("other"), F.col("e.sc").alias("score"))
    back = top_n(links, ["other"], [F.col("score").desc(), F.col("idx")], degree).groupBy("other").agg(F.collect_set("idx").alias("back"))
    joined = graph.join(back.withColumnRenamed("other", "idx"), "idx", "left")
    return joined.select("idx", "unit", F.array_union(F.slice("nb", 1, degree), F.coalesce("back", F.array().cast("array<bigint>"))).alias("nb"))


def advance(pool: int, expand: int):
    """One step of the greedy search for a block of queries: measures the neighbours of what was expanded, keeps the best, picks the next."""
    def run(table: pa.Table) -> pa.Table:
        known, asking = filled(table.column("unit")), filled(table.column("query"))
        ids = table.column("id").to_numpy()
        order = np.argsort(ids[known], kind="stable")
        node = ids[known][order]
        unit = grid_from(table.column("unit").filter(pa.array(known)), np.float16)[order][:, :-1].astype(np.float32) if known.any() else None
        asked = table.filter(pa.array(asking))
        q, query = asked.column("id").to_numpy(), grid_from(asked.column("query"), np.float32)
        more = table.filter(pa.array(~known & ~asking))
        row, found = opened(more.column("nb"))
        owner = more.column("id").to_numpy()[row]
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
        start, end = np.searchsorted(owner, q), np.searchsorted(owner, q, "right")
        pools, done, scores = asked.column("nb").to_pylist(), asked.column("done").to_pylist(), asked.column("sc").to_pylist()
        out = []
        for i in range(len(q)):
            old = np.array(pools[i], np.int64)
            fresh = np.setdiff1d(found[start[i]:end[i]], old)
            near = unit[np.searchsorted(node, fresh)] @ query[i] if len(fresh) else np.zeros(0, np.float32)
            who, sc = np.r_[old, fresh], np.r_[np.array(scores[i], np.float32), near]
            seen = np.r_[np.array(done[i], bool), np.zeros(len(fresh), bool)]
            top = np.lexsort((who, -sc))[:pool]
            who, sc, seen = who[top], sc[top], seen[top]
            following = np.flatnonzero(~seen)[:expand]
            seen[following] = True
            out.append((who.tolist(), sc.tolist(), seen.tolist(), who[following].tolist()))
        kinds = [pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        columns = [pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)]
        return pa.table([asked.column("id"), asked.column("query"), *columns], names=["id", "query", "nb", "sc", "done", "next"])
    return run


def search(graph: DataFrame, queries: DataFrame, n: int, pool: int = POOL, expand: int = EXPAND) -> DataFrame:
    """id (a query's node), nb, sc: the pools, for queries (id, query: the direction as binary floats)."""
    spark = graph.sparkSession
    schema = f"id bigint, query binary, {LIST}, done array<boolean>, next array<bigint>"
    own = F.array(F.col("id"))
    state = queries.select("id", "query", own.alias("nb"), F.array(F.lit(float("-inf")).cast("float")).alias("sc"), F.array(F.lit(True)).alias("done"), own.alias("next"))
    b = block("id", 2 * block_of(n)).alias("b")
    while True:
        ahead = state.select("id", F.explode("next").alias("u")).join(graph.select(F.col("idx").alias("u"), "nb"), "u").select(b, "id", "nb")
        wanted = ahead.select("b", F.explode("nb").alias("u")).distinct()
        rest = (NO_SCORES().alias("sc"), NO_FLAGS().alias("done"))
        vectors = wanted.join(graph.select(F.col("idx").alias("u"), "unit"), "u").select(
            "b", F.col("u").alias("id"), "unit", NO_BYTES().alias("query"), NO_IDS().alias("nb"), *rest)
        asked = state.select(b, "id", NO_BYTES().alias("unit"), "query", "nb", "sc", "done")
        lines = ahead.select("b", "id", NO_BYTES().alias("unit"), NO_BYTES().alias("query"), "nb", *rest)
        path = scratch(spark, "pools")
        asked.unionByName(lines).unionByName(vectors).groupBy("b").applyInArrow(advance(pool, expand), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if state.filter(F.size("next") > 0).limit(1).count() == 0:
            return state.select("id", "nb")


def directions(batches):
    """id, query of nodes: their original vectors with norm one."""
    for batch in batches:
        column = batch.column("vector")
        x = grid_of(column, batch.column("dims")[0].as_py()) if batch.num_rows else np.zeros((0, 0))
        x = x / np.abs(x).max(1, keepdims=True)
        yield pa.RecordBatch.from_arrays([batch.column("idx"), cells((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32))], names=["id", "query"])


def exact_score():
    """The inner product of the columns x and y, in double precision."""
    products = F.zip_with("x", "y", lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows_path, class_path, path = (scratch(spark, name) for name in ("vectors", "classes", "nodes"))
    rows = usable(vectors, vec_id, vector)
    rows.write.parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    classes(rows, top + 1).write.parquet(class_path)
    n = numbered(spark.read.parquet(class_path), path, K)
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    nodes = spark.read.parquet(path)
    searched = scratch(spark, "links")
    both_ways(descend(nodes, n)).write.parquet(searched)
    graph = spark.read.parquet(searched)
    asked = rows.filter(F.col("id") % every == 0).select("id", *hash_key())
    members = asked.join(nodes.select("idx", *hash_key()), ["h1", "h2"]).select(F.col("id").alias("query_id"), "idx").checkpoint()
    wanted = members.select("idx").distinct()
    dims = nodes.agg(F.max(F.size("vector"))).first()[0]
    own = nodes.join(wanted, "idx", "left_semi")
    queries = own.select("idx", "vector", F.lit(dims).alias("dims")).mapInArrow(directions, "id bigint, query binary")
    pairs = search(graph, queries, n).select("id", F.explode("nb").alias("idx"))
    measured = pairs.join(nodes.select("idx", "ids", F.col("vector").alias("y")), "idx").join(
        own.select(F.col("idx").alias("id"), F.col("vector").alias("x")), "id").select("id", "ids", exact_score().alias("score"))
    best_of = measured.select("id", "score", F.explode("ids").alias("vec_id")).groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, top + 1).alias("found"))
    results = salted_lookup(members, best_of.withColumnRenamed("id", "idx"), ["idx"], "inner", ["query_id"], 8)
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, top)
    return results.select("query_id", F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.less")).alias("score"))
