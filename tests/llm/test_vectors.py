"""Vector codes against plain k-means in Python integers, and nearest neighbours against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from traceframe.llm import neighbour_graph, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string, assigned int, sums string, code string"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    if not kept:
        return []
    p = max(1, -(-max(len(r[1]) for r in kept) // parts))
    whole = [[math.floor(Fraction(c) * 256) for c in r[1]] + [0] * (p * parts - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    out, errors, final = [""] * len(kept), [0] * len(kept), []
    for k in range(parts):
        x = [w[k * p:(k + 1) * p] for w in whole]
        book = [x[i] for i in order]
        for r in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(y, c)), j) for j, c in enumerate(book)) for y in x]
            if r < rounds:
                for j in range(len(book)):
                    own = [y for y, n in zip(x, near) if n[1] == j]
                    if own:
                        book[j] = [sum(c) // len(own) for c in zip(*own)]
        for i, (d, j) in enumerate(near):
            out[i] += f"{j:02x}"
            errors[i] += d
        final += [c for entry in book for c in entry]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()
    short = lambda e: e if e < 1 << 63 else None
    bad = {r[2] for r, e in zip(kept, errors) if short(e) is None}
    return sorted((str(r[0]), c, short(e), None if r[2] in bad else short(sums[r[2]]), digest) for r, c, e in zip(kept, out, errors))


def rows_of(n, dims, seed=1, step=None):
    rng = random.Random(seed)
    value = (lambda: rng.randint(-4, 4) / 128) if step else (lambda: rng.gauss(0, 0.2))
    rows = [(3 * i + 1, [value() for _ in range(dims)], rng.choice(["a", "b", None]), 1, "x", "y") for i in range(n)]
    rows += [rows[0], rows[0], (2, rows[5][1], "c", None, None, None), (None, rows[7][1], "a", None, None, None)]
    odd = [None, [None] + [0.1] * (dims - 1), [math.nan] + [0.1] * (dims - 1), [-math.inf] * dims, [0.0] * dims, [-0.0] * dims]
    return rows + [(10000 + i, v, "d", None, None, None) for i, v in enumerate(odd)]


def got(spark, rows):
    df = vector_codes.codes(spark.createDataFrame(rows, SCHEMA).repartition(4))
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("rows", [
    rows_of(700, 32), rows_of(400, 32, step=True), rows_of(20, 16), rows_of(80, 40) + [(-5, [0.5] * 3, "z", 0, "", ""), (-4, [], "z", 0, "", "")],
    rows_of(90, 16) + [(-9, [1e9] * 16, "a", 0, "", ""), (-8, [1e300, -1.7e308] * 8, "big", 0, "", "")], [(1, None, "a", 1, "", "")], []],
    ids=["plain", "ties", "few rows", "lengths", "huge", "none kept", "empty"])
def test_codes(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_bounds_save_work_and_lists_shrink():
    """Entries that hardly move leave nearly all parts certain; the results stay those of a full search."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 60, (5000, 4)))
    book = np.floor(rng.normal(0, 60, (64, 4)))
    a, error, near, low, outer = vector_codes.measure(x, book, 8)
    after = book + rng.integers(-1, 2, book.shape)
    moved = np.sqrt(((after - book) ** 2).sum(1))
    for b in (8, 3):
        new, far, ids, bounds, rest, needed = vector_codes.settle(x, after, a, near, low, outer, moved, b)
        want = vector_codes.measure(x, after, b)
        assert (new == want[0]).all() and (far == want[1]).all()
        true = np.sqrt(vector_codes.squares(x, after))
        assert (bounds <= true[np.arange(5000)[:, None], ids]).all() and (np.diff(bounds) >= 0).all()
        true[np.arange(5000)[:, None], np.c_[new[:, None], ids]] = np.inf
        assert (rest <= true.min(1)).all()
    assert (needed > 3).mean() < 0.1 < (needed == 0).mean()
    counts = np.zeros((2, 66), int)
    counts[0, :6], counts[1, :2] = [900, 60, 30, 6, 3, 1], [999, 1]
    assert vector_codes.adapted([8, 8], counts) == [2, 2] and vector_codes.adapted([8], counts[:1] * 0 + [[0, 0, 0, 0, 0, 500] + [0] * 60]) == [5]


def brute_nearest(rows, every=20, top=20):
    """query id: a list of (score, id) of all candidates, nearest first, once for each row."""
    kept = list({(r[0], tuple(c + 0.0 for c in r[1])): 1 for r in rows if r[0] is not None and r[1] and all(
        c is not None and math.isfinite(c) for c in r[1]) and any(r[1])})
    out = []
    for q, x in kept:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in kept if i != q)
            out.append((q, found[:top], len(found)))
    return out


def vectors_of(n, dims, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, dims)) * rng.uniform(0.5, 1.5, (n, 1))
    x[: n // 3] = x[0]  # a third of all rows share one vector
    rows = [(i, list(map(float, v)), "l", 1, "s", "c") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * dims, [-0.0] * dims, [math.nan] + [1.0] * (dims - 1), [math.inf] * dims, [None] + [1.0] * (dims - 1)]
    rows += [(20 * (n + i), v, None, None, None, None) for i, v in enumerate(odd)]
    return rows + [rows[0], rows[n - 1], (None, rows[5][1], "l", 1, "s", "c"), (20 * n + 200, [1.0, 2.0], "l", 1, "s", "c"), (40, rows[-13][1], "l", 1, "s", "c")]


def found_by(spark, rows, **more):
    df = neighbour_graph.nearest(spark.createDataFrame(rows, SCHEMA).repartition(6), **more)
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_nearest_is_exact_on_one_run(spark):
    rows = vectors_of(600, 12)
    got = found_by(spark, rows)
    want = brute_nearest(rows)
    assert set(got) == {q for q, _, _ in want}
    for q in got:
        own = [w for w in want if w[0] == q]
        one = [f for f in got[q]]
        assert len(one) == sum(min(20, w[2]) for w in own)
        if len(own) == 1:
            assert [i for _, i, _ in one] == [i for _, i in own[0][1]] and [r for r, _, _ in one] == list(range(1, len(one) + 1))
            assert np.allclose([s for _, _, s in one], [-s for s, _ in own[0][1]], rtol=1e-12)


def test_nearest_few_rows(spark):
    assert found_by(spark, []) == {} and found_by(spark, [(0, None, "", 1, "", "")]) == {}
    assert found_by(spark, [(0, [1.0], "", 1, "", "")]) == {}
    got = found_by(spark, [(0, [1.0, 0.0], "", 1, "", ""), (1, [3.0, 1.0], "", 1, "", ""), (3, [3.0, 1.0], "", 1, "", ""), (2, [-1.0, 0.0], "", 1, "", "")])
    assert got == {0: [(1, 1, 3.0), (2, 3, 3.0), (3, 2, -1.0)]}


def test_nearest_recall(spark, monkeypatch):
    """Small runs, so that the graph comes from the descent and not from the first lists."""
    monkeypatch.setattr(neighbour_graph, "RUN", 128)
    monkeypatch.setattr(neighbour_graph, "NODES_A_PARTITION", 500)
    monkeypatch.setattr(neighbour_graph.runs_of, "__defaults__", (128,))
    rows = vectors_of(6000, 16)
    got = found_by(spark, rows)
    hit = total = 0
    for q, best, _ in brute_nearest(rows):
        least = best[-1][0] + 1e-9
        hit += sum(-s <= least for _, _, s in got[q][:20])
        total += len(best)
    assert hit / total >= 0.95


def test_best_keeps_first_of_equal_pairs():
    owner, other, score = np.array([1, 0, 0, 0, 1]), np.array([5, 7, 7, 8, 6]), np.array([0.5, 0.2, 0.9, 0.4, 0.6])
    assert neighbour_graph.best(owner, other, score, 1).tolist() == [3, 4]
    assert neighbour_graph.best(owner, other, score, 5).tolist() == [3, 1, 4, 0]


def test_blocks_do_not_depend_on_partitions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(neighbour_graph, "NODES_A_PARTITION", 30)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([([i], v) for i, v in enumerate(rng.normal(size=(900, 6)).tolist())], "ids array<bigint>, vector array<double>")
    assert neighbour_graph.numbered(rows, str(tmp_path / "nodes"), 10) == 900
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    got = {r.idx: r for r in nodes.collect()}
    assert sorted(got) == list(range(900))
    unit = {i: np.frombuffer(r.unit, np.float16).astype(np.float32) for i, r in got.items()}
    assert all(abs(unit[i] @ unit[o] - s) < 1e-5 for i, r in got.items() for o, s in zip(r.nb, r.sc, strict=True))
    size = neighbour_graph.block_of(900)
    assert nodes.select(neighbour_graph.block("idx", size)).distinct().count() == neighbour_graph.BLOCKS
    assert neighbour_graph.block_of(10**9) == neighbour_graph.BLOCK
