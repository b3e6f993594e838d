"""Families whose members are linked to an original or to a chain only, against brute force."""

import random
from pathlib import Path

import numpy as np

import corpus_pipeline
from traceframe.llm import near_dedup
from traceframe.llm.hashing import shingles, word_hashes


def brute(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(sets))]


def jaccard(x, y):
    x, y = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def far_sketches(rng, differ):
    """A text and a longer one that holds it, with similarity 0.8: ``differ`` of the added shingles have the smallest hashes, the others
    large ones, so that the sketches differ in as many values."""
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))
    short = [word() for _ in range(200)]
    long = list(short)
    for k in range(49):
        tried = []
        for _ in range(200):
            w = word()
            raw = np.frombuffer(" ".join([*long[-4:], w]).encode(), np.uint8)
            tried.append((int(shingles(word_hashes(raw, np.array([0, len(raw)]))[0])[0]), w))
        long.append((min if k < differ else max)(tried)[1])
    return " ".join(short), " ".join(long)


def test_pipeline_takes_pairs_from_eighty_percent(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))
    pairs = []
    for size, edits in ((300, 5), (300, 6), (120, 2)):
        for _ in range(4):
            base = [word() for _ in range(size)]
            other = list(base)
            for i in range(edits):
                other[10 + i * size // edits] = word()
            pairs.append((" ".join(base), " ".join(other)))
    pairs += [far_sketches(rng, near_dedup.prefix_of(80) - 1) for _ in range(3)]
    assert all(0.8 <= jaccard(*p) < 0.85 for p in pairs)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()) == list(range(0, 2 * len(pairs), 2))
    assert near_dedup.near_groups(df).filter("NOT kept").count() == 0


def test_loss_is_as_stated():
    for threshold in (80, 85, 90):
        p = near_dedup.prefix_of(threshold)
        assert near_dedup.loss_of(p, threshold) <= 1e-8 < near_dedup.loss_of(p - 1, threshold)


def test_stars_chains_and_near_misses(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))

    def edited(words, edits):
        out = list(words)
        for i in rng.sample(range(len(out)), edits):
            out[i] = word()
        return out

    texts = []
    for size, edits, copies in ((300, 4, 40), (300, 6, 30), (60, 1, 20), (300, 12, 30)):
        base = [word() for _ in range(size)]
        texts += [base] + [edited(base, edits) for _ in range(copies)]
    link = [word() for _ in range(200)]
    for _ in range(25):  # a chain
        texts.append(link)
        link = edited(link, 2)
    rng.shuffle(texts)
    sets = [frozenset(tuple(t[i:i + 5]) for i in range(len(t) - 4)) for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(sets)


def test_texts_for_verification_are_smaller_than_their_sets(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [[word() for _ in range(400)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(40 + i, " ".join([*w[:200], "changed", *w[201:]])) for i, w in enumerate(base)]
    # Used and null ids: a text is found by its class, not by its id alone.
    rows += [(0, rows[41][1]), (None, rows[3][1]), (None, " ".join([*base[5][:100], "other", *base[5][101:]])), (7, rows[7][1])]
    written = {}

    def settled(df, name):
        path = str(tmp_path / f"{name}-{len(written)}")
        df.write.parquet(path)
        written[name, len(written)] = sum(f.stat().st_size for f in Path(path).glob("*.parquet"))
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(near_dedup, "settled", settled)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(i, i % 40 if i % 40 != 1 else 0) for i in range(1, 80)}
    assert {r.component_id for r in got if r.doc_id is None} == {3, 5}
    sets = 8 * sum(len(t.split()) - 4 for _, t in rows[:80])
    assert max(written.values()) < sets / 2


def test_estimate_is_that_of_the_union():
    rng, size = np.random.default_rng(3), near_dedup.SKETCH
    pairs = []
    for _ in range(300):
        both = rng.integers(0, 1 << 64, rng.integers(0, 150), np.uint64)
        pairs.append([np.unique(np.r_[both, rng.integers(0, 1 << 64, rng.integers(1, 60), np.uint64)]) for _ in range(2)])
    x, y = (near_dedup.filled_up(np.concatenate([p[j][:size] for p in pairs]), np.array([min(len(p[j]), size) for p in pairs])) for j in (0, 1))
    n, m = (np.array([len(p[j]) for p in pairs]) for j in (0, 1))
    want = []
    for a, b in pairs:
        union = np.union1d(a, b)[:size]
        common = len(np.intersect1d(union, np.intersect1d(a, b)))
        want.append(size * common >= near_dedup.least_common(85) * len(union) and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)))
    assert near_dedup.alike(x, y, n, m, 85).tolist() == want
    assert 0 < sum(want) < len(want)


def test_members_below_the_threshold_make_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=7))
    base = [word() for _ in range(300)]
    texts = [base]
    for _ in range(60):
        texts.append([word() if i % 37 == k else w for k in [rng.randrange(37)] for i, w in enumerate(base)])
    made, settled = {}, near_dedup.settled

    def counted(df, name):
        done = settled(df, name)
        made[name] = done.count()
        return done

    monkeypatch.setattr(near_dedup, "settled", counted)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()}
    sets = [frozenset(tuple(t[i:i + 5]) for i in range(len(t) - 4)) for t in texts]
    assert [got[i] for i in range(len(texts))] == brute(sets)
    linked = sum(100 * len(a & b) >= 85 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert made["open"] > 61 and made["pairs"] <= 2 * linked + 61


def test_parities_lose_no_link():
    rng = np.random.default_rng(7)
    sets = []
    for size in (1, 3, 60, 70, 300, 1000, 70_000):
        both = rng.integers(0, 1 << 64, size, np.uint64)
        sets += [np.unique(np.r_[both[: size - size // d], rng.integers(0, 1 << 64, size // d, np.uint64)]) for d in (2, 4, 8, 15, 30, size + 1)]
    own = [near_dedup.parity_of(s) for s in sets]
    n = np.array([len(s) for s in sets])
    p, q = np.triu_indices(len(sets), 1)
    for threshold in (80, 85):
        got = near_dedup.close(own, p, q, n[p], n[q], threshold)
        same = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(p, q, strict=True)])
        linked = 100 * same >= threshold * (n[p] + n[q] - same)
        assert got[linked].all() and linked.sum() > 10
        assert (got & (100 * np.minimum(n[p], n[q]) >= threshold * np.maximum(n[p], n[q]))).sum() < 2 * linked.sum()


def test_meetings_are_all_pairs_of_a_group(monkeypatch):
    for at_once in (1, 4, 1000):
        monkeypatch.setattr(near_dedup, "MEETINGS_AT_ONCE", at_once)
        edge = np.array([0, 1, 4, 4 + 7, 12])
        got = [(x, y) for p, q in near_dedup.meetings(edge) for x, y in zip(p.tolist(), q.tolist(), strict=True)]
        assert got == [(x, y) for lo, hi in zip(edge[:-1], edge[1:], strict=True) for x in range(lo, hi) for y in range(x + 1, hi)]
