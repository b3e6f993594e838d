"""Spelling variants against brute force over all pairs of words."""

import collections
import random
import re
import string
import zlib

import pytest

from tests.llm.data import awkward
from traceframe.llm import spelling_variants

SCHEMA = "doc_id long, text string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    count = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            count[run if h % 97 else run[:k] + run[k + 1:]] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    out, form = [], {}
    for w, n in count.items():
        others = [x for x in count if near(w, x)]
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * n else None
        out.append([w, form[w], None, n, len(others), count[best] if form[w] else None])
    for row in out:
        row[2] = row[0]
        while form[row[2]]:
            row[2] = form[row[2]]
    return sorted(map(tuple, out))


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def texts():
    """Dense families of words, so that many pairs are one edit apart: ties, chains, accents, capitals and multiplication signs."""
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcdeé×Ñ", k=rng.randint(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaaaaaaaa", "W" * 300]
    words = []
    for stem in stems:
        for _ in range(6):
            w, k = list(stem), rng.randrange(len(stem))
            w[k:k + rng.randint(0, 1)] = rng.choices("abÀÿ", k=rng.randint(0, 1))
            words += ["".join(w)] * rng.choice([1, 3, 3, 6, 13, 30])
        words += [stem] * rng.choice([3, 20, 60])
    rng.shuffle(words)
    return [(i, " ".join(words[i::25]).title() if i % 3 else "-".join(words[i::25])) for i in range(25)]


@pytest.mark.parametrize("symbols", [None, 2, 40])
def test_brute_force(spark, symbols, monkeypatch):
    rows = texts() + [(None, "Alpha alphas ALPHA"), (7, None), (8, "")]
    if symbols:
        monkeypatch.setattr(spelling_variants, "symbols_for", lambda words: symbols)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert got(spelling_variants.variants(df)) == want
    assert any(r[1] and r[1] != r[2] for r in want) and any(r[4] == 0 for r in want)  # chains and lone words


def test_awkward_rows(spark):
    df, rows = awkward(spark, "doc_id long, text string, word string, form string, root long, key string, n long")
    assert got(spelling_variants.variants(df)) == brute([r[:2] for r in rows])


def test_empty(spark):
    assert spelling_variants.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_neighbourhoods_hold_all_edits():
    import pyarrow as pa

    words = ["abcde", "zzzzz", "äöüßx", "abcdefghijk"]
    of, key = spelling_variants.neighbourhoods(pa.array(words))
    for i, w in enumerate(words):
        edits = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k + d:] for k in range(len(w) + 1) for c in "aqzÿ" for d in (0, 1)}
        assert {int(k) for k in spelling_variants.keys(pa.array(sorted(edits)))} <= {int(k) for k in key[of == i]}
