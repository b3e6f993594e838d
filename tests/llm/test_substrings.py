"""Substring deduplication: repeated passages wherever they lie, texts of a short period, clean documents."""

import random

import pytest

from traceframe.llm import substring_dedup


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    passages = [own(n) for n in (52, 60, 75, 120)]
    texts = {i: own(100) for i in range(20)}
    for k in range(80):
        p = passages[k % 4]
        texts[100 + k] = f"{own(rng.randint(0, 60))} {p}\n{own(rng.randint(0, 60))}".strip()
    texts[300] = f"{own(20)} {'la ' * 100}{own(20)}"
    texts[301] = f"{own(33)} {'la ' * 140}{own(20)}"
    texts[302], texts[303] = "x y " * 200, own(45)
    texts[304] = texts[303]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return texts, passages, {r.doc_id: r for r in substring_dedup.dedup(df).collect()}


def test_passages_are_cut(found):
    texts, passages, got = found
    for k in range(4, 80):
        p = passages[k % 4]
        assert p not in got[100 + k].text and abs(got[100 + k].n_cut_words - len(p.split())) <= 2, k
        assert min(got[100 + k].first_ids) == 100 + k % 4  # edges of a passage may be found first in another copy


def test_first_places_and_clean_documents_stay(found):
    texts, _, got = found
    for i in [*range(20), 100, 101, 102, 103, 303, 304]:
        assert got[i].text == texts[i] and got[i].n_cut_words == 0, i


def test_short_periods(found):
    texts, _, got = found
    assert 95 <= got[301].n_cut_words <= 141
    assert all(got[i].n_words == len(texts[i].split()) for i in texts)
