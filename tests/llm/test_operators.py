"""Operators against brute force on awkward rows, and on empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.data import awkward
from traceframe.llm import exact_dedup, html_extraction, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, substring_dedup

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = awkward(spark)
    return df.cache(), rows


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact(docs):
    df, rows = docs
    got = exact_dedup.groups(df).collect()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r)
    want = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        want += [(str(r[0]), str(best[0]), len(own), hashlib.sha256(text.encode()).hexdigest()) for r in own]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(want)
    assert exact_dedup.keep_first(df).count() == len(groups)


def test_near(docs):
    df, rows = docs
    sets = collections.defaultdict(list)
    for r in rows:
        w = words(low(r[1]))
        sets[r[0]].append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i in sets if i is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 85 * len(x | y):
                        p, q = find(a), find(b)
                        parent[max(p, q)] = min(p, q)
    got = near_dedup.near_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:  # id 3 has two texts of different groups
            assert r.component_id == find(r.doc_id), r
            assert r.n_shingles == len(sets[r.doc_id][0])


def test_rules(docs):
    df, rows = docs
    got = quality_rules.decide(df, max_docs=3).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows[:-4]}
    for r in got:
        if r.doc_id in by_id and r.doc_id != 3:
            w = words(by_id[r.doc_id][1])
            windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
            covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
            assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality_rules.clean(df, max_docs=3).columns == df.columns


def test_frequent_lines_go_and_copies_do_not_count(spark):
    rows = [(i, f"All rights reserved {i}.\n" + " ".join("ab"[k % 2] * k + "qrstuvwxyz"[i] for k in range(40)), "h") for i in range(8)]
    copy = "\n".join(" ".join(f"c{j}y{k}" for k in range(20)) for j in range(3))
    rows += [(100 + i, copy, "h") for i in range(9)] + [(200, "All rights reserved 7.\nfew words", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.decide(df, max_docs=5).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 4 for i in range(8))
    assert all(got[100 + i].kept and got[100 + i].n_removed_words == 0 for i in range(9))
    assert not got[200].kept
    cleaned = {r.doc_id: r.text for r in quality_rules.clean(df, max_docs=5).collect()}
    assert "reserved" not in cleaned[3] and cleaned[100] == copy


def test_lines_shared_by_documents_that_share_several(spark):
    shared = [f"template line number {'abcdefgh'[k]} of the host" for k in range(7)]
    own = lambda i: " ".join(f"{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}{'uvwxyz'[k % 6] * (k // 6 + 1)}" for k in range(40))
    texts = {}
    for host, n_shared in (("two", 2), ("five", 5), ("seven", 7)):
        texts |= {(host, i): "\n".join([*shared[:n_shared], own(i)]) for i in range(60)}
    copies = [("copies", texts["five", 0])] * 60  # one document of that host
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate([*((k[0], t) for k, t in texts.items()), *copies])], "doc_id long, text string, source string")
    found = collections.Counter()
    for r in quality_rules.frequent_lines(df, max_docs=50).collect():
        assert r.n_docs == 60
        found[r._host] += 1
    assert found == {"two": 2, "five": 5, "seven": 7}
    got = quality_rules.decide(df, max_docs=50).collect()
    assert [r.n_removed_words for r in sorted(got, key=lambda r: r.doc_id)] == [14] * 60 + [35] * 60 + [49] * 60 + [0] * 60


def test_substrings(docs):
    df, rows = docs
    got = substring_dedup.dedup(df).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r for r in got if r.doc_id is not None}
    texts = {r[0]: r[1] for r in rows[:-4]}
    with_passage = range(24, 35)
    passage_words = 70
    for i in list(with_passage)[1:]:
        assert kept[i].n_cut_words >= passage_words - 1, i
    assert kept[36].text == texts[36]  # long text of its own
    assert kept[17].n_cut_words == kept[17].n_words  # a whole copy
    assert substring_dedup.clean(df).columns == df.columns


def test_scores(docs):
    df, rows = docs
    tokens = [words(low(r[1])) + ["\0end"] for r in rows]
    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10 == 0 for r in rows]
    count, pairs, state = collections.Counter(), collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held):
        if not h:
            count.update(t)
            pairs.update(zip(["\0start", *t], t))
            state.update(["\0start", *t[:-1]])
    n, v = sum(count.values()), len(count)
    arcs = {k: c for k, c in pairs.items() if c >= 2}
    mass = collections.Counter()
    for (h, _), c in arcs.items():
        mass[h] += c - lm_scoring.DISCOUNT
    want = []
    for r, t, h in zip(rows, tokens, held):
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        total = 0.0
        for p, w in zip(["\0start", *t], t):
            plain = (count[w] + 0.1) / (n + 0.1 * (v + 1))
            g = 1 - mass[p] / state[p] if state[p] else 1
            total += math.log10(g * plain + ((arcs[p, w] - lm_scoring.DISCOUNT) / state[p] if (p, w) in arcs else 0))
        want.append((str(r[0]), h, len(t), sum(count[w] > 0 for w in t), n, round(base, 5), round(total, 5)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in lm_scoring.score(df).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3 and abs(a[6] - b[6]) < 1e-3


def test_packing(docs):
    df, rows = docs
    t = Tokenizer.from_file(PATH)
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows[:-4]}
    got = packing.pack(df, PATH).toPandas()
    seqs = got.sort_values(["sequence_id", "offset"])
    assert ((seqs.offset + seqs.length).groupby(seqs.sequence_id).shift().fillna(0) == seqs.offset).all()
    totals = seqs.groupby("sequence_id").length.sum()
    assert totals.max() <= 2048
    assert got.length.sum() == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    padding = sum(0 if x & (x - 1) == 0 else 2048 - x for x in totals)
    assert padding <= len(packing.TIERS) * 2048
    for i, own in got[~got.doc_id.isin([3, 6])].dropna().groupby("doc_id"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids[i])
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start:r.start + r.length], "<u4").tobytes())


def test_classifier(spark, docs):
    df, rows = docs
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5, 30)] + [(None, 1, 1), (5, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 and r.kept is not None for r in got)
    assert quality_classifier.classify(df, labels.limit(0)).filter("kept").count() == len(rows)


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.filter("pmod(xxhash64(doc_id), 4) > 0")
    rest = quality_classifier.classify(docs, known).join(labels.filter("pmod(xxhash64(doc_id), 4) = 0"), "doc_id").collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in rest]) > 0.9


PAGES = [
    (1, "u", None, ""), (2, None, "", ""), (3, "u", "plain &amp; simple  text", "plain & simple text"),
    (4, "u", html_extraction.PLAIN, "A title of some words\nA first paragraph, with words and stops. It goes on for a while, as paragraphs do.\nA second one, which is shorter."),
    (5, "u", html_extraction.PLAIN.replace("article>", "main>").replace("</html>", "").replace("<p>A second", "<script>var a='<p>no</p>'</script><!-- <p>no</p> --><p>A second"),
     "A title of some words\nA first paragraph, with words and stops. It goes on for a while, as paragraphs do.\nA second one, which is shorter."),
    (6, "u", "<html><body><nav><ul><li><a href=a>x</a></li></ul></nav></body></html>", ""),
]


def test_html(spark):
    pages = spark.createDataFrame([(*p[:3], "noise") for p in [*PAGES, PAGES[3], (None, "u", PAGES[3][2], PAGES[3][3])]], "page_id long, url string, html string, text string")
    got = html_extraction.extract(pages).collect()
    want = [(str(i), t, len(t)) for i, _, _, t in PAGES] + [("4", PAGES[3][3], len(PAGES[3][3])), ("None", PAGES[3][3], len(PAGES[3][3]))]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted(want)


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>T</title><meta x><body><p>one</p>", "one"),
    ("<html><head><title>T</title><style>a</style><p>one</p><p>two</p>", "one\ntwo"),
    ("<html><head><title>T<body><p>one</p>", "one"),
    ("<head>lost<script>'<p>no</p>'</script><noscript><div>no</div></noscript></head><body><p>one</p>", "one"),
    *[(f"<body><article><p>one</p><{t}/><p>two</p></article>", "one\ntwo") for t in sorted({"svg", "iframe", "object", "canvas", "video"})],
    ('<body><p>one <svg viewBox="0 0 1 1"/>more</p><p>two <svg><title>no</title></svg>end</p>', "one more\ntwo end"),
    *[(f"<body><article><p>one</p><div><{t} x=1></div><p>two</p></article><p>three <{t}>no</{t}>end</p>", "one\ntwo\nthree end")
      for t in sorted(html_extraction.DROPPED)],
    ("<body><article><iframe src=x><p>one</p><p>two</p></article>", "one\ntwo"),
    ("<body><p>one</p><button>no<div>no</div></button><object><object>no</object>no</object><p>two</p>", "one\ntwo"),
    ("<body><p>one</p><iframe src=/a/>no</iframe><video-list>two</video-list>", "one\ntwo"),
    *[(f"<body><p>one</p><{t}><p>no</p>", "one") for t in ("script", "style", "textarea")],
    ("<body><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "so x=1 holds"),
])
def test_html_drops_nothing_else(html, want):
    page = html_extraction.Page(html)
    assert page.text(np.ones(len(page.tags), bool)) == want


def test_empty(spark, docs):
    none = docs[0].limit(0)
    for f in (exact_dedup.groups, exact_dedup.keep_first, near_dedup.near_groups, quality_rules.decide, quality_rules.clean, substring_dedup.dedup, substring_dedup.clean, lm_scoring.score,
              lambda d: packing.pack(d, PATH)):
        assert f(none).count() == 0
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(none, labels).count() == 0


def test_lm_answers_carry_no_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20000, np.uint64))
    sent = [r for block in (0, 1) for r in lm_scoring.entries(block, keys, np.full(len(keys), 1 + block, np.uint32), None, 1)]
    answers = lm_scoring.merge_pairs(pa.Table.from_pylist(sent, schema=lm_scoring.ENTRY_TYPE)).to_pylist()
    assert sum(len(v) for r in answers for v in (r["keys"], r["counts"], r["rest"])) < len(keys)
    for r in answers:
        counts, own = lm_scoring.answered([r], bool)
        assert (counts == 3).all() and len(counts) == len(keys) and (own == (r["block"] == 0)).all()
