"""Encoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from traceframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "  \n", "Hello, World's 'LL don't", "naïve İstanbul ΑΣ Σ 日本語 ​\x1c\x85 x", "<|endoftext|>ab<|startoftext|> <|nope|>", "aaaa aaaaaaaaa", "é Å", "x" * 5000, "😀😀 ١٢ ½"]


def want(text):
    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids():
    rng = random.Random(7)
    letters = "aaabeinorsthlyingd  éß'.,$1Z"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(400)]
    t = Tokenizer.from_file(PATH)
    assert bpe.encode_texts(texts, PATH) == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_greedy_fails_somewhere_and_is_mended():
    _, b = bpe.coder(PATH)
    words = ["".join(random.Random(i).choices("abcdeinorst", k=9)) for i in range(2000)]
    exact = [b.merge(w) for w in words]
    assert b.encode(words) == exact
    assert [b.propose(w) for w in words] != exact


def test_query_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a b", "y"), (3, "a b", "y")], "doc_id long, text string, n_tokens string")
    t = Tokenizer.from_file(PATH)
    rows = bpe.encode(docs, PATH).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r.doc_id in (None, 3):
            continue
        ids = want(ODD[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).count() == 0
