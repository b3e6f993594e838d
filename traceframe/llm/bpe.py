"""BPE encoding and decoding by speculation and verification.

Pieces between white space are split into words once for each distinct piece. For the distinct words that are not known yet: (1) greedy longest match proposes tokens; (2) every
adjacent pair of proposed tokens is checked at once, with vector operations over the distinct pairs: a proposal is the
BPE result exactly when no merge across any of its borders would happen before the tokens on both sides are complete; (3) only the words
with a failing pair are merged step by step. Results are kept by word and by piece, about ``KEPT_WORDS`` of each kind, so
memory is bounded. There is no shuffle; each row is encoded where it is read.

Split rules: ordinary European text is split here; rows with other characters use the tokenizer file's own
normaliser and word splitter, so that Unicode details agree.

Defined results: null and empty texts have no tokens and the hashes of the empty string; repeated rows and null ids are
encoded like all others; an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from traceframe.llm.hashing import slices

END = "</w>"
KEPT_WORDS = 400_000
KNOWN = re.compile(r"[\t-\r\x20-\x7e¡-ſ‐-‧€]*")
NEVER = 1 << 40


class Splitter:
    """Splits a text into special tokens and words, as the tokenizer file prescribes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.around = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")")
        self.word = regex.compile(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def pieces(self, text: str) -> list[str] | None:
        """What stands between white space, for texts whose pieces have the same tokens alone as together; else None."""
        return text.split() if "<|" not in text and KNOWN.fullmatch(text) else None

    def words(self, text: str) -> list[str]:
        return self.word.findall(unicodedata.normalize("NFC", text).lower())

    def parts(self, text: str):
        """(special token or None, words, whether they are byte-level strings already)."""
        for part in self.around.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield part, (), False
            elif KNOWN.fullmatch(part):
                yield None, self.words(part), False
            elif part:
                yield None, [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))], True


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others counted from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    def __init__(self, spec: dict):
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        size = max(self.vocab.values()) + 1
        merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.made = [t for _, _, t in merges]
        self.birth, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for r, (a, b, t) in reversed(list(enumerate(merges))):
            self.birth[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * size + b for a, b, _ in merges], np.int64)
        self.size, order = size, np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        a, b, t = np.array(merges, np.int64).T
        good = np.ones(size, bool)
        good[t] = ~self.broken(a, b, self.birth[t])
        while True:  # a token is reachable only if its parts are
            bad = good[t] & ~(good[a] & good[b])
            if not bad.any():
                break
            good[t[bad]] = False
        self.tokens = {x: i for x, i in self.vocab.items() if good[i]}
        self.longest = max(len(x.removesuffix(END)) for x in self.tokens)
        self.letters = byte_letters()

    def broken(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """For pairs of tokens: would a merge across the border happen? Candidates are the parts at the right edge of a
        and at the left edge of b, each alive from the merge that makes it to the merge that uses it."""
        out = np.zeros(len(a), bool)
        x, x_dies = a.copy(), np.broadcast_to(until, a.shape).copy()
        while (x >= 0).any():
            y, y_dies = b.copy(), np.broadcast_to(until, b.shape).copy()
            while (y >= 0).any():
                key = x * self.size + y
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (x >= 0) & (y >= 0)
                when = np.maximum(self.ranks[at], np.maximum(self.birth[x], self.birth[y]))
                out |= hit & (when < x_dies) & (when <= y_dies)
                y_dies = np.where(y >= 0, self.birth[y], -1)
                y = np.where(y >= 0, self.left[y], -1)
            x_dies = np.where(x >= 0, self.birth[x], -1)
            x = np.where(x >= 0, self.right[x], -1)
        return out

    def propose(self, word: str) -> list[int]:
        out, at, n, tokens = [], 0, len(word), self.tokens
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                token = tokens.get(word[at:] + END if to == n else word[at:to])
                if token is not None:
                    out.append(token)
                    at = to
                    break
        return out

    def merge(self, word: str) -> list[int]:
        """The exact result, one lowest-ranked merge after another."""
        parts = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + END]]
        get = self.rank.get
        ranks = [get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            parts[i:i + 2] = [self.made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of byte-level words."""
        proposals = [self.propose(w) for w in words]
        flat = np.fromiter((t for p in proposals for t in p), np.int64)
        ends = np.cumsum([len(p) for p in proposals], dtype=np.int64)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False  # pairs that cross from one word to the next
        at = np.flatnonzero(inner)
        pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        bad = self.broken(pairs // self.size, pairs % self.size)[back] if len(pairs) else np.zeros(0, bool)
        for i in np.unique(np.searchsorted(ends, at[bad], "right")):
            proposals[i] = self.merge(words[i])
        return proposals

    def byte_level(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode()])


@functools.lru_cache(2)
def coder(path: str) -> tuple[Splitter, Bpe]:
    splitter = Splitter(path)
    return splitter, Bpe(splitter.spec)


def encode_rows(path: str):
    def run(batches):
        splitter, bpe = coder(path)
        known: dict = {}  # of pieces, byte-level words behind a mark and special tokens behind two: ids and names as text, number
        coded: dict = {}  # the same of byte-level words
        for part, _, _ in slices(batches, 2 << 20):
            texts = []
            for text in part.column("text").to_pylist():
                keys = splitter.pieces(text or "")
                if keys is None:
                    keys = []
                    for special, words, raw in splitter.parts(text):
                        keys += ["\0\0" + special] if special else ["\0" + (w if raw else bpe.byte_level(w)) for w in words]
                texts.append(keys)
            known, coded = ({} if len(x) > KEPT_WORDS else x for x in (known, coded))
            new = set().union(*texts) - known.keys()
            known |= {w: (str(splitter.special[w[2:]]), w[2:], 1) for w in new if w[:2] == "\0\0"}
            words_of = {w: [w[1:]] if w[0] == "\0" else [bpe.byte_level(x) for x in splitter.words(w)] for w in new if w[:2] != "\0\0"}
            fresh = list(set().union(*words_of.values()) - coded.keys())
            for w, ids in zip(fresh, bpe.encode(fresh), strict=True):
                coded[w] = (" ".join(map(str, ids)), " ".join([bpe.names[i] for i in ids]), len(ids))
            for w, words in words_of.items():
                if len(words) == 1:
                    known[w] = coded[words[0]]
                else:
                    ids, names, sizes = zip(*[coded[x] for x in words], strict=True)
                    known[w] = (" ".join(ids), " ".join(names), sum(sizes))
            out: list[list] = [[], [], []]
            for keys in texts:
                ids, names, sizes = zip(*map(known.__getitem__, keys), strict=True) if keys else ((), (), ())
                out[0].append(sum(sizes))
                out[1].append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                out[2].append(hashlib.sha256(" ".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text, for each document."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(encode_rows(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of texts, for use inside tasks."""
    splitter, bpe = coder(path)
    out = []
    for text in texts:
        ids: list[int] = []
        for special, words, raw in splitter.parts(text or ""):
            ids += [splitter.special[special]] if special else []
            ids += [t for w in bpe.encode([w if raw else bpe.byte_level(w) for w in words]) for t in w] if words else []
        out.append(ids)
    return out
