"""Quality and toxicity classification by co-training two views.

View one is the text (hashed words and binned figures of form), view two the page's metadata (language, source, length). Each view
trains a logistic model on labelled documents. In every round each view labels the unlabelled documents it is surest about, and they
join the *other* view's training set. At the end each view is calibrated on labelled documents kept apart for that, and the two
calibrated log-odds are added (less the prior, which both contain). All documents are scored where they are read.

Bounds: training uses at most ``LABELLED`` labelled and ``POOL`` unlabelled documents, taken in the order of a hash of their id; those
rows' features alone come to the driver. Scoring covers all rows and whole texts; only weights of fixed size are sent out.

Defined results: null text is empty, null metadata is a value of its own; repeated rows get equal scores; labels with null ids or values
and labels of unknown documents are ignored, of repeated labels the lowest value holds; without labels of both classes
scores are the prior (0.5 without any); an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceframe.llm.hashing import slices, word_hashes

LABELLED, POOL = 8000, 4000
ROUNDS, SURE, SHARE = 3, 0.95, 0.1
WORD_BITS, BINS, FIGURES, META = 16, 16, 6, 4096
Z = 3.5
TEXT_SIZE = (1 << WORD_BITS) + BINS * FIGURES
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>_=~^{}[]\\@"]] = True


def text_features(data: np.ndarray, bounds: np.ndarray):
    """Feature numbers of each row (present or not), as one array with the rows' borders."""
    hashes, starts, ends, first = word_hashes(data, bounds)
    rows, n = len(bounds) - 1, np.diff(first)
    keys = np.unique((np.repeat(np.arange(rows, dtype=np.uint64), n) << np.uint64(WORD_BITS)) | (hashes & np.uint64((1 << WORD_BITS) - 1)))
    distinct = np.bincount((keys >> np.uint64(WORD_BITS)).astype(np.int64), minlength=rows)
    total = lambda x, at: np.diff(np.r_[0, np.cumsum(x)][at])
    size = np.maximum(np.diff(bounds), 1)
    per_word = np.maximum(n, 1)
    figures = [
        np.log2(n + 1), 60 * total(SYMBOL[data], bounds) / size, 16 * distinct / per_word, 1.5 * total(ends - starts, first) / per_word,
        60 * total((data >= 48) & (data <= 57), bounds) / size, np.log2(n / (1 + total(data == 10, bounds)) + 1)]
    binned = [(1 << WORD_BITS) + BINS * k + np.clip(f, 0, BINS - 1).astype(np.int64) for k, f in enumerate(figures)]
    cut = np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(WORD_BITS))
    words = (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    flat = np.insert(words, np.repeat(cut[1:], FIGURES), np.stack(binned, 1).ravel()) if rows else words
    return flat, cut + FIGURES * np.arange(rows + 1)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Three feature numbers for each row."""
    values = [(f"l{a}", f"s{b}", f"n{'' if c is None else max(c, 0).bit_length()}") for a, b, c in zip(lang, source, n_chars, strict=True)]
    return np.array([[zlib.crc32(v.encode()) % META for v in row] for row in values], np.int64).reshape(-1, 3)


class Rows:
    """Rows of feature numbers."""

    def __init__(self, flat: np.ndarray, cut: np.ndarray, size: int):
        self.flat, self.cut, self.size = flat, cut, size

    def take(self, rows: np.ndarray) -> Rows:
        parts = [self.flat[self.cut[i]:self.cut[i + 1]] for i in rows]
        return Rows(np.concatenate(parts) if parts else self.flat[:0], np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64), self.size)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(weights[self.flat])]
        return sums[self.cut[1:]] - sums[self.cut[:-1]] + weights[-1]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: Rows, y: np.ndarray, steps: int = 60, rate: float = 0.25, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression by adaptive gradient steps with balanced classes; the last weight is the constant. Only
    features whose share differs between the classes by more than chance (``Z`` standard deviations) get a weight."""
    lengths = np.diff(rows.cut)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    with_1 = np.bincount(rows.flat, np.repeat(y, lengths), rows.size + 1)
    both = np.bincount(rows.flat, minlength=rows.size + 1)
    share = (both + 1) / (n1 + n0 + 2)
    telling = np.abs(with_1 / n1 - (both - with_1) / n0) > Z * np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    weights, squares = np.zeros(rows.size + 1), np.full(rows.size + 1, 1e-8)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(steps):
        error = (sigmoid(rows.scores(weights)) - y) * balance / len(y)
        slope = np.bincount(rows.flat, np.repeat(error, lengths), rows.size + 1) + decay * weights
        slope *= telling
        slope[-1] = error.sum()
        squares += slope ** 2
        weights -= rate * slope / np.sqrt(squares)
    return weights


def calibrate(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make scores log-odds (Platt's method, with damped Newton steps)."""
    scale = max(float(np.std(scores)), 1e-6)
    x = np.stack([scores / scale, np.ones(len(scores))], 1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w = np.clip(w, -20, 20)
    return float(w[0] / scale), float(w[1])


def co_train(views: list[Rows], y: np.ndarray, pool: list[Rows]) -> tuple[list[np.ndarray], list[tuple[float, float]], float]:
    """Weights and calibration of each view, and the prior's log-odds."""
    n = len(y)
    apart = np.arange(n) % 5 == 0
    prior = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    if len(np.unique(y[~apart])) < 2:
        return [np.zeros(v.size + 1) for v in views], [(0.0, prior)] * 2, prior
    own = np.flatnonzero(~apart)
    added: list[dict[int, int]] = [{}, {}]
    models = [np.zeros(v.size + 1) for v in views]
    for turn in range(ROUNDS + 1):
        for v in (0, 1):
            more = np.array(sorted(added[v]), np.int64)
            base, extra = views[v].take(own), pool[v].take(more)
            both = Rows(np.r_[base.flat, extra.flat], np.r_[base.cut, extra.cut[1:] + base.cut[-1]], base.size)
            models[v] = train(both, np.r_[y[own], [added[v][i] for i in more.tolist()]])
        if turn == ROUNDS:
            break
        for v in (0, 1):  # each view teaches the other one
            a, b = calibrate(views[v].take(own).scores(models[v]), y[own])
            p = sigmoid(a * pool[v].scores(models[v]) + b)
            for label, sure in ((1, p), (0, 1 - p)):
                best = np.argsort(-sure)[:max(1, int(SHARE * len(p)))] if len(p) else []
                for i in best:
                    if sure[i] >= SURE:
                        added[1 - v].setdefault(int(i), label)
    held = np.flatnonzero(apart)
    return models, [calibrate(views[v].take(held).scores(models[v]), y[held]) for v in (0, 1)], prior


def feature_rows(batches):
    for part, data, bounds in slices(batches, 2 << 20):
        flat, cut = text_features(data, bounds)
        meta = meta_features(*[part.column(c).to_pylist() for c in ("lang", "source", "n_chars")])
        yield pa.RecordBatch.from_arrays(
            [part.column("quality"), part.column("toxic"), pa.array([flat[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
             pa.array([m.astype(np.int32).tobytes() for m in meta], pa.binary())], names=["quality", "toxic", "words", "meta"])


def score_rows(models):
    def run(batches):
        for part, data, bounds in slices(batches, 2 << 20):
            flat, cut = text_features(data, bounds)
            meta = meta_features(*[part.column(c).to_pylist() for c in ("lang", "source", "n_chars")])
            views = [Rows(flat, cut, TEXT_SIZE), Rows(meta.ravel(), 3 * np.arange(len(meta) + 1), META)]
            out = []
            for weights, calibration, prior in models:
                odds = sum(a * v.scores(w) + b for v, w, (a, b) in zip(views, weights, calibration, strict=True)) - prior
                out.append(pa.array(sigmoid(odds)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out], names=["doc_id", "quality_score", "toxic_score"])
    return run


def rows_of(table: pa.Table) -> list[Rows]:
    out = []
    for name, size in (("words", TEXT_SIZE), ("meta", META)):
        parts = [np.frombuffer(x, np.int32).astype(np.int64) for x in table[name].to_pylist()]
        out.append(Rows(np.concatenate(parts) if parts else np.zeros(0, np.int64), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64), size))
    return out


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """One row per document: doc_id, quality_score, toxic_score, kept (good and not toxic)."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
                        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("bigint").alias("n_chars"))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    chosen = known.orderBy(by_hash, "doc_id").limit(labelled)
    rest = given.select("doc_id").filter("doc_id IS NOT NULL").join(known.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(by_hash, "doc_id").limit(pool)
    wanted = chosen.unionByName(rest.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic")))
    sample = given.join(F.broadcast(wanted), "doc_id")  # at most labelled + pool ids
    features = sample.mapInArrow(feature_rows, "quality int, toxic int, words binary, meta binary").toArrow().sort_by("words")
    has = features.filter(features["quality"].is_valid())
    free = rows_of(features.filter(features["quality"].is_null()))
    views = rows_of(has)
    models = [co_train(views, has[c].to_numpy().astype(np.int64), free) if has.num_rows else
              ([np.zeros(TEXT_SIZE + 1), np.zeros(META + 1)], [(0.0, 0.0)] * 2, 0.0) for c in ("quality", "toxic")]
    scored = given.mapInArrow(score_rows(models), "doc_id bigint, quality_score double, toxic_score double")
    return scored.withColumn("kept", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") <= 0.5))
