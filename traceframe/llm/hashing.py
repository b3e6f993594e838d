"""Vectorised word and shingle hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE_TABLE = np.zeros(256, bool)
SPACE_TABLE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20, column: str = "text"):
    """Parts of the batches with about ``size`` bytes of text (one row at least): the part, its bytes and the rows' bounds."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
            at = to


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True):
    """Hashes of all words, the words' first and end bytes, and for each row the number of its first word (one more at the end)."""
    inside = ~SPACE_TABLE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False] if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power = np.multiply.accumulate(np.full(len(data) + 1, ODD))
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    sums = np.r_[np.uint64(0), np.cumsum((LOWER_TABLE if lower else BYTE_TABLE)[data] * power[:-1], dtype=np.uint64)]
    back = np.multiply.accumulate(np.full(len(data) + 1, inverse))
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * ODD) if len(starts) else np.zeros(0, np.uint64)
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, one hash of them all."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64) * ODD
    for k in range(size):
        total = mix(total + words[k:len(words) - size + 1 + k])
    return total
