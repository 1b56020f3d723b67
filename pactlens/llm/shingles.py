"""Weighted word shingles of whole texts, and their probability Jaccard similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pactlens.llm.memo import Memo, between_blanks, runs

_WORD = re.compile(r"\w+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
MEMORY = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: well-spread hashes from unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of texts' words: runs of letters, digits and underscores, lower-cased. Each distinct chunk between blanks is hashed once."""

    def __init__(self, memory: int = MEMORY):
        self.memo = Memo(self._hashed, np.uint64, memory)

    @staticmethod
    def _hashed(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [_WORD.findall(c.lower()) for c in chunks]
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for own in words for w in own), np.uint64), np.array([len(own) for own in words])

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' hashes and where each text's end; a null text has none."""
        return self.memo.texts(between_blanks(texts))

    def words(self, text: str | None) -> np.ndarray:
        return self.flat(pa.array([text], pa.string()))[0]

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The hashes of each text, worked out in runs of bounded size."""
        for at, stop in runs(texts):
            hashes, ends = self.flat(texts.slice(at, stop - at))
            yield from np.split(hashes, ends[:-1])


def shingles(words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs; fewer words than ``size`` make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    count = max(1, n - size + 1)
    h = np.full(count, min(n, size), np.uint64)
    for k in range(min(size, n)):
        h = (h ^ words[k : k + count]) * _MIX[0]
        h ^= h >> np.uint64(32)
    return np.unique(mix(h), return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i); plain Jaccard where all weights are equal.

    With elements sorted by x / y, the maximum is x's side from i on and y's side before it.
    """
    both, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][at_a].astype(float), b[1][at_b].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    by = np.argsort(x / y, kind="stable")
    x, y = x[by], y[by]
    from_here = np.cumsum(x[::-1])[::-1] + only_x
    before = np.concatenate([[0.0], np.cumsum(y)[:-1]]) + only_y
    return float((1.0 / (from_here / x + before / y)).sum())
