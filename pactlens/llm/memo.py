"""A bounded memory of the numbers made from each distinct word of many texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Memo:
    """Numbers of texts, put together from those of the parts that they are cut into.

    Arrow cuts a run of texts and numbers its distinct parts, here called chunks; ``make(chunks)`` gives the numbers of those not yet
    known, one after the other, and how many each has. All of it is forgotten once ``size`` chunks are known, so what
    is held is bounded by that and by one run. A task makes its own, so nothing is held for later stages.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: type, size: int):
        self.make, self.kind, self.size = make, kind, size
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.numbers, self.used = np.empty(1 << 16, self.kind), 0
        self.starts, self.counts = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def _learn(self, chunks: list[str]) -> None:
        numbers, counts = self.make(chunks)
        n, m = len(self.rows), len(chunks)
        while n + m > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.counts))
        while self.used + len(numbers) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.empty_like(self.numbers)])
        self.counts[n : n + m] = counts
        self.starts[n : n + m] = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.numbers[self.used : self.used + len(numbers)] = numbers
        self.used += len(numbers)
        self.rows.update(zip(chunks, range(n, n + m), strict=True))

    def numbered(self, chunks: list[str]) -> np.ndarray:
        """The row of each chunk; the chunks are distinct."""
        get = self.rows.get
        found = np.array([get(c, -1) for c in chunks], np.int32)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if len(self.rows) > self.size:
                self._forget()
                missing = np.arange(len(chunks))
            found[missing] = np.arange(len(self.rows), len(self.rows) + len(missing))
            self._learn([chunks[i] for i in missing.tolist()])
        return found

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the rows, one after the other, and where each row's end. Places take four bytes each where those hold them."""
        counts = self.counts[rows]
        total = int(counts.sum(dtype=np.int64))
        kind = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        stops = np.cumsum(counts, dtype=kind)
        first = self.starts[rows].astype(kind, copy=False)
        first -= stops
        first += counts
        at = np.repeat(first, counts)
        at += np.arange(total, dtype=kind)
        return self.numbers[at], stops

    def joined(self, parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
        """(numbers, stops, chunks, ends): the numbers of all texts' parts, where those of each part end, the parts by their
        numbers among the distinct ones, and where each text's parts end."""
        ends = parts.offsets.to_numpy()
        found = parts.flatten().dictionary_encode()
        numbers, stops = self.gathered(self.numbered(found.dictionary.to_pylist())[found.indices.to_numpy()])
        return numbers, stops, found, ends[1:] - ends[0]

    def texts(self, parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' numbers and where each text's end in them."""
        numbers, stops, _, ends = self.joined(parts)
        return numbers, np.where(ends > 0, stops[np.maximum(ends, 1) - 1], 0).astype(np.int64) if len(stops) else np.zeros(len(ends), np.int64)


def between_blanks(texts: pa.Array) -> pa.ListArray:
    """Each text cut at single blanks, a line feed counting as one; a null text is an empty one, and that is one empty part."""
    return pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")


def in_order(numbers: np.ndarray, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ``counts`` numbers, the i-th of which belongs at place ``order[i]``, in order of their places."""
    back = np.argsort(order)
    begins, n = (np.cumsum(counts) - counts)[back], counts[back]
    return numbers[np.repeat(begins - np.cumsum(n) + n, n) + np.arange(len(numbers))], n


def as_array(texts: pa.Array | list) -> pa.Array:
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())


def runs(texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Places (start, stop) of runs of about ``size`` bytes of text, so that few split texts are held at once; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, stop
        at = stop


def slices(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``ids`` cut at ``ends`` as a binary column, without a copy of each part."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over a task's batches, after which the memory that it held goes back to the machine: a worker that waits
    for its next task holds what the allocators keep, and executors count it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return over
