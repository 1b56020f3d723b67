"""Token ids of whole texts with a tokenizer file, each distinct word encoded once.

The vocabulary splits a text at white space before it merges, so a text's ids are those of its space-separated
chunks in order. A chunk that is Latin letters with ASCII punctuation behind splits again between the two. Both steps
are the tokenizer's own, so the ids equal those of encoding the text in one piece; what is saved is encoding the same
word again. Words of plain lower-case letters need no normalizing and no splitting beyond blanks, so they go to the
same model without those steps. Memories are emptied at a fixed size, so a worker's memory is bounded.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pactlens.llm.memo import Memo, as_array, between_blanks, in_order, runs

#: Letters whose normal form is themselves, and ASCII punctuation without the apostrophe (``'s`` is one unit).
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
MEMORY, RUN = 500_000, 4_000_000


@functools.cache
def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file, the same one for plain lower-case words, and which ids end a word, once per Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    plain = Tokenizer(tokenizer.model)  # the same model, held once
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return tokenizer, plain, ends


class TokenIds:
    """Ids of texts. At most ``memory`` chunks and twice as many words are remembered, and those of one run; a task makes its own."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.tokenizer, self.plain, self.ends = _tokenizer(path)
        self.words = Memo(self._encoded, np.uint32, 2 * memory)
        self.chunks = Memo(self._made, np.uint32, memory)

    def _made(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks: those of a word of plain letters in lower case, then those of the punctuation behind it; any other chunk is one word."""
        whole = pa.array(chunks, pa.string())
        word = pc.utf8_rtrim(whole, characters=_PUNCTUATION)
        plain = pc.match_substring_regex(word, _PLAIN)
        tailed = pc.and_(plain, pc.not_equal(word, whole)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(tailed)
        length = pc.utf8_length(word).take(pa.array(at)).to_pylist()
        tails = pa.array([chunks[i][k:] for i, k in zip(at.tolist(), length, strict=True)], pa.string())
        found = pa.chunked_array([pc.if_else(plain, pc.utf8_lower(word), whole), tails]).combine_chunks().dictionary_encode()
        rows = self.words.numbered(found.dictionary.to_pylist())[found.indices.to_numpy()]
        n = len(chunks)
        ids, stops = self.words.gathered(np.insert(rows[:n], at + 1, rows[n:]))
        return ids, np.diff(stops[np.cumsum(1 + tailed) - 1], prepend=0)

    def _encoded(self, words: list[str], many: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words: those of plain letters by ``many`` in one call, where each ends at a piece with the end mark."""
        own = pc.match_substring_regex(pa.array(words, pa.string()), _PLAIN).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
        plain, told = [words[i] for i in np.flatnonzero(own).tolist()], []
        for at in range(0, len(plain), many):
            part = plain[at : at + many]
            found = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            n = np.diff(np.flatnonzero(self.ends[found]) + 1, prepend=0)
            told.append((found, n) if len(n) == len(part) else self._whole(part))
        told.append(self._whole([words[i] for i in np.flatnonzero(~own).tolist()]))
        ids, counts = (np.concatenate(x) for x in zip(*told, strict=True))
        return in_order(ids, counts, order)

    def _whole(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for own in found for i in own], np.uint32), np.array([len(own) for own in found], np.int64)

    def flat(self, texts: pa.Array | list, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by ``end_id`` if given, and where each text's end."""
        ids, ends = self.chunks.texts(between_blanks(as_array(texts)))
        if end_id is None:
            return ids, ends
        return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        ids, ends = self.flat(texts)
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * s : 4 * e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encoded_runs(encoder: TokenIds, batches: Iterable[pa.RecordBatch], end_id: int, run: int = RUN) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, ids, ends) of runs of the batches' rows (key, text), as :meth:`TokenIds.flat` gives them."""
    for b in batches:
        for at, stop in runs(b.column(1), run):
            yield b.column(0).slice(at, stop - at), *encoder.flat(b.column(1).slice(at, stop - at), end_id)


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF
