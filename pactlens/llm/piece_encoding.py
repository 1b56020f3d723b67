"""Operator 7: encoding and decoding with a piece vocabulary, by an Aho-Corasick automaton that drives Viterbi.

One pass over the characters follows the automaton; at each position the output links give every piece that ends
there, and each relaxes the best score of that position. The best-scoring segmentation wins, of equal scores the one
whose last piece is longest. This is the unigram objective on the vocabulary's scores; a vocabulary that was made for
merging gives other ids under its own merge rule.

No piece holds a blank behind another character, so the best path is cut before every run of blanks and each distinct
word needs one pass. Scores are added in double precision: the vocabulary marks its blanks and unknown characters with
scores so low that single precision would lose what follows them. Many words advance together, position by position, in numpy.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.memo import Memo, as_array, in_order, runs, slices, tidy

BLANK = "▁"
_UNIT = re.compile(" +[^ ]*")
MEMORY = 300_000


class Automaton:
    """Trie of pieces with fail and output links, as sorted arrays."""

    def __init__(self, pieces: dict[str, int], scores: np.ndarray):
        children: list[dict[int, int]] = [{}]
        self.depth, self.piece = [0], [-1]
        for text, number in pieces.items():
            node = 0
            for c in map(ord, text):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.piece.append(-1)
                node = children[node][c]
            self.piece[node] = number
        fail, out, line = [0] * len(children), [-1] * len(children), [0]
        for node in line:
            for c, child in children[node].items():
                line.append(child)
                back = fail[node]
                while node and back and c not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(c, 0) if node else 0
                out[child] = fail[child] if self.piece[fail[child]] >= 0 else out[fail[child]]
        keys = np.array([node << 21 | c for node, own in enumerate(children) for c in own], np.int64)
        to = np.array([child for own in children for child in own.values()], np.int64)
        by = np.argsort(keys)
        self.keys, self.to = keys[by], to[by]
        self.fail, self.out, self.depth, self.piece = (np.array(x, np.int64) for x in (fail, out, self.depth, self.piece))
        self.scores = scores

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        state, left = state.copy(), np.arange(len(state))
        while len(left):
            key = state[left] << 21 | char[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[left[hit]] = self.to[at[hit]]
            missed = left[~hit]
            stuck = state[missed] == 0
            state[missed[~stuck]] = self.fail[state[missed[~stuck]]]
            left = missed[~stuck]
        return state

    def viterbi(self, words: list[str], unknown: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, end, piece) of the best segmentations, in order; piece -1 is a single character that no piece is."""
        length = np.array([len(w) for w in words])
        by = np.argsort(-length, kind="stable")
        n, longest = len(words), int(length.max(initial=0))
        chars = np.zeros((n, longest), np.int64)
        flat = np.frombuffer("".join(words[i] for i in by).encode("utf-32-le"), np.uint32)
        rows = np.repeat(np.arange(n), length[by])
        chars[rows, np.arange(len(flat)) - np.repeat(np.cumsum(length[by]) - length[by], length[by])] = flat
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        came, used = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        state = np.zeros(n, np.int64)
        for i in range(1, longest + 1):
            live = int(np.searchsorted(-length[by], -i, "right"))
            state = self.step(state[:live], chars[:live, i - 1])
            single = np.zeros(live, bool)
            node, lane = state, np.arange(live)
            node = np.where(self.piece[node] >= 0, node, self.out[node])
            while True:
                lane, node = lane[node >= 0], node[node >= 0]
                if not len(lane):
                    break
                start = i - self.depth[node]
                score = best[lane, start] + self.scores[self.piece[node]]
                single[lane[self.depth[node] == 1]] = True
                better = score > best[lane, i]
                best[lane[better], i], came[lane[better], i], used[lane[better], i] = score[better], start[better], self.piece[node[better]]
                node = self.out[node]
            alone = np.flatnonzero(~single)
            score = best[alone, i - 1] + unknown
            alone, score = alone[score > best[alone, i]], score[score > best[alone, i]]
            best[alone, i], came[alone, i], used[alone, i] = score, i - 1, -1
        at, lane, ends, pieces, lanes = length[by].astype(np.int64), np.arange(n), [], [], []
        lane = lane[at > 0]
        while len(lane):
            ends.append(at[lane])
            pieces.append(used[lane, at[lane]])
            lanes.append(by[lane])
            at[lane] = came[lane, at[lane]]
            lane = lane[at[lane] > 0]
        if not ends:
            return (np.empty(0, np.int64),) * 3
        lanes, ends, pieces = np.concatenate(lanes), np.concatenate(ends), np.concatenate(pieces)
        order = np.lexsort((ends, lanes))
        return lanes[order], ends[order], pieces[order]


class Pieces:
    """Encodes and decodes texts with the pieces and scores of a vocabulary file; unknown characters become byte pieces. At most
    ``memory`` words and those of one run are remembered; a task makes its own."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.names, self.byte, self.unknown_id, self.unknown, *_ = _vocabulary(path)
        self.path = path
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.is_byte = np.zeros(len(self.names), bool)
        self.is_byte[list(self.byte_of)] = True
        self.words = Memo(self._made, np.uint32, memory)

    @property
    def automaton(self) -> Automaton:
        """Built by who encodes; decoding needs none."""
        return _automaton(self.path)

    def _made(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each taken to stand behind a blank."""
        length = np.array([len(w) for w in words])
        order, told, at = np.argsort(length, kind="stable"), [], 0
        while at < len(words):  # runs of similar length whose tables stay small
            stop = min(len(words), at + 20_000)
            while stop - at > 1 and (stop - at) * length[order[stop - 1]] > 2_000_000:
                stop = at + (stop - at) // 2
            told.append(self._best([BLANK + words[i].replace(" ", BLANK) for i in order[at:stop].tolist()]))
            at = stop
        return in_order(*(np.concatenate(x) for x in zip(*told, strict=True)), order)

    def _best(self, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word, end, piece = self.automaton.viterbi(run, self.unknown)
        unknown = np.flatnonzero(piece < 0)
        if not len(unknown):
            return piece.astype(np.uint32), np.bincount(word, minlength=len(run))
        spelt = [run[w][e - 1].encode("utf-8", "replace") for w, e in zip(word[unknown].tolist(), end[unknown].tolist(), strict=True)]
        n = np.ones(len(piece), np.int64)
        n[unknown] = [len(b) for b in spelt]
        ids = np.repeat(piece, n)
        ids[ids < 0] = [self.byte.get(b, self.unknown_id) for own in spelt for b in own]
        return ids.astype(np.uint32), np.bincount(word, n, len(run)).astype(np.int64)

    @staticmethod
    def _units(texts: pa.Array) -> pa.ListArray:
        """Words by what follows their first blank; a text is taken to begin with a blank, a null or empty one has none."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), BLANK, " ")
        parts = pc.split_pattern(texts, " ")
        odd = pc.or_(pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " ")), pc.match_substring(texts, "  "))
        if not pc.any(odd).as_py():
            return parts
        plain, places = pc.invert(odd), np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        runs_of_blanks = pa.array([[u[1:] for u in _UNIT.findall(" " + t)] if t else [] for t in pc.filter(texts, odd).to_pylist()], parts.type)
        return pa.concat_arrays([pc.filter(parts, plain), runs_of_blanks]).take(pa.array(np.argsort(places)))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids and where each text's end; null and empty give none."""
        return self.words.texts(self._units(texts))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.flat(as_array(texts))
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]

    def decode(self, raw: bytes) -> str:
        ids = np.frombuffer(raw, "<u4")
        names = self.names
        if not self.is_byte[ids].any():
            return "".join([names[i] for i in ids.tolist()]).replace(BLANK, " ")[1:]
        parts, pending = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                parts.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            parts.append(names[i])
        parts.append(pending.decode("utf-8", "replace"))
        return "".join(parts).replace(BLANK, " ")[1:]


@functools.cache
def _vocabulary(path: str) -> tuple:
    """What a vocabulary file says, once per Python worker; its size is the file's."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(BLANK in names[i].lstrip(BLANK) for i in plain):
        raise ValueError("a piece holds a blank behind another character: texts cannot be cut at blanks")
    byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    return names, byte, sp.unk_id(), float(scores[plain].min()) - 10, {names[i]: i for i in plain}, scores


@functools.cache
def _automaton(path: str) -> Automaton:
    return Automaton(*_vocabulary(path)[4:])


def encode_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each whole text, ids as little-endian unsigned 32-bit bytes; null and empty texts give no ids.

    A blank mark in a text counts as a blank, as the vocabulary's own escape does. Repeated rows are encoded each, a
    null id stays; other columns are left out, whatever their names. No rows give no rows.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary)
        for b in batches:
            for at, stop in runs(b.column(1)):
                ids, ends = pieces.flat(b.column(1).slice(at, stop - at))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, stop - at), slices(ids.astype("<u4"), ends)], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(encoded), "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text) from :func:`encode_pieces`' rows."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pieces.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return encoded.mapInArrow(tidy(decoded), "doc_id long, ids binary, text string")


def op7_piece_encoding(spark, sf_dir):
    """doc_id, n_tokens, ids_crc32, decoded_chars and decoded_sha256 (of the text decoded from the ids; equals the text's own, but that a blank mark in it has become a blank)."""
    import public_tokenizers

    from pactlens.llm.common import table

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"),
    )
