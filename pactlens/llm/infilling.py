"""Operator 11: fill-in-middle by a byte automaton in two passes.

The automaton is one table over (state, class of byte). Its states are the prefixes of the sentinels joined with where
the text is within a unit, and a transition tells whether a unit starts at the byte and whether a sentinel ends there.
A byte that continues a UTF-8 character starts no unit. As the state rests on the last few bytes only, texts are cut into blocks that
are read side by side, each entered in the state that the bytes before it lead to. The first pass counts the
transitions of each block; a second one reads again only the blocks that the counts say hold a cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactlens.llm.memo import runs, tidy

#: What marks prefix, suffix and middle in an output.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("char", "word", "line")
_STARTS, _SENTINEL = 1, 2  # what a transition tells
_BLANKS = b" \t\n\v\f\r"
BLOCK = 256


@dataclass(frozen=True)
class Automaton:
    """``classes``: of each byte; ``following`` and ``tells``: by state times the number of classes, plus class. ``following`` holds states times that number."""

    classes: np.ndarray
    following: np.ndarray
    tells: np.ndarray
    memory: int  # of the last bytes that a state rests on


def automaton(sentinels: tuple[str, ...] = SENTINELS, unit: str = "char") -> Automaton:
    """Units: ``char`` is a code point; ``line`` ends behind a line feed; ``word`` is a run of blanks and what follows up to the next."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    words = [s.encode() for s in sentinels]
    if not all(words):
        raise ValueError("a sentinel must not be empty")
    prefixes = sorted({w[:n] for w in words for n in range(len(w) + 1)}, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(prefixes)}
    own = sorted(set(b"".join(words)))

    def kind(byte: int) -> tuple:
        return byte if byte in own else -1, 0x80 <= byte < 0xC0, byte in _BLANKS, byte == 10

    kinds = sorted({kind(b) for b in range(256)})
    example = {kind(b): b for b in range(256)}
    places = ("start", "blank", "inside")  # of a unit
    following = np.zeros((len(prefixes) * len(places), len(kinds)), np.int32)
    tells = np.zeros(following.shape, np.uint8)
    for p, read in enumerate(prefixes):
        for q, place in enumerate(places):
            for c, (_, continues, blank, feed) in enumerate(kinds):
                after = read + bytes([example[kinds[c]]])
                kept = next(after[i:] for i in range(len(after) + 1) if after[i:] in number)
                starts = {"char": not continues, "line": place == "start", "word": place == "start" or (place == "inside" and blank)}[unit] or (place == "start" and not continues)
                then = {"char": "inside", "line": "start" if feed else "inside", "word": "blank" if blank else "inside"}[unit]
                following[p * len(places) + q, c] = (number[kept] * len(places) + places.index(then)) * len(kinds)
                tells[p * len(places) + q, c] = _STARTS * starts + _SENTINEL * any(after.endswith(w) for w in words)
    classes = np.array([kinds.index(kind(b)) for b in range(256)], np.int32)
    return Automaton(classes, following.ravel(), tells.ravel(), max(map(len, words)))


class Scan:
    """The first pass over texts that lie one after the other in ``data``, text i from ``begins[i]`` to ``ends[i]``."""

    def __init__(self, table: Automaton, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, block: int = BLOCK):
        if block < table.memory:
            raise ValueError("a block must not be shorter than what a state rests on")
        self.table, self.data, self.ends = table, data, ends
        blocks = -((begins - ends) // block)
        self.last = np.cumsum(blocks)
        self.first = self.last - blocks
        within = np.arange(blocks.sum()) - np.repeat(self.first, blocks)
        self.start = np.repeat(begins, blocks) + within * block
        self.stop = np.minimum(self.start + block, np.repeat(ends, blocks))
        inside = np.flatnonzero(within > 0)
        self.entry = np.zeros(len(self.start), np.int32)
        self.entry[inside] = self._read(self.start[inside] - table.memory, self.start[inside], np.zeros(len(inside), np.int32))[0]
        _, self.counts, told = self._read(self.start, self.stop, self.entry)
        self.before = np.concatenate([[0], np.cumsum(self.counts)])
        #: Units of each text, and whether a sentinel is in it.
        self.units = self.before[self.last] - self.before[self.first]
        hits = np.concatenate([[0], np.cumsum((told & _SENTINEL) > 0)])
        self.marked = hits[self.last] > hits[self.first]

    def _read(self, start: np.ndarray, stop: np.ndarray, state: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Read all blocks side by side: (states behind them, units that start in them, all that was told). With ``wanted``, where the unit of that number in its block starts comes instead of the count."""
        table, data = self.table, self.data
        longest_first = np.argsort(start - stop, kind="stable")
        sizes = (stop - start)[longest_first]
        at, state = start[longest_first].copy(), state[longest_first].copy()
        count, told, place = (np.zeros(len(at), np.int64) for _ in range(3))
        goal = None if wanted is None else wanted[longest_first]
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step))  # blocks that go on
            key = state[:n] + table.classes[data[at[:n]]]
            state[:n] = table.following[key]
            tells = table.tells[key]
            starts = tells & _STARTS
            if goal is not None:
                here = np.flatnonzero((starts > 0) & (count[:n] == goal[:n]))
                place[here] = at[here]
            count[:n] += starts
            told[:n] |= tells
            at[:n] += 1
        back = np.empty(len(at), np.int64)
        back[longest_first] = np.arange(len(at))
        return state[back], (count if goal is None else place)[back], told[back]

    def cuts(self, texts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The second pass: where in ``data`` each text's unit of that number, from 0, starts; its end for the number behind the last."""
        out = self.ends[texts].astype(np.int64)
        inner = np.flatnonzero(units < self.units[texts])
        goal = self.before[self.first[texts[inner]]] + units[inner]
        block = np.searchsorted(self.before, goal, "right") - 1
        out[inner] = self._read(self.start[block], self.stop[block], self.entry[block], goal - self.before[block])[1]
        return out


def draws(seed: str, key: object) -> tuple[int, ...]:
    """The first four numbers of 32 bits of the sha256 of seed, colon, key; a null key is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def _infilled(table: Automaton, keys: list, texts: pa.Array, sentinels: tuple[str, str, str], seed: str, plain: int, spm: int) -> tuple[list, list, list, list, list]:
    """(units, forms, prefix units, middle units, outputs) of a run of texts."""
    texts = texts.fill_null("")
    offsets, raw = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64), texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    scan = Scan(table, data, offsets[:-1], offsets[1:])
    units, drawn = scan.units.tolist(), [draws(seed, k) for k in keys]
    forms = ["plain" if n == 0 or marked or d[2] % 100 >= 100 - plain else "spm" if d[3] % 100 < spm else "psm" for n, marked, d in zip(units, scan.marked.tolist(), drawn, strict=True)]
    cut = [i for i, f in enumerate(forms) if f != "plain"]
    ends = np.array([sorted((drawn[i][0] % (units[i] + 1), drawn[i][1] % (units[i] + 1))) for i in cut], np.int64).reshape(-1, 2)
    where = scan.cuts(np.repeat(np.array(cut, np.int64), 2), ends.ravel()).reshape(-1, 2).tolist()
    prefix, middle = [None] * len(forms), [None] * len(forms)
    marks, body = [s.encode() for s in sentinels], memoryview(data)
    outputs = [body[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    for i, (p, m), (a, b) in zip(cut, ends.tolist(), where, strict=True):
        prefix[i], middle[i] = p, m - p
        head, centre, tail = body[offsets[i] : a], body[a:b], body[b : offsets[i + 1]]
        outputs[i] = b"".join((marks[0], head, marks[1], tail, marks[2], centre) if forms[i] == "psm" else (marks[1], tail, marks[0], head, marks[2], centre))
    return units, forms, prefix, middle, outputs


ADDED = S.StructType().add("output", "string").add("form", "string").add("units", "long").add("prefix_units", "long").add("middle_units", "long")


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, unit: str = "char", seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` with ``output`` in place of the text, ``form``, ``units``, ``prefix_units`` and ``middle_units``.

    ``draws`` of the id give two cuts, each after any number of units alike, and the form: ``plain`` percent of the
    texts stay as they are, of the others ``spm`` percent have the suffix first. A text that is null, empty or holds a sentinel is
    always plain, so an output of another form holds each sentinel once and the text comes back by :func:`restored`.
    Cuts of plain texts are null, a null text's output is empty. Rows that share an id are cut by the same draws, a
    null id draws as an empty one. Bytes that begin no character belong to the unit before. Columns of ``docs`` named
    as the new ones are replaced. A text is one row's, and rows are read in runs of a few MB.
    """
    if len(set(sentinels)) != 3 or any(a != b and a in b for a in sentinels for b in sentinels) or any(a[-n:] == b[:n] for a in sentinels for b in sentinels for n in range(1, min(len(a), len(b)) + (a != b))):
        raise ValueError("sentinels must differ, and none may begin as another or the same one ends")
    others = [f for f in docs.schema.fields if f.name.lower() not in {x.name for x in ADDED.fields} | {text_col.lower()}]
    names = [f.name for f in others]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton(sentinels, unit)
        for batch in batches:
            texts, keys = batch.column(0), batch.column(1).to_pylist()
            for at, stop in runs(texts):
                units, forms, prefix, middle, outputs = _infilled(table, keys[at:stop], texts.slice(at, stop - at), sentinels, seed, plain, spm)
                told = [pa.array(outputs, pa.binary()).view(pa.string()), pa.array(forms, pa.string()), *(pa.array(x, pa.int64()) for x in (units, prefix, middle))]
                yield pa.RecordBatch.from_arrays([*(batch.column(2 + i).slice(at, stop - at) for i in range(len(names))), *told], [*names, *ADDED.names])

    quoted = [F.col(f"`{n.replace('`', '``')}`") for n in (text_col, id_col, *names)]
    first = [quoted[0].cast("string").alias("_0"), quoted[1].cast("string").alias("_1")]
    return docs.select(*first, *[c.alias(f"_{k}") for k, c in enumerate(quoted[2:], 2)]).mapInArrow(tidy(work), S.StructType([*others, *ADDED.fields]))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from an output and its form."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    whole = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    told = [F.when(form == f, F.concat(*[F.get(parts, i) for i in order])) for f, order in whole.items()]
    return F.coalesce(*told, output)


def op11_infilling(spark, sf_dir):
    from pactlens.llm.common import table

    out = infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_DRAWS = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, {_DRAWS} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
cut AS (SELECT *, substr(t, 1, p) AS a, substr(t, p + 1, q - p) AS m, substr(t, q + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
