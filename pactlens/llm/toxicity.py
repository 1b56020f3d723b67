"""Operator 6: toxicity of texts restored by a noisy-channel decoder.

What may be disguised (letters mixed with digits or signs, letters parted by blanks or signs, letters repeated three
times or more) becomes a lattice: each sign may stand for itself, for a letter it looks like, or for nothing; a
repeated letter may stand for nothing; a blank between single letters may be one or nothing. Viterbi finds the path
that is likeliest under a character language model times the channel. Any other word has one path, itself.

The language model's trigrams are counted over all texts. Restored words are scored by logistic regression on which
words and word beginnings occur and how densely. Those that stand out in toxic texts are chosen by a likelihood-ratio test; their
weights, none below zero, are learned by follow-the-regularised-leader with
an elastic net, all from a bounded sample. Distinct words are restored and looked up once. A text's score is the largest
of those of the whole text and of overlapping windows over all of it, so a toxic passage does not fade in a long text.
"""

from __future__ import annotations

import collections
import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pactlens.llm.ftrl import Ftrl
from pactlens.llm.language_id import held_out, smallest_hashes
from pactlens.llm.memo import Memo, between_blanks, runs, tidy
from pactlens.llm.shingles import WordHashes, mix, shingles

#: Letters that a sign can stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l", "µ": "u"}
GAPS = " .-_*~'`,/\\^="
#: Costs (negative log probabilities) of the channel.
SWAP, KEEP_SIGN, DROP_GAP, KEEP_GAP, DROP_REPEAT, KEEP_REPEAT = 1.0, 14.0, 0.5, 6.0, 0.7, 3.0
PER, WINDOW = 50, 600
HALF = WINDOW // 2
BITS, SYMBOLS, MEMORY, MARKS = 20, 128, 300_000, 16
_ALPHABET = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + "".join(chr(i) for i in range(0xDF, 0x100) if chr(i).isalpha()))}
_OTHER = 1
_SIGN = rf"[{re.escape(GAPS.strip())}]"
_BETWEEN = rf"(?:[ \t]{{1,2}}(?:{_SIGN}{{1,3}}[ \t]{{0,2}})?|{_SIGN}{{1,3}}[ \t]{{1,2}})"  # a blank, with signs or without
_BEFORE, _AFTER = rf"(?:{_SIGN}|[\"(\[{{<«“¿¡])", rf"(?:{_SIGN}|[;:!?\")\]}}>»”…])"
_SPACED = re.compile(rf"(?:(?<!\S)|(?<=\s{_BEFORE})|(?<=\A{_BEFORE}))[^\W_](?:{_BETWEEN}[^\W_]){{2,}}(?={_AFTER}*(?!\S))")
#: What :data:`_SPACED` begins with, for Arrow's expressions, where the classes of letters and blanks have other names.
_MAYBE_SPACED = rf"(?:^|[\s\pZ\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]){_BEFORE}?[\pL\pN]{_BETWEEN}[\pL\pN]{_BETWEEN}"
_SIGNS = re.escape("".join(LOOKALIKES))
_DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|^[{_SIGNS}]+[^\W\d_]{{2,}}|[^\W\d_][@$0-9|]+$|([^\W\d_])\1\1|[^\W_](?:[{re.escape(GAPS)}][^\W_]){{2,}}")
_EDGE = re.compile(r"^[\"'(\[{<«“¿¡]+|[.,;:!?\"')\]}>»”…]+$")
_WORDS = re.compile(r"[^\W\d_]+")
_FIXED: np.ndarray | None = None


def _codes() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 1 for letters outside the alphabet."""
    global _FIXED
    if _FIXED is None:
        _FIXED = np.fromiter((_ALPHABET.get(chr(i), _OTHER) if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000)
    return _FIXED


class CharModel:
    """Trigram model of letters with a boundary symbol 0, from counts of shape (SYMBOLS,) * 3."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        two, one = c.sum(axis=0), c.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one + 0.5).sum()
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        self.cost = -np.log((c + 20 * p2) / (c.sum(axis=2, keepdims=True) + 20)).astype(np.float32)

    def __call__(self, a: str, b: str, c: str) -> float:
        x, y, z = (_ALPHABET.get(s, _OTHER) if s.isalpha() else 0 for s in (a, b, c))
        return float(self.cost[x, y, z])

    def restore(self, noisy: str) -> str:
        """The likeliest text behind a disguised stretch (lower case); as long texts as wanted, in one pass.

        A state is the last two characters of the text so far. No place offers more than four, and a place that may
        give nothing keeps its states, so there are few of them (see the tests) and none is dropped.
        """
        noisy = noisy.lower()
        n = len(noisy)
        told: list[str] = []  # what all paths begin with
        due = 256
        beams: dict[tuple[str, str], tuple[float, tuple | None]] = {(" ", " "): (0.0, None)}
        for i, c in enumerate(noisy):
            if i == due:
                beams, still = _flush(beams, told)
                due += max(256, still)
            last, step = noisy[i - 1] if i else " ", {}
            inner = 0 < i < n - 1
            emits: list[tuple[str, float]] = []
            if c.isalpha():
                if c == last:
                    emits = [(c, KEEP_REPEAT if i > 1 and noisy[i - 2] == c else 0.0), ("", DROP_REPEAT if i > 1 and noisy[i - 2] == c or i + 1 < n and noisy[i + 1] == c else 5.0)]
                else:
                    emits = [(c, 0.0)]
            else:
                emits = [(x, SWAP) for x in LOOKALIKES.get(c, "")]
                if c in GAPS:
                    emits += [("", DROP_GAP if inner else 0.0), (" ", KEEP_GAP if c == " " else KEEP_GAP + 2)]
                else:
                    emits.append((c, KEEP_SIGN))
                    if not emits[:-1]:
                        emits = [(c, 0.0)]
            for (a, b), (cost, path) in beams.items():
                for out, channel in emits:
                    if not out:
                        state, total, way = (a, b), cost + channel, path
                    else:
                        seen = out if out.isalpha() else " "
                        state, total, way = (b, seen), cost + channel + (self(a, b, out) if not (seen == " " and b == " ") else 0.0), (path, out)
                    if state not in step or total < step[state][0]:
                        step[state] = (total, way)
            beams = step
        end = min(((cost + self(a, b, " "), path) for (a, b), (cost, path) in beams.items()), key=lambda x: x[0])
        letters, path = [], end[1]
        while path is not None:
            path, out = path
            letters.append(out)
        return "".join(told + letters[::-1]).strip()


def _flush(beams: dict, told: list[str]) -> tuple[dict, int]:
    """``beams`` without what all of their paths begin with, which goes to ``told``, and the length of the longest path
    left; costs count from the least. So memory follows the part that is still open."""
    low, paths = min(cost for cost, _ in beams.values()), []
    for _, path in beams.values():
        letters = []
        while path is not None:
            path, out = path
            letters.append(out)
        paths.append(letters[::-1])
    shared = 0
    for column in zip(*paths, strict=False):
        if len(set(column)) > 1:
            break
        shared += 1
    told += paths[0][:shared]
    fresh, nodes = {}, {}
    for (state, (cost, _)), letters in zip(beams.items(), paths, strict=True):
        path, name = None, 0
        for out in letters[shared:]:  # equal beginnings are one path
            if (name, out) not in nodes:
                nodes[name, out] = len(nodes) + 1, (path, out)
            name, path = nodes[name, out]
        fresh[state] = (cost - low, path)
    return fresh, max(map(len, paths)) - shared


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigrams of letters over all texts; as many numbers reach the driver as there are trigrams of the alphabet."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            texts, n = [], 0
            for t in [*b.column(0).to_pylist(), None]:
                texts.append(t or "")
                n += len(texts[-1])
                if n > 500_000 or t is None:
                    c = _codes()[np.frombuffer(("  ".join(texts) + "  ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
                    c = np.concatenate([np.zeros(2, np.uint32), c])
                    at = (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]
                    total += np.bincount(at[(c[2:] > 0) | (c[1:-1] > 0)], minlength=SYMBOLS**3)
                    texts, n = [], 0
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    sums = docs.select(text_col).mapInArrow(tidy(counted), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(SYMBOLS**3, np.int64)
    total[sums["at"].to_numpy(int)] = sums["n"].to_numpy(int)
    return total


class Restorer:
    """Feature numbers of whole texts' restored words. At most ``memory`` distinct words are remembered, and those of one run."""

    def __init__(self, model: CharModel, kept: set[int] | None = None, memory: int = MEMORY):
        self.model, self.kept = model, kept
        self.chunks, self.spaced = Memo(self._made, np.uint32, memory), Memo(self._decoded, np.uint32, memory // 8)

    def _made(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.features(self.restored(c)) for c in chunks]
        return np.concatenate(found), np.array([len(x) for x in found])

    def _decoded(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.features(self.model.restore(c)) for c in stretches]
        return np.concatenate(found), np.array([len(x) for x in found])

    def restored(self, chunk: str) -> str:
        """The chunk with what may be disguised in it restored."""
        core = _EDGE.sub("", chunk)
        if core.isalpha() and not _DISGUISED.search(core):
            return chunk
        for part in dict.fromkeys((core, chunk)):  # signs at the edge may be punctuation or letters
            if _DISGUISED.search(part):
                return self.model.restore(part)
        return chunk

    def features(self, words: str) -> np.ndarray:
        found: set[int] = set()
        for w in _WORDS.findall(words.lower()):
            for f in {w + "$", *(w[:k] for k in (4, 5, 6) if len(w) >= k)}:
                found.add(xxhash.xxh32_intdigest(f) & ((1 << BITS) - 1))
        return np.array(sorted(found if self.kept is None else found & self.kept), np.uint32)

    def of(self, texts: pa.Array, windows: bool = True) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """For each text the views of it, first the whole, then windows of ``WINDOW`` words that overlap by half: the
        features of the restored words, ascending, and how often each occurs per ``PER`` words, at most 1 in each.
        Windows without a feature are left out, and all of them if not ``windows``."""
        for at, stop in runs(texts, 1_000_000 if self.kept is None else 2_000_000):  # all features are many more
            yield from self._run(texts.slice(at, stop - at), windows)

    def _run(self, texts: pa.Array, windows: bool) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        numbers, stops, found, ends = self.chunks.joined(between_blanks(texts))
        chunks, empty = found.indices.to_numpy(), pc.index(found.dictionary, "").as_py()
        place = np.repeat(np.arange(len(chunks)), np.diff(stops, prepend=0))  # the part of each feature
        spaced = pc.fill_null(pc.match_substring_regex(texts, _MAYBE_SPACED), False).to_pylist()
        cuts = np.concatenate([[0], np.concatenate([[0], stops])[ends]]).tolist()
        for i, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            at, where = numbers[cuts[i] : cuts[i + 1]], place[cuts[i] : cuts[i + 1]] - begin
            if spaced[i]:
                text = texts[i].as_py().replace("\n", " ")
                stretches = list(_SPACED.finditer(text))
                if stretches:
                    told = pa.array([re.sub(r"\s+", " ", m[0]) for m in stretches]).dictionary_encode()
                    more, stop = self.spaced.gathered(self.spaced.numbered(told.dictionary.to_pylist())[told.indices.to_numpy()])
                    behind = np.cumsum([text.count(" ", a, b) for a, b in zip([0, *(m.start() for m in stretches)], (m.start() for m in stretches), strict=False)])
                    at, where = np.concatenate([at, more]), np.concatenate([where, np.repeat(behind, np.diff(stop, prepend=0))])
            if not len(at):
                yield [(at, np.empty(0))]
                continue
            own = chunks[begin:end]
            views = [self._view(at, own, empty)]
            if windows and len(own) > WINDOW:
                for w in np.unique(np.concatenate([where // HALF, np.maximum(0, where // HALF - 1)])).tolist():
                    inside = (where >= w * HALF) & (where < w * HALF + WINDOW)
                    views.append(self._view(at[inside], own[w * HALF : w * HALF + WINDOW], empty))
            yield views

    @staticmethod
    def _view(features: np.ndarray, chunks: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(features, return_counts=True)
        words = chunks[chunks != empty]
        length = min(len(words), 3 * len(np.unique(words)))  # a word said over and over does not make a text long
        return at, np.minimum(1.0, PER * n / max(PER / 2, length))

    def restored_text(self, text: str | None) -> str:
        """The whole text with disguised stretches restored."""
        text = _SPACED.sub(lambda m: self.model.restore(re.sub(r"\s+", " ", m[0])), text or "")
        return re.sub(r"\S+", lambda m: self.restored(m[0]), text)


@dataclasses.dataclass
class ToxicityModel:
    counts: np.ndarray  # of the character model, sparse: positions
    values: np.ndarray
    weights: dict[int, float]
    bias: float
    trained: bool

    def restorer(self, all_features: bool = False) -> Restorer:
        full = np.zeros(SYMBOLS**3, np.int64)
        full[self.counts] = self.values
        return Restorer(CharModel(full), None if all_features else set(self.weights))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = 4000, clean_rows: int = 12_000, epochs: int = 8, least_ratio: float = 20.0) -> ToxicityModel:
    """Character counts from all ``docs``; weights from those that ``labels`` (id, toxic) marks.

    ``toxic_rows`` and ``clean_rows`` bound the sample that weights are learned from (the smallest hashes of the id).
    Texts of any length are learned from, whole. Of a document labelled twice the higher label counts; an id that repeats
    counts once, with the smallest of its texts, and null ids are not learned from. ``least_ratio`` is the likelihood ratio (G squared) from
    which a feature is used, or what one in a hundred such tests of so many features reaches by chance, if less.
    """
    from pactlens.llm.common import stash

    counts = char_counts(docs, text_col)
    at = np.flatnonzero(counts)
    model = ToxicityModel(at, counts[at], {}, 0.0, False)
    marked = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = smallest_hashes(marked, "toxic", "toxicity sample", F.when(F.col("toxic") == 1, toxic_rows).otherwise(clean_rows))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # a bounded number of ids
    sample = sample.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic")

    sample = stash(sample, "toxicity-sample")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            marks = []
            for w in words.each(b.column(1)):
                h, _ = shingles(w)
                marks.append([int(mix(h ^ np.uint64(k)).min().astype(np.int64)) for k in range(MARKS)] if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(marks, pa.list_(pa.int64()))], ["id", "toxic", "marks"])

    copies = near_copies(sample.mapInArrow(tidy(smallest), "id long, toxic int, marks array<long>").collect())

    def standing_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, n = model.restorer(all_features=True), np.zeros((2, (1 << BITS) + 1), np.int64)
        for b in batches:
            for key, toxic, views in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), restorer.of(b.column(1), False), strict=True):
                if key in copies:
                    continue
                n[toxic, views[0][0]] += 1
                n[toxic, -1] += 1
        at = np.flatnonzero(n.any(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[1, at]), pa.array(n[0, at])], ["feature", "toxic", "clean"])

    tables = sample.mapInArrow(tidy(standing_out), "feature int, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = tables.where("toxic >= 3").toPandas()
    whole = found[found.feature == 1 << BITS]
    if not len(whole):
        totals = tables.where(F.col("feature") == 1 << BITS).first()
        if totals is None:
            return model
        model.bias, model.trained = -5.0, True  # labels, but hardly a toxic one
        return model
    positive, negative = float(whole.toxic.iloc[0]), float(whole.clean.iloc[0])
    found = found[found.feature < 1 << BITS]
    a, b = found.toxic.to_numpy(float), found.clean.to_numpy(float)
    least = min(least_ratio, 2 * np.log(max(1, len(found)) / 0.01))  # where few features are tested, chance reaches less
    chosen = set(found.feature[(likelihood_ratio(a, b, positive, negative) >= least) & (a * negative > 8 * b * positive)].tolist())
    model.weights = dict.fromkeys(chosen, 1.0)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = model.restorer()
        for b in batches:
            found = [views[0] for views in restorer.of(b.column(1), False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["id", "toxic", "at", "x"])

    rows = sorted((r for r in sample.mapInArrow(tidy(featured), "id long, toxic int, at binary, x binary").collect() if r.id not in copies), key=lambda r: r.id)
    learner = Ftrl(1 << BITS, 2, alpha=1.0, l1=0.2, l2=0.001)
    order, rng = np.arange(len(rows)), np.random.default_rng(6)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            learner.learn(np.frombuffer(rows[i].at, "<u4"), np.frombuffer(rows[i].x), rows[i].toxic)
    w = learner.weights(np.array(sorted(chosen), int))
    model.weights = {f: float(x) for f, x in zip(sorted(chosen), w[:, 1] - w[:, 0], strict=True) if x > 0}
    model.bias, model.trained = float(learner.bias[1] - learner.bias[0]), True
    return model


def near_copies(rows: list) -> set:
    """Ids of the rows (id, toxic, marks) most of whose marks agree with those of an earlier row of the same label that is no copy."""
    copies, seen = set(), {}
    for r in sorted(rows):
        shared = collections.Counter(k for place in enumerate(r.marks) for k in seen.get((r.toxic, place), ()))
        if any(n > MARKS // 2 for n in shared.values()):
            copies.add(r.id)
        else:
            for place in enumerate(r.marks):
                seen.setdefault((r.toxic, place), []).append(r.id)
    return copies


def likelihood_ratio(a: np.ndarray, b: np.ndarray, positive: float, negative: float) -> np.ndarray:
    """G squared of the two-by-two tables of having a feature (a toxic, b clean) or not."""
    n = positive + negative
    cells = ((a, (a + b) * positive / n), (b, (a + b) * negative / n), (positive - a, (n - a - b) * positive / n), (negative - b, (n - a - b) * negative / n))
    return 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0) for o, e in cells)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic. An empty or null text gets that of a text without any known
    word; a model without labels gives 0. A column of that name is replaced."""
    kept = docs.drop(score_col)
    place = kept.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, weights = model.restorer(), np.zeros(1 << BITS)
        weights[list(model.weights)] = list(model.weights.values())
        for b in batches:
            s = [model.bias + max(float(weights[at] @ x) for at, x in views) for views in restorer.of(b.column(place))]
            p = 1.0 / (1.0 + np.exp(-np.clip(s, -500, 500))) if model.trained else np.zeros(len(s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, score_col])

    return kept.mapInArrow(tidy(scored), StructType([*kept.schema.fields, StructField(score_col, DoubleType())]))


def op6_toxicity(spark, sf_dir):
    from pactlens.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")
    out = score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
