"""Training of a severity classifier from labelled sentences with Spark ML."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions import text as T


def training_set(*frames: DataFrame) -> DataFrame:
    """ML01, SET04: rows (text, severity) of all frames, severity upper-case, without nulls and blanks."""
    out = None
    for f in frames:
        rows = f.select(F.trim("text").alias("text"), F.upper(F.trim("severity")).alias("severity")).where("text <> '' AND severity <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def stratified_split(rows: DataFrame, held_out: float = 0.2, seed: int = 42) -> DataFrame:
    """ML01: with ``held_out``, true for a fixed share of each severity, chosen by hash."""
    rows = rows.withColumns({"_hash": F.xxhash64("text", F.lit(seed)), "_range": F.shiftright(F.xxhash64("text", F.lit(seed)), 55)})  # 512 ranges of hashes
    earlier = Window.partitionBy("_severity").orderBy("_of")
    sizes = rows.groupBy(F.col("severity").alias("_severity"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))  # at most 512 rows a severity
    sizes = sizes.withColumns({"_before": F.sum("_n").over(earlier) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy("_severity"))})
    rows = rows.join(F.broadcast(sizes), F.col("severity").eqNullSafe(F.col("_severity")) & (F.col("_range") == F.col("_of")))
    rank = F.rank().over(Window.partitionBy("severity", "_range").orderBy("_hash", "text")) - 1 + F.col("_before")
    return rows.withColumn("held_out", F.coalesce(rank / F.nullif(F.col("_all") - 1, F.lit(0)), F.lit(0.0)) < held_out).drop("_hash", "_range", "_severity", "_of", "_n", "_before", "_all")


def _words(text):
    return F.filter(F.split(T.ascii_fold(F.lower(text)), r"[^\p{L}\p{Nd}]+", -1), lambda w: w != "")


def _grams(words, low: int = 3, high: int = 5):
    grams = lambda w, n: F.when(F.length(w) + 2 >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - n, F.lit(1))), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    of = lambda n: F.transform(words, lambda w: grams(w, n))  # noqa: E731  a second parameter would be the word's place
    return F.flatten(F.concat(*[of(n) for n in range(low, high + 1)]))


def char_grams(text, low: int = 3, high: int = 5):
    """Character n-grams inside words padded with a blank on each side."""
    return _grams(_words(text), low, high)


def _most_frequent(counted: DataFrame, features: int) -> list[str]:
    return [r.term for r in counted.orderBy(F.desc("n"), "term").limit(features).collect()]


def _char_vocabulary(rows: DataFrame, features: int) -> list[str]:
    """The most frequent of :func:`char_grams` that two rows have at least, worked out once for each distinct word."""
    words = rows.select(F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("words"))  # rows are numbered before they are taken apart
    words = words.select("row", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))
    grams = words.select("n", "first", "last", F.explode(_grams(F.array("word"))).alias("term")).groupBy("term").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return _most_frequent(grams.where("first < last"), features)


def train_tfidf(rows: DataFrame, features: int = 12_000):
    """ML02, ML03: TF-IDF of one to three words and of characters, into a multinomial logistic regression with balanced weights. Returns the fitted pipeline; its input needs :func:`prepared`.

    Terms are counted by groups, as there are many more of them than features; then each text is counted out once, and what learns reads its counts.
    """
    from pactlens.sources.store import stash

    rows = stash(rows.select("text", "severity"), "labelled")
    counts = rows.groupBy("severity").count()
    total, classes = counts.agg(F.sum("count"), F.count("*")).first()
    whole = prepared(rows).join(F.broadcast(counts), "severity").withColumn("weight", F.lit(total) / (F.lit(classes) * F.col("count")))  # one row a severity
    words: list = [StringIndexer(inputCol="severity", outputCol="label", stringOrderType="alphabetAsc").fit(rows), RegexTokenizer(inputCol="folded", outputCol="g1", pattern=r"[^a-z0-9]+", minTokenLength=2)]
    words += [NGram(n=n, inputCol="g1", outputCol=f"g{n}") for n in (2, 3)]
    spoken = PipelineModel(words).transform(whole)
    counters = [CountVectorizerModel.from_vocabulary(_most_frequent(spoken.select(F.explode(g).alias("term")).groupBy("term").agg(F.count("*").alias("n")), features), g, f"{g}_n") for g in ("g1", "g2", "g3")]
    counters.append(CountVectorizerModel.from_vocabulary(_char_vocabulary(rows, features), "chars", "chars_n"))
    counted = PipelineModel(counters).transform(spoken).select("label", "weight", *[c.getOutputCol() for c in counters])
    counted = stash(counted, "counted")
    learned: list = [IDF(inputCol=f"{g}_n", outputCol=f"{g}_t") for g in ("g1", "g2", "g3", "chars")]
    learned += [VectorAssembler(inputCols=[f"{g}_t" for g in ("g1", "g2", "g3", "chars")], outputCol="raw_features"), Normalizer(inputCol="raw_features", outputCol="features"), LogisticRegression(weightCol="weight", regParam=0.01, maxIter=50)]
    return PipelineModel([*words, *counters, *Pipeline(stages=learned).fit(counted).stages])


def prepared(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"folded": F.lower(T.ascii_fold(F.col("text"))), "chars": char_grams(F.col("text"))})


def weights(model) -> list[tuple]:
    """What a pipeline of :func:`train_tfidf` with three classes or more has learned: (kind, term, idf, a coefficient for each
    label), kinds 1 to 3 being words and 4 character grams; first the intercepts as kind 0."""
    vocabularies = [s.vocabulary for s in model.stages if isinstance(s, CountVectorizerModel)]
    idf = np.concatenate([s.idf.toArray() for s in model.stages if isinstance(s, IDFModel)])
    terms = [(kind, t) for kind, own in enumerate(vocabularies, 1) for t in own]
    rows = zip(terms, idf.tolist(), model.stages[-1].coefficientMatrix.toArray().T.tolist(), strict=True)
    return [(0, "", 0.0, *model.stages[-1].interceptVector.toArray().tolist()), *[(*t, i, *c) for t, i, c in rows]]


_AT_ONCE = 500  # texts whose terms a task holds at a time


def _places(codes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The place of each of ``found`` in the sorted ``codes``, -1 of those that are not there."""
    if not len(codes):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
    return np.where(codes[at] == found, at, -1)


class _Terms:
    """The terms of texts by tables of characters, of words and of runs of them: a few passes of arrays over many texts at once.

    Words are runs of plain letters and digits of the folded text, grams stand within words of any letters and digits in
    the lower-case text that have a blank on each side; as no gram has a blank inside, all of a text can be looked through at once.
    """

    def __init__(self, vocabularies: list[list[str]]):
        starts = np.cumsum([0, *map(len, vocabularies)]).tolist()
        spoken = [[t.split(" ") for t in own] for own in vocabularies[:3]]
        self.words = {w: k for k, w in enumerate(sorted({w for own in spoken for t in own for w in t}))}
        self.runs = []  # of one, two and three words: sorted codes and their terms
        for at, own in zip(starts, spoken, strict=False):
            codes = np.array([self._code([self.words[w] for w in t], len(self.words)) for t in own], np.int64)
            self.runs.append((np.sort(codes), at + np.argsort(codes)))
        grams = vocabularies[3]
        self.letters = {c: k for k, c in enumerate(sorted({c for g in grams for c in g} - {" "}), 2)}  # 0 is any other letter, 1 a blank
        letters = self.letters | {" ": 1}
        self.base = len(self.letters) + 2
        #: Of three, four and five letters: sorted codes of the place of all but the last and of the last, and the term that ends there.
        self.steps, before = [], {g[:2]: letters[g[0]] * self.base + letters[g[1]] for g in grams}
        for n in (3, 4, 5):
            begun = {g[:n]: before[g[: n - 1]] * self.base + letters[g[n - 1]] for g in grams if len(g) >= n}
            order, own = sorted(begun, key=begun.get), {g: starts[3] + k for k, g in enumerate(grams) if len(g) == n}
            self.steps.append((np.array([begun[g] for g in order], np.int64), np.array([own.get(g, -1) for g in order], np.int64)))
            before = {g: k for k, g in enumerate(order)}
        self.plain = {ord(x): y for x, y in zip(T._ASCII_FROM, T._ASCII_TO, strict=True)}
        self.spoken, self.written = np.full(0x110000, -1, np.int16), np.full(0x110000, -1, np.int32)  # of characters, once they have come up

    @staticmethod
    def _code(words: list[int], base: int) -> int:
        return sum(w * base**k for k, w in enumerate(reversed(words)))

    def _spoken(self, c: int) -> int:
        own = self.plain.get(c, chr(c)).lower()
        return ord(own) if own.isascii() and own.isalnum() else 0

    def _written(self, c: int) -> int:
        own = self.plain.get(c, chr(c))
        return self.letters.get(own, 0) if own.isalpha() or own.isdecimal() else 1

    @staticmethod
    def _looked_up(text: str, table: np.ndarray, of: Callable[[int], int]) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out = table[points]
        if (new := out < 0).any():
            for c in np.unique(points[new]).tolist():
                table[c] = of(c)
            out = table[points]
        return out

    @staticmethod
    def _joined(texts: list[str]) -> tuple[str, np.ndarray]:
        """All texts with a line end on each side, and the text of each character; the line end before a text is its own."""
        return "\n" + "\n".join(texts) + "\n", np.repeat(np.arange(len(texts)), np.array([*map(len, texts)]) + 1)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of all terms of ``texts``."""
        whole, row = self._joined(texts)
        if "ß" in whole or "İ" in whole:  # letters that become two
            whole, row = self._joined(texts := [t.replace("ß", "ss").replace("İ", "i\u0307") for t in texts])
        rows, terms = [], []
        said = self._looked_up(whole, self.spoken, self._spoken).astype(np.uint8)
        border = np.flatnonzero((said[1:] > 0) != (said[:-1] > 0)) + 1
        first, end = border[::2], border[1::2]
        long = end - first > 1
        first, end, said = first[long], end[long], said.tobytes().decode("latin-1")
        word = np.array([self.words.get(said[a:b], -1) for a, b in zip(first.tolist(), end.tolist(), strict=True)], np.int64)
        of, code = row[first], word
        for n, (codes, own) in enumerate(self.runs):
            if n:
                code = np.where((code[:-1] >= 0) & (word[n:] >= 0) & (of[n:] == of[: len(of) - n]), code[:-1] * len(self.words) + word[n:], -1)
            at = _places(codes, code)
            rows.append(of[: len(code)][at >= 0])
            terms.append(own[at[at >= 0]])

        if "ẞ" in whole:
            whole, row = self._joined([t.replace("ẞ", "ss") for t in texts])
        letter = self._looked_up(whole.lower(), self.written, self._written).astype(np.int64)
        begin, code = np.arange(len(letter) - 2), letter[:-2] * self.base + letter[1:-1]
        for n, (codes, own) in enumerate(self.steps, 2):
            held = begin + n < len(letter)
            begin, code = begin[held], code[held] * self.base + letter[begin[held] + n]
            at = _places(codes, code)
            begin, code = begin[at >= 0], at[at >= 0]
            term = own[code]
            rows.append(row[begin[term >= 0]])
            terms.append(term[term >= 0])
        return np.concatenate(rows), np.concatenate(terms)


def scorer(model) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """From a pipeline of :func:`train_tfidf` a function for tasks: of texts the place of the likeliest label and its probability, as
    the pipeline's own ``transform`` of :func:`prepared` texts gives them. The terms of many texts are looked up at once (:class:`_Terms`)."""
    vocabularies = [s.vocabulary for s in model.stages if isinstance(s, CountVectorizerModel)]
    idf = np.concatenate([s.idf.toArray() for s in model.stages if isinstance(s, IDFModel)])
    head = model.stages[-1]
    coefficients, intercepts = head.coefficientMatrix.toArray(), head.interceptVector.toArray()
    if len(coefficients) == 1:  # two classes
        coefficients, intercepts = np.vstack([np.zeros_like(coefficients), coefficients]), np.append(0.0, intercepts)
    weights, n = coefficients * idf, len(idf)
    made: list = []  # once in a task

    def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [few(texts[k : k + _AT_ONCE]) for k in range(0, max(1, len(texts)), _AT_ONCE)]
        return np.concatenate([k for k, _ in parts]), np.concatenate([p for _, p in parts])

    def few(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, np.int64), np.empty(0)
        if not made:
            made.append(_Terms(vocabularies))
        row, term = made[0].of(texts)
        at = row * n + term
        at, times = np.unique(at, return_counts=True)
        row, term = at // n, at % n
        norm = np.sqrt(np.bincount(row, (times * idf[term]) ** 2, len(texts)))
        norm[norm == 0] = 1
        margins = np.array([np.bincount(row, times * w[term], len(texts)) for w in weights]) / norm + intercepts[:, None]
        likely = np.exp(margins - margins.max(axis=0))
        likely /= likely.sum(axis=0)
        return likely.argmax(axis=0), likely.max(axis=0)

    return score


def train_vectors(rows: DataFrame, max_iter: int = 50):
    """ML04: the same head over vectors (embedding, severity)."""
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "severity")
    return Pipeline(stages=[StringIndexer(inputCol="severity", outputCol="label", stringOrderType="alphabetAsc"), LogisticRegression(maxIter=max_iter, regParam=0.01)]).fit(data)


def report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """AGG15, ML05: precision, recall, F1 and support of each class."""
    pairs = predicted.select(F.col(label).alias("y"), F.col(prediction).alias("p")).groupBy("y", "p").agg(F.count("*").alias("n"))
    y = pairs.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    p = pairs.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("told"))
    out = y.join(p, "class", "full").fillna(0)
    precision, recall = F.coalesce(F.try_divide("hits", "told"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return out.select("class", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 6).alias("f1"), "support")
