"""Operator 5: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of letters, lower-cased and parted by one blank, give n-grams of one to three characters, hashed into a fixed
number of features. Document frequencies are counted over every document that may be learned from; weights are
learned by follow-the-regularised-leader with an elastic net from a sample bounded by a number of rows per language,
and a temperature is fitted on a part of the sample that is not learned from. Whole texts are scored.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pactlens.llm.ftrl import Ftrl, softmax, temperature
from pactlens.llm.memo import tidy

BITS = 15
UNKNOWN = "und"
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngram_counts(text: str | None) -> np.ndarray:
    """How often each feature occurs in the text; all zero if it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(1 << BITS, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of what stands between two runs becomes their blank
    c = np.where(letter, c, 32)[keep]
    c = np.concatenate([[32], c, [32] if c[-1] != 32 else []]).astype(np.uint32)
    with np.errstate(over="ignore"):
        mixed = c * np.uint32(2654435761)
        two = (mixed[:-1] ^ (mixed[1:] >> np.uint32(15)) ^ (c[1:] << np.uint32(7))) * np.uint32(2246822519)
        three = (two[:-1] ^ (mixed[2:] >> np.uint32(13)) ^ (c[2:] << np.uint32(9))) * np.uint32(3266489917)
    return np.bincount(np.concatenate([mixed[1:-1], two, three]) >> np.uint32(32 - BITS), minlength=1 << BITS)


@dataclasses.dataclass
class LanguageModel:
    """``weights`` (features, languages), ``bias``, inverse document frequencies and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text)
        at = np.flatnonzero(counts)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax((vector(counts[at], self.idf[at]) @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector; term frequency 1 + log(count)."""
    x = (1.0 + np.log(counts)) * idf
    return x / max(1e-12, np.sqrt(x @ x))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def smallest_hashes(rows: DataFrame, group: str, salt: str, bound: Column, bits: int = 12) -> DataFrame:
    """Of each ``group`` the ``bound`` rows with the smallest hashes of ``id``.

    Rows are counted by ranges of the hash; ranges below the one in which a group's bound falls are taken whole, that one
    by rank, so no group is sorted in one task. The counts are ``2 ** bits`` rows a group at most.
    """
    rows = rows.withColumn("hash", F.xxhash64("id", F.lit(salt))).withColumn("range", F.shiftright("hash", 64 - bits))
    sizes = rows.groupBy(group, "range").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(group).orderBy("range")) - F.col("n"))
    rows = rows.join(sizes.drop("n"), [group, "range"]).withColumn("left", bound - F.col("before")).where("`left` > 0")
    place = F.row_number().over(Window.partitionBy(group, "range").orderBy("hash", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= F.col("left")).drop("hash", "range", "before", "left", "place")


def _frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents with letters and, per feature, of those that have it, over all rows of ``docs`` (text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(1 << BITS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                counts = ngram_counts(text)
                at = np.flatnonzero(counts)
                df[at] += 1
                n += bool(len(at))
        at = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["feature", "n"])

    sums = docs.select("text").mapInArrow(tidy(counted), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # as many rows as features
    df = np.zeros(1 << BITS, np.int64)
    real = sums[sums.feature >= 0]
    df[real.feature.to_numpy()] = real.n.to_numpy()
    return int(sums.n[sums.feature < 0].sum()), df


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1500, epochs: int = 2) -> LanguageModel:
    """Fit on ``docs``, every row of which may be learned from.

    ``rows_per_language`` bounds the sample that weights and temperature are fitted on (those with the smallest hash
    of their id); document frequencies are counted over all rows. Rows with a null language or id are not learned from;
    an id that repeats counts once for a language, with the smallest of its texts.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n, df = _frequencies(rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    named = rows.where(F.col("id").isNotNull())
    sample = smallest_hashes(named.select("id", "lang").distinct(), "lang", "language sample", F.lit(rows_per_language))
    sample = named.join(F.broadcast(sample.select("id", "lang")), ["id", "lang"], "left_semi")  # rows_per_language ids a language
    sample = sample.groupBy("id", "lang").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts = ngram_counts(text)
                at = np.flatnonzero(counts)
                if len(at):
                    rows.append((key, lang, at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["id", "lang", "at", "n"])

    found = sorted(sample.select(F.col("id").cast("string"), "lang", "text").mapInArrow(tidy(featured), "id string, lang string, at binary, n binary").collect())
    languages = sorted({r.lang for r in found})
    number = {x: i for i, x in enumerate(languages)}
    data = []
    for r in found:
        at = np.frombuffer(r.at, "<u2").astype(np.int64)
        data.append((at, vector(np.frombuffer(r.n, "<u4").astype(float), idf[at]), number[r.lang]))
    order = np.random.default_rng(5).permutation(len(data))
    kept_back = order[: len(data) // 5]
    model = Ftrl(1 << BITS, max(1, len(languages)), l1=0.02, l2=0.001)
    for _ in range(epochs):
        for i in order[len(data) // 5 :]:
            model.learn(*data[i])
    scores = np.array([model.scores(data[i][0], data[i][1]) for i in kept_back])
    t = temperature(scores, np.array([data[i][2] for i in kept_back], int))
    return LanguageModel(languages, idf.astype(np.float32), model.weights().astype(np.float32), model.bias, t)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language predicted and its calibrated probability.

    A null text, one without letters, or a model without languages gives ``und`` and score 0. Columns of those names
    are replaced.
    """
    kept = docs.drop(pred_col, score_col)
    place = kept.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [model.predict(t) for t in b.column(place).to_pylist()]
            columns = [*b.columns, pa.array([x for x, _ in told], pa.string()), pa.array([p for _, p in told], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, pred_col, score_col])

    schema = StructType([*kept.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])
    return kept.mapInArrow(tidy(scored), schema)


def op5_language_id(spark, sf_dir):
    from pactlens.llm.common import table

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = train(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
