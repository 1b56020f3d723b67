"""Full-text search in Spanish: an inverted index with places, matched on all words, ranked by frequency and nearness.

The index is two Parquet tables. ``postings`` has blocks: a lexeme, rows that hold it, and its places in each. Each file is
sorted by lexeme and has small row groups, so that a question reads those of its own lexemes and no other. Blocks are short and row groups and pages
are measured every few blocks: what a task holds of a lexeme that all rows have does not grow with its rows. ``lexemes`` says how many rows hold each.
A question goes from its rarest lexeme to the more frequent ones, which are looked up in the rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactlens.sources.store import stash

#: Words that are left out of index and question, without accents.
STOP = """a al algo alguna algunas alguno algunos ante antes aquel aquella aquellas aquello aquellos aqui asi aun aunque bajo bien cada casi como con contra cual cuales cualquier cuando cuanta cuantas cuanto cuantos cuya cuyas cuyo cuyos
de del desde donde dos durante e el ella ellas ello ellos en entre era eran es esa esas ese eso esos esta estaba estan estar estas este esto estos fue fueron ha haber habia hace hacia han hasta hay la las le les lo los mas me mi mientras mis mucho muy
nada ni no nos nosotros o os otra otras otro otros para pero poco por porque pues que quien quienes se sea sean segun ser si sin sino sobre solo son su sus tal tales tambien tan tanto te tiene tienen toda todas todo todos tras tu tus u un una unas uno unos usted ustedes y ya yo""".split()
_FROM, _TO = "áéíóúüàèìòùâêîôûäëïö", "aeiouuaeiouaeiouaeio"
#: Fixed values of the rank: the weight of plain text, the limit of the sum of 1 / n², the farthest two words are near, and the fall of nearness with distance.
WEIGHT, LIMIT, FAR = 0.1, 1.64493406685, 100
#: Bytes of a row group: what a question reads of a file at least.
GROUP_BYTES = 4 << 20
#: Rows of a block at most, and the place of places from which on no further row begins in it.
BLOCK_ROWS, BLOCK_PLACES = 1_000, 16_000
#: Settings of the files of postings. Parquet measures a row group and its pages when so many blocks have come since it last did. It starts from 100 and goes up to
#: 10,000, more than a task has of the lexemes that all rows have, which then are one row group with pages of any size.
_FILES = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 10, "parquet.page.size.row.check.max": 50}
_NEAR = "sqrt(1D / (1.005D + 0.05D * exp((x.p - y.p) / 1.5D - 2D)))"


def words(text: Column) -> Column:
    """All words of a text in order: runs of letters and digits in lower case without accents; ñ stays. None of a null text."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), _FROM, _TO), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stem(word: Column) -> Column:
    """A light stem: words of five letters or more lose the endings of gender and number."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return F.when(n < 5, word).when(F.endswith(word, F.lit("eses")), cut(2)).when(F.endswith(word, F.lit("ces")), F.concat(cut(3), F.lit("z"))).when(word.rlike("[oae]s$"), cut(2)).when(word.rlike("[oae]$"), cut(1)).otherwise(word)


def _stemmed(word: str) -> str:
    """:func:`stem` of a word at hand."""
    if len(word) < 5:
        return word
    if word.endswith("ces"):
        return word[:-3] + "z"
    if word.endswith(("eses", "os", "as", "es")):
        return word[:-2]
    return word[:-1] if word[-1] in "oae" else word


def lexemes(text: Column) -> Column:
    """The distinct lexemes of a question."""
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: ~w.isin(STOP)), stem))


def write_index(rows: DataFrame, path: str, keys: list[str], text_col: str = "text") -> None:
    """Add ``rows`` to the index at ``path``, whose postings hold ``keys``.

    Places count all words of a text from 1, stop words too. Rows of equal keys and text are one; rows of equal keys
    and other texts stay apart by ``row``, a hash of the text. Each task writes the postings of its own rows as a part, sorted
    by lexeme, so nothing is shuffled; :func:`merge_index` makes one of many parts. A text without lexemes is not found by any question.
    """
    spark = rows.sparkSession
    given = rows.select(words(F.col(text_col)).alias("_words"), F.hash(text_col).alias("row"), *keys)
    names = ["row", *keys]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _blocks(batch.column(0), [batch.column(i) for i in range(1, batch.num_columns)])
            if own:
                yield pa.RecordBatch.from_arrays(own, ["lexeme", *names, "starts", "places"])

    kinds = [S.StructField(f.name, S.ArrayType(f.dataType)) for f in given.schema.fields[1:]]
    schema = S.StructType([S.StructField("lexeme", S.StringType()), *kinds, S.StructField("starts", S.ArrayType(S.IntegerType())), S.StructField("places", S.ArrayType(S.IntegerType()))])
    at = f"{path}/postings"
    before = _files(spark, at)
    given.mapInArrow(blocks, schema).sortWithinPartitions("lexeme").write.mode("append").options(**_FILES).parquet(at)
    _count(spark, [f for f in _files(spark, at) if f not in before], path)


def _count(spark: SparkSession, files: list[str], path: str) -> None:
    rows = spark.read.parquet(*files).groupBy("lexeme").agg(F.sum(F.size("row")).alias("rows"))
    rows.write.mode("append").parquet(f"{path}/lexemes")


def merge_index(spark: SparkSession, path: str, to: str, parts: int | None = None) -> None:
    """The index at ``path``, written at ``to`` in ranges of lexemes, so that a question opens few files. A lexeme that most rows have spans several ranges."""
    blocks = spark.read.parquet(f"{path}/postings")
    by = ["lexeme", F.xxhash64("starts", "row")]
    dealt = blocks.repartitionByRange(parts, *by) if parts else blocks.repartitionByRange(*by)
    dealt.sortWithinPartitions("lexeme").write.options(**_FILES).parquet(f"{to}/postings")
    _count(spark, [f"{to}/postings"], to)


def _blocks(found: pa.ListArray, columns: list[pa.Array]) -> list[pa.Array] | None:
    """Of rows' words (lists) and columns: for each block its lexeme, those rows that have it, where the places in each begin, and all places."""
    ends = found.offsets.to_numpy() - found.offsets[0].as_py()
    coded = found.flatten().dictionary_encode()
    if not len(coded):
        return None
    stems = pa.array([_stemmed(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    code, names = stems.indices.to_numpy()[coded.indices.to_numpy()], stems.dictionary
    row = np.repeat(np.arange(len(found)), np.diff(ends))
    place = np.arange(len(code)) - ends[:-1][row] + 1
    stop = pc.is_in(coded.dictionary, pa.array(STOP)).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(~stop[coded.indices.to_numpy()])
    if not len(kept):
        return None
    order = kept[np.argsort(code[kept], kind="stable")]  # by lexeme, then row and place
    code, row, place = code[order], row[order], place[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))  # of the places of a lexeme in a row
    lexeme = np.flatnonzero(np.append(True, code[first][1:] != code[first][:-1]))  # of the rows of a lexeme
    own = np.repeat(lexeme, np.diff(np.append(lexeme, len(first))))
    part = np.stack([(np.arange(len(first)) - own) // BLOCK_ROWS, (first - first[own]) // BLOCK_PLACES])
    lexeme = np.union1d(lexeme, 1 + np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)))  # of the rows of a block
    bounds, whole = np.append(lexeme, len(first)), np.append(first, len(code))
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), c.take(pa.array(row[first]))) for c in columns]
    base = np.repeat(whole[bounds[:-1]], np.diff(bounds))
    starts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(first - base, pa.int32()))
    places = pa.ListArray.from_arrays(pa.array(whole[bounds], pa.int32()), pa.array(place, pa.int32()))
    return [names.take(pa.array(code[first][lexeme])), *lists, starts, places]


def _files(spark: SparkSession, path: str) -> set[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(at) if fs.exists(at) else []
    return {x.getPath().toString() for x in found if x.getPath().getName().startswith("part-")}


def read_postings(spark: SparkSession, path: str, lexemes: list[str] | None = None) -> DataFrame:
    """(lexeme, keys, row, places) of the index at ``path``; of ``lexemes`` only, of which row groups that have none are not read."""
    blocks = spark.read.parquet(f"{path}/postings")
    if lexemes is not None:
        blocks = blocks.where(F.col("lexeme").isin(lexemes))
    names = [c for c in blocks.columns if c not in ("lexeme", "starts", "places")]
    end = F.when(F.col("i") + 1 < F.size("starts"), F.get("starts", F.col("i") + 1)).otherwise(F.size("places"))
    each = blocks.select("lexeme", *names, "starts", "places", F.posexplode("starts").alias("i", "start"))
    return each.select("lexeme", *[F.get(c, F.col("i")).alias(c) for c in names], F.slice("places", F.col("start") + 1, end - F.col("start")).alias("places"))


def _rank(terms: str) -> Column:
    """From an array of (lexeme, places): of one lexeme the sum of 1 / n² over its places; of several, each pair of places of
    different ones that are near adds its share of what is left to 1. The places are gone through in order with those not yet far behind."""
    placed = f"array_sort(flatten(transform({terms}, (t, i) -> transform(t.places, p -> struct(p, i AS t)))))"
    near = f"aggregate(filter(a.r, y -> y.t <> x.t), 1D, (b, y) -> b * (1D - {WEIGHT}D * {_NEAR}))"
    pairs = f"""aggregate({placed}, named_struct('c', 1D, 'r', cast(array() AS array<struct<p: int, t: int>>)),
        (a, x) -> named_struct('c', a.c * {near.replace('a.r', f'filter(a.r, y -> x.p - y.p <= {FAR})')}, 'r', concat(filter(a.r, y -> x.p - y.p < {FAR}), array(x))), a -> 1D - a.c)"""
    alone = f"aggregate(sequence(1, size({terms}[0].places)), 0D, (a, n) -> a + {WEIGHT}D / (n * n)) / {LIMIT}D"
    return F.expr(f"CASE WHEN size({terms}) = 1 THEN {alone} ELSE {pairs} END")


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 12, within: list[str] | None = None, few: int = 10_000, small: int = 1_000_000) -> DataFrame:
    """SRT08, TXT20: (query_id, place, rank, keys, row) of the ``k`` best rows for each of questions (query_id, question).

    A row is found if it holds every lexeme of the question; a question without lexemes finds nothing. ``within``
    names keys that questions have as columns too: where they are not null only rows of that value are found. Rows of equal rank (nine
    decimals) come in the order of their keys. Lexemes are pushed to the scan while there are no more than ``few``; tables up to
    ``small`` rows, which are counted first, are broadcast, larger ones are joined by shuffles.
    """
    within = within or []
    asked = questions.select("query_id", *[F.col(c).alias(f"_{c}") for c in within], F.explode(lexemes(F.col("question"))).alias("lexeme"))
    wanted = asked.select("lexeme").distinct()
    known = spark.read.parquet(f"{path}/lexemes")
    told = [r["lexeme"] for r in wanted.limit(few + 1).collect()]
    if len(told) <= few:
        known = known.where(F.col("lexeme").isin(told))
    postings = read_postings(spark, path, told if len(told) <= few else None)
    keys = [c for c in postings.columns if c not in ("lexeme", "row", "places")]
    counts = known.groupBy("lexeme").agg(F.sum("rows").alias("rows"))
    own = Window.partitionBy("query_id")
    asked = asked.join(counts, "lexeme", "left").withColumns({"n": F.count("*").over(own), "found": F.count("rows").over(own), "turn": F.row_number().over(own.orderBy("rows", "lexeme"))}).where("n = found")
    asked = stash(asked, "asked")
    near = lambda df: F.broadcast(df) if df.count() <= small else df
    allowed = [F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")) for c in within]

    row = ["query_id", *keys, "row"]
    hits = postings.join(near(asked.where("turn = 1").drop("rows", "found", "turn")), "lexeme")
    for fits in allowed:
        hits = hits.where(fits)
    hits = stash(hits.drop(*[f"_{c}" for c in within]), "first-hits")

    def also(rows: DataFrame, turns: str) -> DataFrame:
        """The postings of a question's lexemes of those turns in the rows that have all lexemes before."""
        needed = rows.select(*row, "n").distinct().join(asked.where(turns).select("query_id", F.col("lexeme").alias("_lexeme")), "query_id")
        needed = stash(needed.select("query_id", "n", "_lexeme", *[F.col(c).alias(f"_{c}") for c in (*keys, "row")]), "needed")
        same = [F.col("lexeme") == F.col("_lexeme"), F.col("row") == F.col("_row"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]]
        own = postings.join(F.broadcast(asked.where(turns).select("lexeme").distinct()), "lexeme", "left_semi") if len(told) <= few else postings
        return own.join(near(needed), same).select(*hits.columns)

    second = stash(also(hits, "turn = 2"), "second-hits")  # few rows have the two rarest
    others = second.unionByName(also(second, "turn > 2"))
    whole = hits.unionByName(others).groupBy(*row, "n").agg(F.sort_array(F.collect_set(F.struct("lexeme", "places"))).alias("terms")).where(F.size("terms") == F.col("n"))
    ranked = whole.select(*row, F.round(_rank("terms"), 9).alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), *keys, "row"))
    return ranked.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "rank", *keys, "row")


def content_search(rows: DataFrame, path: str, question: str, within: dict | None = None, k: int = 12, text_col: str = "text") -> DataFrame:
    """B7: the ``k`` best of the indexed ``rows`` with their texts, for one question; ``within``: key and value that rows must have."""
    spark, within = rows.sparkSession, within or {}
    asked = spark.createDataFrame([(0, question)], "query_id int, question string").select("*", *[F.lit(v).alias(c) for c, v in within.items()])
    hits = search(spark, path, asked, k, list(within)).drop("query_id")
    keys = [c for c in hits.columns if c not in ("place", "rank", "row")]
    texts = rows.select(*keys, F.hash(text_col).alias("row"), F.col(text_col)).alias("t")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*keys, "row"]]
    return texts.join(F.broadcast(hits.alias("h")), same).select("h.place", "h.rank", *[f"t.{c}" for c in [*keys, text_col]]).distinct()  # k rows
