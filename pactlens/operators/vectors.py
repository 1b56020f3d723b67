"""Vector search and extractive answers over embeddings that come with the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.functions import text as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def index_docs(docs: DataFrame) -> DataFrame:
    """VEC01: documents to index, their fragments cleaned; what is empty then is left out."""
    return docs.withColumn("fragmento", T.ocr_cleanup(T.one_line(F.col("fragmento")))).where("fragmento <> ''")


def search(vectors: DataFrame, query: list[float], k: int = 5, label: int | None = None) -> DataFrame:
    """VEC02, SRT05: the filter first, then the ``k`` most similar, ties by id. Only k rows a partition are exchanged."""
    if label is not None:
        vectors = vectors.where(F.col("label") == label)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", "label", cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(max(0, k))


def _dots(a: pd.Series, b: pd.Series) -> pd.Series:
    """Inner products, each added up in the same way wherever in a batch it stands, so equal vectors get equal scores. Null where lengths differ."""
    one = lambda x, y: np.sum(np.asarray(x, "f8") * np.asarray(y, "f8")) if len(x) == len(y) else None
    if len(a) and a.map(len).nunique() == 1 and b.map(len).nunique() == 1 and len(a.iloc[0]) == len(b.iloc[0]):
        return pd.Series(np.sum(np.stack(a.to_numpy()).astype("f8") * np.stack(b.to_numpy()).astype("f8"), axis=1))
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="object").astype("Float64")


def searchable(vectors: DataFrame) -> DataFrame:
    """Vectors that have a direction, with their ``norm``: null, empty or zero ones and those with null or non-finite components go."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.coalesce(finite, F.lit(False)))
    return whole.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).where("norm > 0")


def write_index(vectors: DataFrame, path: str, buckets: int = 64) -> None:
    """VEC01, SNK04: append vectors (vec_id, convenio_id, version_id, embedding, ...) to the index at ``path``.

    An agreement's rows are in one of ``buckets`` folders, there in the order of agreement and version, so a search with
    a filter reads one folder and in it the row groups that can hold the agreement. A large agreement's rows are dealt to
    several tasks. Each append may take another number of buckets. What has no direction (:func:`searchable`) is not in the index.
    """
    rows = searchable(vectors).withColumns({"buckets": F.lit(buckets), "bucket": F.pmod(F.xxhash64(F.col("convenio_id").cast("long")), F.lit(buckets)).cast("int")})
    order = ["bucket", "convenio_id", "version_id", "vec_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("buckets", "bucket").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search_index(index: DataFrame, query: list[float], k: int = 5, convenio_id: int | None = None, version_id: int | None = None) -> DataFrame:
    """VEC02: (vec_id, convenio_id, version_id, score) of the ``k`` most similar of the rows that the filters leave, ties by id; none
    where nothing is left, for a query without direction, and from rows of another length.

    The agreement picks its folder before anything is read; agreement and version reach the files.
    """
    if convenio_id is not None:
        index = index.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(convenio_id).cast("long")), F.col("buckets"))) & (F.col("convenio_id") == convenio_id))
    if version_id is not None:
        index = index.where(F.col("version_id") == version_id)
    asked = np.asarray(query, "f8")
    size = float(np.sqrt(np.sum(asked * asked))) if asked.size and np.isfinite(asked).all() else 0.0
    if not size:
        return index.select("vec_id", "convenio_id", "version_id", F.lit(0.0).alias("score")).limit(0)
    of = F.pandas_udf(lambda e: pd.Series([float(np.sum(np.asarray(x, "f8") * asked)) if len(x) == len(asked) else None for x in e], dtype="Float64"), "double")
    scored = index.select("vec_id", "convenio_id", "version_id", F.round(of("embedding") / (F.col("norm") * size), 12).alias("score"))
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), "vec_id").limit(max(0, k))


def search_each(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """VEC02 for many queries (query_id, convenio_id, version_id, embedding), each over the rows of its own agreement and version
    (over the agreement's, where its version is null): (query_id, rank, vec_id, score), nearest first, ties by id.

    Queries and rows meet by their filters alone; of what meets, each task keeps a query's ``k`` best before the exchange.
    Queries without an agreement or without direction find nothing.
    """
    asked = searchable(queries.where("convenio_id IS NOT NULL")).select("query_id", "convenio_id", F.col("version_id").alias("_version"), F.col("embedding").alias("_asked"), F.col("norm").alias("_norm"))
    rows = index.select("vec_id", "convenio_id", "version_id", "embedding", "norm")
    by_version = rows.join(asked.where("_version IS NOT NULL").withColumnRenamed("_version", "version_id"), ["convenio_id", "version_id"])
    by_agreement = rows.join(asked.where("_version IS NULL").drop("_version"), "convenio_id")
    met = by_version.unionByName(by_agreement)
    scored = met.select("query_id", "vec_id", F.round(F.pandas_udf(_dots, "double")("embedding", "_asked") / (F.col("norm") * F.col("_norm")), 12).alias("score")).where("score IS NOT NULL")
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def answer(items: DataFrame, sentences: DataFrame, least: float = 0.30, k: int = 5, most: int = 10_000) -> DataFrame:
    """VEC03, SRT06: the most similar item (id, score) and, if it is similar enough, its ``k`` best sentences (id, pos, text, score) in text order."""
    best = items.orderBy(F.desc("score"), "id").limit(1)
    top = sentences.join(F.broadcast(best.select("id", F.col("score").alias("item_score"))), "id")  # one row
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos"))).where(F.col("n") <= k)
    told = top.groupBy("id").agg(F.expr("array_join(transform(sort_array(collect_list(struct(pos, text))), x -> x.text), ' ')").alias("text"))
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit(" …"))).otherwise(F.col("text"))
    return best.join(told, "id", "left").select("id", "score", F.when((F.col("score") >= least) & (F.length("text") >= 10), cut).alias("answer"))
