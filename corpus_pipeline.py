"""A training corpus from raw documents: toxicity, language, near duplicates, packing.

Each stage works on all that the one before kept, is written as Parquet, and is read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import language_id, minhash_dedup, packing, toxicity
from pactlens.llm.common import free_name, stash, table, wide_tasks

#: From this score on a document is rejected as toxic.
TOXIC = 0.5
#: A document stays if its language is told with this probability at least.
LANGUAGE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labels = labels.where(~language_id.held_out(F.col("doc_id"), 5, 0))
    score = free_name(docs, "_toxicity")
    return toxicity.score(docs, toxicity.train(docs, labels), score_col=score).where(F.col(score) < TOXIC).select(docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with ``LANGUAGE`` or more. A text without letters goes, and so does one (mostly a
    short one) for which no language reaches that. Where no label can be learned from, all documents stay."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"), 3, 1)))
    if not model.languages:
        return docs
    language, sure = free_name(docs, "_language"), free_name(docs, "_sure")
    told = language_id.predict(docs, model, pred_col=language, score_col=sure)
    return told.where((F.col(language) != language_id.UNKNOWN) & (F.col(sure) >= LANGUAGE)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True, memory=100_000, run=1_000_000, profile=wide_tasks(spark))  # executors still hold what the stages before took


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("near copies", drop_near_copies), ("packing", pack)]

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
