"""Operator 12: how filters interact, by aggregating the edges of their lattice.

A pipeline that has applied a set of filters stands at a node of the lattice of all sets; applying one more walks an
edge. What the next filter removes depends on the set behind it and not on the order within, so five filters have 80
edges for all their 120 orders of 5 steps. Documents are reduced to which filters they fail and counted once; the counts contribute to
each edge, and each order is a path that reads its edges by a join.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that is not null: A under 200 words, B half of the words repeat, C over 3 percent capitals, D holds a sign."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, text_filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails, digest) of each row: the filters it fails as bits, the first one lowest, and the sha256 of its text. A null text is empty, a null part too."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_filters.values())]
    return rows.select("id", "part", sum(bits[1:], bits[0]).alias("fails"), F.sha2("text", 256).alias("digest"))


def outcomes(rows: DataFrame, labels: DataFrame, copies_bit: int) -> DataFrame:
    """(part, fails, good, toxic, n): documents counted by what they fail, ``copies_bit`` with them for a text that a row of a smaller id has too.

    ``labels`` (id, good, toxic) has an id once at most. Rows of one id and text are counted together before anything is
    joined, and those with no id, which are no copies and have no label, are dealt by their texts.
    """
    same = ["id", "part", "fails", "digest"]
    counted = rows.groupBy(same).agg(F.count("*").alias("n"))
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0)
    told = counted.withColumn("spread", spread).join(labels.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left").drop("spread")
    kinds = ["digest", "part", "fails", "good", "toxic"]
    told = told.select("id", "n", *kinds[:3], *[F.coalesce(c, F.lit(False)).alias(c) for c in kinds[3:]])
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))  # rows of one id differ in part only, so one kind holds an id once
    grouped = told.groupBy(kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))  # a few rows for each text: its parts times its labels
    originals = F.col("no_id") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    split = grouped.withColumn("originals", originals).select(*kinds[1:], F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("originals").alias("n")), F.struct(F.lit(copies_bit).alias("copy"), (F.col("n") - F.col("originals")).alias("n")))).alias("x"))
    return split.where("x.n > 0").groupBy("part", F.col("fails").bitwiseOR(F.col("x.copy")).alias("fails"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def lattice_edges(spark: SparkSession, filters: str) -> DataFrame:
    """(applied, filter, bit): for each set of filters, as bits, each filter that is not in it."""
    edges = [(applied, f, 1 << i) for applied in range(1 << len(filters)) for i, f in enumerate(filters) if not applied >> i & 1]
    return spark.createDataFrame(edges, "applied int, filter string, bit int")


def lattice_paths(spark: SparkSession, filters: str) -> DataFrame:
    """(filter_order, step, applied, filter): the edges that each order walks, step by step from 1."""
    steps = [("".join(order), k + 1, sum(1 << filters.index(f) for f in order[:k]), order[k]) for order in permutations(filters) for k in range(len(order))]
    return spark.createDataFrame(steps, "filter_order string, step int, applied int, filter string")


def edge_counts(counts: DataFrame, filters: str) -> DataFrame:
    """What each edge does to each part, zeros included, from (part, fails, good, toxic, n).

    kept, removed, redundant (fail this filter and were removed before), unique_fails (fail this one only), good_lost, toxic_lost, and shapley: what
    the filter removes in all orders together, an edge counting once for each order that walks it.
    """
    edges = lattice_edges(counts.sparkSession, filters)
    each = counts.select("*", F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(edges.columns, e, strict=True)]) for e in edges.collect()])).alias("edge")).select("*", "edge.*")
    there, failing = F.col("fails").bitwiseAND(F.col("applied")) == 0, F.col("fails").bitwiseAND(F.col("bit")) != 0
    total = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    summed = each.groupBy("part", "applied", "filter").agg(
        total(there & ~failing).alias("kept"), total(there & failing).alias("removed"), total(~there & failing).alias("redundant"), total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(there & failing & F.col("good")).alias("good_lost"), total(there & failing & F.col("toxic")).alias("toxic_lost"),
    )
    k = len(filters)
    walked = F.get(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), F.bit_count("applied"))
    return summed.withColumn("shapley", F.sum(F.col("removed") * walked).over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", conditions=text_filters, copies: str = "E") -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of :func:`edge_counts`.

    ``conditions(text)`` names the filters and their failure conditions; ``copies`` names the one that a text fails if
    a row of a smaller id has it too. ``labels`` (``id_col``, quality, toxic) says what is good (quality 1) and toxic
    (1); of several rows of an id any counts, null ids say nothing. A null text is empty; a null part is the
    empty string. Rows without an id are never copies nor originals of other rows. A row that is repeated counts again, but
    is no copy of itself. An empty table has no parts and gives no rows. Other columns are not read.
    """
    spark, filters = docs.sparkSession, "".join(conditions(F.col("text"))) + copies
    rows = failures(docs, conditions(F.col("text")), id_col, text_col, part_col)
    flags = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*flags)
    counts = outcomes(rows, known, 1 << (len(filters) - 1))
    return edge_counts(counts, filters).join(F.broadcast(lattice_paths(spark, filters)), ["applied", "filter"]).drop("applied", "filter")


def op12_filter_audit(spark, sf_dir):
    from pactlens.llm.common import table

    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH labelled AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first, false)::INT AS fails
  FROM d LEFT JOIN labelled USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM names a, names b, names c, names d, names e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS applied FROM orders, range(1, 6) r(step)),
walked AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (applied | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & applied <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM walked
"""
