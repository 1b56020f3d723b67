"""Which agreement a text means: mentions, aliases, similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.functions import text as T

#: Short names and what they stand for. What is compared with them has lost its accents, so spellings with accents are left out.
ALIASES = {
    "boa": ["boliviana de aviacion", "linea aerea boa", "boa aerolinea", "boa linea aerea"], "agetic": ["agencia de gobierno electronico y tic", "agencia tic", "agencia de tic", "agencia gobierno electronico"],
    "umss": ["universidad mayor de san simon"], "upb": ["universidad privada boliviana"], "msd": ["ministerio de salud y deportes", "minsalud", "ministerio de salud", "ministerio salud deportes", "min. salud y deportes", "minsyd"],
    "sin": ["servicio de impuestos nacionales"], "bdp": ["banco de desarrollo productivo"], "egpp": ["escuela de gestion publica plurinacional"], "emi": ["escuela militar de ingenieria"], "unandes": ["universidad de los andes"],
    "cns": ["caja nacional de salud", "cooperacion interinstitucional cns"], "gad oruro": ["gobierno autonomo departamental de oruro"],
}


def mention_strict(message: Column) -> Column:
    """ENT01: quoted text, else what follows "convenio con", else what follows "convenio"; null if none."""
    quoted = F.regexp_extract(message, "[\"“'‘]([^\"”'’]+)[\"”'’]", 1)
    named = F.regexp_extract(message, r"(?iu)convenio\s+con\s+(?:(?:el|la|los|las)\s+)?([^,.?¿!\n]+)", 1)
    plain = F.regexp_extract(message, r"(?iu)convenio\s+([^,.?¿!\n]+)", 1)
    clean = [F.nullif(T.sanitize_name(x), F.lit("")) for x in (quoted, named, plain)]
    return F.coalesce(*clean)


def mention(message: Column) -> Column:
    """ENT02: the strict one, else the first word in capitals, else the significant words."""
    capitals = F.nullif(F.regexp_extract(message, r"\b([A-ZÁÉÍÓÚÑ]{2,})\b", 1), F.lit(""))
    return F.coalesce(mention_strict(message), capitals, F.nullif(F.array_join(T.significant_tokens(message), " "), F.lit("")))


def _plain(name: str) -> str:
    """The name in lower case without accents, blanks or signs around it."""
    bare = unicodedata.normalize("NFD", name)
    return " ".join("".join(c for c in bare if not unicodedata.combining(c)).lower().split()).strip(" \"'“”‘’.,;:¿?¡!()[]-")


def expand_aliases(name: str) -> list[str]:
    """ENT03, SET05: the name without accents; if it is a short name, holds one or is one of its aliases, that whole entry; the short names of aliases that it holds."""
    base = _plain(name)
    out = [base]
    for short, full in ALIASES.items():
        if short in base or base in full:
            out += [short, *full]
        out += [short for f in full if f in base]
    return list(dict.fromkeys(out))


def rerank_score(title: Column, query: str, alternatives: list[str]) -> Column:
    """ENT05: 0.6 if the title holds the query, 0.5 for each alternative it holds, and up to 1 for a small distance."""
    t = F.lower(T.ascii_fold(title))
    score = F.when(F.contains(t, F.lit(query)), 0.6).otherwise(0.0)
    for a in alternatives:
        score = score + F.when(F.contains(t, F.lit(a)), 0.5).otherwise(0.0)
    distance = F.levenshtein(F.substring(t, 1, 128), F.lit(query[:128]))
    return score + F.greatest(F.lit(0.0), 1 - F.least(distance / 20, F.lit(1.0)))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def write_trigrams(agreements: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """TXT19: the trigram index of titles and descriptions at ``path``: (gram, key, n) for each distinct text, n being how many trigrams it
    has. It is dealt by ranges of gram and sorted, so a name reads what its own trigrams have; one that all texts have spans several files.
    ``mode`` ``append`` adds the texts of new agreements, and those that are there already do not count twice."""
    texts = agreements.select(F.explode(F.array("titulo", "descripcion")).alias("text")).where("text IS NOT NULL").distinct()
    from pactlens.sources.store import stash

    grams = stash(texts.select(_key(F.col("text")).alias("key"), T.trigrams(F.col("text")).alias("grams")), "grams")  # dealing by ranges reads its rows twice
    postings = grams.select(F.explode("grams").alias("gram"), "key", F.size("grams").alias("n"))
    postings.repartitionByRange("gram", "key").sortWithinPartitions("gram").write.mode(mode).parquet(path)


def indexed_similarities(spark: SparkSession, path: str, query: str, few: int = 500) -> DataFrame:
    """(key, sim) of the texts that share a trigram with ``query``, from the postings of its own trigrams."""
    asked = T.trigrams_of(query)
    postings = spark.read.parquet(path)
    if len(asked) <= few:
        postings = postings.where(F.col("gram").isin(asked))
    else:
        postings = postings.join(F.broadcast(spark.createDataFrame([(g,) for g in asked], "gram string")), "gram", "left_semi")  # of one name
    shared = postings.groupBy("key", "n").agg(F.size(F.collect_set("gram")).alias("shared"))  # of one name's trigrams
    return shared.select("key", (F.col("shared") / (F.col("n") + len(asked) - F.col("shared"))).alias("sim"))


def _similar_by_index(agreements: DataFrame, path: str, query: str, k: int) -> DataFrame:
    """(id, titulo, sim) of agreements that can be among the ``k`` most similar. As an agreement has two texts, 2 k texts belong to k
    agreements at least, so none below the last of those counts."""
    found = indexed_similarities(agreements.sparkSession, path, query)
    top = found.orderBy(F.desc("sim")).limit(2 * k).collect()
    least = top[-1]["sim"] if len(top) == 2 * k else 0.0
    found = found.where(F.col("sim") >= least)
    out = agreements.select("id", "titulo", _key(F.col("titulo")).alias("key"), _key(F.coalesce("descripcion", F.lit(""))).alias("_d"))
    out = out.join(found.withColumnRenamed("sim", "_s"), "key", "left").join(found.select(F.col("key").alias("_d"), F.col("sim").alias("_e")), "_d", "left")
    sim = F.greatest(F.coalesce("_s", F.lit(0.0)), F.coalesce("_e", F.lit(0.0)))
    return out.select("id", "titulo", sim.alias("sim")).where(F.col("sim") >= least)


def fuzzy_find(agreements: DataFrame, name: str, k: int = 5, index: str | None = None) -> DataFrame:
    """ENT04, SRT07: the ``k`` agreements with the highest trigram similarity of title or description, re-ranked; the first is the answer.

    No similarity is too low, as in the trigram search this stands for: a table with rows always gives some. ``index``
    is where :func:`write_trigrams` has written these agreements' trigrams; without it those of every row are worked out.
    """
    query = _plain(name)
    if index:
        found = _similar_by_index(agreements, index, query, k)
    else:
        asked = F.array(*map(F.lit, T.trigrams_of(query))).cast("array<string>")
        grams = agreements.select("id", "titulo", T.trigrams(F.col("titulo")).alias("_t"), T.trigrams(F.coalesce("descripcion", F.lit(""))).alias("_d"))  # each worked out once
        found = grams.select("id", "titulo", F.greatest(T.shared_share(F.col("_t"), asked), T.shared_share(F.col("_d"), asked)).alias("sim"))
    top = found.orderBy(F.desc("sim"), "id").limit(k)
    return top.select("id", "titulo", F.round("sim", 6).alias("sim"), F.round(rerank_score(F.col("titulo"), query, expand_aliases(name)), 6).alias("rank_score")).orderBy(F.desc("rank_score"), F.desc("sim"), "id")


def like_find(agreements: DataFrame, name: str, k: int = 10) -> DataFrame:
    """ENT04 without trigrams: words in order in title or description, newest first; each alternative in turn only if those before find none."""
    fits = lambda like: F.lower("titulo").like(like) | F.lower("descripcion").like(like)
    tier = F.coalesce(*[F.when(fits("%" + "%".join(alt.split()) + "%"), n) for n, alt in enumerate(expand_aliases(name))])
    told = agreements.select("id", "titulo", "updated_at", tier.alias("tier")).where("tier IS NOT NULL")
    order = [F.desc("updated_at"), F.desc("id")]
    best = told.orderBy("tier", *order).limit(k)  # those of the first tier that finds any come first
    first = F.min("tier").over(Window.partitionBy())
    return best.withColumn("first", first).where("tier = first").orderBy(*order).select("id", "titulo", "tier")


def similar_pairs(names: DataFrame, least: float = 75.0, salts: int = 8) -> DataFrame:
    """TXT21 over a column ``name``: every pair (a, b, percent) of distinct names, a < b, whose :func:`similar_text` is ``least`` percent or more.

    The pairs compared are found by shared byte bigrams, and none that reaches ``least`` is missed: of L bytes in both
    names C >= least * L / 200 are common, in at most 1 + L - 2 C runs, so 3 C - L - 1 bigrams are shared at least.
    Where that is 0 or less the names are short and are brought together by single bytes. Each bigram's names are
    dealt to ``salts`` tasks. Empty names are similar to none.
    """
    per_byte = 3 * least / 200 - 1
    if not 0 < per_byte <= 0.5:
        raise ValueError("least must be over 66.7 and at most 100")
    short = int(1 / per_byte + 1e-9)  # up to so many bytes in both names the bound says nothing
    code = F.hex(F.encode("name", "utf-8"))
    grams = lambda n: F.when(F.col("n") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - n + 1, F.lit(1))), lambda i: F.substring("code", 2 * i - 1, F.lit(2 * n)))).otherwise(F.array().cast("array<string>"))
    distinct = names.select("name").where("name <> ''").distinct().withColumn("code", code).withColumn("n", (F.length("code") / 2).cast("int"))
    marked = distinct.select("name", "n", F.explode(F.concat(grams(2), F.when(F.col("n") < short, grams(1)).otherwise(F.array().cast("array<string>")))).alias("gram"))
    counted = marked.groupBy("name", "n", "gram").agg(F.count("*").alias("k"))
    a = counted.select(F.col("name").alias("a"), F.col("n").alias("n_a"), "gram", F.col("k").alias("k_a"), F.pmod(F.xxhash64("name"), F.lit(salts)).alias("salt"))
    b = counted.select(F.col("name").alias("b"), F.col("n").alias("n_b"), "gram", F.col("k").alias("k_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"))
    shared = a.join(b, ["gram", "salt"]).where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.sum(F.when(F.length("gram") == 4, F.least("k_a", "k_b")).otherwise(0)).alias("bigrams"))
    maybe = shared.where(F.col("bigrams") >= per_byte * (F.col("n_a") + F.col("n_b")) - 1 - 1e-6)
    return maybe.select("a", "b", T.similar_text("a", "b").alias("percent")).where(F.col("percent") >= least)
