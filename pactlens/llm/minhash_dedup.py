"""Operator 9: near-duplicate documents by ProbMinHash over weighted word shingles.

Each shingle is a Poisson process whose rate is its weight; every arrival falls on a random component of the
signature, which keeps the shingle that arrives first. A shingle's process ends as soon as its next arrival is later
than every component's first, so few arrivals are drawn. Two signatures agree on a component with the probability
Jaccard similarity of the documents. Bands of components give the candidates, the exact similarity decides.

Documents with the same words in the same order are one class with a representative. In a bucket every member is
checked against the smallest one, so a large group of near copies costs one check a member. Members that these links
leave apart from the bucket's largest component are checked against all members of other components, in blocks, unless
their distances to the smallest already rule a link out: 1 - probability Jaccard is a metric. A pair that shares no
bucket is never checked; that is the only way to lose a link.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.memo import tidy
from pactlens.llm.shingles import WordHashes, mix, probability_jaccard, shingles

BANDS, ROWS, SHINGLE, SIMILARITY = 40, 8, 5, 0.8
_ROUND, _PLACE = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def signatures(hashes: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """(docs, m) hashes of the shingles that arrive first; ``doc`` numbers each shingle's document, 0 where it has none."""
    first, winner = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    time = np.zeros(len(hashes))
    h, w, d, k = hashes, weights.astype(float), doc.astype(np.int64), 0
    while len(h):
        k += 1
        u = mix(h + np.uint64(k * int(_ROUND) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
        at = d * m + (mix(u ^ _PLACE) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = h[won]
        live = time < first.reshape(docs, m).max(axis=1)[d]
        h, w, d, time = h[live], w[live], d[live], time[live]
    return winner.reshape(docs, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(docs, bands) keys; equal only for equal rows of the same band."""
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _ROUND, (len(signature), bands)).copy()
    for r in range(rows):
        keys = mix(keys ^ signature[:, r::rows][:, :bands]) * _PLACE
    return keys.astype(np.int64)


def sketch(docs: DataFrame, bands: int, rows: int, size: int, run: int = 400_000, many: int = 2_000) -> DataFrame:
    """(id, digest, keys) of each document (id, text); digest and keys are null where there is no word. Signatures are worked
    out for about ``run`` words or ``many`` documents at a time."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()

        def flush(ids: list, texts: list) -> pa.RecordBatch:
            digests, found = [], []
            for w in texts:
                digests.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None)
                found.append(shingles(w, size))
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            keys = band_keys(signatures(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), doc, len(found), bands * rows), bands, rows)
            places = pa.array(np.arange(0, keys.size + 1, bands), pa.int32())
            keys = pa.ListArray.from_arrays(places, pa.array(keys.reshape(-1)), mask=pa.array([x is None for x in digests]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), keys], ["id", "digest", "keys"])

        for b in batches:
            ids, texts, n = [], [], 0
            for key, found in zip(b.column(0).to_pylist(), words.each(b.column(1)), strict=True):
                ids.append(key)
                texts.append(found)
                n += len(found)
                if n >= run or len(ids) >= many:
                    yield flush(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield flush(ids, texts)

    return docs.select("id", "text").mapInArrow(tidy(sketched), "id long, digest binary, keys array<long>")


def _similarities(pairs: DataFrame, size: int) -> DataFrame:
    """(a, b, sim) of pairs with their texts."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept = WordHashes(), OrderedDict()

        def of(key: int, text: str) -> tuple:
            if key not in kept:
                kept[key] = shingles(words.words(text), size)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[key]

        for b in batches:
            a, c = b.column("a"), b.column("b")
            sims = [probability_jaccard(of(i, s), of(j, t)) for i, s, j, t in zip(a.to_pylist(), b.column("text_a").to_pylist(), c.to_pylist(), b.column("text_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, c, pa.array(sims, pa.float64())], ["a", "b", "sim"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidy(measured), "a long, b long, sim double")


def _texts_of(docs: DataFrame, ids: DataFrame, label: str, small: int = 200_000) -> DataFrame:
    """A written table of the documents named; a set of ids that is small enough by count is broadcast, a larger one is joined by shuffle."""
    from pactlens.llm.common import stash

    ids = stash(ids, f"{label}-ids")
    few = ids.count() <= small
    return stash(docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"]), f"{label}-texts")


def _links_apart(placed: DataFrame, texts: DataFrame, similarity: float, size: int, block: int = 512, chunk: int = 1024) -> DataFrame:
    """Links (u, v) of the members of buckets that are apart with any other member of another component.

    A bucket is dealt as pairs of a block of those apart and a chunk of all members, so a task holds a bounded number
    of documents. A pair is checked in the first bucket that it shares, if its distances to that bucket's smallest
    member allow a link. Only links leave the task.
    """
    from pactlens.llm.common import stash, whole_groups

    keys = placed.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            bags = [shingles(w, size) for w in words.each(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h, _ in bags], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in bags], pa.binary()), b.column(2)], ["id", "hashes", "counts", "keys"])

    bags = texts.select("id", "text").join(keys, "id").select("id", "text", "keys").mapInArrow(tidy(bagged), "id long, hashes binary, counts binary, keys array<long>")
    bags = stash(bags, "bags")
    blocks, chunks = F.ceil(F.col("outer") / block).cast("int"), F.ceil(F.col("members") / chunk).cast("int")
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    names = ["key", "id", "component", "far", "apart"]
    left = placed.where("apart").select(*names, part(blocks, 1).alias("block"), every(chunks).alias("chunk"), F.lit(0).alias("side"))
    right = placed.select(*names, every(blocks).alias("block"), part(chunks, 2).alias("chunk"), F.lit(1).alias("side"))
    order = ["key", "block", "chunk"]
    dealt = left.unionByName(right).join(bags, "id").repartition(*order).sortWithinPartitions(*order, "side", "id")
    reach = 1 - similarity + 1e-9

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in whole_groups(batches, order):
            ids, component, far, side, bucket = (rows[c].to_numpy() for c in ("id", "component", "far", "side", "key"))
            apart, found = rows["apart"].to_numpy(zero_copy_only=False), []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                outer, member = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                if not len(outer) or not len(member):
                    continue
                group = rows.slice(s, e - s)
                hashes = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
                counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in group["counts"].to_pylist()]
                earlier = [frozenset(k for k in x if k < bucket[s]) for x in group["keys"].to_pylist()]
                total = np.array([c.sum() for c in counts])
                for p in outer.tolist():
                    q = member[(component[member] != component[p]) & (np.abs(far[member] - far[p]) <= reach) & (~apart[member] | (ids[member] > ids[p]))]
                    q = [x for x in q.tolist() if earlier[p - s].isdisjoint(earlier[x - s])] if earlier[p - s] else q.tolist()
                    if not q:
                        continue
                    mine, weight = hashes[p - s], counts[p - s]
                    flat, own = np.concatenate([hashes[x - s] for x in q]), np.concatenate([counts[x - s] for x in q])
                    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                    which = np.repeat(np.arange(len(q)), [len(hashes[x - s]) for x in q])
                    shared = np.minimum(weight[at] / total[p - s], own / total[[x - s for x in q]][which]) * (mine[at] == flat)
                    bound = np.bincount(which, shared, len(q))  # no less than the similarity
                    for x in np.flatnonzero(bound >= similarity - 1e-9).tolist():
                        x = q[x]
                        if probability_jaccard((mine, weight), (hashes[x - s], counts[x - s])) >= similarity:
                            found.append((int(ids[p]), int(ids[x])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    return dealt.select(*order, "id", "component", "far", "apart", "side", "hashes", "counts", "keys").mapInArrow(tidy(checked), "u long, v long")


def _grouped(given: DataFrame, sketches: DataFrame, similarity: float, size: int) -> DataFrame:
    """(id, class_id, component_id) of each row of ``sketches`` of ``given`` (id, text), where an id has one text."""
    from pactlens.llm.common import connected_components, discard, join_hot, stash

    worded = sketches.where("id is not null and digest is not null")
    copies = worded.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep")
    copies = stash(copies, "copies")
    classes = stash(join_hot(worded.select("id", "digest"), copies, ["digest"], "left").select("id", F.coalesce("rep", "id").alias("class_id")), "classes")
    others = stash(classes.where("id <> class_id").select("id").distinct(), "others")
    reps = worded.join(F.broadcast(others) if others.count() <= 200_000 else others, "id", "left_anti")
    keyed = reps.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead")
    buckets = stash(keyed.join(shared, "key").select("key", "lead", "id").distinct(), "buckets")

    stars = stash(buckets.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    texts = _texts_of(given, stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct(), "candidates")

    def measured(pairs: DataFrame, label: str) -> DataFrame:
        left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        return stash(_similarities(pairs.join(left, "a").join(right, "b"), size), label)

    star_sims = measured(stars, "star-sims")
    links = star_sims.where(F.col("sim") >= similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = connected_components(links, "near")

    # buckets that hold several components: what is not of the largest is apart
    named = buckets.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max(F.struct("n", F.col("component").alias("major"))).alias("top"), F.sum("n").alias("members"), F.count("*").alias("components")).where("components > 1")
    split = split.select("key", "top.major", "members", (F.col("members") - F.col("top.n")).alias("outer"))
    fars = star_sims.select(F.col("a").alias("lead"), F.col("b").alias("id"), (1 - F.col("sim")).alias("far"))
    placed = named.join(split, "key").join(fars, ["lead", "id"], "left").withColumns({"far": F.coalesce("far", F.lit(0.0)), "apart": F.col("component") != F.col("major")})
    placed = stash(placed.select("key", "id", "component", "far", "apart", "members", "outer"), "placed")
    if not placed.isEmpty():
        more, first = stash(_links_apart(placed, texts, similarity, size), "links-apart"), found
        found = connected_components(links.union(more), "near-all")
        discard(more, first)
    discard(placed, star_sims, stars, texts, buckets, others, copies)
    out = join_hot(classes, found.select(F.col("node").alias("class_id"), "component"), ["class_id"], "left").select("id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return out.unionByName(sketches.where("id is null or digest is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("component_id")))


def _sketched(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, size: int) -> tuple[DataFrame, DataFrame, bool]:
    """(id, text) of the documents, their sketches, and whether every id has one text."""
    from pactlens.llm.common import stash

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = stash(sketch(given, bands, rows, size), "sketches")
    words = F.coalesce("digest", F.lit(b""))
    mixed = sketches.where("id is not null").groupBy("id").agg((F.min(words) != F.max(words)).alias("mixed")).where("mixed")
    return given, sketches, mixed.isEmpty()


def _numbered(docs: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows: int, size: int) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` written with a number for each row, that column's name, and (row, id, class_id, component) in terms of rows, for ids with several texts."""
    from pactlens.llm.common import free_name, stash

    name = free_name(docs, "_row")
    held = stash(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")  # written once, so the numbers stay
    # a null id is linked with nothing: its row takes part without words
    given = held.select(F.col(name).alias("id"), F.when(F.col(id_col).isNotNull(), F.col(text_col)).alias("text"))
    told = _grouped(given, stash(sketch(given, bands, rows, size), "row-sketches"), similarity, size)
    ids = held.select(F.col(name).alias("row"), F.col(id_col).cast("long").alias("id"))
    return held, name, stash(told.toDF("row", "class_row", "component").join(ids, "row"), "rows-told")


def near_documents(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(id, class_id, component_id, kept), one row for each row of ``docs``: documents linked when their similarity is at least ``similarity``.

    class_id is the smallest id with the same words in the same order, component_id the smallest id reachable by
    links. A null, empty or wordless text, or a null id, is linked with nothing and stays. Rows that share an id and
    all words are copies of each other; rows that share an id alone are documents of their own, for which the table is
    written once with a number for each row. Other columns are left out, whatever their names. With the defaults a
    pair at similarity 0.8 is missed with probability 0.0006, less above.
    """
    given, sketches, plain = _sketched(docs, id_col, text_col, bands, rows, size)
    if plain:
        out = _grouped(given, sketches, similarity, size)
    else:
        told = _numbered(docs, id_col, text_col, similarity, bands, rows, size)[2]
        least = lambda key, name: told.where("id is not null").groupBy(key).agg(F.min("id").alias(name))
        out = told.join(least("class_row", "class_id"), "class_row", "left").join(least("component", "component_id"), "component", "left")
        out = out.select("id", "class_id", "component_id")
    return out.select(F.col("id").alias(id_col), "class_id", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 200_000, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id, and all that is linked with nothing.

    Of rows that share an id and all words one stays, the first by its columns' values. What goes is named by id; a
    set of ids that is small enough by count is broadcast, a larger one is joined by shuffle.
    """
    from pactlens.llm.common import free_name, stash

    given, sketches, plain = _sketched(docs, id_col, text_col, bands, rows, size)
    if not plain:
        held, name, told = _numbered(docs, id_col, text_col, similarity, bands, rows, size)
        stays = told.groupBy("component").agg(F.min(F.struct("id", "row")).alias("m")).select(F.col("m.row").alias(name))
        return held.join(stays, name, "left_semi").select(docs.columns)
    told = stash(_grouped(given, sketches, similarity, size).select("id", "component_id"), "kept")
    gone = told.where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    out = docs.join(F.broadcast(gone) if gone.count() <= small else gone, id_col, "left_anti").select(docs.columns)
    twice = sketches.where("id is not null and digest is not null").groupBy(F.col("id").alias(id_col)).count().where("count > 1").select(id_col)
    twice = stash(twice, "repeated")
    if twice.isEmpty():
        return out
    n = free_name(docs, "_n")
    first = out.join(twice, id_col, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(id_col).orderBy(F.to_json(F.struct(*docs.columns))))).where(F.col(n) == 1)
    return out.join(twice, id_col, "left_anti").select(docs.columns).unionByName(first.select(docs.columns))


def op9_minhash_dedup(spark, sf_dir):
    from pactlens.llm.common import table

    return near_documents(table(spark, sf_dir, "documents"))
