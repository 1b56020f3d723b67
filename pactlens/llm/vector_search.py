"""Operator 8: nearest neighbours with a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards of bounded bytes by hash. A shard's graph is built in one task, level by level
from the top, in growing batches that search the graph so far together, and is written as flat arrays: vectors in
insertion order and, per level, a matrix of neighbour numbers. Queries stream past every shard; its results are merged.

Nearness in the graph is the inner product itself, of vectors scaled by one number so that none overflows; on vectors
of equal length it is the order by distance. Scores come from the original vectors in double precision. Every vector is indexed; recall is measured against brute force in the tests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.memo import tidy

M, BUILD_WIDTH, SEARCH_WIDTH, STEP, SEED = 16, 64, 96, 4, 23
#: Vectors of a shard at most: the recall of one graph falls as it grows (64 unclustered dimensions: the tests say how far).
SHARD_ROWS = 8_192


class Graph:
    """Flat HNSW: ``points`` in insertion order (higher levels first), ``links[l]``: neighbours of the first rows on level l, -1: none."""

    def __init__(self, points: np.ndarray, links: list[np.ndarray]):
        self.points, self.links = points, links

    @classmethod
    def build(cls, points: np.ndarray, m: int = M, width: int = BUILD_WIDTH, seed: int = SEED) -> tuple[Graph, np.ndarray]:
        """(graph, order): order gives the row of ``points`` that stands at each place of the graph."""
        n = len(points)
        level = (-np.log(1.0 - np.random.default_rng(seed).random(n)) / math.log(m)).astype(int)
        order = np.argsort(-level, kind="stable")
        counts = [int((level >= x).sum()) for x in range(int(level.max(initial=0)) + 1)]
        graph = cls(np.ascontiguousarray(points[order], np.float32), [np.empty((0, 0), np.int32)] * len(counts))
        for x in reversed(range(len(counts))):
            graph._build_level(x, counts[x], 2 * m if x == 0 else m, width)
        return graph, order

    def _build_level(self, level: int, n: int, degree: int, width: int) -> None:
        links = self.links[level] = np.full((n, degree), -1, np.int32)
        done = min(n, 256)
        near = self.points[:done] @ self.points[:done].T
        np.fill_diagonal(near, -np.inf)
        links[:done] = self._chosen(np.arange(done), np.argsort(-near, axis=1)[:, : min(done - 1, width)].astype(np.int32), degree)
        while done < n:
            stop = min(n, done + min(done, 512))
            new = np.arange(done, stop)
            entry = self._descend(self.points[new], level)
            entry[entry >= done] = 0
            found = self._beam(self.points[new], level, entry, width)[0]
            mates = self.points[new] @ self.points[new].T
            np.fill_diagonal(mates, -np.inf)
            mates = new[np.argpartition(-mates, min(16, len(new) - 1), axis=1)[:, :16]] if len(new) > 1 else np.empty((len(new), 0), int)
            links[new] = self._chosen(new, np.concatenate([found, mates.astype(np.int32)], axis=1), degree)
            self._link_back(new, links, degree)
            done = stop

    def _link_back(self, new: np.ndarray, links: np.ndarray, degree: int) -> None:
        """Each new point joins the lists of the points it chose; a list that is full keeps the best by the same rule."""
        to, source = links[new].reshape(-1), np.repeat(new, degree)
        source, to = source[to >= 0], to[to >= 0]
        near = np.einsum("ij,ij->i", self.points[to], self.points[source])
        by = np.lexsort((-near, to))
        to, source = to[by], source[by]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, counts)
        extra = np.full((len(targets), min(int(counts.max(initial=0)), 2 * degree)), -1, np.int32)
        row, kept = np.repeat(np.arange(len(targets)), counts), place < extra.shape[1]
        extra[row[kept], place[kept]] = source[kept]
        links[targets] = self._chosen(targets, np.concatenate([links[targets], extra], axis=1), degree)

    def _chosen(self, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
        """Of each row's candidates the near ones that are nearer to it than to any chosen before; the nearest others fill up."""
        out = np.full((len(own), degree), -1, np.int32)
        for at in range(0, len(own), 256):
            who, c = own[at : at + 256], candidates[at : at + 256]
            c = np.where(c == who[:, None], -1, c)
            vectors = self.points[c]
            near = np.einsum("bcd,bd->bc", vectors, self.points[who])
            near[c < 0] = -np.inf
            by = np.argsort(-near, axis=1, kind="stable")
            c, near = np.take_along_axis(c, by, 1), np.take_along_axis(near, by, 1)
            same = np.zeros_like(c, bool)
            sorted_c = np.sort(c, axis=1)
            if (sorted_c[:, 1:] == sorted_c[:, :-1])[sorted_c[:, 1:] >= 0].any():
                order = np.argsort(c, axis=1, kind="stable")
                repeat = np.take_along_axis(c, order, 1)
                np.put_along_axis(same, order[:, 1:], repeat[:, 1:] == repeat[:, :-1], 1)
            near[same] = -np.inf
            vectors = np.take_along_axis(vectors, by[:, :, None], 1)
            mutual = vectors @ vectors.transpose(0, 2, 1)
            closest = np.full(c.shape, -np.inf, np.float32)  # of each candidate to those chosen
            rank = np.full(c.shape, 2, np.int8)
            taken = np.zeros(len(c), int)
            for j in range(c.shape[1]):
                good = (near[:, j] > closest[:, j]) & (taken < degree) & np.isfinite(near[:, j])
                rank[good, j] = 0
                taken += good
                closest = np.where(good[:, None], np.maximum(closest, mutual[:, j]), closest)
            rank[(rank == 2) & np.isfinite(near)] = 1
            last = np.argsort(rank, axis=1, kind="stable")[:, :degree]
            picked = np.take_along_axis(c, last, 1)
            picked[np.take_along_axis(rank, last, 1) == 2] = -1
            out[at : at + 256, : picked.shape[1]] = picked
        return out

    def _descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The entry point for each query on ``level``, found greedily on the levels above."""
        entry = np.zeros(len(queries), np.int64)
        for x in range(len(self.links) - 1, level, -1):
            entry = self._beam(queries, x, entry, 4)[0][:, 0].astype(np.int64)
        return entry

    def _beam(self, queries: np.ndarray, level: int, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, inner products) of the best ``width`` found for each query, best first, -1 where there are fewer."""
        links, n = self.links[level], len(self.links[level])
        rows, scores = np.full((len(queries), width), -1, np.int32), np.full((len(queries), width), -np.inf, np.float32)
        block = max(16, min(256, (1 << 25) // max(1, n)))
        for at in range(0, len(queries), block):
            q = queries[at : at + block]
            seen = np.zeros((len(q), n + 1), bool)  # the last column stands for -1
            seen[:, n] = True
            ids, sims, open_ = np.full((len(q), width), -1, np.int32), np.full((len(q), width), -np.inf, np.float32), np.zeros((len(q), width), bool)
            start = entry[at : at + block]
            ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("bd,bd->b", self.points[start], q), True
            seen[np.arange(len(q)), start] = True
            live = np.arange(len(q))
            while len(live):
                chance = np.where(open_[live], sims[live], -np.inf)
                step = min(STEP, width)
                best = np.argpartition(-chance, step - 1, axis=1)[:, :step]
                usable = np.take_along_axis(chance, best, 1) > -np.inf
                live, best, usable = live[usable.any(axis=1)], best[usable.any(axis=1)], usable[usable.any(axis=1)]
                if not len(live):
                    break
                open_[live[:, None], best] &= ~usable
                near = links[np.where(usable, ids[live[:, None], best], 0)]
                near[~usable] = -1
                near = np.sort(near.reshape(len(live), -1), axis=1)
                near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
                near[seen[live[:, None], near]] = -1
                seen[live[:, None], near] = True
                got = np.einsum("bkd,bd->bk", self.points[near], q[live])
                got[near < 0] = -np.inf
                both, value = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], got], axis=1)
                fresh = np.concatenate([open_[live], near >= 0], axis=1)
                keep = np.argpartition(-value, width - 1, axis=1)[:, :width]
                ids[live], sims[live], open_[live] = np.take_along_axis(both, keep, 1), np.take_along_axis(value, keep, 1), np.take_along_axis(fresh, keep, 1)
            by = np.argsort(-sims, axis=1, kind="stable")
            rows[at : at + block], scores[at : at + block] = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        rows[~np.isfinite(scores)] = -1
        return rows, scores

    def search(self, queries: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Rows of the ``k`` best found for each query, -1 where there are fewer."""
        queries = np.ascontiguousarray(queries, np.float32)
        return self._beam(queries, 0, self._descend(queries, 0), max(width, k))[0][:, :k]


INDEX = "dim int, shard int, ids array<long>, least array<long>, vectors binary, links array<binary>"
_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("vectors", pa.binary()), ("links", pa.list_(pa.binary()))])


def build_index(classes: DataFrame, shards: int, scale: float) -> DataFrame:
    """One row per dimension and shard of ``classes`` (rep, least, k1, vec): rep, smallest id and original vector in insertion order, and the flat links of each level."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("least", "ascending"), ("k1", "ascending")])
        x = np.array(group["vec"].to_pylist(), float)
        graph, order = Graph.build(x / scale)
        ids, least = (group[c].to_numpy()[order].tolist() for c in ("rep", "least"))
        row = {"dim": [x.shape[1]], "shard": [group["shard"][0].as_py()], "ids": [ids], "least": [least], "vectors": [x[order].tobytes()], "links": [[level.tobytes() for level in graph.links]]}
        return pa.table(row, _INDEX)

    dealt = classes.select("rep", "least", "k1", "vec", F.size("vec").alias("dim"), F.pmod("k1", F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("dim", "shard").applyInArrow(build, INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int, scale: float, shards: int, copies: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query, rep, least, score): for each of ``queries`` (query, vec) the ``k`` best that each shard finds.

    A task reads one shard's index, then the queries sent to it as they come, so it holds a shard and a batch. Each
    shard is sent to ``copies`` tasks, among which its queries are dealt.
    """
    keys = ["dim", "shard", "copy"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.select("dim", "shard", every(copies).alias("copy"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<double>").alias("vec"), "ids", "least", "vectors", "links")
    sent = queries.select(F.size("vec").alias("dim"), every(shards).alias("shard"), F.pmod(F.xxhash64("query"), F.lit(copies)).cast("int").alias("copy"), "query", "vec")
    sent = sent.withColumns({"ids": F.lit(None).cast("array<long>"), "least": F.lit(None).cast("array<long>"), "vectors": F.lit(None).cast("binary"), "links": F.lit(None).cast("array<binary>")})
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * shards * copies)  # so that few shards share one
    dealt = held.unionByName(sent).repartition(tasks, *keys).sortWithinPartitions(*keys, F.col("query").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, graph, ids, least, vectors = None, None, None, None, None
        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
            starts = b.column("vectors").is_valid().to_numpy(zero_copy_only=False)
            cuts = [i for i, p in enumerate(places) if i == 0 or starts[i] or starts[i - 1] or p != places[i - 1]]
            for s, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if starts[s]:
                    key, dim = places[s], places[s][0]
                    ids, least = (b.column(c)[s].values.to_numpy() for c in ("ids", "least"))
                    vectors = np.frombuffer(b.column("vectors")[s].as_py()).reshape(-1, dim)
                    links = [np.frombuffer(x, np.int32) for x in b.column("links")[s].as_py()]
                    graph = Graph((vectors / scale).astype(np.float32), [x.reshape(-1, 2 * M if level == 0 else M) for level, x in enumerate(links)])
                elif places[s] == key:
                    q = b.column("vec").slice(s, e - s).flatten().to_numpy().reshape(-1, key[0])
                    found = graph.search(q / scale, k, width)
                    who, place = np.nonzero(found >= 0)
                    hit = found[who, place]
                    score = np.einsum("ij,ij->i", q[who], vectors[hit])
                    yield pa.RecordBatch.from_arrays([pa.array(b.column("query").slice(s, e - s).to_numpy()[who]), pa.array(ids[hit]), pa.array(least[hit]), pa.array(score)], ["query", "rep", "least", "score"])

    return dealt.mapInArrow(tidy(search), "query long, rep long, least long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shards: int = 8, shard_bytes: int = 32 << 20, shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by ``every`` its ``k`` nearest other rows by inner product.

    Ties go to the smaller id; if there are fewer other rows, all are returned. Vectors that are null, zero or hold
    null or non-finite components take no part, nor do rows with a null id; vectors of another length are no
    candidates; rows with the query's id are its own. A row that occurs several times is one candidate; an id with several
    vectors is taken for one candidate by each.
    Other columns are left out, whatever their names. No rows give no rows.

    At least ``shards`` shards are made, more where a shard's vectors would pass ``shard_rows``, up to which the recall of one
    graph is measured, or ``shard_bytes``. A shard goes to one
    task for each so many bytes of queries, so copies of the index never cost more than the queries do.
    """
    from pactlens.llm.common import discard, join_hot, stash
    from pactlens.llm.vector_dedup import usable

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("id is not null").where(usable(F.col("vec")))
    rows = rows.withColumns({"k1": F.xxhash64(F.lit(1), "vec"), "k2": F.xxhash64(F.lit(2), "vec")})  # a vector's name in 128 bits
    # of equal vectors, the k + 1 smallest ids are all that a result can name
    few = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = stash(few.groupBy("vec", "k1", "k2").agg(F.min("id").alias("least"), F.sort_array(F.collect_set("id")).alias("ids")).withColumn("rep", F.monotonically_increasing_id()), "search-classes")  # written once, so the numbers stay
    told = classes.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vec", F.abs))).alias("scale"), F.max(F.size("vec")).alias("dim")).first()
    scale, shard_rows = told["scale"] or 1.0, max(1, min(shard_rows, shard_bytes // (8 * (told["dim"] or 1))))
    shards = max(shards, -(-told["n"] // shard_rows))
    index = stash(build_index(classes, shards, scale), "search-index")

    names = classes.select("k1", "k2", "rep")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "k1", "k2").distinct()
    asked = stash(join_hot(asked, names, ["k1", "k2"]).select("query_id", F.col("rep").alias("query")), "search-queries")
    distinct = stash(classes.select(F.col("rep").alias("query"), "vec").join(asked.select("query").distinct(), "query", "left_semi"), "search-vectors")
    found = search_index(index, distinct, k + 1, scale, shards, max(1, -(-distinct.count() // shard_rows)), width)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    merged = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    named = merged.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("id"))
    ranked = named.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = stash(ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("hits")), "search-hits")
    discard(index, distinct, classes)
    own = join_hot(asked, lists, ["query"], few=50_000).select("query_id", F.expr(f"slice(filter(hits, h -> h.id <> query_id), 1, {k})").alias("hits"))
    out = own.select("query_id", F.posexplode("hits").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), F.col("hit.score").alias("score"))


def op8_hnsw_search(spark, sf_dir):
    from pactlens.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings"))


#: Brute force of the same result, with which the tests measure the recall.
OP8_EXACT_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
