"""Operator 1: near-duplicate vectors by collision-counting projections.

Each vector is projected on many random directions. Of two vectors at the wanted cosine the projections differ by
little on every direction, those of two others by much on most, so the pair's collisions are counted: each projection
is sorted, a window centred at each vector collides with what lies in it, and a pair is verified by its cosine in
double precision only if its count reaches a threshold that a binomial tail sets for the wanted recall.

One window holds a good part of all vectors, so comparing whole sorted lines would be quadratic. Windows of several
projections at once (fixed windows, side by side with a random shift) therefore deal the vectors to tables' runs first,
and the sorting and counting is done inside a run. How many projections a run takes follows from the number of
vectors, so that unlike vectors leave about ``CROWD`` in it, and how many tables there are from the probability that
a pair at the wanted cosine shares a run, so that a pair is missed with probability ``1 - recall`` at most, whatever
the size of the table. A pair that meets in several tables counts in the first alone: windows of a vector are the same
wherever they are worked out (:class:`Windows`), so a task works out those of earlier tables for the pairs it links, and
a vector travels without them.

No pair leaves its task: a task reports, per vector, the number of links found and the edges of a spanning forest of
them. Equal vectors are one vector with a multiplicity. A crowded run is dealt as pairs of chunks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.memo import tidy

#: Width of fixed windows in units of a unit vector's spread on a random direction, wanted vectors in a run, rows of a chunk.
WIDTH, CROWD, CHUNK, SEED = 2.56, 128, 1024, 17


def usable(vector: Column) -> Column:
    """Not null, not zero, and no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def collision_threshold(similarity: float, window: float, dim: int, projections: int, recall: float) -> int:
    """The largest count that a pair of the given cosine reaches with probability ``recall``."""
    spread = math.sqrt(2 * (1 - similarity) / dim)  # of the difference of two such vectors on a random unit direction
    p = math.erf(window / (spread * math.sqrt(2)))
    below, count = 0.0, 0
    while count <= projections:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
        count += 1
    return projections


def directions(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((dim, n))
    return x / np.linalg.norm(x, axis=0)


def units(x: np.ndarray) -> np.ndarray:
    """The rows, none of them zero, at length 1 in double precision; none overflows or vanishes on the way."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def shares_window(spread: float, width: float = WIDTH) -> float:
    """Probability that two projections whose difference is normal with ``spread`` lie in the same window of ``width`` at a random shift."""
    z = width / spread
    return math.erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) / z * (1 - math.exp(-z * z / 2))


def plan(vectors: int, similarity: float, recall: float) -> tuple[int, int]:
    """(tables, projections of a run) for so many vectors that are compared with each other."""
    near, far = shares_window(math.sqrt(2 * (1 - similarity))), shares_window(math.sqrt(2))
    group = max(4, math.ceil(math.log(max(1.0, vectors / CROWD)) / -math.log(far)))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**group)))), group


class Windows:
    """The runs of unit vectors of one length in each table, as 64-bit names.

    Vectors and directions are rounded to multiples of 2^-25. Their products are then whole multiples of 2^-50 and sums
    stay below 2, so projections are exact in double precision in whatever order they are added: equal vectors have
    equal runs in every task.
    """

    STEP = 16  # tables at a time, so that many tables need no more memory

    def __init__(self, dim: int, tables: int, group: int):
        self.dim, self.group = dim, group
        self.lines = self._grid(directions(dim, tables * group))
        self.shift = np.random.default_rng(SEED + 2).random(tables * group) * WIDTH

    @staticmethod
    def _grid(x: np.ndarray) -> np.ndarray:
        return np.rint(x * 2.0**25) * 2.0**-25

    def runs(self, unit: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Runs (row, table) in the tables from ``start`` up to ``stop``."""
        own = slice(start * self.group, stop * self.group)
        window = np.floor((self._grid(unit) @ self.lines[:, own]) * (math.sqrt(self.dim) / WIDTH) + self.shift[own] / WIDTH).astype(np.int64)
        mixed = np.full((len(unit), stop - start), self.dim, np.uint64)
        for j in range(self.group):
            mixed = (mixed ^ (window[:, j :: self.group].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        return mixed.astype(np.int64)

    def first_met(self, unit: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs a-b that share no run in the tables before ``t``."""
        for start in range(0, t, self.STEP):
            if not len(a):
                break
            rows = np.unique(np.concatenate([a, b]))
            runs, new = self.runs(unit[rows], start, min(t, start + self.STEP)), np.empty(len(a), bool)
            x, y = np.searchsorted(rows, a), np.searchsorted(rows, b)
            for at in range(0, len(a), 1 << 16):
                some = slice(at, at + (1 << 16))
                new[some] = ~(runs[x[some]] == runs[y[some]]).any(axis=1)
            a, b = a[new], b[new]
        return a, b


def window_collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """Counts (left, right) of projections on which the right row lies in the window centred at the left row."""
    n, lines = right.shape
    order = np.argsort(right, axis=0, kind="stable")
    rank = np.empty((n, lines), np.int16 if n < 1 << 15 else np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=rank.dtype)[:, None], axis=0)
    apart = 4.0 * np.arange(lines)  # unit vectors' projections are within 1, so all lines are searched as one
    line = (np.take_along_axis(right, order, axis=0) + apart).T.reshape(-1)
    low = (np.searchsorted(line, left + apart - window, "left") - n * np.arange(lines)).astype(rank.dtype)
    high = (np.searchsorted(line, left + apart + window, "right") - n * np.arange(lines)).astype(rank.dtype)
    counts, step = np.empty((len(left), n), np.uint8), max(1, 2_000_000 // max(1, n * lines))
    for at in range(0, len(left), step):
        own = slice(at, at + step)
        counts[own] = ((rank[None] >= low[own, None]) & (rank[None] < high[own, None])).sum(axis=2, dtype=np.uint8)
    return counts


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the components of the links a-b among n vectors."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


class Cells:
    """Finds links inside a cell, or between two of its chunks."""

    def __init__(self, dim: int, similarity: float, recall: float, counted: int, window: float, windows: Windows):
        self.windows = windows
        self.lines, self.similarity, self.window = directions(dim, counted, SEED + 1), similarity, window
        self.least = collision_threshold(similarity, window, dim, counted, recall)

    def links(self, unit: np.ndarray, chunk: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of linked pairs that meet in table ``t`` first. chunk: 0 or 1; if both occur, only pairs across are compared."""
        projected = unit @ self.lines
        across = bool(chunk.any() and not chunk.all())
        left, right = (np.flatnonzero(chunk == 0), np.flatnonzero(chunk == 1)) if across else (np.arange(len(unit)),) * 2
        a, b = np.nonzero(window_collisions(projected[left], projected[right], self.window) >= self.least)
        a, b = left[a], right[b]
        if not across:
            a, b = a[a < b], b[a < b]
        out = []
        for at in range(0, len(a), 1 << 16):  # pairs at a time, so that a crowded run needs no more memory
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= self.similarity
            out.append((x[near], y[near]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (a[:0], b[:0])
        return self.windows.first_met(unit, a, b, t)


def near_vectors(vectors: DataFrame, similarity: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", within: str | None = "label", recall: float = 0.99999, chunk: int = CHUNK, counted: int = 48) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``.

    Rows are linked if ``within`` is equal and not null and the cosine is at least ``similarity``. A vector that is
    null, zero or has null or non-finite components links with nothing, nor does a row with a null id. Vectors of
    different lengths are not compared. Repeated rows are vectors of their own, linked with each other; rows that share
    an id but not a vector keep links of their own and are one node of the components. component_id is the smallest id
    reachable. Other columns are left out, whatever their names. No rows give no rows.

    A pair at ``similarity`` is missed with probability 1 - ``recall`` at most by either step (runs, then counts); pairs above it less.
    """
    from pactlens.llm.common import connected_components, discard, join_hot, stash, whole_groups

    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # then what travels is half as long
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), (F.col(within) if within else F.lit(0)).alias("part"))
    rows = rows.withColumn("vec", F.when(usable(F.col("vec")) & F.col("part").isNotNull() & F.col("id").isNotNull(), F.col("vec") if single else F.col("vec").cast("array<double>")))
    key_of = {"k1": F.xxhash64(F.lit(1), "part", "vec"), "k2": F.xxhash64(F.lit(2), "part", "vec")}  # a vector's name in 128 bits
    classes = rows.where("vec is not null").groupBy("part", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumns(key_of)
    classes = stash(classes, "vector-classes")
    most = classes.groupBy("part", F.size("vec").alias("n")).count().agg(F.max("count")).first()[0] or 0
    tables, group = plan(most, similarity, recall)
    kind = np.float32 if single else np.float64

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Windows] = {}
        for b in batches:
            vecs, n = b.column("vec"), b.num_rows
            flat, ends = vecs.flatten().to_numpy(), vecs.offsets.to_numpy() - vecs.offsets[0].as_py()
            cells, raw = np.empty((n, tables), np.int64), [b""] * n
            for d in np.unique(np.diff(ends)).tolist():
                own = np.flatnonzero(np.diff(ends) == d)
                x = flat[ends[own][:, None] + np.arange(d)].astype(kind)
                for i, u in zip(own.tolist(), x, strict=True):
                    raw[i] = u.tobytes()
                if d not in known:
                    known[d] = Windows(d, tables, group)
                unit = units(x)
                for start in range(0, tables, Windows.STEP):
                    stop = min(tables, start + Windows.STEP)
                    cells[own, start:stop] = known[d].runs(unit, start, stop)
            told = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables), pa.int32()), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part_key", "rep", "k1", "k2", "copies")), pa.array(raw, pa.binary()), told], ["part_key", "rep", "k1", "k2", "copies", "raw", "cells"])

    keyed = classes.select(F.xxhash64("part").alias("part_key"), "rep", "k1", "k2", "copies", "vec")
    keyed = stash(keyed.mapInArrow(tidy(placed), "part_key long, rep long, k1 long, k2 long, copies long, raw binary, cells array<long>"), "vector-runs")
    spread = keyed.select("part_key", "k1", "k2", F.posexplode("cells").alias("t", "cell"))
    crowds = spread.groupBy("part_key", "t", "cell").agg(F.count("*").alias("count")).where("count > 1")
    crowds = crowds.select("part_key", "t", "cell", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    met = stash(spread.join(crowds, ["part_key", "t", "cell"]), "vector-met")  # where a vector meets another at all
    there = met.join(keyed.drop("part_key", "cells"), ["k1", "k2"]).withColumn("own", F.pmod(F.col("k2"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = there.select("part_key", "t", "cell", "rep", "k1", "copies", "raw", "own", other)
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).withColumn("side", (F.col("own") > F.col("low")).cast("int"))
    key = ["part_key", "t", "cell", "low", "high"]
    dealt = dealt.select(*key, "rep", "k1", "copies", "raw", "side").repartition(*key).sortWithinPartitions(*key, "rep", "k1")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders: dict[int, Cells] = {}
        for rows, cuts in whole_groups(batches, key):
            keys = np.stack([rows[k].to_numpy() for k in key])
            ids, names, copies, side = (rows[c].to_numpy() for c in ("rep", "k1", "copies", "side"))
            raw, table = rows["raw"].to_pylist(), keys[1]
            out_id, out_name, out_n, out_to = [], [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s < 2 or (keys[3, s] != keys[4, s] and (side[s:e] == side[s]).all()):
                    continue
                t = int(table[s])
                size = np.array([len(u) for u in raw[s:e]])
                for d in np.unique(size).tolist():
                    own = s + np.flatnonzero(size == d)
                    dim = d // np.dtype(kind).itemsize
                    if dim not in finders:
                        finders[dim] = Cells(dim, similarity, recall, counted, 2 * math.sqrt(2 * (1 - similarity) / dim), Windows(dim, tables, group))
                    unit = units(np.frombuffer(b"".join(raw[i] for i in own), kind).reshape(-1, dim))
                    a, b = finders[dim].links(unit, side[own], t)
                    if not len(a):
                        continue
                    n = np.bincount(a, copies[own][b], len(own)) + np.bincount(b, copies[own][a], len(own))
                    has, forest = np.flatnonzero(n), _forest(len(own), a, b)
                    out_id += ids[own[has]].tolist() + [int(ids[own[x]]) for x, _ in forest]
                    out_name += names[own[has]].tolist() + [int(names[own[x]]) for x, _ in forest]
                    out_n += n[has].astype(np.int64).tolist() + [0] * len(forest)
                    out_to += [None] * len(has) + [int(ids[own[y]]) for _, y in forest]
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_id, out_name, out_n, out_to)], ["rep", "k1", "n", "to"])

    found = stash(dealt.mapInArrow(tidy(linked), "rep long, k1 long, n long, to long"), "vector-links")
    discard(keyed, met)
    counts = found.where("to is null").groupBy("rep", "k1").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("to is not null").select(F.col("rep").alias("u"), F.col("to").alias("v")), "vector-components")
    told = classes.join(counts, ["rep", "k1"], "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    told = stash(told.where("n_links > 0"), "vector-told")  # the others are their own components
    discard(found, components)
    named = rows.select("id", *[F.when(F.col("vec").isNotNull(), k).alias(n) for n, k in key_of.items()])
    out = join_hot(named, told, ["k1", "k2"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir):
    from pactlens.llm.common import table

    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT reach.node, links.v FROM reach JOIN links ON reach.seen = links.u)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) r ON r.node = e.vec_id
"""
