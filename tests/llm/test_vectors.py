import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlens.llm import vector_search as VS
from pactlens.llm.common import connected_components, discard, free_name, join_hot, stash
from pactlens.llm.vector_dedup import OP1_SQL, Windows, collision_threshold, near_vectors, op1_embedding_dedup, plan, shares_window, units, window_collisions
from pactlens.llm.vector_search import OP8_EXACT_SQL, Graph, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, cells string"


def table(spark, vectors, labels=None):
    labels = labels or [1] * len(vectors)
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], la, "x") for i, (v, la) in enumerate(zip(vectors, labels, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, labels, least=0.93):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    n = len(vectors)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and labels[i] == labels[j] and labels[i] is not None and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], np.float32).astype(float), np.array(vectors[j], np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in links[i])])
            changed |= low != comp[i]
            comp[i] = low
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in range(n)}


def families(rng, n, dim=64):
    out = []
    while len(out) < n:
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 9)):
            out.append(base + rng.standard_normal(dim) * rng.uniform(0.02, 0.4))
    return out[:n]


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = families(rng, 300)
    vectors += [vectors[0]] * 5 + [[1.0] * 64, [2.0] * 64]  # copies, and a multiple
    vectors += [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0, 2.0], [2.0, 4.1]]
    labels = [int(x) for x in rng.integers(0, 3, 300)] + [1] * 7 + [1] * 8
    labels[5] = None
    labels[300:305] = [labels[0]] * 5
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table(spark, vectors, labels), chunk=32).collect()}
    assert got == brute(vectors, labels)


def at_cosine(rng, a, cosine):
    """A vector at the cosine from each row of ``a``."""
    a = a / np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    return cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1)[:, None]


def test_many_vectors_with_thousands_of_links_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((14_000, 64))
    close = at_cosine(rng, base[:6000], 0.935) * rng.uniform(0.1, 9, (6000, 1))  # most pairs near the threshold, some below
    crowd = base[0] + rng.standard_normal((1500, 64)) * 0.2  # one group of near copies, all distinct
    x = np.concatenate([base, close, crowd]).astype(np.float32)
    labels = np.where(np.arange(len(x)) % 14_000 % 3 == 0, 1, 2)  # a pair has one label, two thirds of all rows one of them
    labels[20_000:] = 1
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    n, comp = np.zeros(len(u), int), np.arange(len(u))
    pairs = []
    for la in (1, 2):
        own = np.flatnonzero(labels == la)
        for at in range(0, len(own), 2000):
            i, j = np.nonzero(u[own[at : at + 2000]] @ u[own].T >= 0.93)
            i, j = own[at + i], own[j]
            pairs.append(np.stack([i, j])[:, i != j])
    a, b = np.concatenate(pairs, axis=1)
    n += np.bincount(a, minlength=len(u))
    while True:
        low = comp.copy()
        np.minimum.at(low, a, comp[b])
        if (low == comp).all():
            break
        comp = low
    rows = [(i, v, la) for i, (v, la) in enumerate(zip(x.tolist(), labels.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_vectors(df).toPandas().sort_values("vec_id")
    assert len(a) > 100_000 and (n[14_000:20_000] > 0).sum() > 4000
    missed = n.sum() - got.n_links.sum()
    print("links:", n.sum(), "missed:", missed)
    assert missed == 0 and (got.n_links.to_numpy() == n).all() and (got.component_id.to_numpy() == comp).all()


def test_tables_grow_slowly_and_keep_the_recall():
    sizes = [plan(n, 0.93, 0.99999) for n in (1, 1000, 10**5, 10**7, 10**9)]
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(sizes, sizes[1:], strict=False))
    assert sizes[-1][0] / sizes[2][0] <= 1.2 * (10**4) ** 0.23  # the power is log(near) / log(far)
    for tables, group in sizes:
        assert (1 - shares_window(np.sqrt(0.14)) ** group) ** tables <= 1e-5
    rng = np.random.default_rng(4)
    d, p = rng.standard_normal(200_000) * np.sqrt(0.14), rng.random(200_000) * 2.56
    assert (np.floor(p / 2.56) == np.floor((p + d) / 2.56)).mean() == pytest.approx(shares_window(np.sqrt(0.14)), abs=0.005)


def test_window_collisions_are_those_counted_one_by_one():
    rng = np.random.default_rng(8)
    left, right = rng.uniform(-1, 1, (40, 9)), rng.uniform(-1, 1, (55, 9))
    left[3] = right[4]
    right[5] = right[6]
    assert (window_collisions(left, right, 0.25) == (np.abs(left[:, None] - right[None]) <= 0.25).sum(axis=2)).all()


def test_sql_and_query_agree_on_dirty_rows(spark, tmp_path):
    rng = np.random.default_rng(13)
    vectors = [*families(rng, 60), None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0, 2.0]]
    labels = [1 + i % 2 for i in range(60)] + [1] * 7
    labels[7] = None
    table(spark, vectors, labels).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duck.execute(OP1_SQL).fetchall()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op1_embedding_dedup(spark, str(tmp_path)).collect()}
    assert got == want == brute(vectors, labels)


def test_rows_that_share_an_id_keep_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.99, 0.01], 1), (3, [0.01, 0.99], 1), (4, [0.02, 0.98], 1)]
    got = sorted(tuple(r)[:3] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_hot_joins_and_discarded_tables(spark):
    left = spark.range(400).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS v", "'x' AS _salt")
    right = stash(spark.range(200).selectExpr("id AS k", "id * 2 AS w"), "hot")
    want = sorted(left.join(right, "k", "left").collect())
    assert sorted(join_hot(left, right, ["k"], "left", few=10, salts=3).collect()) == want == sorted(join_hot(left, right, ["k"], "left").collect())
    assert free_name(left, "_SALT") == "_SALT_"
    path = right.inputFiles()[0]
    discard(right)
    assert not __import__("os").path.exists(path.removeprefix("file:"))


def test_no_vectors(spark):
    assert near_vectors(table(spark, [])).count() == 0
    assert nearest(table(spark, [])).count() == 0
    got = near_vectors(table(spark, [None, None])).collect()
    assert sorted((r.vec_id, r.n_links, r.kept) for r in got) == [(0, 0, True), (1, 0, True)]
    assert nearest(table(spark, [None, [1.0] * 8])).count() == 0


def test_repeated_rows_are_vectors_of_their_own(spark):
    t = table(spark, [[1.0, 0.0], [0.0, 1.0]])
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(t.union(t)).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (1, 1, 1), (1, 1, 1)]


def test_threshold_keeps_the_wanted_recall():
    rng = np.random.default_rng(5)
    lines = rng.standard_normal((64, 48))
    lines /= np.linalg.norm(lines, axis=0)
    window = 2 * np.sqrt(2 * 0.07 / 64)
    least = collision_threshold(0.93, window, 64, 48, 0.999)
    hit = 0
    for _ in range(2000):
        a, b = rng.standard_normal(64), rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
        hit += window_collisions((a @ lines)[None], (c @ lines)[None], window)[0, 0] >= least
    assert hit >= 0.99 * 2000


def exact(vectors, every, k):
    ids = [i for i, v in enumerate(vectors) if v is not None and all(np.isfinite(v)) and any(v)]
    x = {i: np.array(vectors[i], np.float32).astype(float) for i in ids}
    return {q: sorted(((-float(x[q] @ x[c]), c) for c in ids if c != q))[:k] for q in ids if q % every == 0}


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    vectors = [v * rng.uniform(0.2, 3) for v in families(rng, 1500, 32)]
    got, want = {}, exact(vectors, 20, 20)
    for r in nearest(table(spark, vectors), shards=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert got.keys() == want.keys()
    hits = sum(len({c for _, c in want[q]} & {c for _, _, c in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, rows in got.items():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21))
        assert [(s, c) for _, s, c in sorted(rows)] == sorted((s, c) for _, s, c in rows)
        scores = dict((c, s) for s, c in exact(vectors, 20, 10**6)[q]) if q < 60 else {}
        assert all(abs(scores.get(c, s) - s) < 1e-9 for _, s, c in rows)


@pytest.mark.parametrize(("n", "dim", "shards", "least"), [(4000, 32, 3, 0.99), (50_000, 24, 8, 0.95)])
def test_recall_against_the_exact_sql(spark, tmp_path, n, dim, shards, least):
    rng = np.random.default_rng(17)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + rng.standard_normal((n - n // 2, dim)).astype(np.float32) * 0.3
    x[:: n // 7] = x[1]  # a vector that occurs again
    every = 20 if n < 10_000 else 500
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = {}
    for q, _, v, score in duck.execute(OP8_EXACT_SQL.replace("% 20", f"% {every}")).fetchall():
        want.setdefault(q, {})[v] = score
    got = {}
    for r in nearest(spark.read.parquet(str(tmp_path / "e")), every=every, shards=shards, shard_bytes=1 << 30).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    recall = sum(len(got[q].keys() & want[q].keys()) for q in want) / (20 * len(want))
    print("rows:", n, "recall:", recall)
    assert recall >= least
    assert all(abs(s - want[q][v]) < 1e-9 for q in want for v, s in got[q].items() if v in want[q])


def test_search_with_many_shards_copies_and_repeated_rows(spark):
    rng = np.random.default_rng(19)
    vectors = [v.tolist() for v in families(rng, 400, 8)]
    few = {tuple(r) for r in nearest(table(spark, vectors), shards=2).collect()}
    many = {tuple(r) for r in nearest(table(spark, vectors), shards=1, shard_bytes=8 * 8 * 60).collect()}  # 7 shards
    assert {r[:2] for r in few} == {r[:2] for r in many} and len(few & many) >= 0.97 * len(few)
    twice = table(spark, vectors[:30]).union(table(spark, vectors[:30]))
    got = [(r.query_id, r.vec_id) for r in nearest(twice).collect()]
    assert len(got) == len(set(got)) == 40 and all(q != v for q, v in got)


def test_search_ties_go_to_the_smaller_id_and_few_rows_give_all(spark):
    vectors = [[1.0, 0.0]] * 50 + [[0.5, 0.1]] * 3
    got = sorted((r["rank"], r.vec_id) for r in nearest(table(spark, vectors)).collect() if r.query_id == 20)
    assert [v for _, v in got] == [i for i in range(21) if i != 20]
    small = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(table(spark, [[1.0, 0], [0, 1.0], [2.0, 2.0], None, [0.0, 0.0]])).collect())
    assert small == [(0, 1, 2), (0, 2, 1)]


def test_graph_reaches_every_point():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, order = Graph.build(x)
    found = graph.search(x, 1)
    assert (order[found[:, 0]] == np.arange(3000)).mean() > 0.99


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (502, 501), (600, 600), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500, 600: 600}


def test_recall_of_the_largest_shard_on_vectors_that_do_not_cluster():
    x = np.random.default_rng(3).standard_normal((VS.SHARD_ROWS, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = VS.Graph.build(x)
    asked = x[:: VS.SHARD_ROWS // 400]
    found, best = graph.search(asked, 21, VS.SEARCH_WIDTH), np.argsort(-(asked @ x[order].T), axis=1)[:, :21]
    recall = np.mean([len(set(a) & set(b)) / 21 for a, b in zip(found.tolist(), best.tolist(), strict=True)])
    print("rows:", VS.SHARD_ROWS, "recall:", recall)
    assert recall >= 0.95


def test_shards_are_bounded_by_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(4)]).alias("embedding"))
    some = nearest(rows, every=100, k=3, shards=1, shard_rows=400)
    whole = nearest(rows, every=100, k=3, shards=1)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect()))


def test_runs_of_a_vector_do_not_depend_on_its_batch_and_pairs_count_where_they_meet_first():
    rng = np.random.default_rng(5)
    for dim in (1, 7, 64, 300):
        base = rng.standard_normal((60, dim))
        unit = units(np.concatenate([base, base + 0.05 * rng.standard_normal((60, dim)), base]))
        w = Windows(dim, 40, 5)
        whole = w.runs(unit, 0, 40)
        assert (whole[:60] == whole[120:]).all()
        assert all((w.runs(unit[i : i + 1], 0, 40)[0] == whole[i]).all() for i in (0, 77, 179))
        assert (np.concatenate([w.runs(unit[::-1], s, min(40, s + 7)) for s in range(0, 40, 7)], axis=1)[::-1] == whole).all()
        a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(60), np.arange(60, 120)))
        for t in (0, 1, 5, 33):
            x, y = w.first_met(unit, a, b, t)
            new = ~(whole[a, :t] == whole[b, :t]).any(axis=1)
            assert (x == a[new]).all() and (y == b[new]).all() and (t == 0 or 0 < len(x) or dim == 1)
