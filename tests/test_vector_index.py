"""The stored index of vectors against plain Python."""

import math
import random

from pactlens.operators import vectors as X

SHAPE = "vec_id long, convenio_id long, version_id long, embedding array<float>"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def rows(n=300):
    r = random.Random(5)
    vectors = [[float(r.randrange(-4, 5)) for _ in range(4)] + [1.0] for _ in range(n // 3)]
    return [(i, None if i % 50 == 7 else 1 if i % 3 else i % 11, None if i % 41 == 3 else i % 4, vectors[i % len(vectors)]) for i in range(n)]


def best(all_rows, query, k, agreement=None, version=None):
    fit = [(-round(cosine(query, e), 12), i) for i, c, v, e in all_rows if (agreement is None or c == agreement) and (version is None or v == version)]
    return [(i, round(-s, 9)) for s, i in sorted(fit)[:k]]


def found(df):
    return [(r.vec_id, round(r.score, 9)) for r in df.collect()]


def test_filters_ties_and_appends(spark, tmp_path):
    path, all_rows = str(tmp_path / "i"), rows()
    X.write_index(spark.createDataFrame(all_rows[:200], SHAPE), path, 8)
    X.write_index(spark.createDataFrame(all_rows[200:], SHAPE), path, 3)
    index = X.open_index(spark, path)
    assert index.count() == 300
    query = all_rows[10][3]
    for own in [{}, {"convenio_id": 1}, {"convenio_id": 9, "version_id": 2}, {"version_id": 0}, {"convenio_id": 99}]:
        assert found(X.search_index(index, query, 7, **own)) == best(all_rows, query, 7, own.get("convenio_id"), own.get("version_id"))
    assert found(X.search_index(index, [0.0] * 5)) == found(X.search_index(index, [])) == found(X.search_index(index, [1.0, 2.0])) == found(X.search_index(index, query, 0)) == []


def test_an_agreement_reads_its_folder_only(spark, tmp_path):
    path = str(tmp_path / "i")
    X.write_index(spark.createDataFrame(rows(), SHAPE), path, 8)
    index = X.open_index(spark, path)
    near = X.search_index(index, [1.0] * 5, 3, 1, 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "pmod(" in plan and "EqualTo(convenio_id,1)" in plan and "EqualTo(version_id,2)" in plan
    assert len({r.bucket for r in index.where("convenio_id = 1").select("bucket").distinct().collect()}) == 1 < index.select("bucket").distinct().count()
    near.collect()
    scan = near._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numPartitions").get().value() == 1


def test_many_queries(spark, tmp_path):
    path, all_rows = str(tmp_path / "i"), rows()
    X.write_index(spark.createDataFrame(all_rows, SHAPE), path)
    asked = [(i, c, v if i % 20 else None, e) for i, c, v, e in all_rows if i % 10 == 0] + [(1000, 1, 1, None), (1001, 1, 1, [0.0] * 5), (1002, 77, None, [1.0] * 5), (1003, 1, None, [1.0])]
    got = {}
    for r in sorted(X.search_each(X.open_index(spark, path), spark.createDataFrame(asked, SHAPE.replace("vec_id", "query_id")), 4).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    want = {q: best(all_rows, e, 4, c, v) for q, c, v, e in asked[:-4] if c is not None}
    assert got == {q: b for q, b in want.items() if b}


def test_vectors_without_direction_are_not_indexed(spark, tmp_path):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    path = str(tmp_path / "i")
    X.write_index(spark.createDataFrame([(i, 1, 1, e) for i, e in enumerate([*bad, [3.0, 4.0], [1.0]])], SHAPE), path)
    index = X.open_index(spark, path)
    assert sorted((r.vec_id, r.norm) for r in index.collect()) == [(6, 5.0), (7, 1.0)]
    assert found(X.search_index(index, [3.0, 4.0])) == [(6, 1.0)]
    X.write_index(spark.createDataFrame([], SHAPE), path)
    assert index.count() == 2
