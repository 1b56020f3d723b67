import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from pactlens.llm import filter_audit as A


def fails_of(rows):
    """The set of filters that each row (id, text, part) fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        own |= {"D"} if re.search("[#$%&*|]", t) else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        out.append(own)
    return out


def by_running_every_order(rows, labels):
    """The audit by applying the filters to the rows, order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, fails = {}, fails_of(rows)
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                removed, earlier = [x for x in left if f in x[1]], [x for x in gone if f in x[1]]
                left, gone = [x for x in left if f not in x[1]], gone + removed
                total[f] += len(removed)
                only = sum(x[1] == {f} for x in own)
                out[part, "".join(order), step] = [len(left), len(removed), len(earlier), only, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
        for (p, order, step), told in out.items():
            if p == part:
                told.append(total[order[step - 1]])
    return out


def test_against_running_every_order(spark):
    rng = np.random.default_rng(12)
    long = " ".join(f"w{i}" for i in range(250))
    pool = [None, "", "short", "SHORT", "a b\xa0c d\x0be", long, long + " 5%", long.upper(), "same " * 300, "Same\x1c " * 300, long + " | X", "$", "é" * 100 + "AB C", " \t\n"]
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 90)), pool[rng.integers(len(pool))], [None, "", "en", "es"][rng.integers(4)]) for _ in range(150)]
    rows += [(500 + i, long, "hot") for i in range(60)] + [(7, "short", "en")] * 5 + [(None, long, "hot")] * 3
    labels = [(int(i), [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for i in rng.integers(0, 560, 200)] + [(None, 1, 1), (7, 1, 0), (7, 0, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, fails string")
    out = A.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out.collect()}
    want = by_running_every_order(rows, labels)
    assert len(got) == out.count() == 4 * 600
    assert got == want


def test_filters_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "a", 3), (2, "a", 3), (3, None, None), (4, "bb", 3)], "k long, body string, src int")
    labels = spark.createDataFrame([(2, 1, 0)], "k long, quality int, toxic int")
    out = A.audit(docs, labels, "k", "body", "src", lambda t: {"L": F.length(t) < 2}, "U")
    got = sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.good_lost, r.shapley) for r in out.collect())
    assert got == [("", "LU", 1, 0, 1, 0, 0, 2), ("", "LU", 2, 0, 0, 0, 0, 0), ("", "UL", 1, 1, 0, 0, 0, 0), ("", "UL", 2, 0, 1, 0, 0, 2),
                   ("3", "LU", 1, 1, 2, 0, 1, 3), ("3", "LU", 2, 1, 0, 1, 0, 1), ("3", "UL", 1, 2, 1, 0, 1, 1), ("3", "UL", 2, 1, 1, 1, 0, 3)]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
    assert A.audit(spark.createDataFrame([(1, "x", "en")], docs.schema), labels).count() == 600


def test_the_lattice():
    class Session:
        def createDataFrame(self, rows, schema):
            return rows

    assert len(A.lattice_edges(Session(), "ABCDE")) == 80 and len(A.lattice_paths(Session(), "ABCDE")) == 600
