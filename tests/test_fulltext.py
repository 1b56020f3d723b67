import math
import re
import unicodedata
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from pactlens.operators import fulltext as W


def plain_lexemes(text):
    """(place, lexeme) word by word."""
    def bare(w):
        return "".join("ñ" if c == "ñ" else unicodedata.normalize("NFD", c)[0] for c in w)

    def stem(w):
        if len(w) < 5:
            return w
        for end, keep in (("eses", "es"), ("ces", "z"), ("os", ""), ("as", ""), ("es", ""), ("o", ""), ("a", ""), ("e", "")):
            if w.endswith(end):
                return w[: len(w) - len(end)] + keep
        return w

    found = [bare(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]
    return [(i, stem(w)) for i, w in enumerate(found, 1) if w not in W.STOP]


def plain_rank(text, question):
    own, asked = plain_lexemes(text), sorted({x for _, x in plain_lexemes(question)})
    places = {x: [i for i, y in own if x == y] for x in asked}
    if not asked or not all(places.values()):
        return None
    if len(asked) == 1:
        return sum(0.1 / n**2 for n in range(1, len(places[asked[0]]) + 1)) / 1.64493406685
    left = 1.0
    for x, y in combinations(asked, 2):
        for i in places[x]:
            for j in places[y]:
                if abs(i - j) <= 100:
                    left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(i - j) / 1.5 - 2)))
    return 1 - left


TEXTS = [
    "El convenio marco de cooperación con la universidad.", "Convenios de COOPERACIÓN; la cooperación interinstitucional y los convenios marcos", "cooperacion", None, "", "de la y el", "luces y luz: las luces del año, año nuevo 2024",
    "intereses, interés e interesa", "universidad " + "palabra " * 150 + "cooperación", "universidad " + "x " * 99 + "cooperación", "a-b c_d 5% precio: 100 precios", "precio " * 40,
]
QUESTIONS = ["cooperación universidad", "convenio de cooperación", "¿la cooperación?", "luz", "año 2024", "de la", "", None, "interés", "precios", "precio 100 c", "inexistente precio", "universidades cooperacion marco"]


def test_rank_against_every_row_word_by_word(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = ["convenio", "cooperación", "marco", "precio", "de", "luz", "año"]
    texts = TEXTS + [" ".join(rng.choice(vocabulary, rng.integers(1, 260))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, lexeme string")
    W.write_index(rows, str(tmp_path / "ix"), ["id"])
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string")
    for limits in ({}, {"few": 0, "small": 0}):
        got = {}
        for r in W.search(spark, str(tmp_path / "ix"), asked, 5, **limits).collect():
            got.setdefault(r.query_id, {})[r.place] = (r.id, r.rank)
        for q, question in enumerate(QUESTIONS):
            ranks = sorted(((-round(x, 9), i) for i, t in enumerate(texts) if (x := plain_rank(t, question)) is not None))[:5]
            own = [got.get(q, {})[k] for k in sorted(got.get(q, {}))]
            assert [i for i, _ in own] == [i for _, i in ranks], question
            assert np.allclose([x for _, x in own], [-x for x, _ in ranks], atol=1e-9)


def test_rows_that_come_later_repeat_or_share_keys(spark, tmp_path):
    path = str(tmp_path / "ix")
    rows = lambda *r: spark.createDataFrame(list(r), "agreement long, version int, text string")
    first = rows((1, 1, "precio único"), (1, 1, "precio único"), (1, 2, "precio fijo y precio único"), (None, 1, "precio sin convenio"))
    later = rows((2, 1, "precio variable"), (1, 1, "otro precio único"))
    W.write_index(first, path, ["agreement", "version"])
    W.write_index(later, path, ["agreement", "version"])
    every = first.unionByName(later)
    got = lambda *a, **k: [(r.place, r.agreement, r.version, r.text) for r in W.content_search(every, path, *a, **k).orderBy("place").collect()]
    assert got("precio", {"agreement": 2}) == [(1, 2, 1, "precio variable")]
    assert [x[1:3] for x in got("precio")] == [(1, 2), (None, 1), (1, 1), (1, 1), (2, 1)]
    assert {x[3] for x in got("únicos", {"agreement": 1, "version": 1})} == {"precio único", "otro precio único"}
    assert got("precio", k=1) == [(1, 1, 2, "precio fijo y precio único")]
    empty = str(tmp_path / "none")
    W.write_index(first.limit(0), empty, ["agreement", "version"])
    assert W.content_search(first, empty, "precio").count() == 0


def test_lexemes_reach_the_scan_and_parts_are_merged(spark, tmp_path):
    path = str(tmp_path / "ix")
    rows = spark.range(200).select(F.col("id"), F.concat(F.lit("precio convenio "), F.col("id")).alias("text"))
    W.write_index(rows, path, ["id"])
    asked = spark.createDataFrame([(0, "precio 17")], "query_id int, question string")
    found = W.search(spark, path, asked)
    assert [r.id for r in found.collect()] == [17]
    plan = found._jdf.queryExecution().toString()
    assert "In(lexeme, [" in plan and "Cartesian" not in plan and "Python" not in plan
    assert sorted((r.id, r.places) for r in W.read_postings(spark, path, ["17"]).collect()) == [(17, [3])]
    assert W.read_postings(spark, path).count() == 600
    merged = str(tmp_path / "merged")
    W.merge_index(spark, path, merged, 3)
    assert sorted(W.read_postings(spark, merged).collect()) == sorted(W.read_postings(spark, path).collect())
    assert sorted(map(tuple, W.search(spark, merged, asked).collect())) == sorted(map(tuple, found.collect()))
    spans = spark.read.parquet(f"{merged}/postings").groupBy(F.input_file_name().alias("f")).agg(F.min("lexeme").alias("low"), F.max("lexeme").alias("high")).orderBy("low").collect()
    assert len(spans) >= 2 and all(a.high <= b.low for a, b in zip(spans, spans[1:], strict=False))


def test_versions_are_numbered_once_for_a_search(spark):
    from pactlens.plans.registry import QUERIES

    found = QUERIES["content_search"](spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0


def test_what_is_read_of_a_lexeme_that_all_rows_have_does_not_grow_with_them(spark, tmp_path):
    import pyarrow.parquet as pq

    path, n = str(tmp_path / "ix"), 300_000
    rows = spark.range(0, n, 1, 1).select("id", F.concat(F.lit("precio convenio "), F.col("id"), F.when(F.col("id") == 7, F.repeat(F.lit(" luz"), 40_000)).otherwise(F.lit(" luz luz"))).alias("text"))
    W.write_index(rows, path, ["id"])
    merged = str(tmp_path / "merged")
    W.merge_index(spark, path, merged, 2)
    for at in (path, merged):
        groups = [g for f in (tmp_path / at).glob("postings/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
        assert max(g.total_byte_size for g in groups) < 2 * W.GROUP_BYTES
        blocks = spark.read.parquet(f"{at}/postings")
        assert blocks.where((F.size("row") > W.BLOCK_ROWS) | (F.element_at("starts", -1) >= W.BLOCK_PLACES)).count() == 0
        sums = {r.lexeme: (r.rows, r.places, r.ids) for r in W.read_postings(spark, at, ["preci", "luz"]).groupBy("lexeme").agg(F.countDistinct("id").alias("rows"), F.sum(F.size("places")).alias("places"), F.sum("id").alias("ids")).collect()}
        assert sums == {"preci": (n, n, n * (n - 1) // 2), "luz": (n, 2 * (n - 1) + 40_000, n * (n - 1) // 2)}
    assert [r.places for r in W.read_postings(spark, path, ["luz"]).where("id = 7").collect()] == [list(range(4, 40_004))]
