import pytest
from pyspark.sql import functions as F

from pactlens import views as V
from pactlens.operators import risk as K

MATCH = "doc_id long, token string, severity string, source string, reason string, start int, end int"


def service(spark, severities):
    m = spark.createDataFrame([(1, "t", s, "keyword", "", i, i + 1) for i, s in enumerate(severities)], MATCH)
    r = K.score_service(m).first()
    return r.score, r.risk_level


@pytest.mark.parametrize(("severities", "want"), [(["HIGH"], (0.3215, "BAJO")), (["MEDIUM"] * 2, (0.3799, "MEDIO")), (["HIGH", "LOW"], (0.4219, "MEDIO")), (["HIGH"] * 2, (0.5828, "MEDIO")), (["HIGH"] * 3, (0.7616, "ALTO"))])
def test_service_scores(spark, severities, want):
    assert service(spark, severities) == want


def test_final_scores_on_their_boundaries(spark):
    def final(rules, semantic):
        rows = [(1, f"t{i}", s, "keyword", "", i, i + 1) for i, s in enumerate(rules)] + [(1, f"s{i}", s, "semantic", "", 99 + i, 100 + i) for i, s in enumerate(semantic)]
        r = K.score_final(spark.createDataFrame(rows, MATCH)).first()
        return r.score, r.risk_level

    assert final(["HIGH"] * 3, ["HIGH"]) == (0.45, "MEDIO")
    assert final(["HIGH"] * 5 + ["MEDIUM"], []) == (0.8, "MEDIO")  # 0.7999999999999999
    assert final(["HIGH"] * 9, []) == (1.0, "ALTO")


def test_keywords_agree_with_a_plain_search(spark):
    texts = ["aaaa b aaa", "Thing thing\nTHING", "", None, "password ### the of the of", "(a.b) a.b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = V.lexicon(spark).unionByName(spark.createDataFrame([(99, "a.b", "HIGH", "meta", True)], "id long, texto string, severity string, reason string, activo boolean"))
    got = {(r.doc_id, r.token, r.start, r.end) for r in K.keyword_matches(docs, lexicon).collect()}
    want = set()
    for token in {r.texto.strip() for r in lexicon.collect() if r.activo and r.texto.strip()}:
        for i, t in enumerate(texts):
            at = (t or "").lower().find(token.lower())
            while at >= 0:
                want.add((i, token, at, at + len(token)))
                at = t.lower().find(token.lower(), at + len(token))
    assert got == want


def test_lines_pages_and_places(spark):
    text = "uno\nPágina 2\ndos thing\n\npage 7 x\ntres thing"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    lines = K.line_index(docs)
    assert [(r.line, r.page) for r in lines.where("doc_id = 1").orderBy("line").collect()] == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 7), (6, 7)]
    for r in lines.where("doc_id = 1").collect():
        assert text[r.start : r.end] == r.text
    got = sorted((r.start, r.page, r.line) for r in K.locate(K.keyword_matches(docs, V.lexicon(spark)), lines).collect() if r.token == "thing")
    assert got == [(text.find("thing"), 2, 3), (text.rfind("thing"), 7, 6)]


def test_overlaps_merge_once_and_stay(spark):
    rows = [(1, "a", "HIGH", "keyword", "", 0, 10), (1, "a", "HIGH", "keyword", "", 0, 6), (1, "a", "HIGH", "keyword", "", 5, 10), (1, "a", "LOW", "keyword", "", 0, 10), (1, "a", "HIGH", "pattern", "", 0, 10), (1, "b", "HIGH", "keyword", "", None, None)]
    once = K.dedupe_overlaps(spark.createDataFrame(rows, MATCH))
    key = lambda df: sorted((r.token, r.severity, r.source, str(r.start), str(r.end)) for r in df.collect())
    assert len(key(once)) == 5  # the 60 % overlap merges, the 50 % does not
    assert key(K.dedupe_overlaps(once)) == key(once)


def test_semantic_filters(spark):
    text = "Se otorga trato preferencial al socio. Lorem ipsum. " + "x" * 100 + " El contrato no confiere precio preferencial."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [(1, "trato preferencial al socio", "HIGH", "semantic", "", 0, 1), (1, "precio preferencial.", "HIGH", "semantic", "", 0, 1), (1, "Lorem ipsum", "HIGH", "semantic", "", 0, 1), (1, "Lorem", "LOW", "keyword", "", 0, 1)]
    assert {r.token for r in K.filter_semantic(spark.createDataFrame(rows, MATCH), docs).collect()} == {"trato preferencial al socio", "Lorem"}


def test_highlights_are_disjoint_and_take_the_stronger(spark):
    rows = [(1, "a", "LOW", "keyword", "", 0, 10), (1, "b", "HIGH", "keyword", "", 4, 6), (1, "c", "HIGH", "semantic", "", 0, 20)]
    got = sorted((r.start, r.end, r.source, r.severity) for r in K.highlight_spans(spark.createDataFrame(rows, MATCH)).collect())
    assert got == [(0, 4, "keyword", "LOW"), (4, 6, "keyword", "HIGH"), (6, 10, "keyword", "LOW"), (10, 20, "semantic", "HIGH")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    located, told = K.analyze(docs, V.lexicon(spark))
    assert located.count() == 0 and told.count() == 0
    assert K.keyword_matches(docs, V.lexicon(spark).limit(0)).count() == 0


def test_analyze_keeps_documents_without_matches(spark):
    docs = spark.createDataFrame([(1, "nada"), (2, None), (3, "password password password")], "doc_id long, text string")
    got = {r.doc_id: (r.total, r.risk_level) for r in K.analyze(docs, V.lexicon(spark))[1].select("doc_id", F.col("total"), "risk_level").collect()}
    assert got == {1: (0, "BAJO"), 2: (0, "BAJO"), 3: (3, "BAJO")}


def test_the_classifier_reaches_the_analysis(spark):
    from pactlens.plans import registry

    held = "El proveedor otorgará precios preferenciales y tarifas exclusivas para la entidad."
    texts = [(1, f"Hola. {held} password"), (2, "Hola. Nada más. password"), (3, None), (4, "El convenio no implica precios exclusivos para esta entidad.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    located, told = registry._analyzed(spark, docs)
    semantic = {(r.doc_id, r.token, r.severity, r.start, r.end) for r in located.where("source = 'semantic'").collect()}
    assert semantic == {(1, held, "HIGH", 6, 6 + len(held))}
    with_it = {r.doc_id: (r.score, r.total) for r in told.collect()}
    without = {r.doc_id: (r.score, r.total) for r in K.analyze(docs, V.lexicon(spark))[1].collect()}
    assert {d: with_it[d] for d in (2, 3, 4)} == {d: without[d] for d in (2, 3, 4)}
    assert with_it[1][0] == pytest.approx(without[1][0] + 0.15 / 7, abs=1e-6) and with_it[1][1] == without[1][1] + 1


def test_registered_analyses_hold_semantic_matches(spark, tmp_path):
    from pactlens.plans.registry import QUERIES

    held = "Se pacta precio preferencial durante la vigencia del convenio."
    spark.createDataFrame([(5, held), (6, "password")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: QUERIES[n](spark, str(tmp_path)).toPandas() for n in ("risk_analysis", "token_style", "highlight_spans", "classifier_matches")}
    assert got["risk_analysis"].set_index("doc_id").total.to_dict() == {5: 2, 6: 1}
    assert got["token_style"].semantic.any() and (got["highlight_spans"].source == "semantic").any()
    assert {(r.doc_id, r.severity) for r in got["classifier_matches"].itertuples() if r.start == 0} >= {(5, "HIGH")}


def test_matches_are_found_once_to_be_merged(spark):
    docs = spark.createDataFrame([(1, "aaaa thing"), (2, None)], "doc_id long, text string")
    plan = K.dedupe_overlaps(K.keyword_matches(docs, V.lexicon(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_keyword") + plan.count("found(") <= 1 and "Union" not in plan
    rows = [(1, "Á  b", "high", "Keyword", "r", 0, 10), (1, "a b", "HIGH", "keyword", None, 1, 12), (1, "a b", "HIGH", "keyword", "q", 40, 50), (1, " ", "HIGH", "keyword", "", 0, 10), (1, "a b", None, "keyword", "", 5, 5), (None, "a", None, None, None, 0, 3), (None, "a", None, None, None, 0, 3)]
    got = {tuple(r) for r in K.dedupe_overlaps(spark.createDataFrame(rows, MATCH)).select("doc_id", "token", "severity", "source", "reason", "start", "end").collect()}
    assert got == {(1, "a b", "HIGH", "Keyword", "q", 1, 12), (1, "a b", "HIGH", "Keyword", "q", 40, 50), (1, " ", "HIGH", "keyword", "", 0, 10), (1, "a b", None, "keyword", "", 5, 5), (None, "a", None, None, None, 0, 3)}


def test_sentences_are_scored_in_one_pass_as_by_the_pipeline(spark):
    from pyspark.ml.functions import vector_to_array

    from pactlens.functions import text as T
    from pactlens.operators import learning as ML
    from pactlens.plans import registry

    texts = ["Se fija un precio muy preferencial. Año ²3: größe ẞ ÀÇ-é? ¡Sí!  \tpage 4\u00a0x… Se fija un precio muy preferencial.", " . ", None, "", "12 34. El PRESUPUESTO se aprueba\n\nsin más.", "Página 9\nİstanbul _a_ ΣΑΣ. El convenio no implica precios exclusivos. " + "exclusividad total y " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = registry._severities(spark)
    scored = K.sentence_scores(docs, model)
    assert "Join" not in K.classifier_matches(scored)._jdf.queryExecution().toString()
    said = docs.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("text"))
    p = model.transform(ML.prepared(said)).select("doc_id", "text", "prediction", vector_to_array("probability").alias("p")).collect()
    want = sorted((r.doc_id, r.text, model.stages[0].labels[int(r.prediction)], round(r.p[int(r.prediction)], 9)) for r in p)
    got = scored.collect()
    assert sorted((r.doc_id, r.sentence, r.severity, round(r.p, 9)) for r in got) == want and len(want) == 11
    assert all(texts[r.doc_id].find(r.sentence) == r.start for r in got)
    assert {r.page for r in got if r.doc_id == 5} == {9} and {(r.page, r.line) for r in got if r.doc_id == 0} == {(4, 1)}
    founded = {(r.doc_id, r.sentence) for r in K.sentence_scores(docs, model, founded=True).collect()}
    shown = scored.withColumn("token", K._shown(F.col("sentence"))).join(docs, "doc_id").where(K.has_risk_stem(F.col("token")) & ~K.negated(F.col("text"), F.col("token")))
    assert founded == {(r.doc_id, r.sentence) for r in shown.collect()} and len(founded) > 0


def test_everything_is_computed_on_the_canonical_text(spark):
    texts = [(1, "a\r\nb password"), (2, "ｐａｓｓｗｏｒｄ ok"), (3, "Página ２\r\nthing"), (4, None), (5, "ﬁn thing")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    located, told = K.analyze(docs, V.lexicon(spark))
    got = {(r.doc_id, r.token, r.start, r.page, r.line) for r in located.collect() if r.token in ("password", "thing")}
    assert got == {(1, "password", 4, 1, 2), (2, "password", 0, 1, 1), (3, "thing", 9, 2, 2), (5, "thing", 4, 1, 1)}
    assert told.count() == 5
    assert [r.text for r in K.canonical(K.canonical(docs)).orderBy("doc_id").collect()] == ["a\nb password", "password ok", "Página 2\nthing", None, "fin thing"]


def test_lexicons_and_archetypes_of_any_size_are_matched_in_parts(spark):
    docs = spark.createDataFrame([(1, "aaaa b aaa Thing"), (2, "the of aa")], "doc_id long, text string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(K.keyword_matches(docs, V.lexicon(spark), most_terms=2)) == key(K.keyword_matches(docs, V.lexicon(spark)))
    v = spark.createDataFrame([(i, [float(i % 3 + 1), float(i % 5), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert key(K.archetype_matches(v, v.where("vec_id < 7"), most=2)) == key(K.archetype_matches(v, v.where("vec_id < 7")))


def test_places_agree_with_the_lines(spark):
    texts = [(i, t) for i, t in enumerate(["thing\nPágina 3\n\nthing thing\npage 12 thing\nthing", "\n\nthing", "PÁGINA 7 thing\nPágina 99999999999 thing"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = K.keyword_matches(docs, V.lexicon(spark))
    swept = {(r.doc_id, r.token, r.start): (r.page, r.line) for r in K.locate(found, K.line_index(docs)).collect()}
    assert {(r.doc_id, r.token, r.start): (r.page, r.line) for r in found.collect()} == swept and len(swept) > 10


def test_matches_cut_to_lines_and_snippets(spark):
    docs = spark.createDataFrame([(1, "uno dos\ntres cuatro\ncinco")], "doc_id long, text string")
    m = spark.createDataFrame([(1, "dos tres", "HIGH", "semantic", "", 4, 12, 1, 1), (1, "cuatro", "LOW", "keyword", "", 13, 19, 1, 2), (1, "cinco", "HIGH", "keyword", "", None, None, 1, 3)], MATCH + ", page int, line int")
    got = sorted((r.line, r.start, r.end, r.token) for r in K.line_matches(m, K.line_index(docs), width=5).collect())
    assert got == [(1, 4, 7, "dos tres"), (2, 0, 4, "dos tres"), (2, 5, 11, "cuatro")]
    snips = K.snippets(m, docs)
    assert {(r.canonical, r.fragment) for r in snips.collect()} == {("dos tres", "uno dos\ntres cuatro"), ("cuatro", "tres cuatro"), ("cinco", "cinco")}
    inside = {(r.start, r.end, r.token) for r in K.snippet_matches(snips, m).collect()}
    assert inside == {(4, 12, "dos tres"), (5, 11, "cuatro"), (None, None, "cinco")}
    summed = K.summary(m, "tfidf").first()
    assert (summed.model, summed.semantic_used, summed.total) == ("tfidf", True, 3)


def test_python_functions_take_a_batch_in_slices(spark):
    """Of a batch of 2,000 rows of 2,000 characters no call of a function gets much more than a slice."""
    from pactlens.functions.slices import SLICE, over_slices

    rows = spark.range(2000).coalesce(1).select("id", F.repeat(F.lit("ñ"), 1000).alias("t")).withColumn("t", F.when(F.col("id") % 100 > 0, F.col("t")))
    got = over_slices(lambda texts: [sum(2 * len(t or "") for t in texts)] * len(texts), "long")("t")
    of_two = over_slices(lambda texts, ids: [i + len(t or "") for t, i in zip(texts, ids, strict=True)], "long")("t", "id")
    told = rows.select("id", got.alias("n"), of_two.alias("m")).collect()
    assert max(r.n for r in told) <= SLICE and min(r.n for r in told) > 0
    assert [r.m for r in sorted(told)] == [i + (1000 if i % 100 else 0) for i in range(2000)]


def test_fixed_rows_take_no_python_worker(spark):
    """The lexicon and the labelled sentences are tables of their own plan, not made from a list by workers that stay beside the query's."""
    for made in (V.lexicon(spark), V.seed(spark)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" in plan and "RDD" not in plan
    assert [tuple(r) for r in V.lexicon(spark).collect()] == V.LEXICON
    assert [f.simpleString() for f in V.lexicon(spark).schema] == ["id:bigint", "texto:string", "severity:string", "reason:string", "activo:boolean"]


def test_density_takes_neither_merged_matches_nor_texts(spark, tmp_path):
    """It is the same from merged matches; the registered query merges none, exchanges no text and normalises texts once, for the table that it reads."""
    from pactlens.plans.registry import QUERIES

    docs = spark.createDataFrame([(1, "x" * 50), (2, "y"), (3, None), (4, "z" * 9)], "doc_id long, text string")
    rows = [(1, "Á  b", "high", "Keyword", "r", 0, 10), (1, "a b", "HIGH", "keyword", None, 1, 12), (1, "thing", "LOW", "keyword", "", 0, 5), (1, "Things", "LOW", "keyword", "", 0, 6), (2, "menor", "LOW", "keyword", "", 0, 5), (3, "aa", "LOW", "keyword", "", 0, 2)]
    found = spark.createDataFrame(rows, MATCH)
    density = lambda m: sorted(map(tuple, K.match_density(m, docs).collect()))
    assert K.dedupe_overlaps(found).count() < len(rows)
    assert density(found) == density(K.dedupe_overlaps(found)) == [(1, 0.16), (2, 1.0), (3, 1.0)]

    texts = [(5, "Se pacta precio preferencial durante la vigencia. ｐａｓｓｗｏｒｄ"), (6, "password"), (7, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["match_density"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3 and "collect_list" not in plan  # keywords, patterns, sentences
    assert "length(text" not in plan.split("Join")[0]  # what stands above the join
    located, _ = K.analyze(docs := K.canonical(spark.createDataFrame(texts, "doc_id long, text string")), V.lexicon(spark))
    told = {r.doc_id: r.density for r in got.collect()}
    assert told[6] == 1.0 and told.keys() == {5, 6} and told[5] >= {r.doc_id: r.density for r in K.match_density(located, docs).collect()}[5] > 0


def test_the_service_scores_terms_patterns_and_sentences_of_every_text(spark, tmp_path):
    import duckdb

    from pactlens.operators import learning as ML
    from pactlens.plans.registry import _LEARNED, _severities, ORACLES, QUERIES

    texts = ["Se exige exclusividad territorial.", "orden, en suma mínima", "Thing thing.\nSe fija un precio muy preferencial. Straße y ñandú!", "", None, "12 34", "El precio preferencial rige.  El precio preferencial rige. ¿Hay límite?"]
    spark.createDataFrame([*enumerate(texts), (7, texts[0]), (7, texts[2])], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["score_service"](spark, str(tmp_path)).select("doc_id", "score", "risk_level").collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.execute(ORACLES["score_service"]).fetchall())
    assert got[0] == (0, 0.3215, "BAJO") and got[3:5] == [(3, 0.0, "BAJO"), (4, 0.0, "BAJO")]  # a sentence alone, and nothing
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = K.service_matches(K.canonical(docs), V.lexicon(spark), _severities(spark)).collect()
    assert {(r.doc_id, r.source) for r in found} >= {(0, "semantic"), (1, "pattern"), (2, "keyword"), (2, "pattern"), (6, "pattern"), (6, "semantic")}
    assert sum(r.doc_id == 6 and r.source == "pattern" for r in found) == 2
    learned = ML.weights(_severities(spark))
    assert [tuple(r[:2]) for r in _LEARNED] == [r[:2] for r in learned]
    assert all(abs(a - b) < 1e-7 for x, y in zip(_LEARNED, learned, strict=True) for a, b in zip(x[2:], y[2:], strict=True))


def test_sentences_are_scored_as_by_the_pipeline(spark):
    import random

    from pyspark.ml.functions import vector_to_array

    from pactlens.operators import learning as ML
    from pactlens.plans.registry import _severities

    model, draw = _severities(spark), random.Random(4)
    words = ["precio", "Preferencial", "de", "la", "EXCLUSIVIDAD", "cantidad", "mínima", "ß", "ẞ", "İ", "Straße", "año", "x", "y²z", "١٢", "ÿ", "Ÿ", "\n", "-", "_", "…", "descuento"]
    texts = ["", "ß", "a", "precio " * 300] + [draw.choice(["", " ", "  ", "-"]).join(draw.choice(words) for _ in range(draw.randrange(12))) for _ in range(1200)]
    told = model.transform(ML.prepared(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()
    best, p = ML.scorer(model)(texts)
    assert [int(r.prediction) for r in told] == best.tolist()
    assert max(abs(max(r.p) - x) for r, x in zip(told, p.tolist(), strict=True)) < 1e-9
