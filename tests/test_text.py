import random

import pytest
from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.operators import diff as D
from pactlens.operators import learning as ML
from pactlens.operators import lexicon as L
from pactlens.operators import resolve as R
from pactlens.sources import io as S
from pactlens import views as V


def apply(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_scalars(spark):
    assert apply(spark, T.fold, "ÁÉñÜ", None) == ["aenu", None]
    assert apply(spark, T.letters_only, "Año 2025: Éxito") == ["añoexito"]
    assert apply(spark, T.ascii_fold, "Größe çà") == ["Grosse ca"]
    assert apply(spark, T.nfkc, "ﬁn\r\n", None) == ["fin\n", None]
    assert apply(spark, T.strip_marks, "áñ") == ["an"]
    assert apply(spark, T.ocr_cleanup, " a&#12;b &amp; 1234567 c\x01 ") == ["a b c"]
    assert apply(spark, T.clean_hard, "a\tb\n\n\n\nc  d") == ["a b\n\nc d"]
    assert apply(spark, T.canonical_token, "Límites  Presupuestarios bases") == ["limit presupuestario bas"]
    assert apply(spark, T.significant_tokens, "El convenio con la Agencia de TIC") == [["agencia", "tic"]]
    assert apply(spark, T.sanitize_name, "  «x» 'Caja  Nacional'., ") == ["«x» 'Caja Nacional"]
    assert apply(spark, lambda c: T.compact(c, 5), "abcdefgh", "", None, "abc") == ["abcde...", "—", "—", "abc"]
    assert apply(spark, T.sentences, "Uno. Dos! ¿Tres? cuatro") == [["Uno.", "Dos!", "¿Tres?", "cuatro"]]
    assert apply(spark, T.clean_extracted, "ok &amp; bien\n---\n123456789 a\n", "...\n!!") == ["ok & bien", None]
    assert apply(spark, T.gibberish_line, "hola a todos los que leen", "@@##!!$$", "a1234567 b") == [False, True, True]
    assert apply(spark, T.viewer_cleanup, "a  \n12345 x\nb") == ["a\nb"]
    assert apply(spark, lambda c: T.answer_layout(c), "x" * 230 + ". y", "corto. y")[1] == "corto. y"
    assert apply(spark, lambda c: c.rlike(T.tolerant_pattern("límite de pago")), "El LIMITE  de pago", "limite pago") == [True, False]


def test_lines_and_sentences_lose_blanks_and_not_digits(spark):
    """A bare ``F.trim`` takes a line's place for the characters to trim."""
    assert apply(spark, T.clean_extracted, "tel. 70\n a1 \nx 2\ny 3") == ["tel. 70\na1\nx 2\ny 3"]
    assert apply(spark, T.pre_diff, "cláusula 50\n1 a de b 1") == ["cláusula 50\n1 a de b 1"]
    assert apply(spark, T.sentences, " 0 uno. 1 dos 1 ") == [["0 uno.", "1 dos 1"]]


def test_character_grams_are_counted_as_a_vectorizer_counts_them(spark):
    from pyspark.ml.feature import CountVectorizer

    assert sorted(apply(spark, ML.char_grams, "Ñu, abc")[0]) == sorted([" nu", "nu ", " nu ", " ab", "abc", "bc ", " abc", "abc ", " abc "])
    rows = spark.createDataFrame([("la clave y la casa",), ("una casa clara",), ("clave",), ("solo aquí",)], "text string")
    want = CountVectorizer(inputCol="chars", outputCol="n", minDF=2).fit(rows.select(ML.char_grams(F.col("text")).alias("chars"))).vocabulary
    assert sorted(ML._char_vocabulary(rows, 1000)) == sorted(want)


def test_snippets_stop_at_line_ends(spark):
    t = "línea uno\nla palabra clave aquí\nlínea tres"
    at = t.find("palabra")
    assert apply(spark, lambda c: T.snippet(c, F.lit(at), F.lit(at + 7)), t) == ["la palabra clave aquí"]


def test_similarities(spark):
    pairs = spark.createDataFrame([("World", "Word"), ("", ""), ("abc", "xyz"), (None, "a")], "a string, b string")
    got = [r.s for r in pairs.select(T.similar_text("a", "b").alias("s")).collect()]
    assert got[0] == pytest.approx(88.8889, abs=1e-3) and got[1:3] == [0.0, 0.0] and got[3] is None
    tri = [r.s for r in pairs.select(T.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert tri[0] == pytest.approx(3 / 8) and tri[1] == 0.0


def test_similar_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(3)
    names = {"cold gear", "old gear", "cold ring", "old ring", "a", "ab", "b", "ñandú", "nandu", "año"}
    while len(names) < 150:
        name = rnd.choice(sorted(names)) if rnd.random() < 0.6 else "".join(rnd.choice("abcñ ") for _ in range(rnd.randint(1, 14)))
        at = rnd.randint(0, len(name))
        names.add(name[:at] + rnd.choice(["", "x", "ab"]) + name[at + rnd.randint(0, 2) :])
    names.discard("")
    table = spark.createDataFrame([(n,) for n in sorted(names)] * 2 + [(None,), ("",)], "name string")
    n = table.where("name <> ''").distinct()
    every = n.selectExpr("name AS a").crossJoin(n.selectExpr("name AS b")).where("a < b").select("a", "b", T.similar_text("a", "b").alias("p")).collect()
    for least in (75.0, 90.0):
        want = sorted((r.a, r.b, r.p) for r in every if r.p >= least)
        assert sorted(map(tuple, R.similar_pairs(table, least).collect())) == want
        assert {("cold gear", "old gear"), ("cold ring", "old ring")} <= {x[:2] for x in want}


def test_similar_names_look_past_the_first_letters(spark):
    from pactlens.plans.registry import QUERIES

    n = V.read(spark, "/root/testdata/sf0.1", "part").select("p_name").distinct()
    every = n.selectExpr("p_name AS a").crossJoin(n.selectExpr("p_name AS b")).where("a < b").select("a", "b", T.similar_text("a", "b").alias("p")).where("p >= 75")
    got = {(r.a, r.b) for r in QUERIES["similar_names"](spark, "/root/testdata/sf0.1").collect()}
    assert got == {(r.a, r.b) for r in every.collect()} and ("cold gear", "old gear") in got


def test_common_runs_of_versions_are_found_at_once(monkeypatch):
    from pactlens.functions import common_runs as C

    rng = random.Random(8)
    words = ["the", *("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(400))]
    pairs = []
    for n in (200, 600, 1500):
        text = " ".join(rng.choices(words, k=n))
        pairs += [(text, text.replace("the", "teh")), (text, text[n:] + " " + text[:n]), (text, text[: 3 * n] + text[4 * n :])]
    pairs.append((("one line again and again\n" * 300)[7:], "one line again and again\n" * 290 + "x"))
    want = [C._halved(a.encode(), b.encode()) for a, b in pairs]

    class Never:
        def __init__(self, *_):
            raise AssertionError("numbered from scratch")

    assert C.common_bytes(pairs[-1][0].encode(), pairs[-1][1].encode()) == want[-1]  # too many runs to list
    monkeypatch.setattr(C, "_Numbered", Never)
    assert [C.common_bytes(a.encode(), b.encode()) for a, b in pairs[:-1]] == want[:-1]


def test_mentions_and_aliases(spark):
    assert apply(spark, R.mention_strict, 'detalle de "Caja Nacional"', "convenio con la UMSS, por favor", "hola") == ["Caja Nacional", "UMSS", None]
    assert apply(spark, R.mention, "datos de AGETIC hoy") == ["AGETIC"]
    assert "universidad mayor de san simon" in R.expand_aliases("UMSS")
    assert "sin" in R.expand_aliases("Servicio de Impuestos Nacionales")


def test_lexicon(spark):
    assert apply(spark, L.shape_reasons, "", "ab", "precio fijo", "xkcdqwrtz", "12345a") == [["texto vacio"], ["demasiado corto", "muy pocas letras"], [], ["palabra incoherente"], ["muy pocas letras", "demasiados simbolos o numeros"]]
    terms = spark.createDataFrame([(1, "presio bajo"), (2, "precio"), (3, "ABC descuentoz")], "id long, texto string")
    got = {r.id: (r.word, r.suggestion) for r in L.typo_suggest(terms, L.known_tokens(V.lexicon(spark).limit(0))).collect()}
    assert got == {1: ("presio", "precio"), 3: ("descuentoz", "descuento")}
    judged = {r.texto: r.reasons for r in L.validate_terms(spark.createDataFrame([("THING ", "HIGH"), ("orden", "X")], "texto string, severity string").withColumn("id", F.lit(1)), V.lexicon(spark)).collect()}
    assert "duplicado" in judged["THING "] and judged["orden"] == ["severidad desconocida"]


def test_diff_rebuilds_both_sides(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(20):
        a = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 12))]
        b = [x for x in a if rnd.random() > 0.3] + [rnd.choice("xyz") for _ in range(2)]
        rows.append((i, "\n".join(a), "\n".join(b)))
    got = D.line_diff(spark.createDataFrame(rows, "pair_id long, a string, b string"), normalize=False).orderBy("pair_id", "seq").collect()
    for i, a, b in rows:
        own = [r for r in got if r.pair_id == i]
        assert [r.text for r in own if r.op <= 0] == [x for x in a.split("\n") if x]
        assert [r.text for r in own if r.op >= 0] == [x for x in b.split("\n") if x]


def test_training_frames(spark, tmp_path):
    (tmp_path / "seed.csv").write_text(' Text ,SEVERITY\n"precio, preferencial",high\nsin nada,\nlimite,low\n')
    assert sorted((r.text, r.severity) for r in S.read_seed(spark, str(tmp_path / "seed.csv")).collect()) == [("limite", "LOW"), ("precio, preferencial", "HIGH")]
    assert S.read_rules(spark, str(tmp_path / "none.csv")).count() == 0
    rows = ML.training_set(S.read_seed(spark, str(tmp_path / "seed.csv")), S.lexicon_examples(V.lexicon(spark)))
    assert rows.where("severity = 'HIGH'").count() > 1
    split = ML.stratified_split(spark.range(100).selectExpr("concat('t', id) AS text", "IF(id % 2 = 0, 'HIGH', 'LOW') AS severity"))
    assert split.where("held_out").count() == 20
    report = {r["class"]: r.f1 for r in ML.report(spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)], "label double, prediction double")).collect()}
    assert report == {0.0: pytest.approx(2 / 3, abs=1e-6), 1.0: pytest.approx(2 / 3, abs=1e-6)}


def test_corpus_and_documents(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes("año ".encode() + b"\xff\xfe ok")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Uno</w:t></w:p><w:p><w:t>Dos</w:t></w:p>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    assert [(r.file, r.text) for r in S.read_corpus(spark, str(tmp_path)).collect()] == [("a.txt", "año  ok")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in S.extract_texts(files).collect()}
    assert got == {"c.docx": "Uno\nDos", "bad.docx": None}


def test_stream_updates_unread(spark, tmp_path):
    from pactlens.streaming.alerts import current, notify, windowed_levels

    rows = spark.createDataFrame([(1, "ALTO"), (1, "BAJO"), (2, "MEDIO")], "convenio_id long, risk_level string").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    notify(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.convenio_id, r.tipo) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "ALTO_RIESGO"), (2, "MEDIO_RIESGO")}
    more = rows.select(F.lit(2).cast("long").alias("convenio_id"), F.lit("MEDIO").alias("risk_level"), F.lit("2024-01-02 10:00:00").cast("timestamp").alias("ts")).distinct()
    more.write.mode("append").parquet(str(tmp_path / "in"))
    notify(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {p.name for p in (tmp_path / "out").glob("batch=*")} == {"batch=0", "batch=1"}  # the second wrote its own change alone
    assert spark.read.parquet(str(tmp_path / "out" / "batch=1")).count() == 1
    base = spark.createDataFrame([(2, "MEDIO_RIESGO", "old", None, False), (1, "ALTO_RIESGO", "seen", None, True)], "convenio_id long, tipo string, mensaje string, fecha_envio timestamp, leido boolean")
    now = {(r.convenio_id, r.mensaje, r.leido): str(r.fecha_envio) for r in current(spark, str(tmp_path / "out"), base).collect()}
    assert now == {(2, "Riesgo medio", False): "2024-01-02 10:00:00", (1, "seen", True): "None", (1, "Riesgo alto", False): "2024-01-01 10:00:00"}
    later = current(spark, str(tmp_path / "out"), base, after=0).collect()
    assert {(r.convenio_id, r.mensaje) for r in later} == {(2, "Riesgo medio"), (1, "seen")}
    assert windowed_levels(rows.where("convenio_id = 1"), "1 hour").count() == 2
