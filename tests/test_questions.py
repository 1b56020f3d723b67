import datetime

import pytest
from pyspark.sql import functions as F

from pactlens.operators import assistant as A
from pactlens.operators import portfolio as P
from pactlens.operators import resolve as R

D = datetime.date
SCHEMA = "id long, titulo string, descripcion string, fecha_firma date, fecha_vencimiento date, estado string, archivo_path string, updated_at timestamp"
VERSION = "convenio_id long, numero_version int, fecha_version date, observaciones string, texto string"


def agreements(spark):
    rows = [(1, "Convenio UMSS", "Apoyo", D(2024, 1, 2), D(2025, 3, 4), "NEGOCIACION"), (2, "Boliviana de Aviación", None, None, None, "CERRADO"), (3, "Agencia Tic", "  ", D(2023, 5, 6), D(2024, 7, 8), "VENCIDO")]
    return spark.createDataFrame([(*r, None, datetime.datetime(2024, 1, r[0])) for r in rows], SCHEMA)


def versions(spark):
    rows = [(1, 1, D(2024, 1, 1), "inicial", "uno"), (1, 2, D(2024, 2, 1), "version Final", "<p>dos</p> " + "palabra " * 200), (1, 3, D(2024, 3, 1), None, None), (3, 1, D(2024, 1, 1), "o", "x")]
    return spark.createDataFrame(rows, VERSION)


def said(df):
    return [r.respuesta for r in df.collect()]


def test_aliases_work_in_both_directions_whatever_the_accents():
    assert R.expand_aliases("Agencia de Gobierno Electrónico y TIC")[:2] == ["agencia de gobierno electronico y tic", "agetic"]
    assert set(R.ALIASES["msd"]) | {"msd"} == set(R.expand_aliases("minsalud"))
    assert set(R.ALIASES["boa"]) < set(R.expand_aliases("BOA"))
    assert R.expand_aliases("«Nadie»") == ["«nadie»"] and R.expand_aliases(" Nadie. ") == ["nadie"]


def test_answers_about_one_agreement(spark):
    a, v = agreements(spark), versions(spark)
    assert said(A.expiry_answer(a, "umss")) == ["El convenio **Convenio UMSS** vence el **4 de marzo de 2025** (NEGOCIACION)."]
    assert said(A.expiry_answer(a, "boa")) == ["El convenio **Boliviana de Aviación** vence el **—** (CERRADO)."]
    assert said(A.version_count_answer(a, v, "umss")) == ["El convenio **Convenio UMSS** tiene **3** versión(es)."]
    assert said(A.version_count_answer(a, v, "boliviana de aviacion")) == ["El convenio **Boliviana de Aviación** tiene **0** versión(es)."]
    assert said(A.description_answer(a, "agencia tic")) == ["Descripción de **Agencia Tic**:\n—"]
    assert said(A.versions_answer(a, v, "umss"))[0].split("\n")[1:3] == ["• v3 (1 de marzo de 2024) — ", "• v2 (1 de febrero de 2024) — version Final"]
    assert said(A.versions_answer(a, v, "boliviana de aviacion")) == []
    analyses = spark.createDataFrame([(1, 1, D(2024, 1, 1), "ALTO", 0.5), (2, 1, D(2024, 1, 2), "BAJO", 0.1234)], "id long, convenio_id long, created_at date, risk_level string, score double")
    assert "- Riesgo más reciente: BAJO (score 0.123)\n- Versiones (máx. 10):\n  • v3" in said(A.detail_answer(a, analyses, v, "umss"))[0]
    assert said(A.detail_answer(a, analyses, v, "boliviana de aviacion"))[0].endswith("- Fecha de Vencimiento: —\n- Aún no hay versiones registradas.\n")
    assert said(A.expiry_answer(a.limit(0), "umss")) == []


def test_contents_of_versions(spark):
    a, v = agreements(spark), versions(spark)
    assert said(A.content_answer(a, v, "umss", "inicial")) == ["Contenido de **Convenio UMSS** — v1 (inicial):\nuno"]
    final = said(A.content_answer(a, v, "umss", "final"))[0]
    assert final.startswith("Contenido de **Convenio UMSS** — v2 (version Final):\ndos palabra") and final.endswith(" …")
    assert said(A.content_answer(a, v, "umss")) == [] == said(A.content_answer(a, v, "umss", "3"))  # without a text
    asked = spark.createDataFrame([("resume v 12",), ("la versión 3",), ("el archivo inicial o final",), ("la final",), ("nada",)], "q string")
    assert [r[0] for r in asked.select(A.version_hint(F.col("q"))).collect()] == ["12", "3", "inicial", "final", None]


def test_contacts_come_from_the_columns_that_there_are(spark):
    df = spark.createDataFrame([(1, "t", "Ana", "a@b.c", "x")], "id long, titulo string, contacto string, correo_contacto string, unidad string")
    assert A.contact(df).first().asDict() == {"id": 1, "titulo": "t", "responsable": "Ana", "area": "x", "email": "a@b.c", "telefono": None}


def test_whole_conversations(spark):
    turns = [(1, 0, "user", "¿Qué riesgo tiene el convenio UMSS?"), (1, 1, "assistant", "…"), (1, 2, "user", "¿y eso?"), (2, 0, "user", "qwzx kjhg"), (3, 0, "user", "  "), (4, 0, "user", "versiones del convenio con UMSS"), (5, 0, "user", "aviacion"), (6, 0, "user", None)]
    got = {(r.conv_id, r.turn): r for r in A.chat_plan(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), agreements(spark)).collect()}
    assert {k: r.way for k, r in got.items()} == {(1, 0): "rag", (1, 2): "rag", (2, 0): "guard", (3, 0): "none", (4, 0): "direct", (5, 0): "rag", (6, 0): "none"}
    assert got[1, 2].asked == "¿Qué riesgo tiene el convenio UMSS? | Seguimiento: ¿y eso?"
    assert (got[4, 0].intent, got[4, 0].name) == ("A18", "UMSS")
    assert got[2, 0].reply == A.REFUSAL and got[3, 0].reply == A.EMPTY and got[5, 0].reply is None


def test_on_topic_words_are_found_inside_words(spark):
    asked = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(["mss", "u", "ia", "gencia zz", "qqq", "el de con"])], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.on_topic for r in A.on_topic_rows(asked, agreements(spark)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_grounding_takes_the_newest_only_if_nothing_else_fits(spark):
    a, v = agreements(spark), versions(spark)
    facts = spark.createDataFrame([(i, 1, f"hallazgo {i}") for i in range(5)], "id long, convenio_id long, text string")
    none = spark.createDataFrame([], "id long, convenio_id long, created_at date, risk_level string, score double")
    got = {r.place: r for r in A.grounding(a, none, v, facts, "háblame de umss").collect()}
    assert set(got) == {0, 1} and got[1].id == 1
    assert "  * F1: hallazgo 4\n  * F2: hallazgo 3\n  * F3: hallazgo 2" in got[1].context and "- Ultimo riesgo: sin analisis" in got[1].context
    assert "    Texto: dos palabra" in got[1].context and "..." in got[1].context
    assert got[0].context == "RESUMEN GLOBAL:\n- Total convenios: 3\n- Por estado: CERRADO: 1, NEGOCIACION: 1, VENCIDO: 1"
    assert {r.id for r in A.grounding(a, none, v, facts, "qwzx").collect()} == {None, 1, 2, 3}


def test_uploads_change_states_in_order(spark):
    a = spark.createDataFrame([(i, s) for i, s in enumerate(["BORRADOR", "NEGOCIACION", "CERRADO", "VENCIDO", None])], "id long, estado string")
    steps = {0: ["subir", "subir_final", "subir", "reabrir", "quitar"], 1: ["reabrir", "subir", None, "otra"], 2: ["quitar", "subir_final", "reabrir", "subir_final"], 3: ["quitar", "subir"]}
    e = spark.createDataFrame([(i, k, x) for i, own in steps.items() for k, x in enumerate(own)], "convenio_id long, seq long, accion string")
    got = {r.id: (r.estado, r.rechazados) for r in P.upload_transitions(a, e).collect()}
    assert got == {0: ("BORRADOR", 1), 1: ("NEGOCIACION", 1), 2: ("CERRADO", 1), 3: ("VENCIDO", 0), 4: ("BORRADOR", 0)}


@pytest.mark.parametrize(("per", "want"), [("7", 7), (None, 20), ("x", 20), (0, 20), (-3, 20), (1000, 100)])
def test_page_sizes(per, want):
    assert P.page_size(per, 20, 100) == want


def test_pages_fall_back_to_the_expiry(spark):
    a = agreements(spark)
    assert [r.id for r in P.sorted_page(a, "updated_at").collect()] == [r.id for r in P.sorted_page(a, "fecha_vencimiento").collect()] == [3, 1, 2]


def test_alert_feed_is_newest_first_within_a_level(spark):
    a = agreements(spark).withColumn("fecha_vencimiento", F.when(F.col("id") == 3, F.lit(D(2024, 1, 1))))
    n = spark.createDataFrame([(1, 1, "ALTO_RIESGO", "m", datetime.datetime(2024, 5, 5), datetime.datetime(2024, 5, 5))], "id long, convenio_id long, tipo string, mensaje string, fecha_envio timestamp, created_at timestamp")
    got = sorted((r.nivel, r.lugar, r.convenio_id, r.detalle, r.badge) for r in P.alert_feed(a, n, D(2024, 6, 1), datetime.datetime(2024, 6, 1)).collect())
    assert got == [("ALTO", 1, 3, "Convenio vencido.", 2), ("ALTO", 2, 1, "Detectado por análisis de riesgo", 2)]


def test_second_set_of_questions(spark):
    a, v = agreements(spark), versions(spark)
    analyses = spark.createDataFrame([(i, 1, "ALTO", i / 10, datetime.datetime(2024, 1, i) if i < 4 else None) for i in range(1, 5)], "id long, convenio_id long, risk_level string, score double, analizado_en timestamp")
    assert [r.id for r in A.analyses_at_level(analyses, a, "ALTO", 2).collect()] == [4, 3]
    assert A.detail_by_title(a, analyses, v, "umss").first().numeros == [3, 2, 1]
    assert A.detail_by_title(a, analyses, v, "").count() == 0 and A.detail_by_title(a, analyses, v, "", 3).first().id == 3
    assert A.detail_by_id(a, analyses, v, 99).count() == 0
    assert [r.id for r in A.title_search(a, "a%tic").collect()] == [3]
    assert [r.id for r in A.expiring_between(a, D(2024, 7, 8), D(2025, 3, 4)).collect()] == [3, 1]
    logs = spark.createDataFrame([(1, "subir", f"d{i:02}", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)) for i in range(60)], "convenio_id long, accion string, descripcion string, fecha timestamp")
    assert A.version_history(v, logs, 1).count() == 53
