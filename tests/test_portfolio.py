import datetime

from pyspark.sql import functions as F

from pactlens.operators import assistant as A
from pactlens.operators import portfolio as P

DAY = datetime.date(2025, 1, 10)
SCHEMA = "id long, titulo string, descripcion string, fecha_firma date, fecha_vencimiento date, estado string, archivo_path string, updated_at timestamp"


def agreements(spark):
    """Every state with every boundary of the expiry."""
    rows, n = [], 0
    for state in ("BORRADOR", "NEGOCIACION", "CERRADO", "VENCIDO"):
        for days in (-1, 0, 30, 31, 90, 91, None):
            n += 1
            due = None if days is None else DAY + datetime.timedelta(days=days)
            rows.append((n, f"{state} {days}", None, None, due, state, "f.docx" if n % 2 else None, datetime.datetime(2024, 1, 1)))
    return spark.createDataFrame(rows, SCHEMA)


def told(df, *names):
    return {r[0]: r[1] if len(names) == 2 else tuple(r[1:]) for r in df.select(*names).collect()}


def test_alert_boundaries(spark):
    got = told(P.expiry_alerts(agreements(spark), DAY), "titulo", "nivel")
    want = {}
    for state in ("NEGOCIACION", "CERRADO", "VENCIDO"):
        want |= {f"{state} 0": "ALTO", f"{state} 30": "ALTO", f"{state} 31": "MEDIO", f"{state} 90": "MEDIO"}
        if state != "NEGOCIACION":
            want[f"{state} -1"] = "ALTO"
    assert got == want


def test_states_keep_their_own_boundaries(spark):
    a = agreements(spark)
    assert told(P.derive_state(a, DAY), "titulo", "estado")["CERRADO -1"] == "CERRADO"
    assert told(P.derive_state(a, DAY), "titulo", "estado")["VENCIDO 0"] in ("NEGOCIACION", "BORRADOR")
    assert told(P.refresh_closed(a, DAY), "titulo", "estado")["CERRADO -1"] == "VENCIDO"
    assert told(P.refresh_on_list(a, DAY), "titulo", "estado")["CERRADO -1"] == "CERRADO"
    assert {r.titulo for r in P.expired_list(a, DAY).collect()} == {"CERRADO -1", "CERRADO 0", "VENCIDO -1", "VENCIDO 0"}


def test_latest_keeps_ties_and_skips_null_times(spark):
    d = datetime.date
    rows = [(1, 1, d(2024, 1, 2), "ALTO", 0.5), (2, 1, d(2024, 1, 2), "BAJO", 0.1), (3, 1, d(2024, 1, 1), "MEDIO", 0.1), (4, 2, None, "ALTO", 0.9)]
    a = spark.createDataFrame(rows, "id long, convenio_id long, created_at date, risk_level string, score double")
    assert sorted(r.id for r in P.latest_with_ties(a).collect()) == [1, 2]


def test_dashboard_prefers_high(spark):
    a = agreements(spark)
    analyses = spark.createDataFrame([(1, 5, DAY, "ALTO", 0.9), (2, 6, DAY, "MEDIO", 0.5)], "id long, convenio_id long, created_at date, risk_level string, score double")
    r = P.dashboard_overview(a, analyses, DAY).first()
    assert (r.altos, r.medios, r.vencidos) == (4 * 3 + 1, 4 * 2 - 1 + 1, 8)


def test_upsert_updates_the_unread_one_or_adds(spark):
    t = datetime.datetime
    old = spark.createDataFrame([(1, "ALTO_RIESGO", "a", t(2024, 1, 1), False), (2, "ALTO_RIESGO", "b", t(2024, 1, 1), True)], "convenio_id long, tipo string, mensaje string, fecha_envio timestamp, leido boolean")
    new = spark.createDataFrame([(1, "ALTO_RIESGO", "n1", t(2024, 2, 1)), (2, "ALTO_RIESGO", "n2", t(2024, 2, 1)), (None, "ALTO_RIESGO", "x", t(2024, 2, 1)), (3, "OTRO", "y", t(2024, 2, 1))], "convenio_id long, tipo string, mensaje string, fecha_envio timestamp")
    got = sorted((r.convenio_id, r.mensaje, r.leido) for r in P.upsert_unread(old, new).collect())
    assert got == [(1, "n1", False), (2, "b", True), (2, "n2", False)]


def test_pages_and_meta(spark):
    a = agreements(spark)
    assert P.page_meta(a, 2, 14).first().has_more is False
    assert P.page_meta(a, 2, 13).first().has_more is True
    assert P.sorted_page(a, "nonsense", page=4, per=7).filter(F.col("fecha_vencimiento").isNull()).count() == 4


def test_intents_in_order(spark):
    asked = {
        "¿Cuándo vence el convenio con UMSS?": "A01", "¿Qué convenios vencen este año?": "A02", "vencen este año": "A02", "convenios ya vencidos": "A03", "convenios firmados este año": "A04", "lista de convenios por orden de firma": "A06",
        "listado de convenios": "A07", "convenios en estado cerrado": "A08", "próximos a vencer en 30 días": "A09", "el más próximo a vencer": "A10", "riesgo alto": "A11", "convenios con una versión": "A13", "alertas": "A21", "hola": "A22",
    }
    df = spark.createDataFrame(list(asked.items()), "q string, want string").withColumn("got", A.route_intent(F.col("q")))
    assert {r.q: r.got for r in df.collect()} == asked


def test_followup(spark):
    rows = [(1, 0, "user", "¿riesgo del convenio A?"), (1, 1, "assistant", "alto"), (1, 2, "user", "y eso?"), (2, 0, "user", "hola")]
    got = {(r.conv_id, r.turn): r.text for r in A.expand_followup(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2] == "¿riesgo del convenio A? | Seguimiento: y eso?"
    assert got[2, 0] == "hola"


def test_places_in_ranges_are_those_of_the_whole_order(spark):
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else "cold", None if i % 5 == 0 else (i * 37) % 50, f"x{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, nivel string, v int, _part string")
    got = P.numbered(df, "lugar", F.col("v").desc_nulls_first(), F.asc("id"), by=("nivel",)).collect()
    assert len(got) == 400 and got[0]._part.startswith("x")
    for level in (None, "hot", "cold"):
        own = sorted((r for r in rows if r[1] == level), key=lambda r: (r[2] is not None, -(r[2] or 0), r[0]))
        assert [r.id for r in sorted((g for g in got if g.nivel == level), key=lambda g: g.lugar)] == [r[0] for r in own]
        assert sorted(g.lugar for g in got if g.nivel == level) == list(range(1, len(own) + 1))
    assert P.numbered(df.limit(0), "lugar", F.asc("id")).count() == 0
    assert [r.lugar for r in P.numbered(df, "lugar", F.desc("id")).orderBy(F.desc("id")).collect()] == list(range(1, 401))
    assert [r.id for r in A.by_title(df.withColumn("titulo", F.lit("t")), "n").orderBy("n").limit(3).collect()] == [0, 1, 2]
