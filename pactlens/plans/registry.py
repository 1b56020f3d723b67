"""Named queries over the driver's tables and the SQL they are checked against. Dates are given as text, doubles rounded."""

from __future__ import annotations

import datetime
import json
import pkgutil

from pyspark.sql import Window
from pyspark.sql import functions as F

from pactlens import views as V
from pactlens.functions import text as T
from pactlens.operators import assistant as A
from pactlens.operators import diff as D
from pactlens.operators import fulltext as W
from pactlens.operators import learning as ML
from pactlens.operators import lexicon as L
from pactlens.operators import portfolio as P
from pactlens.operators import resolve as R
from pactlens.operators import risk as K
from pactlens.operators import vectors as X
from pactlens.sources import io as S
from pactlens.sources import store

D0 = V.AS_OF
_D = f"DATE '{D0}'"
QUERIES: dict = {}
ORACLES: dict = {}


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def query(name: str, sql: str | None = None, *needs: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = V.with_views(sql, *needs) if needs else sql
        return f

    return put


# --- lists, filters, pages -------------------------------------------------------------------------------------------
@query("filter_agreements", f"SELECT id, titulo, CAST(fecha_vencimiento AS VARCHAR) AS fecha_vencimiento, estado FROM agreements WHERE (lower(titulo) LIKE '%urgent%' OR lower(descripcion) LIKE '%urgent%') AND estado IN ('CERRADO', 'VENCIDO') AND fecha_vencimiento >= {_D} AND fecha_vencimiento <= DATE '1999-06-15'", "agreements")
def filter_agreements(spark, d):
    out = P.filter_agreements(V.agreements(spark, d), "Urgent", ["CERRADO", "VENCIDO"], D0, datetime.date(1999, 6, 15))
    return out.select("id", "titulo", _day("fecha_vencimiento"), "estado")


@query("token_filter", "SELECT id, descripcion FROM agreements WHERE lower(titulo) LIKE '%high%' OR lower(descripcion) LIKE '%high%' OR lower(titulo) LIKE '%build%' OR lower(descripcion) LIKE '%build%'", "agreements")
def token_filter(spark, d):
    return P.filter_agreements(V.agreements(spark, d), tokens=["high", "build"]).select("id", "descripcion")


@query("literal_filter", "SELECT id, titulo FROM agreements WHERE contains(lower(titulo), '#0000001') OR contains(lower(titulo), 'low')", "agreements")
def literal_filter(spark, d):
    a = V.agreements(spark, d)
    return P.contains_literal(a, "#0000001", "titulo").unionByName(P.contains_literal(a, "LOW", "titulo")).distinct().select("id", "titulo")


@query("agreement_page", "SELECT id, CAST(fecha_vencimiento AS VARCHAR) AS fecha_vencimiento, estado FROM agreements ORDER BY fecha_vencimiento ASC NULLS LAST, id LIMIT 25 OFFSET 50", "agreements")
def agreement_page(spark, d):
    return P.sorted_page(V.agreements(spark, d), "fecha_vencimiento", page=3, per=25).select("id", _day("fecha_vencimiento"), "estado")


@query("agreement_page_desc", "SELECT id, CAST(fecha_vencimiento AS VARCHAR) AS fecha_vencimiento FROM agreements ORDER BY fecha_vencimiento DESC NULLS FIRST, id DESC LIMIT 10", "agreements")
def agreement_page_desc(spark, d):
    return P.sorted_page(V.agreements(spark, d), "fecha_vencimiento", True).select("id", _day("fecha_vencimiento"))


@query("page_meta", "SELECT 3 AS page, 25 AS per, count(*) AS total, 75 < count(*) AS has_more FROM agreements", "agreements")
def page_meta(spark, d):
    return P.page_meta(V.agreements(spark, d), 3, 25)


@query("expiry_badges", f"SELECT id, CASE WHEN k < 0 THEN 'Vencido ' || -k || 'd' WHEN k = 0 THEN 'Vencido hoy' ELSE k || 'd' END AS badge FROM (SELECT id, datediff('day', {_D}, fecha_vencimiento) AS k FROM agreements)", "agreements")
def expiry_badges(spark, d):
    return V.agreements(spark, d).select("id", P.expiry_badge(D0).alias("badge"))


@query("long_dates", "SELECT id, coalesce(day(fecha_vencimiento) || ' de ' || list_extract(['" + "','".join(P.MONTHS) + "'], month(fecha_vencimiento)) || ' de ' || year(fecha_vencimiento), '—') AS texto FROM agreements", "agreements")
def long_dates(spark, d):
    return V.agreements(spark, d).select("id", P.long_date(F.col("fecha_vencimiento")).alias("texto"))


@query("count_by_state", "SELECT estado, count(*) AS total FROM agreements GROUP BY estado", "agreements")
def count_by_state(spark, d):
    return P.count_by_state(V.agreements(spark, d))


# --- states ------------------------------------------------------------------------------------------------------------
_FILE = "CASE WHEN archivo_path IS NOT NULL THEN 'NEGOCIACION' ELSE 'BORRADOR' END"


@query("derive_state", f"SELECT id, CASE WHEN estado = 'CERRADO' THEN 'CERRADO' WHEN fecha_vencimiento < {_D} THEN 'VENCIDO' ELSE {_FILE} END AS estado FROM agreements", "agreements")
def derive_state(spark, d):
    return P.derive_state(V.agreements(spark, d), D0).select("id", "estado")


@query("refresh_on_list", f"SELECT id, CASE WHEN fecha_vencimiento < {_D} AND estado <> 'CERRADO' THEN 'VENCIDO' ELSE estado END AS estado FROM agreements", "agreements")
def refresh_on_list(spark, d):
    return P.refresh_on_list(V.agreements(spark, d), D0).select("id", "estado")


@query("refresh_closed", f"SELECT id, CASE WHEN fecha_vencimiento < {_D} AND estado = 'CERRADO' THEN 'VENCIDO' ELSE estado END AS estado FROM agreements", "agreements")
def refresh_closed(spark, d):
    return P.refresh_closed(V.agreements(spark, d), D0).select("id", "estado")


@query("expired_list", f"SELECT id, 'VENCIDO' AS estado, CAST(fecha_vencimiento AS VARCHAR) AS fecha_vencimiento FROM agreements WHERE estado IN ('CERRADO', 'VENCIDO') AND fecha_vencimiento <= {_D}", "agreements")
def expired_list(spark, d):
    return P.expired_list(V.agreements(spark, d), D0).select("id", "estado", _day("fecha_vencimiento"))


@query("recompute_state", f"SELECT id, CASE WHEN estado = 'CERRADO' AND fecha_vencimiento < {_D} THEN 'VENCIDO' WHEN estado = 'CERRADO' THEN 'CERRADO' WHEN archivo_path IS NOT NULL OR id IN (SELECT convenio_id FROM versions) THEN 'NEGOCIACION' ELSE 'BORRADOR' END AS estado FROM agreements", "agreements", "versions")
def recompute_state(spark, d):
    return P.recompute_state(V.agreements(spark, d), V.versions(spark, d), D0).select("id", "estado")


@query("refresh_closed_count", f"SELECT count(*) AS updated FROM agreements WHERE fecha_vencimiento < {_D} AND estado = 'CERRADO'", "agreements")
def refresh_closed_count(spark, d):
    return P.refresh_closed_count(V.agreements(spark, d), D0)


_REFUSED = "((e IN ('subir', 'subir_final') AND split_part(a, '|', 1) = 'CERRADO') OR (e = 'reabrir' AND split_part(a, '|', 1) <> 'CERRADO'))"


@query("upload_transitions", f"""done AS (SELECT convenio_id, list(accion ORDER BY seq) AS acciones FROM uploads GROUP BY convenio_id),
folded AS (SELECT g.id, list_reduce(list_prepend(g.estado || '|0', coalesce(acciones, [])), lambda a, e:
  CASE WHEN {_REFUSED} THEN split_part(a, '|', 1) || '|' || (CAST(split_part(a, '|', 2) AS INTEGER) + 1) WHEN e = 'subir_final' THEN 'CERRADO|' || split_part(a, '|', 2)
    WHEN e = 'reabrir' OR (e = 'subir' AND split_part(a, '|', 1) = 'BORRADOR') THEN 'NEGOCIACION|' || split_part(a, '|', 2)
    WHEN e = 'quitar' AND split_part(a, '|', 1) NOT IN ('CERRADO', 'VENCIDO') THEN 'BORRADOR|' || split_part(a, '|', 2) ELSE a END) AS f FROM agreements g LEFT JOIN done ON done.convenio_id = g.id)
SELECT id, split_part(f, '|', 1) AS estado, CAST(split_part(f, '|', 2) AS INTEGER) AS rechazados FROM folded""", "agreements", "uploads")
def upload_transitions(spark, d):
    return P.upload_transitions(V.agreements(spark, d), V.uploads(spark, d))


@query("state_summary", "SELECT string_agg(estado || ': ' || n, ', ' ORDER BY n DESC, estado) AS resumen FROM (SELECT estado, count(*) AS n FROM agreements GROUP BY estado)", "agreements")
def state_summary(spark, d):
    return P.state_summary(V.agreements(spark, d))


_ISO = "strftime(analizado_en, '%Y-%m-%dT%H:%M:%S+00:00') AS analizado_en"


@query("analysis_history", f"SELECT id, risk_level, {_ISO} FROM analyses WHERE convenio_id = 7 ORDER BY analyses.analizado_en DESC, id DESC LIMIT 10 OFFSET 10", "analyses")
def analysis_history(spark, d):
    return P.analysis_history(V.analyses(spark, d), 7, 2).select("id", "risk_level", "analizado_en")


@query("risk_dataset_page", "SELECT id, text FROM facts WHERE version_id = 3 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20", "facts")
def risk_dataset_page(spark, d):
    return P.risk_dataset_page(V.facts(spark, d), 3, 2, "no number").select("id", "text")


@query("report_rows", "SELECT id, printf('%.0f', greatest(0, least(1, score)) * 100) || '%' AS porcentaje, CASE risk_level WHEN 'ALTO' THEN 'Alto' WHEN 'MEDIO' THEN 'Medio' ELSE 'Bajo' END AS nivel FROM analyses WHERE convenio_id = 7", "analyses")
def report_rows(spark, d):
    return S.report_row(V.analyses(spark, d).where("convenio_id = 7")).select("id", "porcentaje", "nivel")


# --- latest, alerts, dashboards --------------------------------------------------------------------------------------
_LATEST = "latest AS (SELECT a.* FROM analyses a JOIN (SELECT convenio_id, max(created_at) AS m FROM analyses GROUP BY convenio_id) x ON a.convenio_id = x.convenio_id AND a.created_at = x.m)\n"


@query("latest_risk", _LATEST + "SELECT convenio_id, id, risk_level FROM latest", "analyses")
def latest_risk(spark, d):
    return P.latest_with_ties(V.analyses(spark, d)).select("convenio_id", "id", "risk_level")


@query("latest_risk_by_level", _LATEST + "SELECT l.convenio_id, l.id AS analysis_id, CAST(l.created_at AS VARCHAR) AS created_at, round(l.score, 6) AS score, g.titulo, g.estado FROM latest l JOIN agreements g ON g.id = l.convenio_id WHERE risk_level = 'ALTO'", "analyses", "agreements")
def latest_risk_by_level(spark, d):
    out = P.latest_risk_by_level(V.analyses(spark, d), V.agreements(spark, d), "ALTO")
    return out.select("convenio_id", "analysis_id", _day("created_at"), F.round("score", 6).alias("score"), "titulo", "estado")


_ALERTS = f"""days AS (SELECT *, datediff('day', {_D}, fecha_vencimiento) AS dias FROM agreements WHERE estado IN ('NEGOCIACION', 'CERRADO', 'VENCIDO')),
expiry AS (SELECT convenio_id, motivo, nivel, CASE WHEN dias < 0 THEN 'Convenio vencido.' WHEN nivel = 'ALTO' THEN 'Vencimiento en ≤ 30 días' ELSE 'Vencimiento en 31–90 días' END AS mensaje, CASE WHEN dias < 0 THEN 'VENCIDO' ELSE estado END AS estado
  FROM (SELECT *, id AS convenio_id, 'vencimiento' AS motivo, CASE WHEN dias < 0 AND estado IN ('CERRADO', 'VENCIDO') THEN 'ALTO' WHEN dias BETWEEN 0 AND 30 THEN 'ALTO' WHEN dias BETWEEN 31 AND 90 THEN 'MEDIO' END AS nivel FROM days) WHERE nivel IS NOT NULL),
risky AS (SELECT n.*, row_number() OVER (PARTITION BY n.convenio_id ORDER BY fecha_envio DESC NULLS FIRST, created_at DESC NULLS FIRST, n.id DESC) AS r FROM notifications n JOIN agreements g ON g.id = n.convenio_id WHERE g.estado = 'NEGOCIACION'),
feed AS (SELECT convenio_id, motivo, nivel, mensaje, TIMESTAMP '2030-01-01' AS momento, estado FROM expiry
  UNION ALL SELECT convenio_id, 'analisis', CASE WHEN tipo = 'ALTO_RIESGO' THEN 'ALTO' ELSE 'MEDIO' END, mensaje, coalesce(fecha_envio, created_at), 'NEGOCIACION' FROM risky WHERE r = 1 AND convenio_id NOT IN (SELECT convenio_id FROM expiry))
"""


@query("expiry_alerts", _ALERTS + "SELECT convenio_id, motivo, nivel, mensaje FROM expiry", "agreements", "notifications")
def expiry_alerts(spark, d):
    return P.expiry_alerts(V.agreements(spark, d), D0).select("convenio_id", "motivo", "nivel", "mensaje")


@query("alerts", _ALERTS + "SELECT convenio_id, motivo, nivel, mensaje FROM feed", "agreements", "notifications")
def alerts(spark, d):
    return P.alerts(V.agreements(spark, d), V.notifications(spark, d), D0).select("convenio_id", "motivo", "nivel", "mensaje")


@query("alert_feed", _ALERTS + "SELECT convenio_id, nivel, row_number() OVER (PARTITION BY nivel ORDER BY momento DESC, convenio_id) AS lugar, CASE WHEN motivo <> 'vencimiento' THEN 'Detectado por análisis de riesgo' WHEN nivel <> 'ALTO' THEN 'Vencimiento en 31–90 días' WHEN estado = 'VENCIDO' THEN 'Convenio vencido.' ELSE 'Vencimiento en ≤ 30 días' END AS detalle, (SELECT count(*) FROM feed) AS badge FROM feed", "agreements", "notifications")
def alert_feed(spark, d):
    out = P.alert_feed(V.agreements(spark, d), V.notifications(spark, d), D0, datetime.datetime(2030, 1, 1))
    return out.select("convenio_id", "nivel", F.col("lugar").cast("long").alias("lugar"), "detalle", "badge")


@query("dashboard_overview", _LATEST.rstrip() + f""",
marks AS (SELECT id AS convenio_id, CASE WHEN fecha_vencimiento <= {_D} + 30 THEN 2 WHEN fecha_vencimiento <= {_D} + 90 THEN 1 END AS v FROM agreements
  UNION ALL SELECT convenio_id, CASE risk_level WHEN 'ALTO' THEN 2 WHEN 'MEDIO' THEN 1 END FROM latest),
top AS (SELECT convenio_id, max(v) AS v FROM marks WHERE v IS NOT NULL GROUP BY convenio_id)
SELECT (SELECT count(*) FROM top WHERE v = 2) AS altos, (SELECT count(*) FROM top WHERE v = 1) AS medios, (SELECT count(*) FROM agreements WHERE fecha_vencimiento <= {_D}) AS vencidos""", "analyses", "agreements")
def dashboard_overview(spark, d):
    return P.dashboard_overview(V.agreements(spark, d), V.analyses(spark, d), D0)


@query("dashboard_summary", f"SELECT (SELECT count(*) FROM agreements WHERE fecha_vencimiento <= {_D}) AS vencidos, (SELECT count(*) FROM agreements WHERE fecha_vencimiento BETWEEN {_D} AND {_D} + 30) AS proximos_30, (SELECT count(*) FROM notifications WHERE NOT leido) AS no_leidas", "agreements", "notifications")
def dashboard_summary(spark, d):
    return P.dashboard_summary(V.agreements(spark, d), V.notifications(spark, d), D0)


@query("single_version", "SELECT id, titulo FROM agreements WHERE id IN (SELECT convenio_id FROM versions GROUP BY convenio_id HAVING count(*) = 1)", "agreements", "versions")
def single_version(spark, d):
    return P.single_version(V.agreements(spark, d), V.versions(spark, d)).select("id", "titulo")


@query("next_version", "SELECT g.id, CAST(coalesce(max(v.numero_version), 0) + 1 AS BIGINT) AS siguiente FROM agreements g LEFT JOIN versions v ON v.convenio_id = g.id GROUP BY g.id", "agreements", "versions")
def next_version(spark, d):
    return P.next_version(V.agreements(spark, d), V.versions(spark, d)).select("id", F.col("siguiente").cast("long").alias("siguiente"))


@query("default_pair", "SELECT convenio_id, CAST(max(numero_version) - 1 AS BIGINT) AS base, CAST(max(numero_version) AS BIGINT) AS comparada FROM versions GROUP BY convenio_id HAVING count(*) > 1", "versions")
def default_pair(spark, d):
    return P.default_pair(V.versions(spark, d)).select("convenio_id", F.col("base").cast("long").alias("base"), F.col("comparada").cast("long").alias("comparada"))


@query("agreement_detail", """risk AS (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY created_at DESC, id DESC) AS r FROM analyses),
last AS (SELECT convenio_id, string_agg(CAST(numero_version AS VARCHAR), ',' ORDER BY numero_version DESC) AS numeros FROM (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY numero_version DESC) AS r FROM versions) WHERE r <= 10 GROUP BY convenio_id)
SELECT g.id, g.titulo, g.estado, risk.risk_level, round(risk.score, 4) AS score, last.numeros FROM agreements g LEFT JOIN risk ON risk.convenio_id = g.id AND risk.r = 1 LEFT JOIN last ON last.convenio_id = g.id""", "agreements", "analyses", "versions")
def agreement_detail(spark, d):
    out = P.detail(V.agreements(spark, d), V.analyses(spark, d), V.versions(spark, d))
    return out.select("id", "titulo", "estado", "risk_level", "score", F.array_join(F.transform("numeros", lambda n: n.cast("string")), ",").alias("numeros"))


@query("final_version", "SELECT convenio_id, CAST(numero_version AS BIGINT) AS numero_version FROM (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY coalesce(lower(observaciones) LIKE '%final%', false) DESC, numero_version DESC) AS r FROM versions) WHERE r = 1", "versions")
def final_version(spark, d):
    return A.resolve_version(V.versions(spark, d), "final").select("convenio_id", F.col("numero_version").cast("long").alias("numero_version"))


@query("upsert_notifications", """incoming AS (SELECT convenio_id, risk_level || '_RIESGO' AS tipo, max(id) AS top FROM analyses WHERE risk_level IN ('ALTO', 'MEDIO') GROUP BY convenio_id, risk_level)
SELECT n.convenio_id, n.tipo, CASE WHEN NOT n.leido AND i.top IS NOT NULL THEN 'Nuevo ' || lpad(CAST(i.top AS VARCHAR), 12, '0') ELSE n.mensaje END AS mensaje, n.leido FROM notifications n LEFT JOIN incoming i ON i.convenio_id = n.convenio_id AND i.tipo = n.tipo
UNION ALL SELECT convenio_id, tipo, 'Nuevo ' || lpad(CAST(top AS VARCHAR), 12, '0'), false FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM notifications n WHERE n.convenio_id = i.convenio_id AND n.tipo = i.tipo AND NOT n.leido)""", "analyses", "notifications")
def upsert_notifications(spark, d):
    new = V.analyses(spark, d).where("risk_level IN ('ALTO', 'MEDIO')").select("convenio_id", F.concat("risk_level", F.lit("_RIESGO")).alias("tipo"), F.concat(F.lit("Nuevo "), F.lpad(F.col("id").cast("string"), 12, "0")).alias("mensaje"), F.lit(datetime.datetime(2030, 1, 1)).alias("fecha_envio"))
    return P.upsert_unread(V.notifications(spark, d), new).select("convenio_id", "tipo", "mensaje", "leido")


# --- questions -----------------------------------------------------------------------------------------------------------
@query("expiring_in_year", "SELECT id, CAST(fecha_vencimiento AS VARCHAR) AS fecha_vencimiento FROM agreements WHERE year(fecha_vencimiento) = 1998", "agreements")
def expiring_in_year(spark, d):
    return A.expiring_in_year(V.agreements(spark, d), 1998).select("id", _day("fecha_vencimiento"))


@query("already_expired", f"SELECT id, estado FROM agreements WHERE estado = 'VENCIDO' OR fecha_vencimiento < {_D}", "agreements")
def already_expired(spark, d):
    return A.already_expired(V.agreements(spark, d), D0).select("id", "estado")


@query("signed_in_year", "SELECT id, CAST(fecha_firma AS VARCHAR) AS fecha_firma FROM agreements WHERE year(fecha_firma) = 1998", "agreements")
def signed_in_year(spark, d):
    return A.signed_in_year(V.agreements(spark, d), 1998).select("id", _day("fecha_firma"))


@query("expiring_within", f"SELECT id FROM agreements WHERE fecha_vencimiento BETWEEN {_D} AND {_D} + 45", "agreements")
def expiring_within(spark, d):
    return A.expiring_within(V.agreements(spark, d), D0, 45).select("id")


@query("nearest_expiry", f"SELECT id, CAST(fecha_vencimiento AS VARCHAR) AS fecha_vencimiento FROM agreements WHERE fecha_vencimiento >= {_D} ORDER BY agreements.fecha_vencimiento, id LIMIT 1", "agreements")
def nearest_expiry(spark, d):
    return A.nearest_expiry(V.agreements(spark, d), D0).select("id", _day("fecha_vencimiento"))


@query("latest_notifications", "SELECT id, tipo, mensaje FROM notifications ORDER BY fecha_envio DESC NULLS FIRST, id DESC LIMIT 50", "notifications")
def latest_notifications(spark, d):
    return A.latest_notifications(V.notifications(spark, d)).select("id", "tipo", "mensaje")


#: Questions for each way through the cascade, with the intent that reading it gives.
QUESTIONS = [
    ("¿Cuándo vence el convenio con UMSS?", "A01"), ("¿vence?", "A01"), ("¿Qué convenios vencen este año?", "A02"), ("convenios ya vencidos", "A03"), ("convenios expirados", "A03"), ("convenios firmados este año", "A04"),
    ("convenios ordenados por vencimiento", "A05"), ("lista de convenios por orden de firma", "A06"), ("listado de convenios", "A07"), ("convenios en estado cerrado", "A08"), ("próximos a vencer en 30 días", "A09"), ("el más próximo a vencer", "A10"),
    ("¿Qué riesgo medio tengo?", "A11"), ("tengo convenios de nivel bajo", "A11"), ("hallazgos del análisis del convenio con AGETIC", "A12"), ("convenios con una versión", "A13"), ("cuantas versiones tiene el convenio UPB", "A14"),
    ("descripción del convenio con BOA", "A15"), ("contacto del convenio con BOA", "A16"), ("detalles del convenio con BOA", "A17"), ("versiones del convenio con BOA", "A18"), ("contenido de la versión 2 del convenio con BOA", "A19"),
    ("resume el convenio con BOA", "A20"), ("alertas", "A21"), ("hola", "A22"), ("fecha de vencimiento", "A22"),
]


@query("route_intent", f"SELECT conv_id, turn, list_extract(['{"','".join(i for _, i in QUESTIONS)}'], CAST((conv_id + turn) % {len(QUESTIONS)} + 1 AS INTEGER)) AS intent FROM conversations")
def route_intent(spark, d):
    asked = F.element_at(F.array(*[F.lit(q) for q, _ in QUESTIONS]), F.expr(f"CAST((conv_id + turn) % {len(QUESTIONS)} + 1 AS INT)"))
    return V.read(spark, d, "conversations").select("conv_id", "turn", A.route_intent(asked).alias("intent"))


#: What is asked about a name, and its intent and version.
ABOUT = [
    ("¿Cuándo vence el convenio con", "A01", None), ("¿Cuántas versiones tiene el convenio", "A14", None), ("Dame la descripción del convenio", "A15", None), ("¿Quién es el contacto del convenio", "A16", None), ("Detalles del convenio", "A17", None),
    ("Muestra las versiones de", "A18", None), ("Explica el contenido de la versión 3 de", "A19", "3"), ("¿De qué habla la versión inicial de", "A19", "inicial"), ("Resume el convenio", "A20", None), ("Alertas de", "A21", None), ("Hola", "A22", None),
]
_ABOUT = f"CAST((conv_id + turn) % {len(ABOUT)} + 1 AS INT)"


@query("routed_turns", f"""own AS (SELECT conv_id, turn, coalesce(nullif(array_to_string(regexp_extract_all(text, '[a-z]+')[1:3], ' '), ''), 'nadie') AS name FROM conversations)
SELECT conv_id, turn, name, list_extract(['{"','".join(i for _, i, _ in ABOUT)}'], {_ABOUT}) AS intent, list_extract([{", ".join("NULL" if v is None else f"'{v}'" for *_, v in ABOUT)}], {_ABOUT}) AS version FROM own""")
def routed_turns(spark, d):
    """Intent, name and version of questions about the first three plain words of each turn."""
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[a-z]+"), 0), 1, 3), " ")
    asked = F.concat(F.element_at(F.array(*[F.lit(q) for q, *_ in ABOUT]), F.expr(_ABOUT)), F.lit(' "'), F.coalesce(F.nullif(words, F.lit("")), F.lit("nadie")), F.lit('"'))
    asked = V.read(spark, d, "conversations").select("conv_id", "turn", asked.alias("asked"))
    return asked.select("conv_id", "turn", R.mention("asked").alias("name"), A.route_intent(F.col("asked")).alias("intent"), A.version_hint(F.col("asked")).alias("version"))


ORACLES["routed_turns"] = "WITH " + ORACLES["routed_turns"]
_HAS_TOPIC = "(len(list_filter(['" + "','".join(A.TOPIC) + "'], lambda k: contains(lower(text), k))) > 0 OR regexp_matches(text, '[\"“''‘].+[\"”''’]'))"


@query("expand_followup", f"""own AS (SELECT conv_id, turn, text, {_HAS_TOPIC} AS topic FROM conversations WHERE role = 'user'),
w AS (SELECT *, last_value(CASE WHEN topic THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM own)
SELECT conv_id, turn, CASE WHEN NOT topic AND before IS NOT NULL AND before <> text AND (length(text) <= 40 OR regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(y|tambi[eé]n|adem[aá]s|eso|ese|esa|m[aá]s)([^\\p{{L}}\\p{{N}}_]|$)')) THEN before || ' | Seguimiento: ' || text ELSE text END AS text FROM w""")
def expand_followup(spark, d):
    return A.expand_followup(V.read(spark, d, "conversations"))


ORACLES["expand_followup"] = "WITH " + ORACLES["expand_followup"]
_FOLDED = f"lower(replace(translate({{}}, '{T._ASCII_FROM}', '{T._ASCII_TO}'), 'ß', 'ss'))"
_TOKENS = f"list_filter(string_split(regexp_replace({_FOLDED.format('text')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('{"','".join(T.STOP)}'))"


_TOPICS = f"""titles AS (SELECT DISTINCT unnest(regexp_split_to_array({_FOLDED.format('t')}, '[^a-z0-9]+')) AS run FROM (SELECT unnest([titulo, descripcion]) AS t FROM agreements)),
asked AS (SELECT conv_id, turn, {_HAS_TOPIC} OR regexp_matches(text, '(?i)convenio\\s') AS topic, {_TOKENS}[1:6] AS tokens FROM conversations WHERE role = 'user'),
words AS (SELECT DISTINCT unnest(tokens) AS w FROM asked), known AS (SELECT w FROM words WHERE EXISTS (SELECT 1 FROM titles WHERE contains(run, w))),
topics AS (SELECT conv_id, turn, topic OR len(list_intersect(tokens, (SELECT list(w) FROM known))) > 0 AS on_topic FROM asked)"""


@query("on_topic", _TOPICS + "\nSELECT * FROM topics", "agreements")
def on_topic(spark, d):
    return A.on_topic_rows(V.read(spark, d, "conversations").where("role = 'user'"), V.agreements(spark, d))


_edge = r"[\s\"''“”‘’.,;:¿?¡!()\[\]-]+"
_named = lambda p: f"nullif(regexp_replace(regexp_replace(regexp_extract(text, '{p}', 1), '^{_edge}|{_edge}$', '', 'g'), '\\s+', ' ', 'g'), '')"
_ACCENTS = "translate(text, '" + T._ASCII_FROM + "', '" + T._ASCII_TO + "')"
_MENTION = "coalesce(" + ", ".join([_named("[\"“''‘]([^\"”''’]+)[\"”''’]"), _named(r"(?i)convenio\s+con\s+(?:(?:el|la|los|las)\s+)?([^,.?¿!\n]+)"), _named(r"(?i)convenio\s+([^,.?¿!\n]+)"), r"nullif(regexp_extract(text, '\b([A-ZÁÉÍÓÚÑ]{2,})\b', 1), '')", f"nullif(array_to_string({_TOKENS}, ' '), '')"]) + ")"
_INTENT = "CASE " + " ".join("WHEN " + " AND ".join([f"regexp_matches(lower({_ACCENTS if i == 'A03' else 'text'}), '{p}')" for p in patterns] + (["name IS NOT NULL"] if needs else [])) + f" THEN '{i}'" for i, patterns, needs in A.INTENTS) + " ELSE 'A22' END"
_HINT = r"coalesce(nullif(regexp_extract(lower(text), '\bv\s*(\d+)\b', 1), ''), nullif(regexp_extract(lower(text), 'versi(?:ón|on)\s*(\d+)', 1), ''), CASE WHEN regexp_matches(lower(text), '\barchivo\s+inicial\b') THEN 'inicial' WHEN regexp_matches(lower(text), '\barchivo\s+final\b') THEN 'final' WHEN regexp_matches(lower(text), '\binicial\b') THEN 'inicial' WHEN regexp_matches(lower(text), '\bfinal\b') THEN 'final' END)"
#: What a user says at every third turn, so that all ways of answering occur: a question, one that goes on with it, nothing.
SAID = ["¿Cuándo vence el convenio con \"la entidad\"?", "¿y eso?", "", "Dame los detalles del convenio con BOA", "Notificaciones de convenios", "¿Qué dice la versión 2 del convenio con UMSS?"]
_SPOKEN = f"SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 3 = 0 THEN list_extract(['{"','".join(SAID)}'], CAST((conv_id + turn // 2) % {len(SAID)} + 1 AS INT)) ELSE text END AS text FROM conversations"


@query("chat_plan", f"spoken AS ({_SPOKEN}),\nturns AS ({ORACLES['expand_followup'].replace('FROM conversations', 'FROM spoken')}),\n" + _TOPICS.replace("conversations WHERE role = 'user'", "turns") + f""",
named AS (SELECT *, {_MENTION} AS name FROM (SELECT conv_id, turn, text AS asked, coalesce(text, '') AS text FROM turns)),
told AS (SELECT n.conv_id, n.turn, n.asked, n.name, {_INTENT.replace("text", "n.text").replace("name IS", "n.name IS")} AS intent, {_HINT.replace("text", "n.text")} AS version,
  CASE WHEN trim(coalesce(o.text, '')) = '' THEN 'none' WHEN NOT on_topic THEN 'guard' WHEN {_INTENT.replace("text", "n.text").replace("name IS", "n.name IS")} <> 'A22' THEN 'direct' ELSE 'rag' END AS way
  FROM named n JOIN spoken o ON o.conv_id = n.conv_id AND o.turn = n.turn JOIN topics t ON t.conv_id = n.conv_id AND t.turn = n.turn WHERE o.role = 'user')
SELECT conv_id, turn, asked, way, CASE WHEN way = 'direct' THEN intent END AS intent, CASE WHEN way = 'direct' THEN name END AS name, CASE WHEN way = 'direct' THEN version END AS version, CASE way WHEN 'none' THEN '{A.EMPTY}' WHEN 'guard' THEN '{A.REFUSAL}' END AS reply FROM told""", "agreements")
def chat_plan(spark, d):
    said = F.element_at(F.array(*map(F.lit, SAID)), F.expr(f"CAST((conv_id + turn div 2) % {len(SAID)} + 1 AS INT)"))
    own = V.read(spark, d, "conversations").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, said).otherwise(F.col("text")))
    return A.chat_plan(own, V.agreements(spark, d))


_INDEXES: dict = {}


def _trigrams(spark, d):
    """Where the trigram index of the agreements is, which an application writes once for each folder of tables."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        path = store.fresh(spark, "trigrams")
        R.write_trigrams(V.agreements(spark, d), path)
        _INDEXES[key] = path
    return _INDEXES[key]


_TRI = """tri AS (SELECT id, titulo, descripcion, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(titulo), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t,
  list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(descripcion), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS u FROM agreements),
q AS (SELECT list_distinct(flatten(list_transform(['customer', '000000042'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS q)
"""


@query("fuzzy_candidates", _TRI + "SELECT id, round(greatest(len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))), len(list_intersect(u, q)) / (len(u) + len(q) - len(list_intersect(u, q)))), 6) AS sim FROM tri, q ORDER BY greatest(len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))), len(list_intersect(u, q)) / (len(u) + len(q) - len(list_intersect(u, q)))) DESC, id LIMIT 5", "agreements")
def fuzzy_candidates(spark, d):
    return R.fuzzy_find(V.agreements(spark, d), "customer#000000042", index=_trigrams(spark, d)).select("id", "sim")


def _resolved(name: str, words: list[str]) -> str:
    """Tables ``best`` (id): the agreement that a name of these words means, by trigrams and then the second score."""
    tri = lambda c: f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    share = lambda c: f"len(list_intersect({c}, q)) / (len({c}) + len(q) - len(list_intersect({c}, q)))"
    return f"""tri AS (SELECT id, titulo, {tri('titulo')} AS t, {tri('descripcion')} AS u FROM agreements), asked AS (SELECT {tri("'" + ' '.join(words) + "'")} AS q),
cand AS (SELECT id, titulo, greatest({share('t')}, {share('u')}) AS sim FROM tri, asked ORDER BY greatest({share('t')}, {share('u')}) DESC, id LIMIT 5),
best AS (SELECT id FROM cand ORDER BY round(CASE WHEN contains(lower(titulo), '{name}') THEN 1.1 ELSE 0 END + greatest(0, 1 - least(levenshtein(substr(lower(titulo), 1, 128), '{name}') / 20, 1)), 6) DESC, round(sim, 6) DESC, id LIMIT 1),
one AS (SELECT * FROM agreements WHERE id = (SELECT id FROM best))
"""


NAME = "customer#000000042 1-urgent"
_ONE = _resolved(NAME, ["customer", "000000042", "1", "urgent"])
_MONTHS = "['" + "','".join(P.MONTHS) + "']"
_LONG = f"coalesce(day({{0}}) || ' de ' || list_extract({_MONTHS}, month({{0}})) || ' de ' || year({{0}}), '—')"


@query("expiry_answer", _ONE + f"SELECT id, 'El convenio **' || titulo || '** vence el **' || {_LONG.format('fecha_vencimiento')} || '** (' || estado || ').' AS respuesta FROM one", "agreements")
def expiry_answer(spark, d):
    return A.expiry_answer(V.agreements(spark, d), NAME, index=_trigrams(spark, d))


@query("version_count_answer", _ONE + "SELECT id, 'El convenio **' || titulo || '** tiene **' || (SELECT count(*) FROM versions WHERE convenio_id = one.id) || '** versión(es).' AS respuesta FROM one", "agreements", "versions")
def version_count_answer(spark, d):
    return A.version_count_answer(V.agreements(spark, d), V.versions(spark, d), NAME, index=_trigrams(spark, d))


@query("description_answer", _ONE + "SELECT id, 'Descripción de **' || titulo || '**:' || chr(10) || descripcion AS respuesta FROM one", "agreements")
def description_answer(spark, d):
    return A.description_answer(V.agreements(spark, d), NAME, index=_trigrams(spark, d))


@query("contact_answer", _ONE + "SELECT id, titulo, CAST(NULL AS VARCHAR) AS responsable, CAST(NULL AS VARCHAR) AS area, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS telefono FROM one", "agreements")
def contact_answer(spark, d):
    return A.contact(A.resolved(V.agreements(spark, d), NAME))


_LINE = f"'{{}} v' || numero_version || ' (' || {_LONG.format('fecha_version')} || ') — ' || coalesce(observaciones, '') || chr(10)"


@query("detail_answer", _ONE.rstrip() + f""",
risk AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r FROM analyses WHERE convenio_id = (SELECT id FROM best)),
last AS (SELECT *, row_number() OVER (ORDER BY numero_version DESC) AS r FROM versions WHERE convenio_id = (SELECT id FROM best))
SELECT one.id, 'Detalles del convenio **' || titulo || '**' || chr(10) || '- Estado: ' || estado || chr(10) || '- Fecha de Firma: ' || {_LONG.format('fecha_firma')} || chr(10) || '- Fecha de Vencimiento: ' || {_LONG.format('fecha_vencimiento')} || chr(10)
  || coalesce((SELECT '- Riesgo más reciente: ' || risk_level || ' (score ' || printf('%.3f', score) || ')' || chr(10) FROM risk WHERE r = 1), '')
  || coalesce((SELECT '- Versiones (máx. 10):' || chr(10) || string_agg({_LINE.format('  •')}, '' ORDER BY numero_version DESC) FROM last WHERE r <= 10), '- Aún no hay versiones registradas.' || chr(10)) AS respuesta FROM one""", "agreements", "analyses", "versions")
def detail_answer(spark, d):
    return A.detail_answer(V.agreements(spark, d), V.analyses(spark, d), V.versions(spark, d), NAME, index=_trigrams(spark, d))


@query("versions_answer", _ONE + f"SELECT one.id, 'Versiones del convenio **' || titulo || '**:' || chr(10) || string_agg({_LINE.format('•')}, '' ORDER BY numero_version DESC) AS respuesta FROM one JOIN versions v ON v.convenio_id = one.id GROUP BY one.id, titulo", "agreements", "versions")
def versions_answer(spark, d):
    return A.versions_answer(V.agreements(spark, d), V.versions(spark, d), NAME, index=_trigrams(spark, d))


_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(texto, ''), '\b\d{6,}\b', ' ', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"
_CONTENT = f"""SELECT one.id, 'Contenido de **' || titulo || '** — v' || numero_version || ' (' || coalesce(observaciones, '') || '):' || chr(10) || {_BARE} AS respuesta
FROM one JOIN (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY _ORDER_) AS r FROM versions) v ON v.convenio_id = one.id AND r = 1 WHERE coalesce(texto, '') <> ''"""


@query("content_answer", _ONE + _CONTENT.replace("_ORDER_", "numero_version DESC"), "agreements", "versions")
def content_answer(spark, d):
    return A.content_answer(V.agreements(spark, d), V.versions(spark, d), NAME, index=_trigrams(spark, d))


@query("first_content_answer", _ONE + _CONTENT.replace("_ORDER_", "numero_version"), "agreements", "versions")
def first_content_answer(spark, d):
    return A.content_answer(V.agreements(spark, d), V.versions(spark, d), NAME, "inicial", index=_trigrams(spark, d))


@query("agreements_by_expiry", "SELECT row_number() OVER (ORDER BY agreements.fecha_vencimiento NULLS LAST, id) AS lugar, id, CAST(fecha_vencimiento AS VARCHAR) AS fecha_vencimiento FROM agreements", "agreements")
def agreements_by_expiry(spark, d):
    return A.by_expiry(V.agreements(spark, d), "lugar").select("lugar", "id", _day("fecha_vencimiento"))


@query("agreements_by_signature", "SELECT row_number() OVER (ORDER BY agreements.fecha_firma NULLS LAST, id) AS lugar, id, CAST(fecha_firma AS VARCHAR) AS fecha_firma FROM agreements", "agreements")
def agreements_by_signature(spark, d):
    return A.by_signature(V.agreements(spark, d), "lugar").select("lugar", "id", _day("fecha_firma"))


@query("agreements_by_title", "SELECT row_number() OVER (ORDER BY titulo, id) AS lugar, id, titulo FROM agreements", "agreements")
def agreements_by_title(spark, d):
    return A.by_title(V.agreements(spark, d), "lugar").select("lugar", "id", "titulo")


@query("agreements_in_state", "SELECT row_number() OVER (ORDER BY fecha_vencimiento NULLS LAST, id) AS lugar, id, titulo FROM agreements WHERE estado = 'VENCIDO'", "agreements")
def agreements_in_state(spark, d):
    return A.in_state(V.agreements(spark, d), "vencido", "lugar").select("lugar", "id", "titulo")


@query("versions_by_hint", """w AS (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY numero_version) AS up, row_number() OVER (PARTITION BY convenio_id ORDER BY observaciones LIKE '%final%' DESC, numero_version DESC) AS last FROM versions)
SELECT pedida, convenio_id, CAST(numero_version AS BIGINT) AS numero_version, observaciones FROM w, (VALUES ('2'), ('inicial'), ('final')) p(pedida) WHERE (pedida = '2' AND numero_version = 2) OR (pedida = 'inicial' AND up = 1) OR (pedida = 'final' AND last = 1)""", "versions")
def versions_by_hint(spark, d):
    """Each agreement's version by number, the first, and the final one."""
    v = V.versions(spark, d)
    asked = [A.resolve_version(v, w).select(F.lit(w).alias("pedida"), "convenio_id", F.col("numero_version").cast("long").alias("numero_version"), "observaciones") for w in ("2", "inicial", "final")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


@query("contacts", "SELECT c_custkey AS id, c_name AS titulo, 'Oficina ' || c_nationkey AS responsable, c_mktsegment AS area, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'oficina' || c_custkey || '@entidad.bo' END AS email, CAST(20000 + c_nationkey AS VARCHAR) AS telefono FROM customer")
def contacts(spark, d):
    """The parts of a contact, each from the first of its columns that there is."""
    own = ["c_custkey AS id", "c_name AS titulo", "'otra persona' AS persona_contacto", "concat('Oficina ', c_nationkey) AS responsable_nombre", "c_mktsegment AS unidad", "'otra' AS dependencia"]
    return A.contact(V.read(spark, d, "customer").selectExpr(*own, "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('oficina', c_custkey, '@entidad.bo') END AS correo_contacto", "CAST(20000 + c_nationkey AS STRING) AS telefono_contacto"))


@query("expiring_this_month", "SELECT id, CAST(fecha_vencimiento AS VARCHAR) AS fecha_vencimiento FROM agreements WHERE fecha_vencimiento BETWEEN DATE '1998-06-01' AND DATE '1998-06-30' ORDER BY agreements.fecha_vencimiento, id LIMIT 50", "agreements")
def expiring_this_month(spark, d):
    return A.expiring_between(V.agreements(spark, d), datetime.date(1998, 6, 1), datetime.date(1998, 6, 30)).select("id", _day("fecha_vencimiento"))


@query("analyses_at_level", "SELECT a.id, a.convenio_id, titulo FROM analyses a JOIN agreements g ON g.id = a.convenio_id WHERE risk_level = 'MEDIO' ORDER BY analizado_en DESC, a.id DESC LIMIT 30", "analyses", "agreements")
def analyses_at_level(spark, d):
    return A.analyses_at_level(V.analyses(spark, d), V.agreements(spark, d), "MEDIO").select("id", "convenio_id", "titulo")


@query("title_search", "SELECT id, titulo FROM agreements WHERE titulo ILIKE '%0042%' ORDER BY titulo, id LIMIT 30", "agreements")
def title_search(spark, d):
    return A.title_search(V.agreements(spark, d), "0042").select("id", "titulo")


_BY_ID = """SELECT g.id, g.titulo, r.risk_level, round(r.score, 4) AS score, n.numeros FROM agreements g
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY analizado_en DESC, id DESC) AS k FROM analyses) r ON r.convenio_id = g.id AND r.k = 1
LEFT JOIN (SELECT convenio_id, string_agg(CAST(numero_version AS VARCHAR), ',' ORDER BY numero_version DESC) AS numeros FROM (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY numero_version DESC) AS k FROM versions) WHERE k <= 10 GROUP BY convenio_id) n ON n.convenio_id = g.id WHERE g.id = """


def _by_id(out):
    return out.select("id", "titulo", "risk_level", F.round("score", 4).alias("score"), F.array_join(F.transform("numeros", lambda n: n.cast("string")), ",").alias("numeros"))


@query("detail_by_id", _BY_ID + "42", "agreements", "analyses", "versions")
def detail_by_id(spark, d):
    return _by_id(A.detail_by_id(V.agreements(spark, d), V.analyses(spark, d), V.versions(spark, d), 42))


@query("detail_by_title", _BY_ID + "(SELECT min(id) FROM agreements WHERE titulo ILIKE '%0007%')", "agreements", "analyses", "versions")
def detail_by_title(spark, d):
    return _by_id(A.detail_by_title(V.agreements(spark, d), V.analyses(spark, d), V.versions(spark, d), "0007"))


@query("version_history", """SELECT 'version' AS tipo, CAST(numero_version AS BIGINT) AS numero, observaciones AS texto, strftime(CAST(fecha_version AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS fecha FROM versions WHERE convenio_id = 42
UNION ALL SELECT 'log', numero, accion || ': ' || descripcion, strftime(fecha, '%Y-%m-%d %H:%M:%S') FROM (SELECT *, row_number() OVER (ORDER BY fecha DESC, accion, descripcion) AS numero FROM logs WHERE convenio_id = 42) WHERE numero <= 50""", "versions", "logs")
def version_history(spark, d):
    return A.version_history(V.versions(spark, d), V.logs(spark, d), 42).withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd HH:mm:ss"))


QUESTION = "¿Qué riesgo tiene el convenio de building?"
_SAID = "CASE WHEN coalesce(texto, '') <> '' THEN chr(10) || '    Texto: ' || regexp_replace(texto, '<[^>]+>', '', 'g') ELSE '' END"


@query("grounding", _resolved("de building", ["de", "building"]).rstrip() + f""",
hits AS (SELECT id, updated_at FROM agreements WHERE regexp_matches(lower(titulo), 'que|riesgo|tiene|building') OR regexp_matches(lower(descripcion), 'que|riesgo|tiene|building') ORDER BY updated_at DESC, id DESC LIMIT 8),
ranked AS (SELECT id, updated_at, 0 AS tier FROM one UNION ALL SELECT id, updated_at, 1 FROM hits UNION ALL SELECT * FROM (SELECT id, updated_at, 2 FROM agreements ORDER BY updated_at DESC, id DESC LIMIT 5)),
chosen AS (SELECT id, min(tier) AS tier, max(updated_at) AS updated_at FROM ranked GROUP BY id),
five AS (SELECT * FROM chosen WHERE tier < 2 OR (SELECT min(tier) FROM chosen) = 2 ORDER BY tier, updated_at DESC, id DESC LIMIT 5),
placed AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS place FROM five),
risk AS (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY created_at DESC, id DESC) AS r FROM analyses),
v AS (SELECT convenio_id, string_agg('  * v' || numero_version || ' (' || fecha_version || ') - ' || coalesce(observaciones, '—') || {_SAID}, chr(10) ORDER BY numero_version DESC) AS said FROM (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY numero_version DESC) AS r FROM versions) WHERE r <= 3 GROUP BY convenio_id),
f AS (SELECT convenio_id, string_agg('  * F' || r || ': ' || text, chr(10) ORDER BY r) AS said FROM (SELECT *, row_number() OVER (PARTITION BY convenio_id ORDER BY id DESC) AS r FROM facts) WHERE r <= 3 GROUP BY convenio_id)
SELECT CAST(place AS INTEGER) AS place, CAST(g.id AS VARCHAR) AS id, 'CONVENIO #' || g.id || ': ' || titulo || chr(10) || '- Estado: ' || estado || chr(10) || '- Fecha firma: ' || coalesce(CAST(fecha_firma AS VARCHAR), '—') || chr(10) || '- Fecha vencimiento: ' || coalesce(CAST(fecha_vencimiento AS VARCHAR), '—') || chr(10)
  || '- Descripcion: ' || descripcion || chr(10) || coalesce('- Ultimo riesgo: ' || risk_level || ' (score ' || printf('%.1f', score * 100) || '%)', '- Ultimo riesgo: sin analisis') || chr(10)
  || coalesce('- Versiones recientes:' || chr(10) || v.said, '- Versiones: sin versiones registradas') || coalesce(chr(10) || '- Fragmentos de clausulas/hallazgos:' || chr(10) || f.said, '') AS context
FROM placed JOIN agreements g ON g.id = placed.id LEFT JOIN risk ON risk.convenio_id = g.id AND risk.r = 1 LEFT JOIN v ON v.convenio_id = g.id LEFT JOIN f ON f.convenio_id = g.id
UNION ALL SELECT 0, NULL, 'RESUMEN GLOBAL:' || chr(10) || '- Total convenios: ' || (SELECT count(*) FROM agreements) || chr(10) || '- Por estado: ' || (SELECT string_agg(estado || ': ' || n, ', ' ORDER BY n DESC, estado) FROM (SELECT estado, count(*) AS n FROM agreements GROUP BY estado))""", "agreements", "analyses", "versions", "facts")
def grounding(spark, d):
    return A.grounding(V.agreements(spark, d), V.analyses(spark, d), V.versions(spark, d), V.facts(spark, d), QUESTION, index=_trigrams(spark, d)).withColumn("id", F.col("id").cast("string"))


@query("like_candidates", "SELECT id, titulo, 0 AS tier FROM agreements WHERE lower(titulo) LIKE '%customer%low%' OR lower(descripcion) LIKE '%customer%low%' ORDER BY updated_at DESC, id DESC LIMIT 10", "agreements")
def like_candidates(spark, d):
    return R.like_find(V.agreements(spark, d), "customer low")


# --- texts ---------------------------------------------------------------------------------------------------------------
@query("text_cleanup", r"""SELECT doc_id, sha256(translate(lower(text), 'áéíóúäëïöüñ', 'aeiouaeioun')) AS folded,
  sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '&#\d+;?', ' ', 'g'), '&[A-Za-z0-9#]+;', ' ', 'g'), '[\x00-\x1F\x7F\x{AD}]', ' ', 'g'), '\b\d{6,}\b', ' ', 'g'), '\s+', ' ', 'g'))) AS ocr,
  sha256(trim(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '\s+', ' ', 'g'))) AS line, sha256(translate(regexp_replace(lower(text), '[^\p{L}]+', '', 'g'), 'áéíóúü', 'aeiouu')) AS letters FROM texts""", "texts")
def text_cleanup(spark, d):
    t = F.col("text")
    return V.texts(spark, d).select("doc_id", F.sha2(T.fold(t), 256).alias("folded"), F.sha2(T.ocr_cleanup(t), 256).alias("ocr"), F.sha2(T.one_line(t), 256).alias("line"), F.sha2(T.letters_only(t), 256).alias("letters"))


@query("text_shares", r"SELECT doc_id, round(len(regexp_extract_all(text, '\p{L}')) / length(text), 6) AS letters, round(len(regexp_extract_all(text, '\p{Nd}')) / length(text), 6) AS digits FROM texts WHERE length(text) > 0", "texts")
def text_shares(spark, d):
    t = F.col("text")
    return V.texts(spark, d).where("length(text) > 0").select("doc_id", F.round(T.share(t, r"\p{L}"), 6).alias("letters"), F.round(T.share(t, r"\p{Nd}"), 6).alias("digits"))


_LINES_OF = "string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{A0}]+', ' ', 'g'), chr(10))"
_COUNT = "len(regexp_extract_all({}, '{}'))"
_NOISY = f"x = '' OR NOT regexp_matches(x, '[\\p{{L}}\\p{{Nd}}]') OR ({_COUNT.format('x', '\\p{Nd}')} >= 6 AND {_COUNT.format('x', '\\p{Nd}')} / length(x) >= 0.4)"


@query("text_quality", rf"""SELECT doc_id, CASE WHEN line = '' THEN '—' WHEN length(line) > 80 THEN rtrim(substr(line, 1, 80)) || '...' ELSE line END AS compact,
  sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F\x{{AD}}]', ' ', 'g'), '&#\d+;?', ' ', 'g'), '&[A-Za-z0-9#]+;', ' ', 'g'), '\b\d{{6,}}\b', ' ', 'g'), '\t', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))) AS hard,
  sha256(nullif(array_to_string(list_filter(list_transform({_LINES_OF}, lambda x: trim(x)), lambda x: NOT ({_NOISY})), chr(10)), '')) AS extracted,
  sha256(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), lambda x: NOT regexp_matches(x, '^\s*\d{{5,}}')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')) AS viewer
FROM (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '\s+', ' ', 'g')) AS line FROM texts)""", "texts")
def text_quality(spark, d):
    t = F.col("text")
    return V.texts(spark, d).select("doc_id", T.compact(t, 80).alias("compact"), F.sha2(T.clean_hard(t), 256).alias("hard"), F.sha2(T.clean_extracted(t), 256).alias("extracted"), F.sha2(T.viewer_cleanup(t), 256).alias("viewer"))


@query("text_sentences")
def text_sentences(spark, d):
    """Lengths of what is compared and said, which need expressions that look around: no SQL."""
    t = F.col("text")
    return V.texts(spark, d).select("doc_id", F.length(T.pre_diff(t)).alias("pre_diff"), F.size(T.sentences(t)).alias("sentences"))


@query("names", f"""SELECT p_partkey, trim(both '-' from regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')) AS slug, replace(replace(replace(p_type || ' & <b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
  'convenio con ' || p_name || ' ' || p_name AS expanded, CASE p_size % 5 WHEN 0 THEN 'búsqueda semántica (TF-IDF)' WHEN 1 THEN 'modelo de similitud (frases)' WHEN 2 THEN 'embeddings avanzados' WHEN 3 THEN 'reglas (palabras clave)' ELSE 'motor desconocido' END AS engine FROM part""")
def names(spark, d):
    model = F.element_at(F.array(*map(F.lit, ("TFIDF-svm", "all-MiniLM", "E5-large", "rules", ""))), F.expr("p_size % 5 + 1"))
    return V.read(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.escape_html(F.concat("p_type", F.lit(" & <b>"))).alias("html"), T.expand_query(F.concat(F.lit(" convenio con "), "p_name")).alias("expanded"), T.engine_label(model).alias("engine"))


@query("similar_names")
def similar_names(spark, d):
    """All pairs of distinct part names of 75 percent or more."""
    pairs = R.similar_pairs(V.read(spark, d, "part").select(F.col("p_name").alias("name")), 75.0)
    return pairs.select("a", "b", F.round("percent", 4).alias("percent"), F.levenshtein("a", "b").alias("distance"))


# --- risk --------------------------------------------------------------------------------------------------------------------
_LINES = r"""pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM texts),
lines AS (SELECT doc_id, line, text, sum(length(text) + 1) OVER w - 1 AS stop, last_value(try_cast(nullif(regexp_extract(text, '(?i)(?:p[aá]gina|page)\s+(\d+)', 1), '') AS INTEGER) IGNORE NULLS) OVER w AS page FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING))
"""
_TERMS = """terms AS (SELECT token, severity FROM (SELECT trim(texto) AS token, coalesce(nullif(upper(trim(severity)), ''), 'MEDIUM') AS severity, row_number() OVER (PARTITION BY trim(texto) ORDER BY id DESC) AS r FROM lexicon WHERE activo AND trim(texto) <> '') WHERE r = 1),
parts AS (SELECT doc_id, token, severity, string_split(lower(text), lower(token)) AS p FROM texts JOIN terms ON contains(lower(text), lower(token))),
rows AS (SELECT doc_id, token, severity, unnest(list_transform(p, lambda x: length(x))) AS n, generate_subscripts(p, 1) AS i, len(p) AS pieces FROM parts),
hits AS (SELECT doc_id, token, severity, CAST(sum(n) OVER (PARTITION BY doc_id, token ORDER BY i ROWS UNBOUNDED PRECEDING) + (i - 1) * length(token) AS INTEGER) AS start, i, pieces FROM rows),
matches AS (SELECT doc_id, token, severity, start, start + length(token) AS stop FROM hits WHERE i < pieces)
"""


def _texts(spark, d):
    """The one canonical text that everything below is computed on. The driver's texts are canonical as they are, which the checking SQL relies on."""
    return K.canonical(V.texts(spark, d))


@query("line_index", _LINES + "SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(stop - length(text) AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\", coalesce(page, 1) AS page FROM lines", "texts")
def line_index(spark, d):
    return K.line_index(_texts(spark, d)).select("doc_id", "line", "start", "end", "page")


@query("keyword_matches", _TERMS + "SELECT doc_id, token, severity, start, CAST(stop AS INTEGER) AS \"end\" FROM matches", "texts", "lexicon")
def keyword_matches(spark, d):
    return K.keyword_matches(_texts(spark, d), V.lexicon(spark)).select("doc_id", "token", "severity", "start", "end")


@query("match_summary", _TERMS + "SELECT doc_id, count(*) AS total, count_if(severity = 'HIGH')::BIGINT AS high, count_if(severity = 'MEDIUM')::BIGINT AS medium, count_if(severity = 'LOW')::BIGINT AS low, count(*) AS keywords FROM matches GROUP BY doc_id", "texts", "lexicon")
def match_summary(spark, d):
    return K.summary(K.keyword_matches(_texts(spark, d), V.lexicon(spark)))


_PLACED = _LINES.rstrip() + ",\n" + _TERMS.rstrip() + """,
found AS (SELECT m.doc_id, m.token, m.severity, m.start, CAST(m.stop AS INTEGER) AS stop, CAST(l.line AS INTEGER) AS line, coalesce(l.page, 1) AS page, t.text,
  array_to_string(list_transform(list_filter(regexp_split_to_array(translate(lower(m.token), 'áéíóúäëïöüñ', 'aeiouaeioun'), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 4 AND regexp_matches(w, '[^aeiou]es$') THEN left(w, length(w) - 2) WHEN length(w) > 4 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END), ' ') AS canonical,
  CASE m.severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank
  FROM matches m JOIN lines l ON l.doc_id = m.doc_id AND m.start BETWEEN l.stop - length(l.text) AND l.stop JOIN texts t ON t.doc_id = m.doc_id)
"""


@query("located_matches", _PLACED + "SELECT doc_id, token, start, line, page FROM found", "texts", "lexicon")
def located_matches(spark, d):
    return K.keyword_matches(_texts(spark, d), V.lexicon(spark)).select("doc_id", "token", "start", "line", "page")


def _marked(spark, d):
    return _texts(spark, d).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit("\nSe fija un precio muy preferencial y cantidad total mínima.")).otherwise(F.lit(""))))


@query("pattern_matches", """m AS (SELECT doc_id, text || chr(10) || 'Se fija un precio muy preferencial y cantidad total mínima.' AS text FROM texts WHERE doc_id % 5 = 0),
p AS (SELECT doc_id, text, unnest([{'t': regexp_extract(text, '(?i)(precio).{0,10}(preferencial|preferentes?)'), 's': 'HIGH', 'r': 'precio preferencial'}, {'t': regexp_extract(text, '(?i)(cantidad|orden).{0,12}m[ií]nima'), 's': 'MEDIUM', 'r': 'cantidad mínima'}]) AS h FROM m)
SELECT doc_id, h.t AS token, h.s AS severity, 'pattern' AS source, h.r AS reason, CAST(instr(text, h.t) - 1 AS INTEGER) AS start, CAST(instr(text, h.t) - 1 + length(h.t) AS INTEGER) AS \"end\", CAST(len(string_split(left(text, instr(text, h.t)), chr(10))) AS INTEGER) AS line FROM p""", "texts")
def pattern_matches(spark, d):
    return K.pattern_matches(_marked(spark, d)).drop("page")


_MODELS: dict = {}


def _severities(spark):
    """The severity classifier of the risk analysis, learned from the labelled sentences and the lexicon's terms, once for each application."""
    key = spark.sparkContext.applicationId
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = ML.train_tfidf(ML.training_set(V.seed(spark), S.lexicon_examples(V.lexicon(spark))))
    return _MODELS[key]


@query("classifier_matches")
def classifier_matches(spark, d):
    return K.classifier_matches(K.sentence_scores(_marked(spark, d), _severities(spark)))


#: What the classifier learns from the labelled sentences and the lexicon (:func:`pactlens.operators.learning.weights`), written down for the checking SQL alone.
_LEARNED = [json.loads(row) for row in pkgutil.get_data("pactlens.plans", "severity_weights.jsonl").decode().splitlines()]
_TEXT = lambda t: "'" + t.replace("'", "''") + "'"
_PLAIN = lambda x: f"replace(translate({x}, '{T._ASCII_FROM}', '{T._ASCII_TO}'), 'ß', 'ss')"
_MARGIN = lambda k: f"coalesce({k}, 0) + {_LEARNED[0][3 + ['high', 'low', 'medium'].index(k)]!r}::DOUBLE AS {k}"
#: Sentences, of each distinct one the words' and characters' terms and from them the likeliest class and its probability; those sure enough as sure (doc_id, severity).
_SURE = f"""learned AS MATERIALIZED (SELECT * FROM (VALUES {", ".join(f"({kind}, {_TEXT(t)}, {i!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for kind, t, i, a, b, c in _LEARNED[1:])}) v(kind, term, idf, high, low, medium)),
split AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?…])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(57344), 'g'), chr(57344))), ' ') AS sentence FROM texts),
known AS MATERIALIZED (SELECT DISTINCT sentence FROM split WHERE sentence <> ''),
spoken AS (SELECT sentence, list_filter(regexp_extract_all(lower({_PLAIN("sentence")}), '[a-z0-9]+'), lambda w: length(w) > 1) AS w FROM known),
grams AS (SELECT sentence, 1 AS kind, unnest(w) AS term FROM spoken UNION ALL SELECT sentence, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM spoken
  UNION ALL SELECT sentence, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM spoken),
written AS MATERIALIZED (SELECT sentence, w, count(*) AS n FROM (SELECT sentence, unnest(regexp_extract_all({_PLAIN("lower(sentence)")}, '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM known) GROUP BY sentence, w),
pieces AS (SELECT w, unnest(flatten(list_transform([3, 4, 5], lambda k: list_transform(range(1, length(w) + 4 - k), lambda i: substr(' ' || w || ' ', i, k))))) AS term FROM (SELECT DISTINCT w FROM written)),
held AS (SELECT w, term, count(*) AS times FROM pieces WHERE term IN (SELECT term FROM learned WHERE kind = 4) GROUP BY w, term),
counted AS (SELECT sentence, kind, term, sum(n) AS n FROM (SELECT sentence, kind, term, 1 AS n FROM grams SEMI JOIN learned USING (kind, term) UNION ALL SELECT sentence, 4, term, n * times FROM written JOIN held USING (w)) GROUP BY sentence, kind, term),
lengths AS (SELECT sentence, sqrt(sum((n * idf) ** 2)) AS norm, sum(n * idf * high) AS high, sum(n * idf * low) AS low, sum(n * idf * medium) AS medium FROM counted JOIN learned USING (kind, term) GROUP BY sentence),
margins AS (SELECT sentence, {_MARGIN("high")}, {_MARGIN("low")}, {_MARGIN("medium")} FROM known LEFT JOIN (SELECT sentence, high / coalesce(nullif(norm, 0), 1) AS high, low / coalesce(nullif(norm, 0), 1) AS low, medium / coalesce(nullif(norm, 0), 1) AS medium FROM lengths) USING (sentence)),
classed AS (SELECT sentence, CASE greatest(high, low, medium) WHEN high THEN 'HIGH' WHEN low THEN 'LOW' ELSE 'MEDIUM' END AS severity, 1 / (exp(high - greatest(high, low, medium)) + exp(low - greatest(high, low, medium)) + exp(medium - greatest(high, low, medium))) AS p FROM margins),
sure AS (SELECT doc_id, severity FROM split JOIN classed USING (sentence) WHERE p >= CASE severity WHEN 'HIGH' THEN 0.60 WHEN 'MEDIUM' THEN 0.55 ELSE 0.70 END)"""
_SHAPED = " UNION ALL ".join(f"SELECT doc_id, unnest(list_transform(regexp_extract_all(text, {_TEXT('(?i)' + p)}), lambda x: '{s}')) AS severity FROM texts" for p, s, _ in K.PATTERNS)


# terms, patterns and the classifier's sentences, and a row for each text; the driver's prose holds no pattern
@query("score_service", _TERMS.rstrip() + f",\n{_SURE},\nevery AS (SELECT doc_id, severity FROM matches UNION ALL SELECT doc_id, severity FROM sure UNION ALL {_SHAPED} UNION ALL SELECT doc_id, NULL FROM texts),\n" + "raw AS (SELECT doc_id, tanh(sum(CASE WHEN severity = 'HIGH' THEN 100 WHEN severity = 'MEDIUM' THEN 60 WHEN severity IS NOT NULL THEN 35 ELSE 0 END) / 100 / 3) AS s FROM every GROUP BY doc_id)\nSELECT doc_id, round(s, 4) AS score, CASE WHEN s >= 0.66 THEN 'ALTO' WHEN s >= 0.33 THEN 'MEDIO' ELSE 'BAJO' END AS risk_level FROM raw", "texts", "lexicon")
def score_service(spark, d):
    texts = K.canonical_table(V.texts(spark, d))
    return K.score_service(K.service_matches(texts, V.lexicon(spark), _severities(spark)), texts)


def _analyzed(spark, texts):
    return _analyzed_table(spark, K.canonical_table(texts))


def _analyzed_table(spark, texts):
    return K.analyze(texts, V.lexicon(spark), K.semantic_matches(texts, _severities(spark)), clean=True, founded=True)


_WEIGHTS = "list_reduce(list_prepend(0.0::DOUBLE, list(CASE severity WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.6::DOUBLE WHEN 'LOW' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END ORDER BY start, stop, token, severity)), lambda a, b: a + b)"
_SCORES = f"SELECT doc_id, greatest(0, least(1, {_WEIGHTS} / 7)) AS s, count(*) AS total, count_if(severity = 'HIGH')::BIGINT AS high, count_if(severity = 'MEDIUM')::BIGINT AS medium, count_if(severity = 'LOW')::BIGINT AS low FROM matches GROUP BY doc_id"
_LEVEL = "CASE WHEN s >= 0.8 THEN 'ALTO' WHEN s >= 0.45 THEN 'MEDIO' ELSE 'BAJO' END AS risk_level"


# the driver's prose holds no pattern and no sentence with a risk stem, so its matches are the keywords' and none of them merge
@query("risk_analysis", _TERMS.rstrip() + f",\nraw AS ({_SCORES})\nSELECT t.doc_id, coalesce(round(s, 6), 0) AS score, {_LEVEL}, coalesce(total, 0) AS total, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(total, 0) AS keywords FROM texts t LEFT JOIN raw ON raw.doc_id = t.doc_id", "texts", "lexicon")
def risk_analysis(spark, d):
    return _analyzed(spark, V.texts(spark, d))[1]


#: What stands before a clause, the clause, and the severity that it is found with.
CLAUSES = [
    ("", "Se concede trato preferente al proveedor en cada compra.", "HIGH"), ("", "El proveedor no goza de exclusividad.", "HIGH"), ("", "La entrega se hace en la ciudad.", "HIGH"), ("", "Rige la CANTIDAD MÍNIMA de cien piezas.", "MEDIUM"),
    ("Sin reparos. ", "Hay un presupuesto aprobado.", "MEDIUM"), ("", "Se prevén reemisiones y un menor precio.", "LOW"),
]
_CLAUSE = f"CAST(doc_id % {len(CLAUSES)} + 1 AS INT)"
_pick = lambda k: f"""list_extract([{", ".join(f"'{c[k]}'" for c in CLAUSES)}], {_CLAUSE})"""
_fold = lambda x: f"translate(lower({x}), '{T._FOLD_FROM}', '{T._FOLD_TO}')"
_any = lambda words, x: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query("risk_clauses", f"""planted AS (SELECT doc_id, doc_id % {len(CLAUSES)} AS k, coalesce(text, '') || chr(10) || {_pick(0)} AS before, {_pick(1)} AS clause, {_pick(2)} AS severity FROM documents),
texts AS (SELECT doc_id, before || clause || chr(10) AS text FROM planted),
{_TERMS.rstrip()},
found AS (SELECT doc_id, k, severity, length(before) AS s, length(clause) AS n, {_fold("before || clause || chr(10)")} AS t, {_fold("clause")} AS c FROM planted),
placed AS (SELECT *, strpos(t, c) AS p FROM found WHERE {_any(K.RISK_STEMS, "c")}),
near AS (SELECT *, substr(t, greatest(p - 81, 0) + 1, p - 1 + n + 80 - greatest(p - 81, 0)) AS around FROM placed),
said AS (SELECT * FROM near WHERE NOT {_any(K.NEGATIONS, "around")}),
semantic AS (SELECT doc_id, severity, s + CASE WHEN k = 5 THEN 1 ELSE 0 END AS start, s + n + CASE WHEN k = 5 THEN 4 ELSE 0 END AS stop FROM said UNION ALL SELECT doc_id, severity, s + 2 * n, s + 3 * n FROM said WHERE k = 5),
marks AS (SELECT doc_id, token, severity, start, stop, TRUE AS keyword FROM matches UNION ALL SELECT doc_id, 'CANTIDAD MÍNIMA', 'MEDIUM', s + 8, s + 23, FALSE FROM found WHERE k = 3),
rules AS (SELECT doc_id, {_WEIGHTS} AS r, count(*) AS n, count_if(keyword) AS keywords FROM marks GROUP BY doc_id),
sure AS (SELECT doc_id, sum(CASE severity WHEN 'HIGH' THEN 0.15::DOUBLE WHEN 'MEDIUM' THEN 0.08::DOUBLE ELSE 0.03::DOUBLE END) AS m, count(*) AS n, string_agg(start || '-' || stop, ' ' ORDER BY start || '-' || stop) AS spans FROM semantic GROUP BY doc_id),
scores AS (SELECT t.doc_id, greatest(0, least(1, (coalesce(r, 0) + least(coalesce(m, 0), coalesce(r, 0) * 0.35::DOUBLE)) / 7)) AS s, coalesce(rules.n, 0) + coalesce(sure.n, 0) AS total, coalesce(keywords, 0) AS keywords, coalesce(spans, '') AS spans FROM texts t LEFT JOIN rules ON rules.doc_id = t.doc_id LEFT JOIN sure ON sure.doc_id = t.doc_id)
SELECT doc_id, round(s, 6) AS score, {_LEVEL}, total, CAST(keywords AS BIGINT) AS keywords, spans FROM scores""", "lexicon")
def risk_clauses(spark, d):
    """The analysis of the documents with a clause behind each, which is also given as a semantic match (one kind of clause three times, two of them overlapping)."""
    own = V.texts(spark, d)
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in CLAUSES]), F.expr(_CLAUSE))
    planted = own.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick(0)).alias("before"), pick(1).alias("token"), pick(2).alias("severity"))
    s, n = F.length("before"), F.length("token")
    three = F.array(*[F.struct(a.alias("start"), b.alias("end")) for a, b in ((s, s + n), (s + 1, s + n + 4), (s + 2 * n, s + 3 * n))])
    spans = planted.select("doc_id", "token", "severity", F.inline(F.when(F.col("doc_id") % len(CLAUSES) == 5, three).otherwise(F.slice(three, 1, 1))))
    nowhere = F.lit(None).cast("int")
    semantic = spans.select("doc_id", "token", "severity", F.lit("semantic").alias("source"), F.lit("").alias("reason"), "start", "end", nowhere.alias("page"), nowhere.alias("line"))
    texts = K.canonical_table(planted.select("doc_id", F.concat("before", "token", F.lit("\n")).alias("text")))
    found, told = K.analyze(texts, V.lexicon(spark), semantic, clean=True, keep=lambda m: store.stash(m, "matches"))
    kept = found.where("source = 'semantic'").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("-", "start", "end"))), " ").alias("spans"))
    return told.join(kept, "doc_id", "left").select("doc_id", "score", "risk_level", "total", "keywords", F.coalesce("spans", F.lit("")).alias("spans"))


@query("stored_analysis", _TERMS.rstrip() + f",\nraw AS ({_SCORES})\nSELECT t.doc_id, coalesce(round(s, 6), 0) AS score, {_LEVEL}, coalesce(total, 0) AS total, coalesce(total, 0) AS facts, 'r1' AS run FROM texts t LEFT JOIN raw ON raw.doc_id = t.doc_id", "texts", "lexicon")
def stored_analysis(spark, d):
    """Headers as they come back from the store, with their facts counted there."""
    folder, texts = store.fresh(spark, "analyses"), K.canonical_table(V.texts(spark, d))
    found, told = K.analyze(texts, V.lexicon(spark), K.semantic_matches(texts, _severities(spark)), clean=True, founded=True, keep=lambda m: store.stash(m, "matches"))
    S.write_analysis(told, found, folder, "r1")
    header, facts = S.read_analysis(spark, folder, "r1")
    counted = facts.groupBy("doc_id").agg(F.count("label").alias("facts"))
    return header.join(counted, "doc_id", "left").select("doc_id", "score", "risk_level", "total", F.coalesce("facts", F.lit(0)).alias("facts"), "run")


@query("score_final", _TERMS.rstrip() + f",\nraw AS ({_SCORES})\nSELECT doc_id, round(s, 6) AS score, {_LEVEL} FROM raw", "texts", "lexicon")
def score_final(spark, d):
    return K.score_final(K.keyword_matches(_texts(spark, d), V.lexicon(spark)))


def _located(spark, d):
    return _analyzed(spark, V.texts(spark, d))[0]


def _placed(spark, d):
    """The matches and the canonical texts that they are found in: a table that is written once for both."""
    texts = K.canonical_table(V.texts(spark, d))
    return _analyzed_table(spark, texts)[0], texts


_RANKED = """,
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, canonical, page, line ORDER BY start, stop, token) AS k FROM found),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, token) AS n FROM one WHERE k = 1),
shown AS (SELECT *, CASE WHEN contains(left(text, start), chr(10)) THEN list_extract(string_split(left(text, start), chr(10)), -1) ELSE substr(text, greatest(start - 160, 0) + 1, start - greatest(start - 160, 0)) END AS l,
  CASE WHEN contains(substr(text, stop + 1), chr(10)) THEN string_split(substr(text, stop + 1), chr(10))[1] ELSE substr(text, stop + 1, 220) END AS r FROM kept WHERE n <= 24)
"""


@query("risk_snippets", _PLACED.rstrip() + _RANKED + "SELECT doc_id, CAST(n AS INTEGER) AS n, canonical, page, line, trim(l || substr(text, start + 1, stop - start) || r) AS fragment FROM shown", "texts", "lexicon")
def risk_snippets(spark, d):
    return K.snippets(*_placed(spark, d)).select("doc_id", "n", "canonical", "page", "line", "fragment")


@query("snippet_matches", _PLACED.rstrip() + _RANKED.rstrip() + """,
s AS (SELECT doc_id, n, severity, start - length(l) AS s0, stop + length(r) AS s1 FROM shown)
SELECT s.doc_id, CAST(n AS INTEGER) AS n, CAST(greatest(m.start, s0) - s0 AS INTEGER) AS start, CAST(least(m.stop, s1) - s0 AS INTEGER) AS \"end\", m.token FROM s JOIN matches m ON m.doc_id = s.doc_id AND m.severity = s.severity AND least(m.stop, s1) > greatest(m.start, s0)""", "texts", "lexicon")
def snippet_matches(spark, d):
    located, texts = _placed(spark, d)
    return K.snippet_matches(K.snippets(located, texts), located)


@query("line_matches", _LINES.rstrip() + ",\n" + _TERMS + """SELECT m.doc_id, CAST(l.line AS INTEGER) AS line, CAST(greatest(m.start, l.stop - length(l.text)) - (l.stop - length(l.text)) AS INTEGER) AS start, CAST(least(m.stop, l.stop) - (l.stop - length(l.text)) AS INTEGER) AS \"end\", m.token, m.severity, 'keyword' AS source
FROM matches m JOIN lines l ON l.doc_id = m.doc_id AND least(m.stop, l.stop) > greatest(m.start, l.stop - length(l.text))""", "texts", "lexicon")
def line_matches(spark, d):
    located, texts = _placed(spark, d)
    return K.line_matches(located, K.line_index(texts))


@query("token_frequency", _PLACED + "SELECT doc_id, canonical, count(DISTINCT (page, line)) AS places FROM found GROUP BY doc_id, canonical", "texts", "lexicon")
def token_frequency(spark, d):
    return K.token_frequency(_located(spark, d))


@query("token_style", _PLACED + "SELECT doc_id, canonical, false AS semantic, ['LOW', 'MEDIUM', 'HIGH'][max(rank)] AS severity FROM found GROUP BY doc_id, canonical", "texts", "lexicon")
def token_style(spark, d):
    return K.token_style(_located(spark, d))


@query("match_density", _PLACED + "SELECT doc_id, round(least(1, sum(length(canonical)) / greatest(any_value(n), 1)), 6) AS density FROM (SELECT DISTINCT doc_id, canonical, length(text) AS n FROM found) GROUP BY doc_id", "texts", "lexicon")
def match_density(spark, d):
    """From the matches before overlaps are merged, which has no part in it."""
    texts = K.canonical_table(V.texts(spark, d))
    return K.match_density(K.found_matches(texts, V.lexicon(spark), K.semantic_matches(texts, _severities(spark)), founded=True), texts)


@query("highlight_spans", _PLACED.rstrip() + """,
cuts AS (SELECT DISTINCT doc_id, unnest([start, stop]) AS p FROM found), runs AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM cuts),
painted AS (SELECT r.doc_id, r.p, r.upto, f.severity, row_number() OVER (PARTITION BY r.doc_id, r.p ORDER BY f.rank DESC, f.stop - f.start DESC, f.start, f.token DESC) AS k FROM runs r JOIN found f ON f.doc_id = r.doc_id AND f.start <= r.p AND r.upto <= f.stop),
marked AS (SELECT *, CASE WHEN lag(upto) OVER w = p AND lag(severity) OVER w = severity THEN 0 ELSE 1 END AS fresh FROM painted WHERE k = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM marked)
SELECT doc_id, min(p) AS start, max(upto) AS \"end\", 'keyword' AS source, any_value(severity) AS severity FROM grouped GROUP BY doc_id, g""", "texts", "lexicon")
def highlight_spans(spark, d):
    return K.highlight_spans(_located(spark, d))


@query("findings", _PLACED.rstrip() + """,
first AS (SELECT doc_id, severity, token, min(start) AS p FROM found GROUP BY doc_id, severity, token), told AS (SELECT doc_id, severity, list(token ORDER BY p, token) AS t FROM first GROUP BY doc_id, severity)
SELECT doc_id, severity, array_to_string(t[1:12], '; ') AS tokens, CAST(greatest(len(t) - 12, 0) AS INTEGER) AS more FROM told""", "texts", "lexicon")
def findings(spark, d):
    return A.findings(_located(spark, d))


@query("weak_labels", _PLACED + "SELECT doc_id, coalesce(nullif(trim(substr(text, start + 1, stop - start)), ''), trim(token)) AS text, severity, 'keyword' AS source, page, line FROM found", "texts", "lexicon")
def weak_labels(spark, d):
    return K.weak_labels(*_placed(spark, d)).drop("reason")


# --- vectors -------------------------------------------------------------------------------------------------------------
def _query_vector(spark, d) -> list[float]:
    return list(V.read(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


@query("vector_search", "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) DESC, vec_id LIMIT 10")
def vector_search(spark, d):
    return X.search(V.read(spark, d, "embeddings"), _query_vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query("vector_search_filtered", "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) DESC, vec_id LIMIT 5")
def vector_search_filtered(spark, d):
    return X.search(V.read(spark, d, "embeddings"), _query_vector(spark, d), 5, label=3).withColumn("score", F.round("score", 6))


_INDEXED = "indexed AS (SELECT vec_id, label AS convenio_id, vec_id // 500 AS version_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


def _indexed(spark, d):
    """Vectors by agreement and version: the label, and runs of 500 ids."""
    return V.read(spark, d, "embeddings").selectExpr("vec_id", "CAST(label AS BIGINT) AS convenio_id", "vec_id DIV 500 AS version_id", "embedding")


def _index(spark, d):
    path = store.fresh(spark, "vectors")
    X.write_index(_indexed(spark, d), path)
    return X.open_index(spark, path)


@query("indexed_search", "WITH " + _INDEXED + """,
asked AS (SELECT * FROM indexed ORDER BY vec_id LIMIT 1), filters AS (SELECT unnest([0, 1, 2]) AS search),
scored AS (SELECT search, i.vec_id, i.convenio_id, i.version_id, list_cosine_similarity(i.e, a.e) AS s FROM filters, asked a, indexed i WHERE (search = 0 OR i.convenio_id = 3) AND (search < 2 OR i.version_id = 0))
SELECT search, vec_id, convenio_id, version_id, round(s, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY search ORDER BY round(s, 12) DESC, vec_id) <= 5""")
def indexed_search(spark, d):
    """The first vector's neighbours in the whole index, in agreement 3, and in version 0 of it."""
    index = _index(spark, d)
    asked = index.orderBy("vec_id").select("embedding").first()
    found = [X.search_index(index, list(asked[0]) if asked else [], 5, *own).withColumn("search", F.lit(i)) for i, own in enumerate([(), (3,), (3, 0)])]
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("score", F.round("score", 6))


@query("indexed_search_each", "WITH " + _INDEXED + """,
scored AS (SELECT q.vec_id AS query_id, i.vec_id, list_cosine_similarity(i.e, q.e) AS s FROM indexed q JOIN indexed i ON i.convenio_id = q.convenio_id AND i.version_id = q.version_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, round(s, 6) AS score FROM ranked WHERE rank <= 5""")
def indexed_search_each(spark, d):
    """For each vector whose id is divisible by 100, its neighbours in its own agreement and version."""
    asked = _indexed(spark, d).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return X.search_each(_index(spark, d), asked, 5).withColumn("score", F.round("score", 6))


@query("archetype_matches", "sims AS (SELECT v.vec_id, a.vec_id AS archetype, list_cosine_similarity(v.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS s FROM embeddings v, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 5) a),\nbest AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, archetype) AS r FROM sims)\nSELECT vec_id, archetype, round(s, 6) AS similarity, CASE WHEN s >= 0.8 THEN 'HIGH' WHEN s >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM best WHERE r = 1 AND s >= 0.6")
def archetype_matches(spark, d):
    v = V.read(spark, d, "embeddings")
    return K.archetype_matches(v, v.orderBy("vec_id").limit(5))


ORACLES["archetype_matches"] = "WITH " + ORACLES["archetype_matches"]


# --- lexicon, versions, learning ------------------------------------------------------------------------------------
@query("lexicon_duplicates", "SELECT id, texto, n FROM (SELECT id, texto, count(*) OVER (PARTITION BY lower(trim(texto))) AS n FROM lexicon) WHERE n > 1", "terms")
def lexicon_duplicates(spark, d):
    return L.duplicates(V.terms(spark, d))


_KNOWN = f"""base AS (SELECT unnest(['{"','".join(L.BASE)}']) AS token, unnest(range({len(L.BASE)})) AS place),
every AS (SELECT token, place FROM base UNION ALL SELECT unnest(regexp_extract_all(texto, '\\p{{L}}+')), {len(L.BASE)} FROM lexicon),
known AS (SELECT translate(lower(token), 'áéíóúü', 'aeiouu') AS token, min(place) AS place FROM every GROUP BY 1),
words AS (SELECT id, len(w) AS words, unnest(w) AS raw, unnest(range(len(w))) AS pos FROM (SELECT id, regexp_extract_all(texto, '\\p{{L}}+') AS w FROM terms)),
asked AS (SELECT * FROM (SELECT *, translate(lower(raw), 'áéíóúü', 'aeiouu') AS word FROM words) WHERE length(word) >= 3 AND NOT regexp_matches(raw, '^[A-Z]{{2,}}$') AND word NOT IN (SELECT token FROM known)),
near AS (SELECT word, min(d) AS d FROM (SELECT DISTINCT word, token, place, levenshtein(word, token) AS d FROM (SELECT DISTINCT word FROM asked), known WHERE abs(length(word) - length(token)) <= 2) WHERE d <= CASE WHEN length(word) <= 4 THEN 1 WHEN length(word) <= 7 THEN 2 ELSE 3 END GROUP BY word),
best AS (SELECT n.word, n.d, (SELECT k.token FROM known k WHERE abs(length(n.word) - length(k.token)) <= 2 AND levenshtein(n.word, k.token) = n.d ORDER BY k.place, k.token LIMIT 1) AS token FROM near n)
"""
_SLIPS = "terms AS (SELECT p_partkey AS id, p_name || ' presio descuentoz' AS texto FROM part),\n" + _KNOWN


@query("clause_quality", "terms AS (SELECT id, texto FROM lexicon UNION ALL SELECT 1000 + p_partkey, p_name || ' presioz' FROM part UNION ALL SELECT 900000 + p_partkey, split_part(p_name, ' ', 1) FROM part),\n" + _KNOWN.rstrip() + f""",
shape AS (SELECT id, trim(coalesce(texto, '')) AS t, len(regexp_extract_all(coalesce(texto, ''), '\\p{{L}}')) AS n FROM terms),
why AS (SELECT a.id, min(CASE WHEN b.token IS NOT NULL THEN lpad(CAST(pos AS VARCHAR), 6, '0') || 'posible error: "' || raw || '" -> "' || b.token || '"' END) AS slip, arg_min(raw, pos) AS first, max(words) AS words FROM asked a LEFT JOIN best b ON b.word = a.word GROUP BY a.id)
SELECT s.id, array_to_string(list_filter([CASE WHEN t = '' THEN 'texto vacio' END, CASE WHEN t <> '' AND length(t) < 3 THEN 'demasiado corto' END, CASE WHEN t <> '' AND n < 3 THEN 'muy pocas letras' END, CASE WHEN t <> '' AND n / length(t) < 0.4 THEN 'demasiados simbolos o numeros' END,
  CASE WHEN t <> '' AND NOT contains(t, ' ') AND length(t) >= 8 AND len(list_filter(['{"','".join(L.STEMS)}'], lambda k: contains(lower(t), k))) = 0 AND regexp_matches(lower(t), '[bcdfghjklmnñpqrstvwxyz]{{3,}}') THEN 'palabra incoherente' END,
  CASE WHEN slip IS NOT NULL THEN substr(slip, 7) WHEN words = 1 THEN 'palabra no reconocida: "' || first || '"' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM shape s LEFT JOIN why ON why.id = s.id""", "lexicon")
def clause_quality(spark, d):
    part, lexicon = V.read(spark, d, "part"), V.lexicon(spark)
    terms = lexicon.select("id", "texto").unionByName(part.select((F.col("p_partkey") + 1000).alias("id"), F.concat("p_name", F.lit(" presioz")).alias("texto")))
    terms = terms.unionByName(part.select((F.col("p_partkey") + 900_000).alias("id"), F.substring_index("p_name", " ", 1).alias("texto")))
    return L.clause_quality(terms, L.known_tokens(lexicon)).select("id", F.array_join("reasons", "; ").alias("reasons"))


@query("typo_suggest", _SLIPS + """, first AS (SELECT a.id, a.word, b.token, b.d, row_number() OVER (PARTITION BY a.id ORDER BY pos) AS r FROM asked a JOIN best b ON b.word = a.word)
SELECT id, word, token AS suggestion, CAST(d AS INTEGER) AS distance FROM first WHERE r = 1""", "lexicon")
def typo_suggest(spark, d):
    words = V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(" presio descuentoz")).alias("texto"))
    return L.typo_suggest(words, L.known_tokens(V.lexicon(spark)))


@query("known_tokens", "terms AS (SELECT id, texto FROM lexicon),\n" + _KNOWN + "SELECT token, CAST(place AS INTEGER) AS place FROM known", "terms")
def known_tokens(spark, d):
    return L.known_tokens(V.terms(spark, d))


@query("lexicon_page", "SELECT id, texto, severity FROM lexicon WHERE texto ILIKE '%red%' AND severity = 'HIGH' AND activo ORDER BY texto, id LIMIT 3 OFFSET 3", "terms")
def lexicon_page(spark, d):
    return L.lexicon_page(V.terms(spark, d), " red ", "high", "on", 2, 3).select("id", "texto", "severity")


@query("line_diff")
def line_diff(spark, d):
    t = V.texts(spark, d)
    pairs = t.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("a"), F.regexp_replace("text", r"\n([^\n]*)$", "\nuna línea nueva").alias("b"))
    return D.diff_totals(D.line_diff(pairs, clean=True))


_SHOWN = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^p[áa]gina\\\\s+\\\\d+(\\\\s+de\\\\s+\\\\d+)?$'))"


@query("diff_sides", f"""WITH pairs AS (SELECT x.doc_id, x.text AS a, y.text AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id - 1),
shown AS (SELECT doc_id, {_SHOWN.format("a")} AS a, {_SHOWN.format("b")} AS b FROM pairs WHERE b IS NOT NULL AND a IS NOT NULL)
SELECT doc_id AS pair_id, len(a) AS lines_a, len(b) AS lines_b, md5(array_to_string(a, chr(10))) AS side_a, md5(array_to_string(b, chr(10))) AS side_b, a = b AS same FROM shown WHERE len(a) + len(b) > 0""")
def diff_sides(spark, d):
    """Both sides of each document's diff with the one of the id before, put together again from its rows."""
    t = V.texts(spark, d).where("text IS NOT NULL")
    pairs = t.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("a")).join(t.select((F.col("doc_id") + 1).alias("pair_id"), F.col("text").alias("b")), "pair_id")
    rows = D.line_diff(pairs, normalize=False, clean=True)
    side = lambda own, n: F.sort_array(F.collect_list(F.when(own, F.struct(n, "text"))))
    whole = rows.groupBy("pair_id").agg(side(F.col("op") <= 0, "aNum").alias("a"), side(F.col("op") >= 0, "bNum").alias("b"), F.min(F.col("op") == 0).alias("same"))
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x["text"]), "\n"))
    return whole.select("pair_id", F.size("a").cast("long").alias("lines_a"), F.size("b").cast("long").alias("lines_b"), digest("a").alias("side_a"), digest("b").alias("side_b"), "same")


@query("compare_versions")
def compare_versions(spark, d):
    t = V.texts(spark, d)
    return D.compare(t.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("a"), F.regexp_replace("text", "the", "teh").alias("b")))


@query("severity_classifier")
def severity_classifier(spark, d):
    labels = V.read(spark, d, "labels").join(V.texts(spark, d), "doc_id")
    rows = ML.stratified_split(ML.training_set(labels.select("text", F.when(F.col("quality") == 1, "HIGH").otherwise("LOW").alias("severity"))))
    rows = store.stash(rows, "split")
    model = ML.train_tfidf(rows.where("NOT held_out"), 2000)
    return ML.report(store.stash(model.transform(ML.prepared(rows.where("held_out"))).select("label", "prediction"), "predicted"))


# --- full-text search ------------------------------------------------------------------------------------------------
_STOPPED = ", ".join(f"'{w}'" for w in W.STOP)
_STEM = """CASE WHEN length(w) < 5 THEN w WHEN ends_with(w, 'eses') THEN left(w, -2) WHEN ends_with(w, 'ces') THEN left(w, -3) || 'z' WHEN regexp_matches(w, '[oae]s$') THEN left(w, -2) WHEN regexp_matches(w, '[oae]$') THEN left(w, -1) ELSE w END"""


def _ranked(rows: str, asked: str, keys: str, fits: str = "TRUE") -> str:
    """SQL of the ranked rows (query_id, place, rank, keys): ``rows`` (keys, text) and ``asked`` (query_id, question) are tables."""
    words = lambda text: f"regexp_extract_all(translate(lower(coalesce({text}, '')), '{W._FROM}', '{W._TO}'), '[\\p{{L}}\\p{{N}}]+')"
    near = "1 / (1.005 + 0.05 * exp(abs(x.place - y.place) / 1.5 - 2))"
    of = lambda a: " AND ".join(f"{a}.{k} = h.{k}" for k in keys.split(", "))
    return f"""found AS (SELECT {keys}, unnest({words("text")}) AS w, generate_subscripts({words("text")}, 1) AS place FROM {rows}),
posted AS (SELECT DISTINCT {keys}, {_STEM} AS lexeme, place FROM found WHERE w NOT IN ({_STOPPED})),
wanted AS (SELECT DISTINCT query_id, {_STEM} AS lexeme FROM (SELECT query_id, unnest({words("question")}) AS w FROM {asked}) WHERE w NOT IN ({_STOPPED})),
sized AS (SELECT query_id, count(*) AS n FROM wanted GROUP BY ALL),
hits AS (SELECT query_id, {keys}, lexeme, place FROM wanted JOIN posted USING (lexeme) WHERE {fits}),
whole AS (SELECT query_id, {keys}, n, count(*) AS places FROM hits JOIN sized USING (query_id) GROUP BY ALL HAVING count(DISTINCT lexeme) = n),
paired AS (SELECT h.query_id, {", ".join(f"h.{k}" for k in keys.split(", "))}, 1 - product(1 - 0.1 * sqrt({near})) AS rank FROM whole h JOIN hits x ON x.query_id = h.query_id AND {of("x")} JOIN hits y ON y.query_id = h.query_id AND {of("y")} AND x.lexeme < y.lexeme AND abs(x.place - y.place) BETWEEN 1 AND 100 GROUP BY ALL),
ranked AS (SELECT h.*, round(CASE WHEN h.n = 1 THEN 0.1 * list_sum(list_transform(range(1, places + 1), lambda j: 1.0 / (j * j))) / 1.64493406685 ELSE coalesce(p.rank, 0) END, 9) AS rank FROM whole h LEFT JOIN paired p ON p.query_id = h.query_id AND {of("p")})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, {keys})::INT AS place, round(rank, 6) AS rank, {keys} FROM ranked QUALIFY place <= 12"""


@query("full_text_search", "asked AS (SELECT item_id AS query_id, unnest(string_split(text, '. ')) AS question FROM benchmark),\nnumbered AS (SELECT row_number() OVER (ORDER BY query_id, question) AS query_id, question FROM asked),\n".join(["WITH ", _ranked("documents", "numbered", "doc_id")]))
def full_text_search(spark, d):
    """The best documents for each sentence of the benchmark's items."""
    path = store.fresh(spark, "full-text")
    W.write_index(V.read(spark, d, "documents").select("doc_id", "text"), path, ["doc_id"])
    asked = V.read(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"\. ", -1)).alias("question"))
    numbered = asked.select("question", F.row_number().over(Window.orderBy("item_id", "question")).alias("query_id"))  # the questions
    return W.search(spark, path, numbered).select("query_id", "place", F.round("rank", 6).alias("rank"), "doc_id")


_PIECES = "¿Cuántas piezas se entregan, del convenio 7?"


@query("content_search", "rows AS (SELECT convenio_id, numero_version, texto AS text FROM versions),\nasked AS (SELECT 0 AS query_id, '" + _PIECES + "' AS question UNION ALL SELECT 1, 'piezas del convenio'),\n" + _ranked("rows", "asked", "convenio_id, numero_version", "query_id = 0 OR convenio_id = 7"), "versions")
def content_search(spark, d):
    """B7: a question over the texts of all versions, and one over those of agreement 7."""
    path = store.fresh(spark, "full-text")
    rows = store.stash(V.versions(spark, d).select("convenio_id", "numero_version", F.col("texto").alias("text")), "versions")  # numbered once, read three times
    W.write_index(rows, path, ["convenio_id", "numero_version"])
    found = [W.content_search(rows, path, q, where).withColumn("query_id", F.lit(i)) for i, (q, where) in enumerate([(_PIECES, None), ("piezas del convenio", {"convenio_id": 7})])]
    return found[0].unionByName(found[1]).select("query_id", "place", F.round("rank", 6).alias("rank"), "convenio_id", "numero_version")
