"""Domain views over the driver's tables, the same expressions in Spark SQL and in the checking SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pactlens.seed import SEED

AS_OF = datetime.date(1998, 6, 15)

#: Terms that occur in the invented prose, so that every size has matches. (id, texto, severity, reason, activo)
LEXICON = [
    (1, "ention", "HIGH", "exclusividad", True), (2, "the of", "MEDIUM", "condición", True), (3, "aa", "LOW", "límite", True), (4, "###", "HIGH", "marca", True),
    (5, "menta", "MEDIUM", "precio preferencial", True), (6, "verein", "LOW", "presupuesto", True), (7, "queción", "HIGH", "descuento", True), (8, "thing", None, None, True),
    (9, "  ", "HIGH", "vacía", True), (10, "Thing", "LOW", "repetida", True), (11, "password", "HIGH", "secreto", True), (12, "inactiva", "HIGH", "no cuenta", False),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(
        "o_orderkey AS id", "concat(c_name, ' ', o_orderpriority) AS titulo", "c_mktsegment AS descripcion", "CAST(o_orderdate AS DATE) AS fecha_firma",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 720 AS INT)) END AS fecha_vencimiento",
        "CASE o_orderkey % 4 WHEN 0 THEN 'BORRADOR' WHEN 1 THEN 'NEGOCIACION' WHEN 2 THEN 'CERRADO' ELSE 'VENCIDO' END AS estado",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('convenio_', o_orderkey, '.docx') END AS archivo_path", "o_orderdate AS updated_at",
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS convenio_id", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS numero_version",
        "CAST(l_shipdate AS DATE) AS fecha_version", "CASE WHEN l_returnflag = 'R' THEN 'versión final' ELSE l_linestatus END AS observaciones",
        "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE concat('Se entregan ', CAST(l_quantity AS INT), ' piezas <b>', l_partkey, '</b> del convenio ', l_orderkey, '.') END AS texto",
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days instead of times, so that the latest of an agreement has ties."""
    return read(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS convenio_id", "CAST(ts AS DATE) AS created_at", "CASE event_type WHEN 'error' THEN 'ALTO' WHEN 'purchase' THEN 'MEDIO' ELSE 'BAJO' END AS risk_level", "value / 500 AS score", "ts AS analizado_en")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS convenio_id", "event_id % 20 AS version_id", "concat('Hallazgo ', event_type, ' ', event_id) AS text", "CAST(ts AS DATE) AS created_at")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("user_id AS convenio_id", "event_type AS accion", "concat('evento ', event_id) AS descripcion", "ts AS fecha")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of files, in the order of their ids."""
    return read(spark, sf_dir, "events").selectExpr("user_id AS convenio_id", "event_id AS seq", "CASE event_type WHEN 'click' THEN 'subir' WHEN 'purchase' THEN 'subir_final' WHEN 'error' THEN 'reabrir' ELSE 'quitar' END AS accion")


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')").selectExpr(
        "event_id AS id", "user_id AS convenio_id", "CASE event_type WHEN 'error' THEN 'ALTO_RIESGO' ELSE 'MEDIO_RIESGO' END AS tipo", "concat('Alerta ', event_id) AS mensaje", "event_id % 2 = 0 AS leido",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS fecha_envio", "ts AS created_at",
    )


def _given(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    """Fixed rows as a table. From a list of rows Spark makes one in Python workers of a kind of their own, which stay in each executor for a minute beside those of the query; from an Arrow table it makes it without any."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = StructType.fromDDL(shape)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], to_arrow_schema(kinds)), kinds)


def lexicon(spark: SparkSession) -> DataFrame:
    return _given(spark, LEXICON, "id long, texto string, severity string, reason string, activo boolean")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of the parts' names, many of which are the same, some in capitals or with blanks around them."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('  ', p_name, ' ') ELSE p_name END AS texto", "CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END AS severity",
        "p_type AS reason", "p_partkey % 7 <> 0 AS activo",
    )


def seed(spark: SparkSession) -> DataFrame:
    return _given(spark, [(t, s) for s, own in SEED.items() for t in own], "text string, severity string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


_LITERALS = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) for v in row) + ")" for row in LEXICON)
#: The views for the checking SQL.
SQL = {
    "agreements": """agreements AS (SELECT o_orderkey AS id, c_name || ' ' || o_orderpriority AS titulo, c_mktsegment AS descripcion, CAST(o_orderdate AS DATE) AS fecha_firma,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 720 AS INTEGER) END AS fecha_vencimiento,
  CASE o_orderkey % 4 WHEN 0 THEN 'BORRADOR' WHEN 1 THEN 'NEGOCIACION' WHEN 2 THEN 'CERRADO' ELSE 'VENCIDO' END AS estado,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'convenio_' || o_orderkey || '.docx' END AS archivo_path, o_orderdate AS updated_at FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "versions": """versions AS (SELECT l_orderkey AS convenio_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS numero_version,
  CAST(l_shipdate AS DATE) AS fecha_version, CASE WHEN l_returnflag = 'R' THEN 'versión final' ELSE l_linestatus END AS observaciones,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 'Se entregan ' || CAST(l_quantity AS INTEGER) || ' piezas <b>' || l_partkey || '</b> del convenio ' || l_orderkey || '.' END AS texto FROM lineitem)""",
    "analyses": """analyses AS (SELECT event_id AS id, user_id AS convenio_id, CAST(ts AS DATE) AS created_at, CASE event_type WHEN 'error' THEN 'ALTO' WHEN 'purchase' THEN 'MEDIO' ELSE 'BAJO' END AS risk_level, value / 500 AS score, ts AS analizado_en FROM events)""",
    "facts": "facts AS (SELECT event_id AS id, user_id AS convenio_id, event_id % 20 AS version_id, 'Hallazgo ' || event_type || ' ' || event_id AS text, CAST(ts AS DATE) AS created_at FROM events)",
    "logs": "logs AS (SELECT user_id AS convenio_id, event_type AS accion, 'evento ' || event_id AS descripcion, ts AS fecha FROM events)",
    "uploads": "uploads AS (SELECT user_id AS convenio_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'subir' WHEN 'purchase' THEN 'subir_final' WHEN 'error' THEN 'reabrir' ELSE 'quitar' END AS accion FROM events)",
    "notifications": """notifications AS (SELECT event_id AS id, user_id AS convenio_id, CASE event_type WHEN 'error' THEN 'ALTO_RIESGO' ELSE 'MEDIO_RIESGO' END AS tipo, 'Alerta ' || event_id AS mensaje, event_id % 2 = 0 AS leido,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS fecha_envio, ts AS created_at FROM events WHERE event_type IN ('error', 'purchase'))""",
    "lexicon": f"lexicon AS (SELECT CAST(id AS BIGINT) AS id, texto, severity, reason, activo FROM (VALUES {_LITERALS}) t(id, texto, severity, reason, activo))",
    "terms": """lexicon AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name || ' ' ELSE p_name END AS texto, CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END AS severity,
  p_type AS reason, p_partkey % 7 <> 0 AS activo FROM part)""",
    "texts": "texts AS (SELECT doc_id, text FROM documents)",
}


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("\n" if sql.lstrip().upper().startswith("SELECT") else ",\n") + sql
