"""Risk notifications from a stream of analyses. The reference polls instead; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlens.operators.portfolio import upsert_unread

CHANGES = "convenio_id long, tipo string, mensaje string, fecha_envio timestamp, batch long"


def windowed_levels(analyses: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Analyses (ts, risk_level) counted by window and level; rows later than ``late`` are dropped with the state they would need."""
    return analyses.withWatermark("ts", late).groupBy(F.window("ts", window), "risk_level").agg(F.count("*").alias("n")).select("window.start", "risk_level", "n")


def notify(analyses: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """SNK02 on a stream: of each batch's analyses (convenio_id, risk_level, ts) at high or medium level one change for each agreement and kind is written.

    A batch writes its own changes alone, below its number, so what it costs follows the batch and not the table, and
    one that is run again gives the same. :func:`current` puts them into the notifications.
    """

    def batch(rows: DataFrame, number: int) -> None:
        told = rows.where("risk_level IN ('ALTO', 'MEDIO') AND convenio_id IS NOT NULL")
        told = told.select("convenio_id", F.concat("risk_level", F.lit("_RIESGO")).alias("tipo"), F.concat(F.lit("Riesgo "), F.lower("risk_level")).alias("mensaje"), F.col("ts").alias("fecha_envio"))
        latest = told.groupBy("convenio_id", "tipo").agg(F.max(F.struct("fecha_envio", "mensaje")).alias("m"))
        latest.select("convenio_id", "tipo", "m.mensaje", "m.fecha_envio").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return analyses.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, base: DataFrame, after: int = -1) -> DataFrame:
    """The notifications ``base`` (convenio_id, tipo, mensaje, fecha_envio, leido) with the changes of the batches ``after`` that number put in: a
    table that holds what is current up to a batch, written now and then, is the next base, and only later batches are read."""
    changes = spark.read.schema(CHANGES).parquet(folder).where(F.col("batch") > after)
    return upsert_unread(base, changes.drop("batch"))
