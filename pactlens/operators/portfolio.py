"""Portfolio lists, states, alerts and counts. Dates are compared with an explicit ``as_of``; each rule keeps its own boundary."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH, MEDIUM = "ALTO", "MEDIO"
SORTABLE = ("titulo", "fecha_firma", "fecha_vencimiento", "estado")


def truthy(text: str | bool | None) -> bool:
    """FIL05: the texts that stand for true."""
    return str(text).strip().lower() in ("1", "true", "on", "yes")


def filter_agreements(df: DataFrame, q: str | None = None, states: list[str] | None = None, expires_from: datetime.date | None = None, expires_to: datetime.date | None = None, signed_year: int | None = None, tokens: list[str] | None = None, folded: bool = False) -> DataFrame:
    """FIL01-04, FIL06, FIL07, FIL10: only the predicates given apply. ``%`` and ``_`` in ``q`` keep their LIKE meaning. Years are ranges, so that they reach the scan. ``folded`` looks for tokens in texts without accents."""
    if q:
        like = f"%{q.lower()}%"
        df = df.where(F.lower("titulo").like(like) | F.lower("descripcion").like(like))
    if states:
        df = df.where(F.col("estado").isin(states))
    if expires_from:
        df = df.where(F.col("fecha_vencimiento") >= F.lit(expires_from))
    if expires_to:
        df = df.where(F.col("fecha_vencimiento") <= F.lit(expires_to))
    if signed_year:
        df = df.where(F.col("fecha_firma").between(F.lit(datetime.date(signed_year, 1, 1)), F.lit(datetime.date(signed_year, 12, 31))))
    if tokens:
        from pactlens.functions.text import ascii_fold

        hit, low = F.lit(False), (lambda c: F.lower(ascii_fold(F.col(c)))) if folded else F.lower
        for t in tokens:
            hit = hit | low("titulo").like(f"%{t}%") | low("descripcion").like(f"%{t}%")
        df = df.where(F.coalesce(hit, F.lit(False)))
    return df


def contains_literal(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """FIL12: case-insensitive, without wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return df.where(hit)


def sorted_page(df: DataFrame, sort: str = "fecha_vencimiento", descending: bool = False, page: int = 1, per: int = 10, id_col: str = "id") -> DataFrame:
    """SRT01-04: a page in a total order. Ascending puts nulls last, descending first; a column that is not ``SORTABLE`` falls back to the expiry."""
    sort = sort if sort in SORTABLE else "fecha_vencimiento"
    order = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(order, F.col(id_col).desc() if descending else F.col(id_col)).offset((max(1, page) - 1) * max(1, per)).limit(max(1, per))


def page_size(per: int | str | None, default: int = 10, most: int | None = None) -> int:
    """SRT02: a whole number over 0, at most ``most``; anything else is the default."""
    try:
        n = int(per)
    except (TypeError, ValueError):
        return default
    return default if n <= 0 else n if most is None else min(n, most)


def newest_page(df: DataFrame, page: int, per: int, *columns: str) -> DataFrame:
    """SRT04: a page by ``columns``, newest first, nulls before all."""
    return df.orderBy(*[F.col(c).desc_nulls_first() for c in columns]).offset((max(1, page) - 1) * per).limit(per)


def analysis_history(analyses: DataFrame, agreement: int, page: int = 1, per: int = 10) -> DataFrame:
    """RSK14, PRJ04: a page of an agreement's analyses, the newest first, times in ISO-8601."""
    from pactlens.functions.text import iso_time

    out = newest_page(analyses.where(F.col("convenio_id") == agreement), page, per, "analizado_en", "id")
    return out.withColumns({c: iso_time(F.col(c)) for c in ("analizado_en", "created_at", "updated_at") if c in out.columns})


def risk_dataset_page(facts: DataFrame, version: int, page: int = 1, per: int | str | None = 20) -> DataFrame:
    """RSK15: a page of a version's match facts, the newest first; ``per`` is 100 at most."""
    return newest_page(facts.where(F.col("version_id") == version), page, page_size(per, 20, 100), "created_at", "id")


def page_meta(df: DataFrame, page: int, per: int) -> DataFrame:
    """SRT03: page, per, total, has_more."""
    return df.agg(F.count("*").alias("total")).select(F.lit(page).alias("page"), F.lit(per).alias("per"), "total", (F.lit(page * per) < F.col("total")).alias("has_more"))


def days_left(as_of: datetime.date) -> Column:
    """PRJ03, signed."""
    return F.datediff(F.col("fecha_vencimiento"), F.lit(as_of))


def expiry_badge(as_of: datetime.date) -> Column:
    """PRJ07."""
    d = days_left(as_of)
    return F.when(d < 0, F.concat(F.lit("Vencido "), -d, F.lit("d"))).when(d == 0, "Vencido hoy").otherwise(F.concat(d, F.lit("d")))


MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def long_date(date: Column) -> Column:
    """PRJ05: day, month and year in Spanish words; a dash for null."""
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date))
    return F.coalesce(F.concat(F.dayofmonth(date), F.lit(" de "), name, F.lit(" de "), F.year(date)), F.lit("—"))


def derive_state(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """STA01: closed stays; past its expiry (before ``as_of``) expired; else by whether there is a file."""
    state = F.when(F.col("estado") == "CERRADO", "CERRADO").when(F.col("fecha_vencimiento") < F.lit(as_of), "VENCIDO").when(F.col("archivo_path").isNotNull(), "NEGOCIACION").otherwise("BORRADOR")
    return df.withColumn("estado", state)


def refresh_on_list(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """STA02: what is not closed and past its expiry becomes expired; a null state stays."""
    return df.withColumn("estado", F.when((F.col("fecha_vencimiento") < F.lit(as_of)) & (F.col("estado") != "CERRADO"), "VENCIDO").otherwise(F.col("estado")))


def refresh_closed(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """STA03: closed and past its expiry becomes expired; :func:`refresh_closed_count` tells how many do."""
    return df.withColumn("estado", F.when((F.col("fecha_vencimiento") < F.lit(as_of)) & (F.col("estado") == "CERRADO"), "VENCIDO").otherwise(F.col("estado")))


def refresh_closed_count(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """STA03: how many agreements :func:`refresh_closed` changes."""
    return df.agg(F.count_if((F.col("fecha_vencimiento") < F.lit(as_of)) & (F.col("estado") == "CERRADO")).alias("updated"))


def upload_transitions(agreements: DataFrame, events: DataFrame) -> DataFrame:
    """STA06: (id, estado, rechazados) after the events (convenio_id, seq, accion) of each agreement, in order of seq.

    ``subir`` takes a draft to negotiation and is refused when closed; ``subir_final`` closes, and is refused when
    closed; ``reabrir`` takes closed back to negotiation and is refused otherwise; ``quitar`` (the file goes) makes a
    draft of what is neither closed nor expired. Unknown and null actions change nothing. The fold is over one
    agreement's events.
    """
    done = events.groupBy(F.col("convenio_id").alias("id")).agg(F.expr("transform(sort_array(collect_list(struct(seq, accion))), e -> e.accion)").alias("acciones"))
    closed, upload = lambda a: a["estado"] == "CERRADO", lambda e: e.isin("subir", "subir_final")
    refused = lambda a, e: (upload(e) & closed(a)) | ((e == "reabrir") & ~closed(a))

    def step(a: Column, e: Column) -> Column:
        after = F.when(refused(a, e), a["estado"]).when(e == "subir_final", "CERRADO").when((e == "subir") & (a["estado"] == "BORRADOR"), "NEGOCIACION")
        after = after.when(e == "reabrir", "NEGOCIACION").when((e == "quitar") & ~a["estado"].isin("CERRADO", "VENCIDO"), "BORRADOR").otherwise(a["estado"])
        return F.struct(after.alias("estado"), (a["no"] + F.when(refused(a, e), 1).otherwise(0)).alias("no"))

    start = F.struct(F.coalesce("estado", F.lit("BORRADOR")).alias("estado"), F.lit(0).alias("no"))
    folded = agreements.join(done, "id", "left").withColumn("f", F.aggregate(F.coalesce("acciones", F.array().cast("array<string>")), start, step))
    return folded.select("id", F.col("f.estado").alias("estado"), F.col("f.no").alias("rechazados"))


def expired_list(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """STA04: closed or expired with expiry up to and including ``as_of``, closed shown as expired."""
    return df.where(F.col("estado").isin("CERRADO", "VENCIDO") & (F.col("fecha_vencimiento") <= F.lit(as_of))).withColumn("estado", F.lit("VENCIDO"))


def recompute_state(df: DataFrame, versions: DataFrame, as_of: datetime.date) -> DataFrame:
    """STA05: like STA01, but a closed one can expire, and having any version counts as a file."""
    seen = versions.select(F.col("convenio_id").alias("id"), F.lit(True).alias("_versioned")).distinct()
    past = F.col("fecha_vencimiento") < F.lit(as_of)
    state = F.when((F.col("estado") == "CERRADO") & past, "VENCIDO").when(F.col("estado") == "CERRADO", "CERRADO").when(F.col("archivo_path").isNotNull() | F.col("_versioned"), "NEGOCIACION").otherwise("BORRADOR")
    return df.join(seen, "id", "left").withColumn("estado", state).drop("_versioned")


def latest_with_ties(analyses: DataFrame) -> DataFrame:
    """JON02: all rows of the latest ``created_at`` of each agreement; null times never count."""
    w = Window.partitionBy("convenio_id").orderBy(F.desc("created_at"))
    return analyses.where("created_at IS NOT NULL").withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def latest_row(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """WIN01, WIN02: one row per key, the first in a total order."""
    return last_rows(df, key, 1, *order)


def last_rows(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """WIN03: the first ``n`` rows per key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest_risk_by_level(analyses: DataFrame, agreements: DataFrame, level: str) -> DataFrame:
    """A11, JON01: agreements whose latest analysis has the level, with its score."""
    found = latest_with_ties(analyses).where(F.col("risk_level") == level)
    return found.select("convenio_id", F.col("id").alias("analysis_id"), "created_at", "score").join(agreements.select(F.col("id").alias("convenio_id"), "titulo", "estado"), "convenio_id")


def expiry_alerts(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """ALR01: past only when closed or expired, then 0-30 days high and 31-90 medium; drafts give none."""
    d = df.where(F.col("estado").isin("NEGOCIACION", "CERRADO", "VENCIDO")).withColumn("dias", days_left(as_of))
    level = F.when((F.col("dias") < 0) & F.col("estado").isin("CERRADO", "VENCIDO"), HIGH).when(F.col("dias").between(0, 30), HIGH).when(F.col("dias").between(31, 90), MEDIUM)
    text = F.when(F.col("dias") < 0, "Convenio vencido.").when(level == HIGH, "Vencimiento en ≤ 30 días").otherwise("Vencimiento en 31–90 días")
    shown = F.when((F.col("dias") < 0) & (F.col("estado") == "CERRADO"), "VENCIDO").otherwise(F.col("estado"))
    d = d.withColumns({"nivel": level, "mensaje": text, "estado": shown}).where("nivel IS NOT NULL")
    return d.select(F.col("id").alias("convenio_id"), "titulo", "estado", F.lit("vencimiento").alias("motivo"), "nivel", "dias", "mensaje", F.lit(None).cast("timestamp").alias("momento"))


def alert_detail(motive: Column, level: Column, state: Column) -> Column:
    """PRJ08: why an alert is shown."""
    return F.when(motive != "vencimiento", "Detectado por análisis de riesgo").when(level != HIGH, "Vencimiento en 31–90 días").when(F.upper(state) == "VENCIDO", "Convenio vencido.").otherwise("Vencimiento en ≤ 30 días")


def risk_alerts(notifications: DataFrame, agreements: DataFrame) -> DataFrame:
    """ALR02: the latest risk notification of each agreement in negotiation; null send times come first."""
    risky = notifications.where(F.col("tipo").isin("ALTO_RIESGO", "MEDIO_RIESGO"))
    open_ = agreements.where("estado = 'NEGOCIACION'").select(F.col("id").alias("convenio_id"), "titulo", "estado")
    latest = latest_row(risky.join(open_, "convenio_id"), "convenio_id", F.col("fecha_envio").desc_nulls_first(), F.col("created_at").desc_nulls_first(), F.desc("id"))
    return latest.select("convenio_id", "titulo", "estado", F.lit("analisis").alias("motivo"), F.when(F.col("tipo") == "ALTO_RIESGO", HIGH).otherwise(MEDIUM).alias("nivel"), F.lit(None).cast("int").alias("dias"), "mensaje", F.coalesce("fecha_envio", "created_at").cast("timestamp").alias("momento"))


def alerts(agreements: DataFrame, notifications: DataFrame, as_of: datetime.date) -> DataFrame:
    """ALR03, JON13: expiry alerts, then risk alerts of agreements that have none."""
    expiry = expiry_alerts(agreements, as_of)
    return expiry.unionByName(risk_alerts(notifications, agreements).join(expiry.select("convenio_id"), "convenio_id", "left_anti"))


def numbered(df: DataFrame, place: str, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its places (long, from 1) in the total order ``by`` and ``order``, counted anew for each value of ``by``.

    The rows are written once in ranges of the order; a range's first places follow from how many rows the ranges before
    it hold, so no task sees more than a range. Values of ``by`` (names of columns) must be few: what is counted is kept
    for each range and value. Null values of ``by`` are a value.
    """
    from pactlens.sources.store import stash

    part, before, own = free_names(df, "part", "before", "own")
    ranged = stash(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(part, F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(part, *by).agg(F.count("*").alias(own))
    ahead = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.withColumn(before, F.coalesce(F.sum(own).over(ahead), F.lit(0))).drop(own)
    met = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (part, *by)]
    rows = ranged.alias("r").join(F.broadcast(counts.alias("c")), met).select("r.*", F.col(f"c.{before}"))
    first = F.row_number().over(Window.partitionBy(part, *by).orderBy(*order))
    return rows.withColumn(place, F.col(before) + first).drop(part, before)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has."""
    there = {c.lower() for c in df.columns}
    return [next(n for n in (f"_{w}{'_' * k}" for k in range(len(there) + 1)) if n not in there) for w in wanted]


def alert_feed(agreements: DataFrame, notifications: DataFrame, as_of: datetime.date, now: datetime.datetime) -> DataFrame:
    """ALR03, SRT09: the alerts with their place within their level (high and medium are lists of their own), newest first, and the number of all as ``badge``.

    An expiry alert is of ``now``. Ties go by agreement. Places come from ranges (:func:`numbered`), so a level that
    holds a third of a portfolio is not one task's.
    """
    feed = alerts(agreements, notifications, as_of).withColumn("momento", F.coalesce("momento", F.lit(now)))
    feed = numbered(feed, "lugar", F.desc("momento"), F.asc("convenio_id"), by=("nivel",))
    feed = feed.withColumn("detalle", alert_detail(F.col("motivo"), F.col("nivel"), F.col("estado")))
    return feed.crossJoin(F.broadcast(feed.agg(F.count("*").alias("badge"))))  # one row


def dashboard_overview(agreements: DataFrame, analyses: DataFrame, as_of: datetime.date) -> DataFrame:
    """ALR04, AGG09, SET02: distinct agreements at high and medium alert, high first, and how many have expired (``as_of`` included)."""
    d = days_left(as_of)
    by_date = agreements.select(F.col("id").alias("convenio_id"), F.when(d <= 30, 2).when(d <= 90, 1).alias("level"))
    by_risk = latest_with_ties(analyses).select("convenio_id", F.when(F.col("risk_level") == HIGH, 2).when(F.col("risk_level") == MEDIUM, 1).alias("level"))
    top = by_date.unionByName(by_risk).where("level IS NOT NULL").groupBy("convenio_id").agg(F.max("level").alias("level"))
    counts = top.agg(F.count_if(F.col("level") == 2).alias("altos"), F.count_if(F.col("level") == 1).alias("medios"))
    return counts.crossJoin(agreements.agg(F.count_if(d <= 0).alias("vencidos")))  # one row each


def dashboard_summary(agreements: DataFrame, notifications: DataFrame, as_of: datetime.date) -> DataFrame:
    """ALR05: unread notifications, expired (``as_of`` included), expiring in the next 30 days (both ends included)."""
    d = days_left(as_of)
    return agreements.agg(F.count_if(d <= 0).alias("vencidos"), F.count_if(d.between(0, 30)).alias("proximos_30")).crossJoin(notifications.agg(F.count_if(~F.col("leido")).alias("no_leidas")))


def count_by_state(df: DataFrame) -> DataFrame:
    """AGG02."""
    return df.groupBy("estado").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "estado")


def state_summary(df: DataFrame) -> DataFrame:
    """AGG12: one row, ``estado: n`` of each state, the most frequent first."""
    counts = df.groupBy("estado").agg(F.count("*").alias("n"))
    ordered = F.expr("sort_array(collect_list(struct(-n AS k, estado)))")
    return counts.agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.coalesce(x["estado"], F.lit("")), F.lit(": "), -x["k"])), ", ").alias("resumen"))


def single_version(agreements: DataFrame, versions: DataFrame) -> DataFrame:
    """AGG04, A13: agreements with exactly one version."""
    once = versions.groupBy("convenio_id").agg(F.count("*").alias("n")).where("n = 1").select(F.col("convenio_id").alias("id"))
    return agreements.join(once, "id", "left_semi")


def next_version(agreements: DataFrame, versions: DataFrame) -> DataFrame:
    """AGG05: one more than the highest version number, 1 without any."""
    top = versions.groupBy(F.col("convenio_id").alias("id")).agg(F.max("numero_version").alias("top"))
    return agreements.join(top, "id", "left").select("id", (F.coalesce("top", F.lit(0)) + 1).alias("siguiente"))


def detail(agreements: DataFrame, analyses: DataFrame, versions: DataFrame, n_versions: int = 10) -> DataFrame:
    """JON06, A17: each agreement with its latest risk and its last versions, numbers descending."""
    risk = latest_row(analyses, "convenio_id", F.desc("created_at"), F.desc("id")).select(F.col("convenio_id").alias("id"), "risk_level", F.round("score", 4).alias("score"))
    last = last_rows(versions, "convenio_id", n_versions, F.desc("numero_version")).groupBy(F.col("convenio_id").alias("id")).agg(F.sort_array(F.collect_list("numero_version"), asc=False).alias("numeros"))
    return agreements.select("id", "titulo", "estado").join(risk, "id", "left").join(last, "id", "left")


def default_pair(versions: DataFrame) -> DataFrame:
    """DIF03: the two highest version numbers of each agreement that has two."""
    pair = last_rows(versions, "convenio_id", 2, F.desc("numero_version")).groupBy("convenio_id").agg(F.min("numero_version").alias("base"), F.max("numero_version").alias("comparada"), F.count("*").alias("n"))
    return pair.where("n = 2").drop("n")


def upsert_unread(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """SNK02: incoming (convenio_id, tipo, mensaje, fecha_envio) update the unread row of their agreement and kind, or are added unread.

    Only the two risk kinds with an agreement count; of several incoming for one key the latest, then the last message, wins.
    """
    fresh = incoming.where(F.col("convenio_id").isNotNull() & F.col("tipo").isin("ALTO_RIESGO", "MEDIO_RIESGO"))
    fresh = fresh.groupBy("convenio_id", "tipo").agg(F.max(F.struct("fecha_envio", "mensaje")).alias("new"))
    unread = existing.where("NOT leido")
    updated = unread.join(fresh, ["convenio_id", "tipo"], "left").withColumns({"mensaje": F.coalesce("new.mensaje", "mensaje"), "fecha_envio": F.coalesce("new.fecha_envio", "fecha_envio")}).select("convenio_id", "tipo", "mensaje", "fecha_envio", "leido")
    added = fresh.join(unread.select("convenio_id", "tipo"), ["convenio_id", "tipo"], "left_anti").select("convenio_id", "tipo", "new.mensaje", "new.fecha_envio", F.lit(False).alias("leido"))
    return existing.where("leido").select("convenio_id", "tipo", "mensaje", "fecha_envio", "leido").unionByName(updated).unionByName(added)


def delete_cascade(agreements: DataFrame, versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK10: without the agreements in ``gone`` (id) and their versions."""
    return agreements.join(gone, "id", "left_anti"), versions.join(gone.select(F.col("id").alias("convenio_id")), "convenio_id", "left_anti")
