"""Sources and sinks. Paths are any that Spark can open."""

from __future__ import annotations

import datetime
import decimal
import io
import math
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.sources import runs

WEAK_LABELS = "file string, text string, severity string, source string, reason string, page int, line int"


def scan(spark: SparkSession, name_or_path: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """SRC01: a table by JDBC options (in parts: :func:`scan_parts`), by name if the catalog has it, else Parquet at the path. Filters and columns reach the source."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name_or_path, **jdbc).load()
    return spark.table(name_or_path) if re.fullmatch(r"\w+(\.\w+)*", name_or_path) and spark.catalog.tableExists(name_or_path) else spark.read.parquet(name_or_path)


def scan_parts(spark: SparkSession, name: str, jdbc: dict[str, str], key: str, rows: int = 1_000_000, most: int = 64, hashed: str | None = None) -> DataFrame:
    """SRC01: a database's table in parts of about ``rows`` rows, at most ``most`` (connections) at a time; every row is in
    one part, those whose key is null too.

    A numeric, date or timestamp key is cut into equal ranges between its least and its greatest value, for which the
    database is asked once. Where its values lie unevenly, or for a key of another type, ``hashed`` is the database's
    own expression of a whole number worked out from the key, 0 or greater (such as ``abs(hashtext(name))``); its
    remainder deals out the rows. An empty table, and a key with one value, is read in one part.
    """
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc["url"]).quoteIdentifier(key)
    read = lambda **more: spark.read.format("jdbc").options(**jdbc, **more)
    low, high, n = read(query=f"SELECT min({quoted}) AS low_end, max({quoted}) AS high_end, count(*) AS all_rows FROM {name}").load().first()
    parts = max(1, min(most, -(-n // rows)))
    if parts == 1 or (low == high and not hashed):
        return read(dbtable=name).load()
    if hashed:
        rest = [f"mod({hashed}, {parts}) = {k}" for k in range(parts)]
        rest[0] = f"({rest[0]} OR {quoted} IS NULL)"
        return spark.read.jdbc(jdbc["url"], name, predicates=rest, properties={k: v for k, v in jdbc.items() if k != "url"})
    if not isinstance(low, int | float | decimal.Decimal | datetime.date):
        raise ValueError(f"a key of type {type(low).__name__} has no ranges: give hashed")
    if isinstance(low, datetime.datetime):
        ends = low.isoformat(sep=" "), high.isoformat(sep=" ")
    elif isinstance(low, datetime.date):
        ends = low.isoformat(), high.isoformat()
    else:
        ends = str(math.floor(low)), str(math.ceil(high) + 1)
    return read(dbtable=name, partitionColumn=key, lowerBound=ends[0], upperBound=ends[1], numPartitions=parts).load()


def first_column(df: DataFrame, *candidates: str) -> str | None:
    """SRC16: the first of the candidate columns that there is."""
    return next((c for c in candidates if c in df.columns), None)


def _labelled(df: DataFrame) -> DataFrame | None:
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if not {"text", "severity"} <= set(df.columns):
        return None
    return df.select("text", F.upper(F.trim("severity")).alias("severity")).dropna()


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """SRC03: labelled sentences from CSV; column names are trimmed and lower-cased, rows with nulls go. Missing columns are an error."""
    found = _labelled(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    if found is None:
        raise ValueError(f"{path}: no columns text and severity")
    return found


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC04: as SRC03, but a missing file or column gives no rows."""
    empty = spark.createDataFrame([], "text string, severity string")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    found = _labelled(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    return empty if found is None else found


def lexicon_examples(lexicon: DataFrame) -> DataFrame:
    """SRC05: terms as training rows."""
    return lexicon.where("activo").select(F.col("texto").alias("text"), F.upper(F.trim("severity")).alias("severity")).dropna()


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """SRC06: (file, text) of the ``*.txt`` below a folder, each whole; bytes that are no UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)

    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.pandas_udf(decoded, "string")("content").alias("text"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC07, SRC08: indexed documents with their vectors, one JSON object a line; joined by key, not by place."""
    return spark.read.schema("convenio_id long, version_id long, fragmento string, meta map<string,string>, embedding array<float>").json(path)


def _docx(content: pd.Series) -> pd.Series:
    def one(raw: bytes) -> str | None:
        try:
            xml = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode("utf-8", "ignore")
        except (zipfile.BadZipFile, KeyError):
            return None
        return re.sub(r"<[^>]+>", "", re.sub(r"</w:(?:p|tr)>", "\n", xml)).strip()

    return content.map(lambda b: one(bytes(b)), na_action="ignore")


def docx_text(content: Column) -> Column:
    """SRC09: the text of DOCX bytes, a line for each paragraph and table row; null if they cannot be read."""
    return F.pandas_udf(_docx, "string")(content)


def extract_texts(files: DataFrame, pdf_text=None) -> DataFrame:
    """SRC10, SRC11: (path, text) of binary files (path, content) by their ending; PDF needs a column function, as no parser is at hand, and is null without one."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(ending == "docx", docx_text(F.when(ending == "docx", F.col("content"))))
    if pdf_text is not None:
        text = text.when(ending == "pdf", pdf_text(F.when(ending == "pdf", F.col("content"))))
    return files.select("path", text.alias("text"))


def stored_or_extracted(versions: DataFrame, extracted: DataFrame) -> DataFrame:
    """SRC12: the stored text, or that of the file where it is null or empty."""
    files = extracted.select(F.col("path").alias("archivo_path"), F.col("text").alias("_file"))
    return versions.join(files, "archivo_path", "left").withColumn("texto", F.coalesce(F.nullif("texto", F.lit("")), "_file")).drop("_file")


def file_facts(files: DataFrame) -> DataFrame:
    """TXT22: hash and size of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))


def write_analysis(header: DataFrame, facts: DataFrame, folder: str, run: str) -> None:
    """SNK01, RSK12: headers and facts of one run, the label as a struct, each header with its number of matches in ``total``.
    A reader sees both tables of the run or neither, and a run written again replaces itself."""
    label = F.struct("severity", "reason", "source").alias("label")
    labelled = facts.select(*[c for c in facts.columns if c not in ("severity", "reason", "source")], label)
    runs.write_run(folder, run, {"analisis_riesgos": header, "riesgo_dataset": labelled})


def read_analysis(spark: SparkSession, folder: str, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The headers and the facts of the committed runs, or of one."""
    return runs.read_runs(spark, folder, "analisis_riesgos", run), runs.read_runs(spark, folder, "riesgo_dataset", run)


def write_weak_labels(rows: DataFrame, path: str) -> None:
    """SNK03."""
    rows.select(*[c.split()[0] for c in WEAK_LABELS.split(", ")]).write.mode("overwrite").csv(path, header=True, escape='"')


def append_index(rows: DataFrame, path: str) -> None:
    """SNK04: an append, where a full rewrite would cost the whole index each time."""
    rows.write.mode("append").parquet(path)


def to_json(df: DataFrame) -> DataFrame:
    """SNK11: one JSON object a row; bytes that are no UTF-8 are replaced."""
    valid = {f.name: F.make_valid_utf8(f.name) for f in df.schema if f.dataType.simpleString() == "string"}
    return df.withColumns(valid).select(F.to_json(F.struct("*")).alias("json"))


def report_row(analysis: DataFrame) -> DataFrame:
    """SNK07: what a report of an analysis says: percent of the score held to 0..1, and the level as it is shown."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    level = F.when(F.col("risk_level") == "ALTO", "Alto").when(F.col("risk_level") == "MEDIO", "Medio").otherwise("Bajo")
    return analysis.withColumns({"porcentaje": F.concat(F.format_number(held * 100, 0), F.lit("%")), "nivel": level})


def save_model(model, path: str) -> None:
    """SNK05: a fitted pipeline, in place of one that is there."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """SNK05."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def index_health(index: DataFrame) -> DataFrame:
    """VEC04: how many documents are indexed, how many have a vector, and of what lengths."""
    return index.agg(F.count("*").alias("docs"), F.count("embedding").alias("vectors"), F.coalesce(F.min(F.size("embedding")), F.lit(0)).alias("least"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("most"))


def repaired(raw: Column) -> Column:
    """TXT26: bytes as text: UTF-8 if they are, else Windows-1252, else ISO-8859-1, in which every byte is a character."""

    def one(b: bytes) -> str:
        for name in ("utf-8", "cp1252"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(b).decode("latin-1")

    def over(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return F.pandas_udf(over, "string")(raw)
