"""Several tables written as one: all of a run's tables are there for a reader, or none.

A run's rows go to folders of their own, ``<folder>/<table>/attempt=<attempt>``. Nobody reads them until the
run's one file in ``<folder>/runs`` names the attempt; that file is written under another name and renamed last. A run
that is written again is replaced at that moment, a write that fails leaves what was there before.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, hidden: str, text: str) -> None:
    """A file that is there whole or not at all, in place of one that is there."""
    jvm = spark._jvm
    where, files = _files(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(where.getParent(), hidden)
    files.mkdir(where.getParent(), None, True)
    out = draft.getFileSystem(spark._jsc.hadoopConfiguration()).create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    files.rename(draft, where, options)


def write_run(folder: str, run: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables of ``run`` (any text that is not empty); they may have any columns but ``run`` and ``attempt``."""
    if not run or not tables:
        raise ValueError("a run has a name and tables")
    taken = [t for t, df in tables.items() if {"run", "attempt"} & {c.lower() for c in df.columns}]
    if taken:
        raise ValueError(f"columns run and attempt are the store's own: {taken}")
    spark, attempt = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}/attempt={attempt}")
    told = {"run": run, "attempt": attempt, "schemas": {name: df.schema.json() for name, df in tables.items()}}
    _put(spark, f"{folder}/runs/{hashlib.sha256(run.encode()).hexdigest()}.json", f".{attempt}", json.dumps(told))


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(run, attempt, schemas, at) of the runs whose tables are all there; none where the folder is not there."""
    shape = "run string, attempt string, schemas map<string,string>"
    where, files = _files(spark, f"{folder}/runs")
    if not files.util().exists(where):
        return spark.createDataFrame([], shape + ", at timestamp")
    return spark.read.schema(shape).json(f"{folder}/runs").select("*", F.col("_metadata.file_modification_time").alias("at"))


def read_runs(spark: SparkSession, folder: str, table: str, run: str | None = None) -> DataFrame:
    """The table's rows of all committed runs, or of one, with the column ``run``; its columns are those of the run that
    was committed last (a column that an older run lacks is null there). FileNotFoundError where no run has the table."""
    runs = committed(spark, folder).where(F.col("schemas").getItem(table).isNotNull())
    runs = runs if run is None else runs.where(F.col("run") == run)
    last = runs.orderBy(F.desc("at"), F.desc("attempt")).first()
    if last is None:
        raise FileNotFoundError(f"{folder}: no committed run{'' if run is None else ' ' + run} with a table {table}")
    shape = StructType.fromJson(json.loads(last.schemas[table])).add("attempt", StringType())
    rows = spark.read.schema(shape).parquet(f"{folder}/{table}")
    rows = rows if run is None else rows.where(F.col("attempt") == last.attempt)
    return rows.join(runs.select("attempt", "run"), "attempt").drop("attempt")


def drop_unread(spark: SparkSession, folder: str, table: str) -> int:
    """Remove the attempts of a table that no committed run names, and say how many. Only when nobody writes or reads the folder."""
    kept = {f"attempt={r.attempt}" for r in committed(spark, folder).select("attempt").toLocalIterator()}
    path, gone = spark._jvm.org.apache.hadoop.fs.Path, 0
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for own in files.listStatus(path(f"{folder}/{table}")) if files.exists(path(f"{folder}/{table}")) else ():
        if own.getPath().getName() not in kept:
            files.delete(own.getPath(), True)
            gone += 1
    return gone
