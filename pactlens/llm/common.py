"""Helpers shared by the operators: the cluster's shared folder, lineage cuts and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset a fresh local one serves, but only a session whose tasks all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pactlens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def wide_tasks(spark: SparkSession, cpus: int = 2) -> ResourceProfile | None:
    """Tasks that take ``cpus`` of an executor's cores each, so that fewer run in it at once and each has more of its memory.

    None where tasks cannot ask for that: in local mode, and where an executor is not known to have as many cores.
    """
    master = spark.sparkContext.master
    cluster = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,.*", master)
    cores = int(cluster[1]) if cluster else int(spark.conf.get("spark.executor.cores", "1"))
    if cores < cpus or (master.startswith("local") and not cluster):
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus)).build


def stash(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: work is done once and survives lost executors. ``codec`` is the files' compression, else Spark's own."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stashed: DataFrame) -> None:
    """Remove stashed tables that nothing reads any more."""
    for df in stashed:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores behind as it takes to be no column of ``df``."""
    there = {c.lower() for c in df.columns}
    while wanted.lower() in there:
        wanted += "_"
    return wanted


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", few: int = 200_000, salts: int = 8) -> DataFrame:
    """``left`` joined with a stashed ``right`` that has a key at most once, where a key may hold much of ``left``.

    A right side that is small by count is broadcast; a larger one is repeated for each of ``salts`` parts that the
    rows of a key are dealt to.
    """
    if right.count() <= few:
        return left.join(F.broadcast(right), keys, how)
    salt = free_name(left, "_salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return dealt.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, salt], how).drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by whole-number ``keys`` as tables of whole groups, with the places where groups begin and the end.

    A group may go on over several batches; what is held is a batch and the group that is not yet ended.
    """

    def begins(rows: pa.Table) -> list[int]:
        k = np.stack([rows[c].to_numpy() for c in keys])
        return [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()]

    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        if held and all(held[0][c][0].as_py() == rows[c][-1].as_py() for c in keys):  # still the same group
            held.append(rows)
            continue
        rows = pa.concat_tables([*held, rows])
        last = begins(rows)[-1]
        if last:
            ended = rows.slice(0, last).combine_chunks()
            yield ended, [*begins(ended), last]
        held = [rows.slice(last)]
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield rows, [*begins(rows), rows.num_rows]


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for each end of ``edges`` (u, v); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, halves the paths, and contracts the graph, so the number
    of rounds follows the logarithm of the longest path. Links with a null end are ignored, self-loops keep their node.
    """
    live = stash(edges.select("u", "v").where("u is not null and v is not null"), f"{label}-edges")
    members = stash(live.select(F.col("u").alias("node")).union(live.select("v")).distinct().withColumn("component", F.col("node")), f"{label}-start")
    done, live, round_no = live, live.where("u <> v"), 0
    while not live.isEmpty():
        round_no += 1
        both = live.union(live.select("v", "u"))
        low = stash(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("root"), F.least("u", "low").alias("parent")), f"{label}-low{round_no}")
        up = low.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
        hook = stash(join_hot(low, up, ["parent"], "left").select("root", F.coalesce("above", "parent").alias("parent")), f"{label}-hook{round_no}")
        moved = join_hot(members, hook.select(F.col("root").alias("component"), "parent"), ["component"], "left")
        moved = stash(moved.select("node", F.coalesce("parent", "component").alias("component")), f"{label}-members{round_no}")
        left, right = (hook.select(F.col("root").alias(c), F.col("parent").alias(f"p{c}")) for c in "uv")
        ends = join_hot(join_hot(live, left, ["u"]), right, ["v"]).select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v")
        ends = stash(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{label}-live{round_no}")
        discard(done, low, hook, members)
        done = live = ends
        members = moved
    discard(done)
    return members
