"""Operator 10: URL rules by a sort-merge range join, in DataFrame functions only.

A rule is a host and a path prefix. Written with the host's labels reversed and the path behind, a rule is a prefix
of what it covers, so it spans one interval of the sorted keys and two rules' intervals are nested or apart. A sweep
over rules and urls in key order carries the stack of rules that are open; a url takes the longest one on the stack
that still spans it.

Subdomains: a url is swept once for each trailing part of its host (no more labels than the longest rule host has),
so that host and path stay next to each other in the key. Only parts that some rule names are kept. One part may
hold most urls; its sweep is dealt out over as many salts as its size asks for, and its rules are repeated for each.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule's key with the stack of rules open at it (itself included): those of its host whose path begins its own.

    Prefixes are found by an equi-join on the rule's path cut at each length, not by comparing rules with each other.
    """
    clean = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    cuts = clean.select("host", F.col("path").alias("full"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    cuts = cuts.select("host", "full", F.expr("substring(full, 1, n)").alias("path"))
    opened = cuts.join(clean, ["host", "path"]).groupBy("host", "full").agg(F.collect_list(F.struct(F.length("path").alias("n"), "path", "verdict")).alias("stack"))
    return opened.select("host", F.col("full").alias("path"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", rows_per_task: int = 10_000, few_rules: int = 100_000) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the longest rule that fits, else null) and ``verdict``.

    A null url, or one without ``://``, has an empty host and path and fits no rule. Equal rules with different
    verdicts count as ``allow``; of two fitting rules of one length the one with the longer host wins. Repeated urls
    are judged once. Columns of ``pages`` named as the new ones are replaced. No row is lost or added.
    """
    from pactlens.llm.common import join_hot, stash

    taken = {"host", "path", "rule", "verdict"}
    host, path = host_and_path(F.col(url_col))
    named = pages.select(*[c for c in pages.columns if c not in taken], host.alias("host"), path.alias("path"))
    stacks = rule_stacks(rules)
    told = rules.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("n"), F.count("*").alias("rules")).first()
    deepest, near = told["n"] or 0, F.broadcast if told["rules"] <= few_rules else lambda df: df  # a table with a row for each rule's host at most
    if deepest == 0:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    labels = F.split("host", r"\.", -1)
    ends = F.expr(f"transform(sequence(1, least(size(labels), {deepest})), n -> array_join(slice(labels, size(labels) - n + 1, n), '.'))")
    probes = named.select("host", "path").where("host <> ''").distinct().withColumn("labels", labels)
    probes = probes.select("host", "path", F.explode(ends).alias("part"))
    probes = probes.join(near(stacks.select(F.col("host").alias("part")).distinct()), "part", "left_semi")

    salts = probes.groupBy("part").agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("salts"))
    starts = stacks.join(salts, F.col("host") == F.col("part")).select(
        "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), _reversed_key(F.col("host"), F.col("path")).alias("key"), F.lit(0).alias("kind"), "stack",
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    points = probes.join(near(salts), "part").select(
        "part", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), _reversed_key(F.col("part"), F.col("path")).alias("key"), F.lit(1).alias("kind"),
        F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"), "host", "path",
    )
    order = Window.partitionBy("part", "salt").orderBy("key", "kind")
    swept = starts.unionByName(points).withColumn("stack", F.last("stack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spanning = F.expr("array_max(filter(stack, r -> startswith(path, r.path)))")
    swept = swept.where("kind = 1").select("host", "path", "part", spanning.alias("hit")).where("hit is not null")
    best = F.max(F.struct((F.length("part") + F.col("hit.n")).alias("n"), F.length("part").alias("m"), F.concat("part", "hit.path").alias("rule"), F.col("hit.verdict").alias("verdict")))
    verdicts = swept.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")
    return join_hot(named, stash(verdicts, "url-verdicts"), ["host", "path"], "left").select(*[c for c in named.columns if c not in taken], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op10_url_rules(spark, sf_dir):
    from pactlens.llm.common import table

    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
OP10_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {', '.join(str(r) for r in RULES)}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT p.page_id, p.host, p.path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) FROM rules r WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) FROM rules r WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM p
"""
