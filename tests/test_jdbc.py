"""A database's table read in parts; the database is the one that Spark brings."""

import datetime

import pytest
from pyspark.sql import functions as F

from pactlens.sources import io as S


@pytest.fixture(scope="module")
def jdbc(spark):
    options = {"url": "jdbc:derby:memory:scans;create=true"}
    df = spark.range(1000).select((F.col("id") * 7 - 900).alias("K"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("GAPS"), F.expr("date_add(DATE'2020-01-01', CAST(id AS INT))").alias("DAY"), F.expr("timestamp_micros(id * 1000000)").alias("AT"), F.concat(F.lit("n"), F.col("id") % 13).alias("NAME"), F.lit(3).alias("ONE"))
    df.write.format("jdbc").options(**options, dbtable="ROWS_T", createTableColumnTypes="NAME VARCHAR(20)").save()
    df.where("false").write.format("jdbc").options(**options, dbtable="NONE_T").save()
    return options


@pytest.mark.parametrize("key", ["K", "GAPS", "DAY", "AT"])
def test_ranges_of_a_key(spark, jdbc, key):
    df = S.scan_parts(spark, "ROWS_T", jdbc, key, rows=150)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert df.rdd.getNumPartitions() == 7 and sum(sizes) == df.select("K").distinct().count() == 1000
    assert max(sizes) < 300
    assert S.scan_parts(spark, "ROWS_T", jdbc, key, rows=10, most=5).rdd.getNumPartitions() == 5


def test_filters_and_columns_reach_the_database(spark, jdbc):
    df = S.scan_parts(spark, "ROWS_T", jdbc, "DAY", rows=150).where("K > 100").select("NAME")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(K), *GreaterThan(K,100)]" in plan and "ReadSchema: struct<NAME:string>" in plan and "numPartitions=7" in plan
    assert df.count() == sum(7 * i - 900 > 100 for i in range(1000))


def test_hashed_parts_one_value_and_empty(spark, jdbc):
    df = S.scan_parts(spark, "ROWS_T", jdbc, "GAPS", rows=150, hashed='"GAPS"')
    assert df.rdd.getNumPartitions() == 7 and df.count() == df.select("K").distinct().count() == 1000
    assert df.where("GAPS IS NULL").count() == 100
    assert [S.scan_parts(spark, t, jdbc, k, rows=150).rdd.getNumPartitions() for t, k in [("ROWS_T", "ONE"), ("NONE_T", "K")]] == [1, 1]
    assert S.scan_parts(spark, "NONE_T", jdbc, "K").count() == 0
    with pytest.raises(ValueError, match="hashed"):
        S.scan_parts(spark, "ROWS_T", jdbc, "NAME", rows=150)
    assert S.scan(spark, "ROWS_T", jdbc).agg(F.min("DAY")).first()[0] == datetime.date(2020, 1, 1)
