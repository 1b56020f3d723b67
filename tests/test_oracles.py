"""Every query of the registry on the smallest tables; those with SQL against DuckDB."""

import duckdb
import pytest

from pactlens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_similar_names_are_all_pairs_that_reach_the_percentage(spark):
    from itertools import combinations

    from pactlens.functions.text import _common

    names = sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()})
    want = {(a, b) for a, b in combinations(names, 2) if 200 * _common(a.encode(), b.encode()) / (len(a.encode()) + len(b.encode())) >= 75}
    assert {(r.a, r.b) for r in QUERIES["similar_names"](spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 200
