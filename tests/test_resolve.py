import pytest

from pactlens.operators import resolve as R

ROWS = [
    (1, "Convenio marco UMSS", "universidad mayor de san simón", 5), (2, "Convenio marco UPB", None, 4), (3, None, "universidad privada", 3), (4, "Boliviana de Aviación", "boliviana de aviacion", 9), (5, "zzz", "", 1),
    (6, "Convenio marco UMSS", "otra", 7), (7, None, None, 8), (8, "marco convenio umss", "convenio marco UMSS", 2), (9, "Servicio de impuestos nacionales", "marco", 6),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, titulo string, descripcion string, updated_at int")


@pytest.mark.parametrize("name", ["UMSS", "convenio marco umss", "boa", "universidad mayor", "qwxk", "", "a" * 700 + " umss"])
@pytest.mark.parametrize("k", [1, 2, 5, 20])
def test_the_index_finds_what_all_rows_give(spark, tmp_path_factory, name, k):
    path = str(tmp_path_factory.mktemp("tri") / "ix")
    rows = table(spark)
    R.write_trigrams(rows.where("id <= 5"), path)
    R.write_trigrams(rows, path, "append")
    plain = [tuple(r) for r in R.fuzzy_find(rows, name, k).collect()]
    assert len(plain) == min(k, 9)
    assert [tuple(r) for r in R.fuzzy_find(rows, name, k, path).collect()] == plain


def test_a_name_reads_its_own_postings(spark, tmp_path):
    path = str(tmp_path / "ix")
    R.write_trigrams(table(spark), path)
    plan = R.fuzzy_find(table(spark), "umss", index=path)._jdf.queryExecution().toString()
    assert "In(gram, [" in plan and "regexp_split" not in plan and "Cartesian" not in plan
    R.write_trigrams(table(spark, ROWS[:0]), str(tmp_path / "none"))
    assert R.fuzzy_find(table(spark, ROWS[:0]), "umss", index=str(tmp_path / "none")).count() == 0


def by_tiers(rows, name, k):
    for tier, alt in enumerate(R.expand_aliases(name)):
        parts = alt.split()

        def holds(text, parts=parts):
            at = 0
            for p in parts:
                at = (text or "").lower().find(p, at) + 1
                if not at:
                    return False
                at += len(p) - 1
            return text is not None

        hits = sorted((r for r in rows if holds(r[1]) or holds(r[2])), key=lambda r: (-r[3], -r[0]))[:k]
        if hits:
            return [(r[0], r[1], tier) for r in hits]
    return []


@pytest.mark.parametrize("name", ["UMSS", "boa", "sin", "marco umss", "upb", "qwxk", "boliviana de aviacion"])
@pytest.mark.parametrize("k", [1, 3, 10])
def test_words_in_order_by_the_first_name_that_finds_any(spark, name, k):
    found = R.like_find(table(spark), name, k)
    assert [tuple(r) for r in found.collect()] == by_tiers(ROWS, name, k)
    assert found._jdf.queryExecution().toString().count("Relation") <= 2
