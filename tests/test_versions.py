import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.operators import diff as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14))
def test_edit_scripts_rebuild_both_sides_with_the_fewest_edits(a, b):
    i = k = kept = 0
    last = None
    for op, n in D.edit_script(a, b):
        assert n > 0 and op != last and (last, op) != (1, -1)
        if op == 0:
            assert a[i : i + n] == b[k : k + n]
            kept += n
        i, k, last = i + n * (op <= 0), k + n * (op >= 0), op
    assert (i, k) == (len(a), len(b)) and kept == lcs(a, b)


def test_long_texts_with_few_changes_are_quick():
    a = list(range(200_000))
    b = [x for x in a if x % 1000] + [7, 8]
    assert sum(n for op, n in D.edit_script(a, b) if op) == 202


def rows(spark, a, b, **more):
    df = spark.createDataFrame([(1, a, b)], "pair_id long, a string, b string")
    return [tuple(r)[2:] for r in D.line_diff(df, **more).orderBy("seq").collect()]


def test_diff_counts_shown_lines_and_pages(spark):
    a = "uno\n\nPágina 2 de 9\ndos\nvieja línea aquí\nfin de todo"
    b = "uno\nPágina 3\ndos\nnueva línea aquí\n\nfin de todo"
    assert rows(spark, a, b, normalize=False) == [
        (0, 1, 1, 1, 1, "uno"), (0, 2, 2, 2, 3, "dos"), (-1, 3, None, 2, None, "vieja línea aquí"), (1, None, 3, None, 3, "nueva línea aquí"), (0, 4, 4, 2, 3, "fin de todo"),
    ]
    assert rows(spark, None, "a", normalize=False) == [(1, None, 1, None, 1, "a")]
    assert rows(spark, "", "", normalize=False) == []
    assert [r[0] for r in rows(spark, "El c0ntrato vale mucho\r\n12345678-9 El plazo corre", "El contrato  vale mucho\nEl plazo corre")] == [0, 0]


def test_diff_totals_and_search(spark):
    df = D.line_diff(spark.createDataFrame([(1, "a b c d\nx y z w", "a b c d\nX y z v")], "pair_id long, a string, b string"), normalize=False)
    assert {(r.op, r.n) for r in D.diff_totals(df).collect()} == {(0, 1), (-1, 1), (1, 1)}
    assert [r.text for r in D.diff_search(df, "Y Z").orderBy("seq").collect()] == ["x y z w", "X y z v"]


def test_lines_before_a_comparison(spark):
    lines = {"  Precio&nbsp\u00a0 total: 5 ": "Precio nbsp total: 5", "&quot;&#39;&amp;": "", "“ ”": "", "@@##!!$$": "", "1l0 c0nt5to": "1l0 contsto", "00-12.34/56 El plazo": "El plazo", "12345678": "", "a1234567 b": "", "\x07Hola\ttodos ★ aquí": "Hola todos aquí", "ﬁrma digital": "firma digital"}
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    got = {r.t: r.c for r in df.select("t", T.pre_diff(F.col("t")).alias("c")).collect()}
    assert got["“ ”"] == got["@@##!!$$"] == got["12345678"] == got["a1234567 b"] == ""
    assert got["00-12.34/56 El plazo"] == "El plazo" and got["ﬁrma digital"] == "firma digital"
    assert got["1l0 c0nt5to"] == "1l0 contsto" and got["&quot;&#39;&amp;"] == ""
    assert got["\x07Hola\ttodos ★ aquí"] == "Holatodos aquí"


def plain_common(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    return 0 if not k else k + plain_common(a[:i], b[:j]) + plain_common(a[i + k :], b[j + k :])


def test_common_runs_equal_their_definition_on_both_ways():
    r = random.Random(3)
    for n in [30] * 60 + [90] * 20:
        a, b = (bytes(r.choice(b"abc") for _ in range(r.randrange(n))) for _ in range(2))
        assert T._common(a, b) == plain_common(a, b)


def test_common_runs_of_longer_texts_equal_their_definition():
    r = random.Random(8)
    for t in range(150):
        k = r.choice([1, 2, 3, 9, 60])
        a, b = (bytes(r.randrange(k) for _ in range(r.randrange(150))) for _ in range(2))
        if t % 3 == 0:
            b = a[: len(a) // 2] + b + a[len(a) // 3 :]
        if t % 4 == 0:
            a *= r.randrange(1, 4)
        assert T._common(a, b) == plain_common(a, b)


def test_texts_of_a_megabyte_are_compared_within_a_minute():
    r = random.Random(2)
    words = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    a = " ".join(r.choice(words) for _ in range(185_000)).encode()[:1_000_000]
    b = bytearray(a)
    for _ in range(500):
        b[r.randrange(len(b))] = 33
    other = " ".join(r.choice(words) for _ in range(185_000)).encode()[:1_000_000]
    for x, low, high in ((bytes(b), 998_000, 1_000_000), (other, 1, 900_000)):
        began = time.monotonic()
        assert low <= T._common(a, x) < high and len(x) == 1_000_000
        assert time.monotonic() - began < 60


def spread(script, a, b):
    """What rows of (op, lines) put together again on both sides."""
    assert [x for op, lines in script if op <= 0 for x in lines] == a
    assert [x for op, lines in script if op >= 0 for x in lines] == b
    return script


def test_short_kept_runs_are_merged_and_blocks_slide():
    said = lambda a, b: spread(D.clean_up(D.edit_script(a, b), a, b), a, b)
    a, b = ["una línea larga", "x", "otra línea larga", "fin"], ["algo bien distinto", "x", "nada de lo mismo", "fin"]
    assert said(a, b) == [(-1, a[:3]), (1, b[:3]), (0, ["fin"])]
    a, b = ["corta", "una línea que se queda", "b"], ["breve", "una línea que se queda", "c"]
    assert [op for op, _ in said(a, b)] == [-1, 1, 0, -1, 1]
    assert said(["A", "B", "C", "B", "D"], ["A", "B", "D"]) == [(0, ["A", "B"]), (-1, ["C", "B"]), (0, ["D"])]
    assert said(["A", "", "B", "", "D"], ["A", "", "D"]) == [(0, ["A", ""]), (-1, ["B", ""]), (0, ["D"])]
    assert said([], []) == [] and said(["a"], []) == [(-1, ["a"])] and said([], ["a"]) == [(1, ["a"])]


def by_definition(script, a, b):
    """Merging of short kept runs, one after another until there is none."""
    size = lambda lines: sum(len(x) + 1 for x in lines)
    parts = [x for x in D.whole_runs(script, a, b)]
    while True:
        runs = [(None, [], [])]
        for op, lines in parts:
            if op == 0:
                runs += [lines, (None, [], [])]
            else:
                runs[-1] = (None, runs[-1][1] + lines * (op < 0), runs[-1][2] + lines * (op > 0))
        short = next((i for i in range(1, len(runs), 2) if all(size(runs[i]) <= max(size(runs[j][1]), size(runs[j][2])) for j in (i - 1, i + 1))), None)
        if short is None:
            return sum(len(x) for x in runs[1::2])
        (_, g, n), k, (_, g2, n2) = runs[short - 1 : short + 2]
        runs[short - 1 : short + 2] = [(None, g + k + g2, n + k + n2)]
        parts = []
        for i, x in enumerate(runs):
            parts += [(0, x)] if i % 2 else [(-1, x[1]), (1, x[2])]


def test_clean_up_keeps_both_sides_and_merges_all_it_should():
    r = random.Random(11)
    lines = ["", "a", "bb", "una línea", "una línea mucho más larga que las otras"]
    for _ in range(400):
        a = [r.choice(lines) for _ in range(r.randrange(14))]
        b = [x for x in a if r.random() > 0.3] + [r.choice(lines) for _ in range(r.randrange(4))]
        script = D.edit_script(*[[lines.index(x) for x in side] for side in (a, b)])
        cleaned = spread(D.clean_up(script, a, b), a, b)
        assert all(x for _, x in cleaned)
        assert sum(len(x) for op, x in cleaned if op == 0) >= by_definition(script, a, b)


def test_unlike_texts_of_many_lines_take_bounded_work():
    r = random.Random(4)
    a, b = ([r.randrange(60) for _ in range(100_000)] for _ in range(2))
    began = time.monotonic()
    script = D.edit_script(a, b)
    assert time.monotonic() - began < 60
    i = k = kept = 0
    for op, n in script:
        assert op or a[i : i + n] == b[k : k + n]
        i, k, kept = i + n * (op <= 0), k + n * (op >= 0), kept + n * (op == 0)
    assert (i, k) == (100_000, 100_000) and kept > 1_000
    # lines that stand out hold blocks together beyond the bound
    c = [x for i in range(0, 4000, 40) for x in [1000 + i, *(r.randrange(9) for _ in range(39))]]
    d = [x for i in range(0, 4000, 40) for x in [1000 + i, *(r.randrange(9) for _ in range(39))]]
    assert {1000 + i for i in range(0, 4000, 40)} <= {c[i] for i, _ in D.kept_lines(c, d, work=4000)}


def test_comparisons_say_what_they_found(spark):
    pairs = [(1, "hola mundo", "hola mundo"), (2, "hola mundo", "hola munda"), (3, None, None), (4, None, "x"), (5, "ab " * 3000, "ab " * 3000 + "c"), (6, "", "")]
    got = {r.pair_id: r for r in D.compare(spark.createDataFrame(pairs, "pair_id long, a string, b string")).collect()}
    assert (got[1].similaridad_texto, got[1].resumen) == (100.0, "Coincidencia 100%. Sin cambios relevantes.")
    assert (got[2].similaridad_texto, got[2].resumen) == (90.0, "Coincidencia 90%. Cambios detectados.")
    assert got[4].resumen == "Cambios detectados (comparación binaria)." and got[4].similaridad_texto is None
    assert got[5].similaridad_texto == 99.99 and got[6].similaridad_texto == 0.0
    assert got[1].hash_base == got[1].hash_comp and (got[2].size_base, got[2].size_comp) == (10, 10)
