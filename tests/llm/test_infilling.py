import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlens.llm import infilling as I


def units_of(text, unit):
    """Where units start, character by character."""
    if unit == "char":
        return list(range(len(text)))
    out = []
    for i, c in enumerate(text):
        before = text[i - 1] if i else None
        if before is None or (unit == "line" and before == "\n") or (unit == "word" and c in " \t\n\v\f\r" and before not in " \t\n\v\f\r"):
            out.append(i)
    return out


def plainly(key, text, unit="char", seed="1", plain=10, spm=20, marks=I.SENTINELS):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    places = [*units_of(text, unit), len(text)]
    n = len(places) - 1
    if not text or any(m in text for m in marks) or h3 % 100 >= 100 - plain:
        return text, "plain", n, None, None
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, z = text[: places[p]], text[places[p] : places[q]], text[places[q] :]
    if h4 % 100 < spm:
        return f"{marks[1]}{z}{marks[0]}{a}{marks[2]}{m}", "spm", n, p, q - p
    return f"{marks[0]}{a}{marks[1]}{z}{marks[2]}{m}", "psm", n, p, q - p


ALPHABET = np.array(list("aZ <>PSM\n\t") + ["é", "€", "😀", "́"])


def texts():
    rng = np.random.default_rng(4)
    out = ["".join(ALPHABET[rng.integers(0, len(ALPHABET), n)]) for n in (*range(40), *rng.integers(0, 900, 160), 255, 256, 257, 512, 70_000)]
    return [*out, None, "", "<P>", "<P", "a<S>b", "<<M>", "<" * 300, "😀" * 1000, "x" * 255 + "<M>", "x" * 254 + "<S>" + "y" * 300, "word " * 200]


@pytest.mark.parametrize("unit", I.UNITS)
def test_against_cutting_by_character(spark, unit):
    rows = [(i, t, "other") for i, t in enumerate(texts())] + [(None, "no id", "x"), (None, "no id", "x"), (7, "same id, other text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = I.infill(docs, unit=unit).withColumn("back", I.restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "output", "form", "units", "prefix_units", "middle_units", "back"]
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.output, r.form, r.units, r.prefix_units, r.middle_units, r.back) for r in out.collect()), key=key)
    want = sorted(((i, *plainly(i, t, unit), t or "") for i, t, _ in rows), key=key)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_parameters_and_columns_that_clash(spark):
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    rows = [(str(i), t, [i], i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "name string, body string, `a b` array<int>, OUTPUT int")
    out = I.infill(docs, "name", "body", sentinels=marks, seed="s", plain=40, spm=50)
    assert out.columns[:2] == ["name", "a b"] and "OUTPUT" not in out.columns
    for r in out.withColumn("back", I.restored(F.col("output"), F.col("form"), marks)).collect():
        i = int(r.name)
        assert (r.output, r.form, r.units, r.prefix_units, r.middle_units) == plainly(i, rows[i][1], "char", "s", 40, 50, marks)
        assert r.back == (rows[i][1] or "") and r["a b"] == [i]


def test_blocks_of_any_size_give_the_same_transitions():
    table = I.automaton()
    texts_ = [t.encode() for t in texts() if t is not None]
    data, ends = np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([len(t) for t in texts_])
    whole = I.Scan(table, data, ends - [len(t) for t in texts_], ends, 1 << 20)
    assert whole.units.tolist() == [len(t.decode()) for t in texts_]
    assert whole.marked.tolist() == [any(m.encode() in t for m in I.SENTINELS) for t in texts_]
    for block in (3, 4, 7, 64, 256):
        scan = I.Scan(table, data, ends - [len(t) for t in texts_], ends, block)
        assert scan.units.tolist() == whole.units.tolist() and scan.marked.tolist() == whole.marked.tolist()
        some = np.flatnonzero(scan.units > 0)
        for share in (0.0, 0.3, 1.0):
            wanted = (scan.units[some] * share).astype(np.int64)
            assert scan.cuts(some, wanted).tolist() == whole.cuts(some, wanted).tolist()


def test_sentinels_that_could_be_misread_are_refused(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for marks in (("a", "a", "b"), ("ab", "bc", "x"), ("aba", "x", "y"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            I.infill(docs, sentinels=marks)
    with pytest.raises(ValueError):
        I.automaton(unit="page")
    assert I.infill(docs).count() == 0
