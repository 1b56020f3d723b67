import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactlens.llm import language_id as LI
from pactlens.llm import minhash_dedup as MD
from pactlens.llm import toxicity as TX
from pactlens.llm.shingles import WordHashes, probability_jaccard, shingles

SF = "/root/testdata/sf0.01"
HASH = WordHashes()


def bag(text, size=5):
    return shingles(HASH.words(text), size)


def slow_jaccard(a, b):
    x, y = dict(zip(*map(list, a), strict=True)), dict(zip(*map(list, b), strict=True))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_probability_jaccard_equals_its_definition():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (" ".join(rng.choice(list("abcdef"), rng.integers(1, 30))) for _ in range(2))
        for size in (1, 2):
            assert probability_jaccard(bag(a, size), bag(b, size)) == pytest.approx(slow_jaccard(bag(a, size), bag(b, size)))
    assert probability_jaccard(bag("x"), bag("x")) == pytest.approx(1.0)


def test_signatures_estimate_it():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    a = list(rng.choice(words, 300))
    for share in (0.1, 0.5, 0.9):
        b = [w if rng.random() > share * 0.2 else "new" + w for w in a]
        x, y = bag(" ".join(a)), bag(" ".join(b))
        s = MD.signatures(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), np.repeat([0, 1], [len(x[0]), len(y[0])]), 2, 2048)
        assert (s[0] == s[1]).mean() == pytest.approx(probability_jaccard(x, y), abs=0.05)


def brute(texts, least=0.8):
    bags = {i: bag(t) for i, t in texts.items()}
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        if len(bags[i][0]) and len(bags[j][0]) and probability_jaccard(bags[i], bags[j]) >= least:
            a, b = sorted((root(i), root(j)))
            comp[b] = a
    return {i: root(i) for i in texts}


def made_texts():
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(300)]
    texts, n = {}, 0
    passage = list(rng.choice(words, 60))
    for family in range(12):
        base = list(rng.choice(words, rng.integers(30, 150)))
        for _ in range(6):
            t = list(base)
            for k in rng.integers(0, len(t), rng.integers(0, 4)):
                t[k] = "edited"
            texts[n] = " ".join(t + (passage if family % 3 == 0 else []))
            n += 1
        texts[n] = texts[n - 1].upper() + " !"
        n += 1
    for t in ("", None, "   ", "one two", "one two", "One, Two!", "!!", "a b c d e", "a b c d e f"):
        texts[n] = t
        n += 1
    return texts


def test_near_documents_equal_brute_force(spark):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, component int")
    got = {r.doc_id: r.component_id for r in MD.near_documents(docs).collect()}
    assert got == brute(texts)
    kept = sorted(r.doc_id for r in MD.keep_one(docs).collect())
    assert kept == sorted({c for c in brute(texts).values()})


def test_dedup_of_nothing_of_repeated_rows_and_of_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f."), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert MD.near_documents(docs.limit(0)).count() == 0
    key = lambda r: (r.doc_id or 0, r.component_id or 0)
    assert sorted(map(key, MD.near_documents(docs).collect())) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted((r.doc_id or 0, r.text) for r in MD.keep_one(docs).collect() if r.text) == [(0, "a b c d e f"), (1, "a b c d e f")]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    texts = made_texts()
    rows = [(i // 2 if i % 2 else i, t, f"row{i}") for i, t in texts.items()] + [(None, "one two", "n1"), (None, "one two", "n2"), (4, "", "e1"), (4, None, "e2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    want = brute({i: t if r[0] is not None else None for i, (r, t) in enumerate(zip(rows, [r[1] for r in rows], strict=True))})
    members = {}
    for i, c in want.items():
        members.setdefault(c, []).append(i)
    least = {c: min((rows[i][0] for i in own), key=lambda x: (x is not None, x)) for c, own in members.items()}
    got = sorted((r.doc_id or -1, r.component_id if r.component_id is not None else -1) for r in MD.near_documents(docs).collect())
    assert got == sorted((rows[i][0] or -1, least[c] if least[c] is not None else -1) for i, c in want.items())
    kept = [r.asDict() for r in MD.keep_one(docs).collect()]
    assert len(kept) == len(members)
    by_row = {r[2]: i for i, r in enumerate(rows)}
    assert sorted(want[by_row[k["_row"]]] for k in kept) == sorted(members)
    assert all(k["doc_id"] == least[want[by_row[k["_row"]]]] for k in kept)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = LI.op5_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, la, "x") for i, (t, la) in enumerate([("der die das und ist", "de"), ("the of and to is", "en"), (None, "en"), ("123 !!", "de"), ("le la les", None)] * 20)], "doc_id long, text string, lang string, score string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in LI.predict(docs, LI.train(docs)).collect()}
    assert out[0][0] == "de" and out[1][0] == "en" and out[2] == ("und", 0.0) and out[3] == ("und", 0.0)
    empty = LI.train(docs.limit(0))
    assert {r.lang_pred for r in LI.predict(docs, empty).collect()} == {"und"}
    assert LI.predict(docs.limit(0), empty).count() == 0


def test_language_stage_of_the_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert cp.keep_known_language(spark, bare, SF).count() == docs.count()
    held = docs.withColumn("lang", F.when(LI.held_out(F.col("doc_id"), 3, 1), F.col("lang")))
    assert cp.keep_known_language(spark, held, SF).count() == docs.count()
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id"), "doc_id", "left_semi").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    gone = clean.select("doc_id").subtract(cp.keep_known_language(spark, docs, SF).select("doc_id")).count()
    print("clean labelled documents:", clean.count(), "rejected:", gone)
    assert gone <= 0.01 * clean.count()


def test_samples_and_splits_are_those_of_one_window_per_group_without_large_tasks(spark):
    from pyspark.sql import Window

    from pactlens.operators import learning as ML

    rows = spark.range(20_000).selectExpr("id", "IF(id % 10 = 0, 'de', 'en') AS lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("language sample")), "id")
    expected = {r.id for r in rows.withColumn("place", F.row_number().over(order)).where("place <= 1500").collect()}
    got = LI.smallest_hashes(rows, "lang", "language sample", F.lit(1500)).collect()
    assert {r.id for r in got} == expected and len(got) == len(expected) == 3000
    texts = spark.range(3000).selectExpr("concat('t', id % 2900) AS text", "IF(id = 7, 'ONE', IF(id % 3 = 0, 'HIGH', 'LOW')) AS severity")
    order = Window.partitionBy("severity").orderBy(F.xxhash64("text", F.lit(42)), "text")
    one = texts.withColumn("held_out", F.percent_rank().over(order) < 0.2)
    split = ML.stratified_split(texts)
    assert split.columns == one.columns and sorted(split.collect()) == sorted(one.collect())
    # the last window sees the rows of 64 parts; the split sorts texts by severity and range of hashes
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "Window [" in line and "rank(" in line), plan


def test_toxicity_on_held_out_documents(spark):
    out = {r.doc_id: r for r in TX.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [d for d in labels if out[d].held_out]
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in labels)
    assert sum(out[d].predicted == labels[d] for d in held) >= 0.97 * len(held)
    assert sum(out[d].predicted and not labels[d] for d in held) <= 0.01 * len(held)


def model(words):
    text = " ".join(words)
    c = np.concatenate([[0, 0], TX._codes()[np.frombuffer((text + "  ").encode("utf-32-le"), np.uint32)]]).astype(int)
    return TX.CharModel(np.bincount((c[:-2] * TX.SYMBOLS + c[1:-1]) * TX.SYMBOLS + c[2:], minlength=TX.SYMBOLS**3))


def features(restorer, text):
    """Features of the whole text, all that its first view has."""
    return next(restorer.of(pa.array([text], pa.string())))[0][0].tolist()


def test_restoring_disguised_words():
    m = TX.Restorer(model(["you", "are", "an", "idiot", "moron", "clown", "the", "stupid", "hello", "world"] * 50))
    for noisy, clear in {"1d10t": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "s.t.u.p.i.d": "stupid", "stuuuupid": "stupid", "cl0wn!": "clown"}.items():
        assert m.restored_text(f"hello {noisy} world") == f"hello {clear} world", noisy
    plain = "Hello world, 2024 was 3.5 good; see a@b.c?"
    assert m.restored_text(plain).split()[:2] == ["Hello", "world,"]
    assert m.restored_text("") == "" and m.restored_text(None) == ""
    assert len(m.restored_text("1d10t" * 5000)) > 0


def test_restoring_long_stretches_and_letters_parted_by_blanks_and_signs():
    m = TX.Restorer(model(["you", "are", "an", "idiot", "moron", "clown", "the", "stupid", "hello", "world"] * 20_000))
    for letters in range(20, 40):  # before the insult, which so starts anywhere around the 64th character
        lead = ["the"] * ((letters - 2 * (2 * letters % 3)) // 3) + ["an"] * (2 * letters % 3)
        for noisy in (".".join("".join([*lead, "idiot", "world"])), ".".join("".join([*lead, "idiot", *["world"] * 200]))):
            assert m.restored(noisy).split()[: len(lead) + 1] == [*lead, "idiot"], letters
    for noisy in ("s - t - u - p - i - d", "s- t- u- p- i- d-", "-s -t -u -p -i -d", "s . t . u . p . i . d!", "s _ t _ u _ p _ i _ d", "s t u p i d."):
        assert "stupid" in TX._WORDS.findall(m.restored_text(f"hello {noisy} world").replace("_", " ")), noisy
        assert set(m.features("stupid").tolist()) <= set(features(m, f"hello {noisy} world")), noisy


def readings(lm, noisy):
    """(cost, text) of each reading of a short disguised stretch."""

    def read(i, out, cost):
        a, b = ("  " + "".join(y if y.isalpha() else " " for y in out))[-2:]
        if i == len(noisy):
            yield cost + lm(a, b, " "), "".join(out).strip()
            return
        c, last = noisy[i], noisy[i - 1] if i else " "
        if c.isalpha() and c == last:
            third, ahead = i > 1 and noisy[i - 2] == c, i + 1 < len(noisy) and noisy[i + 1] == c
            ways = [(c, TX.KEEP_REPEAT if third else 0.0), ("", TX.DROP_REPEAT if third or ahead else 5.0)]
        elif c.isalpha():
            ways = [(c, 0.0)]
        elif c in TX.GAPS:
            ways = [("", TX.DROP_GAP if 0 < i < len(noisy) - 1 else 0.0), (" ", TX.KEEP_GAP + 2 * (c != " "))]
        elif c in TX.LOOKALIKES:
            ways = [*((x, TX.SWAP) for x in TX.LOOKALIKES[c]), (c, TX.KEEP_SIGN)]
        else:
            ways = [(c, 0.0)]
        for x, channel in ways:
            yield from read(i + 1, [*out, x] if x else out, cost + channel + (0.0 if not x or (b == " " and not x.isalpha()) else lm(a, b, x)))

    return list(read(0, [], 0.0))


def test_viterbi_finds_the_least_cost_of_all_readings():
    lm = model(["you", "idiot", "moron", "stupid", "hello", "world"] * 50)
    rng = np.random.default_rng(7)
    for _ in range(150):
        noisy = "".join(rng.choice(list("idotmrn110.-!|$ssx&"), rng.integers(1, 9)))
        every, got = readings(lm, noisy), lm.restore(noisy)
        assert min(c for c, t in every if t == got) == pytest.approx(min(every)[0], abs=1e-4), (noisy, got)


def test_a_disguised_word_is_found_at_every_place_of_a_long_stretch():
    m = TX.Restorer(model(["you", "are", "an", "idiot", "moron", "clown", "the", "stupid", "hello", "world"] * 50))
    for at in range(200):
        assert "idiot" in m.model.restore("x" * at + ".1d10t." + "z" * (200 - at)), at


def test_a_toxic_passage_does_not_fade_in_a_long_text():
    kept = TX.Restorer(model(["moron", "nice", "day"])).features("moron")
    rest = TX.Restorer(model(["moron", "nice", "day"]), set(kept.tolist()))
    long_text = " ".join([*(f"nice{i}" for i in range(2500)), *["what a moron he is and so on"] * 10, *(f"day{i}" for i in range(2500))])
    whole, *windows = next(rest.of(pa.array([long_text])))
    assert 2 <= len(windows) <= 3 and max(x.max() for _, x in windows) > 5 * whole[1].max()
    assert len(next(rest.of(pa.array(["moron " * 500])))) == 1


def test_near_copies_of_one_label_count_once():
    from types import SimpleNamespace

    class Row(SimpleNamespace):
        def __lt__(self, other):
            return self.id < other.id

    rows = [Row(id=1, toxic=1, marks=[*range(16)]), Row(id=2, toxic=1, marks=[*range(15), 99]), Row(id=3, toxic=0, marks=[*range(16)]), Row(id=4, toxic=1, marks=[*range(8), *range(50, 58)]), Row(id=5, toxic=0, marks=[])]
    assert TX.near_copies(rows) == {2}


def test_toxicity_edge_cases(spark):
    rows = [(i, ("you moron " if i % 4 == 0 else "nice day ") + f"number{i % 7} word") for i in range(120)] + [(200, None), (201, ""), (202, "you m0r0n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(0, 1), (5, None)], "doc_id long, toxic int")
    trained = TX.train(docs, labels)
    out = {r.doc_id: r.score for r in TX.score(docs, trained).collect()}
    assert all((out[i] >= 0.5) == (i % 4 == 0) for i in range(120))
    assert out[202] >= 0.5 and out[200] == out[201] < 0.5
    bare = TX.train(docs, labels.limit(0))
    assert {r.score for r in TX.score(docs, bare).collect()} == {0.0}
    assert TX.score(docs.limit(0), bare).count() == 0


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:3]:
        before, docs = docs, cp.stash(stage(spark, docs, SF), "test")
        assert docs.columns == before.columns
        kept[name] = (before, docs)
    before, after = kept["near copies"]
    texts = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    inverted, comp = {}, {i: i for i in texts}
    bags = {i: bag(t) for i, t in texts.items()}
    for i, (h, _) in bags.items():
        for x in h.tolist():
            inverted.setdefault(x, []).append(i)
    pairs = {p for own in inverted.values() for p in combinations(own, 2)}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in pairs:
        if probability_jaccard(bags[i], bags[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            comp[b] = a
    assert {r.doc_id for r in after.select("doc_id").collect()} == {root(i) for i in texts}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    before, after = kept["toxicity"]
    gone = {r.doc_id for r in before.select("doc_id").subtract(after.select("doc_id")).collect()}
    assert gone and len(gone & toxic) <= 0.02 * len(toxic)
    assert kept["language"][1].where(~F.col("text").rlike(r"\p{L}")).count() == 0
    packed = cp.STAGES[3][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_ftrl_steps_are_those_of_its_definition():
    from pactlens.llm.ftrl import Ftrl, softmax

    rng = np.random.default_rng(21)
    alpha, beta, l1, l2, features, classes = 0.3, 1.0, 0.05, 0.01, 12, 3
    model = Ftrl(features, classes, alpha, beta, l1, l2)
    z, n, bias = ([[0.0] * classes for _ in range(features)] for _ in range(2)), None, [0.0] * classes
    z, n = z
    for _ in range(200):
        at = np.sort(rng.choice(features, rng.integers(1, 6), replace=False))
        x, label = rng.standard_normal(len(at)), int(rng.integers(classes))
        w = {}
        for i in at.tolist():
            for c in range(classes):
                zi = z[i][c]
                w[i, c] = 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i][c])) / alpha + l2)
        score = [bias[c] + sum(w[i, c] * v for i, v in zip(at.tolist(), x, strict=True)) for c in range(classes)]
        p = softmax(np.array(score))
        for c in range(classes):
            e = p[c] - (c == label)
            for i, v in zip(at.tolist(), x, strict=True):
                g = e * v
                sigma = (np.sqrt(n[i][c] + g * g) - np.sqrt(n[i][c])) / alpha
                z[i][c] += g - sigma * w[i, c]
                n[i][c] += g * g
            bias[c] -= 0.02 * e
        model.learn(at, x, label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and np.allclose(model.bias, bias)
    strong = Ftrl(features, classes, l1=50.0)
    for _ in range(100):
        strong.learn(np.arange(3), rng.standard_normal(3), int(rng.integers(classes)))
    assert (strong.weights() == 0).all() and (np.abs(model.weights()) > 0).any()  # the first penalty makes weights exactly zero


def test_temperature_has_the_least_loss_and_calibrates():
    from pactlens.llm.ftrl import softmax, temperature

    rng = np.random.default_rng(22)
    true = rng.standard_normal((4000, 4)) * 1.5
    labels = np.array([rng.choice(4, p=softmax(s)) for s in true])
    t = temperature(true * 3.0, labels)  # scores three times too sure
    assert t == pytest.approx(3.0, rel=0.1)
    loss = lambda t: -np.log(softmax(true * 3.0 / t)[np.arange(4000), labels]).mean()
    assert all(loss(t) <= loss(u) + 1e-6 for u in np.exp(np.linspace(np.log(0.05), np.log(20), 200)))
    assert temperature(np.empty((0, 4)), np.empty(0, int)) == 1.0


def test_language_features_and_weights_equal_a_plain_reading(spark):
    texts = ["Ein Haus, ein Haus!", "the house is the house", "la casa", "", None, "12 34", "x" * 70_000 + " y"]

    def grams(text):
        runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        return " " + " ".join(runs) + " " if runs else ""

    for t in texts:
        s = grams(t)
        want = len([c for c in s[1:-1]]) + max(0, len(s) - 1) + max(0, len(s) - 2) if s else 0
        counts = LI.ngram_counts(t)
        assert counts.sum() == want, t
        assert (counts == LI.ngram_counts(s)).all()
    assert LI.ngram_counts(texts[-1]).max() > 65_535
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "id long, text string")
    n, df = LI._frequencies(rows)
    plain = np.zeros(1 << LI.BITS, int)
    for t in texts * 2:
        plain += LI.ngram_counts(t) > 0
    assert n == 8 and (df == plain).all()
    counts = np.array([1, 3, 70_000])
    x = LI.vector(counts, np.array([1.0, 2.0, 0.5]))
    raw = np.array([1.0, 2 * (1 + np.log(3)), 0.5 * (1 + np.log(70_000))])
    assert np.allclose(x, raw / np.sqrt((raw**2).sum()))


def test_language_of_very_long_texts_repeated_rows_and_clashing_columns(spark):
    rows = [(i % 40, "der die das und ist nicht " * 3 if i % 2 else "the of and to is not " * 3, "de" if i % 2 else "en") for i in range(80)]
    docs = spark.createDataFrame([*rows, (900, "der die das " * 60_000, None), (901, "the of and " * 60_000, None)], "doc_id long, text string, lang string").selectExpr("*", "'mine' AS lang_pred", "5 AS place", "'x' AS hash")
    out = LI.predict(docs, LI.train(docs))
    assert out.columns == ["doc_id", "text", "lang", "place", "hash", "lang_pred", "score"] and out.count() == 82
    got = {r.doc_id: r.lang_pred for r in out.where("doc_id >= 900").collect()}
    assert got == {900: "de", 901: "en"}


def test_toxicity_of_very_long_texts_and_clashing_columns(spark):
    rows = [(i, ("you moron " if i % 4 == 0 else "nice day ") + f"number{i % 7} word", "mine") for i in range(120)]
    long_clean = " ".join(f"nice{i} day{i}" for i in range(30_000))
    rows += [(500, long_clean, "a"), (501, long_clean + " you m0r0n, you moron, such a moron. " + long_clean, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    out = TX.score(docs, TX.train(docs, labels))
    assert out.columns == ["doc_id", "text", "score"]
    got = {r.doc_id: r.score for r in out.where("doc_id >= 500").collect()}
    assert got[500] < 0.5 <= got[501]


def test_pipeline_keeps_the_callers_columns(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).selectExpr("*", "'mine' AS _sure", "'mine' AS _language", "'mine' AS _toxicity", "'mine' AS _row").cache()
    for _, stage in cp.STAGES[:3]:
        docs = cp.stash(stage(spark, docs, SF), "test")
        assert docs.columns[-4:] == ["_sure", "_language", "_toxicity", "_row"]
        assert docs.where("_sure <> 'mine' or _language <> 'mine' or _toxicity <> 'mine' or _row <> 'mine'").count() == 0
    assert docs.count() > 50


def test_rows_that_share_an_id_and_a_column_that_is_called_as_a_helper(spark):
    rows = [(1, "a b c d e f", "b"), (1, "a b c d e f", "a"), (2, "A b c d e f.", "c"), (3, "other words in this one", "d"), (3, "other words in this one", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    kept = MD.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "_n"]
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", "a"), (3, "other words in this one", "d")]
    counted = spark.createDataFrame([(1, "a b c d e f", 42), (1, "a b c d e f", 42)], "doc_id long, text string, _n int")
    assert [tuple(r) for r in MD.keep_one(counted).collect()] == [(1, "a b c d e f", 42)]


def test_null_and_repeated_ids_take_no_places_of_a_sample(spark, monkeypatch):
    pairs = [("der die das und ist nicht", "de"), ("the of and to is not", "en")]
    rows = [(i, *pairs[i % 2]) for i in range(40)]
    noise = [(None, "qqq www", "en")] * 300 + [(7, "the of and to is not", "en")] * 300 + [(8, f"zz {i}", "de") for i in range(300)]
    schema = "doc_id long, text string, lang string"
    collected = []
    whole = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: collected.append(whole(self)) or collected[-1])
    LI.train(spark.createDataFrame(rows + noise, schema), rows_per_language=15)
    sampled = max((x for x in collected if x and "lang" in x[0].__fields__), key=len)
    ids = [r.id for r in sampled]
    assert len(sampled) == 30 and len(set(ids)) == 30 and None not in ids
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (None, 0), (7, 1)] * 50, "doc_id long, toxic int")
    collected.clear()
    TX.train(spark.createDataFrame(rows + noise, schema), labels, toxic_rows=15, clean_rows=15)
    assert max(len(x) for x in collected if x and "id" in x[0].__fields__) <= 30


def test_columns_of_any_name_and_type_stay(spark):
    docs = spark.createDataFrame([(1, "der die das", "de", (1, "x"))], "doc_id long, text string, lang string, `a b` struct<`c ``d`:int,e:string>")
    model = LI.train(docs)
    assert LI.predict(docs, model).schema.fields[:4] == docs.schema.fields and LI.predict(docs, model).count() == 1
    toxic = TX.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert TX.score(docs, toxic).schema.fields[:4] == docs.schema.fields and TX.score(docs, toxic).count() == 1


def test_tasks_ask_for_cores_only_where_they_can():
    from types import SimpleNamespace

    from pactlens.llm.common import wide_tasks

    made = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=conf)
    assert wide_tasks(made("local[8]")) is None
    assert wide_tasks(made("yarn")) is None and wide_tasks(made("local-cluster[3,1,500]")) is None
    assert wide_tasks(made("local-cluster[3,2,500]")).taskResources["cpus"].amount == 2
    assert wide_tasks(made("yarn", **{"spark.executor.cores": "4"})).taskResources["cpus"].amount == 2
