import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pactlens.llm.packing import best_fit, pack, pack_documents, pack_sequences, packed_documents, placements, sequences, token_pieces
from pactlens.llm.piece_encoding import Pieces, decode_pieces, encode_pieces
from pactlens.llm.token_blocks import decode_segment, encode_segment, read_token_file, write_token_file
from pactlens.llm.token_ids import TokenIds

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello, WORLD! it's", "", None, "ñandú été ß größe " * 50, "a\tb\n\nc  d", "x" * 3000, "<|endoftext|> a<|startoftext|>b", "Hello, WORLD! it's", "中文 😀 é", "word " * 9000]
PLAIN = Tokenizer.from_file(WORDS)
MEMO = TokenIds(WORDS, memory=50)
UNI = Pieces(PIECES)


def docs(spark):
    return spark.createDataFrame([(3 * i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcZÉéñßÿŸʼİ中1²_'’.,!<|>-%\t\n\x1c\u00a0\u0301 ", "<|endoftext|>", " the ", "'s"]), max_size=30).map("".join))
def test_memoised_ids_are_the_tokenizers_own(text):
    assert np.frombuffer(MEMO.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=700))
def test_segments_come_back(values):
    x = np.array(values, np.uint32)
    raw = encode_segment(x)
    assert decode_segment(raw).tolist() == values
    if len(x) > 300:
        assert decode_segment(raw, np.array([1])).tolist() == values[128:256]


def test_outliers_do_not_widen_a_block():
    x = np.arange(100_000, 100_128, dtype=np.uint32)
    wide = x.copy()
    wide[5] = 2**31
    assert len(encode_segment(wide)) - len(encode_segment(x)) < 10


def test_token_file_round_trip(spark, tmp_path):
    write_token_file(docs(spark), WORDS, str(tmp_path / "f"), segment_ids=500, files=3)
    got = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_file(spark, str(tmp_path / "f")).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        assert got[3 * i] == (start, ids_of(t))
        start += len(ids_of(t))


def test_token_file_of_nothing_and_of_repeated_rows(spark, tmp_path):
    none = docs(spark).limit(0)
    write_token_file(none, WORDS, str(tmp_path / "e"))
    assert read_token_file(spark, str(tmp_path / "e")).count() == 0
    twice = docs(spark).union(docs(spark))
    write_token_file(twice, WORDS, str(tmp_path / "t"))
    rows = sorted((r.start, len(r.ids) // 4) for r in read_token_file(spark, str(tmp_path / "t")).collect())
    assert len(rows) == 2 * len(TEXTS) and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))


def check_packed(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_documents(spark):
    rows = pack_documents(docs(spark), WORDS).collect()
    n = check_packed(rows)
    total = sum(r.length for r in rows)
    assert n == -(-total // 4096)
    for i, t in enumerate(TEXTS):
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 3 * i)
        ids = np.array(ids_of(t), "<u4")
        assert [(p, s, n) for p, s, n, _ in own] == [(k, a, min(4096, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 4096))]
        assert [c for *_, c in own] == [zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, _ in own]


def test_sequences_hold_their_pieces(spark):
    pieces = token_pieces(docs(spark), WORDS, 512).cache()
    packed = pack(pieces, (512, 512, 512 * 512))
    check_packed(packed.collect(), 512)
    want = sum(len(ids_of(t)) for t in TEXTS)
    assert sum(len(r.ids) // 4 for r in sequences(packed).collect()) == want
    assert pack(pieces.limit(0)).count() == 0


def test_written_sequences_hold_the_right_ids(spark):
    twice = docs(spark).union(docs(spark))
    made = packed_documents(twice, WORDS, 512)
    want = sorted((3 * i, np.array(ids_of(t), "<u4").tobytes()[4 * a : 4 * a + 2048]) for i, t in enumerate(TEXTS) for a in range(0, len(ids_of(t)), 512) for _ in range(2))
    got = []
    for r in made.collect():
        assert len(r.ids) == 4 * sum(p.length for p in r.parts) <= 2048
        got += [(p.doc_id, bytes(r.ids[4 * p.offset : 4 * (p.offset + p.length)])) for p in r.parts]
    assert sorted(got) == want
    rows = placements(made, keep_ids=True).collect()
    check_packed(rows, 512)
    assert sorted((r.doc_id, bytes(r.ids)) for r in rows) == want and all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    spoiled = made.selectExpr("sequence_id", "reverse(ids) ids", "parts")
    assert placements(spoiled).collect() != placements(made).collect()
    many = spark.range(700).selectExpr("id doc_id", "0 piece", "0L start", "3L length", "cast(concat(lpad(id, 4, '0'), '12345678') as binary) ids")
    packed = pack_sequences(many, (3, 9, 9)).collect()  # more sequences than one batch holds
    assert sorted((r.parts[0].doc_id, bytes(r.ids)[:4]) for r in packed) == [(i, b"%04d" % i) for i in range(700)]
    assert pack_sequences(many.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120), st.sampled_from(["norm", "dot"]), st.integers(1, 6), st.integers(10_000, 20_000))
def test_best_fit_keeps_every_capacity(lengths, rule, most, attention):
    x = np.array(lengths, int)
    sequence, offset = best_fit(x, (100, most, attention), rule=rule)
    for s in set(sequence.tolist()):
        own = sequence == s
        assert x[own].sum() <= 100 and own.sum() <= most and (x[own] ** 2).sum() <= attention
        assert sorted(offset[own].tolist()) == np.concatenate([[0], np.cumsum(x[own][np.argsort(offset[own])])[:-1]]).tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80), st.sampled_from(["norm", "dot"]), st.integers(1, 6), st.integers(10_000, 20_000))
def test_each_piece_takes_the_best_sequence_that_has_room(lengths, rule, most, attention):
    cap, weights = (100, most, attention), (1.0, 0.05, 0.05)
    sequence, offset = best_fit(np.array(lengths, int), cap, weights, rule)
    left = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        item = (lengths[i], 1, lengths[i] ** 2)
        if rule == "norm":
            score = {b: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, room, item, cap, strict=True)) for b, room in left.items() if all(x >= y for x, y in zip(room, item, strict=True))}
        else:
            score = {b: -sum(w * x * y / c**2 for w, x, y, c in zip(weights, room, item, cap, strict=True)) for b, room in left.items() if all(x >= y for x, y in zip(room, item, strict=True))}
        b = int(sequence[i])
        assert score[b] <= min(score.values()) + 1e-9 if b in left else not score
        room = left.setdefault(b, list(cap))
        assert offset[i] == cap[0] - room[0]
        left[b] = [x - y for x, y in zip(room, item, strict=True)]


def test_many_short_pieces_fill_their_sequences(spark):
    rows = spark.range(300_000).selectExpr("id AS doc_id", "cast(1 + id % 9 as long) AS length", "-1 AS sequence_id", "'mine' AS `offset`")
    got = pack(rows).select("doc_id", "length", "sequence_id", "offset").toPandas()
    assert len(got) == 300_000 and got.sequence_id.nunique() <= got.length.sum() / 4096 + 2
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").offset.shift(-1).dropna() == (got.offset + got.length)[got.groupby("sequence_id").offset.shift(-1).notna()]).all()


def test_token_file_with_null_ids_and_clashing_columns(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a b", 1), (5, "c", 2), (None, None, 3)], "doc_id long, text string, start int")
    write_token_file(rows, WORDS, str(tmp_path / "n"))
    got = sorted(((r.doc_id is not None, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_file(spark, str(tmp_path / "n")).collect()))
    assert [g[2] for g in got] == [[1], ids_of("a b"), ids_of("c")] and [g[1] for g in got] == [0, 1, 1 + len(ids_of("a b"))]


def test_best_fit_is_tight_and_refuses_what_cannot_fit():
    x = np.random.default_rng(0).integers(1, 900, 4000)
    assert best_fit(x)[0].max() + 1 <= -(-x.sum() // 4096) + 1
    with pytest.raises(ValueError, match="larger"):
        best_fit(np.array([5000]))


def best_scores(text):
    """Best path over all pieces, position by position, in plain Python."""
    pieces = {UNI.names[i]: UNI.automaton.scores[i] for i in range(len(UNI.names)) if i not in UNI.byte_of and i > 2}
    best = [0.0] + [-np.inf] * len(text)
    for i in range(1, len(text) + 1):
        for n in range(1, min(i, 20) + 1):
            score = pieces.get(text[i - n : i], UNI.unknown if n == 1 else None)
            if score is not None:
                best[i] = max(best[i], best[i - n] + score)
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("etaoinsr h.ñ中🙂\n")), min_size=1, max_size=18))
def test_pieces_have_the_best_score_and_come_back(text):
    raw = UNI.encode([text])[0]
    assert UNI.decode(raw) == text
    got, unknown = 0.0, bytearray()
    for i in np.frombuffer(raw, "<u4").tolist():
        if i in UNI.byte_of:
            unknown.append(UNI.byte_of[i])
        else:
            got += UNI.automaton.scores[i]
    got += UNI.unknown * len(unknown.decode())
    assert got == best_scores("▁" + text.replace(" ", "▁"))


def test_pieces_equal_the_librarys_best_path():
    import sentencepiece

    model = bytearray(open(PIECES, "rb").read())
    at = model.rfind(b"\x18\x02\x20\x80\xfa\x01")  # model type and size in the trainer's settings
    model[at + 1] = 1  # the unigram objective over the same pieces
    sp = sentencepiece.SentencePieceProcessor(model_proto=bytes(model))
    words = sorted({w for t in TEXTS if t for w in t.split() if w.isalpha() and w.isascii() and len(w) < 50} | {"herest", "enaich", "thorindge"})
    got = [np.frombuffer(x, "<u4").tolist() for x in UNI.encode(words)]
    assert got == [sp.nbest_encode_as_ids(w, 2)[0] for w in words]


def test_piece_tables(spark):
    out = decode_pieces(encode_pieces(docs(spark), PIECES), PIECES).collect()
    assert {r.doc_id: r.text for r in out} == {3 * i: t or "" for i, t in enumerate(TEXTS)}
    assert encode_pieces(docs(spark).limit(0), PIECES).count() == 0
    assert os.environ.get("TOKENIZERS_PARALLELISM") == "false"
