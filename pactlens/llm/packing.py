"""Operator 2: best-fit packing of documents into sequences, as vector bin packing.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths). Pieces are
placed from the longest down; of the open sequences with room under every constraint, the one with the least weighted
norm of what is left is taken (``rule="norm"``), or the one with the greatest weighted dot product of the piece and
what is left (``rule="dot"``). Pieces are dealt round robin into groups of a bounded number of tokens and rows, each
packed by one task, which also joins the pieces' ids into the sequences; a group costs at most about one unfilled
sequence in thousands, or in hundreds where every document is a token or two, as a group has a million rows at most. The sequences are written, and the digests of the pieces are taken from what is read back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.memo import tidy

#: The last two never bind when a piece has at least one token: the contract limits tokens alone.
CAPACITY = (4096, 4096, 4096 * 4096)
WEIGHTS = (1.0, 0.05, 0.05)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int] = CAPACITY, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. A piece that fits no empty sequence is refused with ValueError."""
    cap = np.array(capacity, float)
    scale = np.sqrt(np.array(weights, float)) / cap
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > cap[0] or lengths.max() ** 2 > cap[2] or cap[1] < 1):
        raise ValueError("a piece is larger than an empty sequence")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 0
    left, names = np.empty((3, 1024)), np.empty(1024, np.int64)  # of the open sequences
    n = made = at = 0
    while at < len(order):
        size = int(lengths[order[at]])
        item = np.array((size, 1.0, float(size) * size))
        rest = left[:, :n] - item[:, None]
        fits = np.flatnonzero((rest >= 0).all(axis=0))
        if len(fits):
            near = rest[:, fits] * scale[:, None]
            score = (near * near).sum(axis=0) if rule == "norm" else -((left[:, fits] * scale[:, None]) * (item * scale)[:, None]).sum(axis=0)
            to = int(fits[np.argmin(score)])
        else:
            if n == len(names):
                left, names = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([names, np.empty_like(names)])
            to, names[n], left[:, n] = n, made, cap
            n, made = n + 1, made + 1
        many = 1
        if rule == "norm":  # what was nearest to full stays so: it takes all pieces of this size that it has room for
            many = int(min(np.floor(left[item > 0, to] / item[item > 0]).min(), _same(lengths, order, at)))
        own = order[at : at + many]
        sequence[own], offset[own] = names[to], int(cap[0] - left[0, to]) + size * np.arange(many)
        left[:, to] -= item * many
        at += many
        if left[0, to] < least or left[1, to] < 1 or left[2, to] < least * least:  # closed: the last open one takes its place
            n -= 1
            left[:, to], names[to] = left[:, n], names[n]
    return sequence, offset


def _same(lengths: np.ndarray, order: np.ndarray, at: int) -> int:
    """How many of the pieces in ``order`` from ``at`` on have the same length."""
    step = 1
    while at + step < len(order) and lengths[order[at + step]] == lengths[order[at]]:
        step *= 2
    low, high = step // 2, min(step, len(order) - at)  # the run ends after low, at high at the latest
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if lengths[order[at + mid]] == lengths[order[at]] else (low, mid)
    return high


def token_pieces(docs: DataFrame, tokenizer: str, tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, narrow: bool = False, memory: int = 500_000, run: int = 4_000_000, profile: ResourceProfile | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): each whole text's ids (null: empty) and ``end_id``, cut only beyond ``tokens`` ids.

    ``narrow`` gives the ids two bytes each, if those hold every id of the vocabulary. ``memory`` is how many words a task
    remembers and ``run`` how many bytes of text it takes at a time: less of either takes less memory and more time.
    ``profile`` says what a task needs (see :func:`pactlens.llm.common.wide_tasks`).
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pactlens.llm.memo import slices
        from pactlens.llm.token_ids import TokenIds, encoded_runs

        encoder = TokenIds(tokenizer, memory)
        kind = "<u2" if narrow and max(len(encoder.ends) - 1, end_id) < 1 << 16 else "<u4"
        for keys, ids, ends in encoded_runs(encoder, batches, end_id, run):
            n = np.diff(ends, prepend=0)
            cuts = -(-n // tokens)
            doc = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            length = np.minimum(tokens, n[doc] - piece * tokens)
            columns = [keys.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * tokens), pa.array(length), slices(ids.astype(kind), np.cumsum(length))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(pieces), "doc_id long, piece int, start long, length long, ids binary", profile=profile)


def pack(pieces: DataFrame, capacity: tuple[int, int, int] = CAPACITY, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", length_col: str = "length", group_sequences: int = 4096, group_rows: int = 1_000_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. The input is read twice: hand over a written table.

    A null length counts as 0. Columns named as the new ones are replaced. No rows give no rows.
    """
    clean = _counted(pieces, length_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema) + ", sequence_id long, offset long"
    return _packed(clean, capacity, weights, rule, length_col, group_sequences, group_rows, pa.Table.to_batches, schema)


def _counted(pieces: DataFrame, length_col: str) -> DataFrame:
    return pieces.drop("sequence_id", "offset").withColumn(length_col, F.coalesce(length_col, F.lit(0)))


def _packed(clean: DataFrame, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str, length_col: str, group_sequences: int, group_rows: int, finish: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``finish`` makes of each group's rows with their ``sequence_id`` and ``offset``."""
    total = clean.agg(F.sum(length_col).alias("tokens"), F.count("*").alias("rows")).first()
    groups = max(1, -(-int(total["tokens"] or 0) // (capacity[0] * group_sequences)), -(-total["rows"] // group_rows))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if group := list(batches):
            rows = pa.Table.from_batches(group)
            group.clear()
            sequence, offset = best_fit(rows[length_col].to_numpy(), capacity, weights, rule)
            rows = rows.append_column("sequence_id", pa.array(sequence + (TaskContext.get().partitionId() << 32), pa.int64()))
            yield from finish(rows.append_column("offset", pa.array(offset, pa.int64())))

    return clean.repartition(groups).mapInArrow(tidy(packed), schema)


PART = ("doc_id", "piece", "start", "length", "offset")


def _joined(rows: pa.Table, step: int = 256) -> Iterator[pa.RecordBatch]:
    """(sequence_id, ids, parts) of one group's rows, ``step`` sequences at a time; ids that follow each other need no joining in Arrow's layout."""
    rows = rows.set_column(rows.schema.get_field_index("ids"), "ids", rows["ids"].cast(pa.binary())).combine_chunks()
    sequence = rows["sequence_id"].to_numpy()
    order = np.lexsort((rows["offset"].to_numpy(), sequence))
    sequence = sequence[order]
    begins = np.append(np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1])), len(sequence)) if len(sequence) else np.zeros(1, int)
    for at in range(0, len(begins) - 1, step):
        cuts = begins[at : at + step + 1]
        part = rows.take(pa.array(order[cuts[0] : cuts[-1]])).combine_chunks()
        ids, cuts = pa.concat_arrays(part["ids"].chunks), cuts - cuts[0]
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        raw, ends = np.frombuffer(ids.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        if len(raw) == 2 * pc.sum(part["length"]).as_py():  # narrow ids
            raw, ends = raw.view("<u2").astype("<u4"), 2 * ends
        whole = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts].tobytes()), pa.py_buffer(raw)])
        parts = pa.StructArray.from_arrays([pa.concat_arrays(part[c].chunks) for c in PART], list(PART))
        names = part["sequence_id"].to_numpy()[cuts[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(names), whole, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts)], ["sequence_id", "ids", "parts"])


def pack_sequences(pieces: DataFrame, capacity: tuple[int, int, int] = CAPACITY, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group_sequences: int = 4096, group_rows: int = 1_000_000) -> DataFrame:
    """(sequence_id, ids, parts) of :func:`token_pieces`' rows, narrow or not: each sequence's ids, four bytes each, and where in it which piece is. The input is read twice, as by :func:`pack`."""
    schema = "sequence_id long, ids binary, parts array<struct<doc_id:long,piece:int,start:long,length:long,offset:long>>"
    return _packed(_counted(pieces.select("doc_id", "piece", "start", "length", "ids"), "length"), capacity, weights, rule, "length", group_sequences, group_rows, _joined, schema)


def placements(sequences: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of the pieces in :func:`pack_sequences`' rows, and their ids; digest and ids are the slice of the sequence at offset and length."""
    own = F.substring(F.col("ids"), (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    cut = sequences.select("sequence_id", "ids", F.explode("parts").alias("p")).withColumn("own", own)
    return cut.select("p.doc_id", "p.piece", "p.start", "p.length", *([F.col("own").alias("ids")] if keep_ids else []), F.crc32("own").alias("ids_crc32"), "sequence_id", "p.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves, from :func:`pack`'s rows with their ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"), F.expr("transform(parts, p -> p.doc_id)").alias("doc_ids")
    )


def packed_documents(docs: DataFrame, tokenizer: str, tokens: int = 4096, **limits) -> DataFrame:
    """The sequences of all documents, written and read back; ``limits`` are the memory, run and profile of :func:`token_pieces`."""
    from pactlens.llm.common import stash

    pieces = stash(token_pieces(docs, tokenizer, tokens, narrow=True, **limits), "pieces", "zstd")
    return stash(pack_sequences(pieces, (tokens, tokens, tokens * tokens)), "sequences", "zstd")


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = 4096, keep_ids: bool = False, **limits) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents, and with ``keep_ids`` ids, as they are in the written sequences."""
    return placements(packed_documents(docs, tokenizer, tokens, **limits), keep_ids)


def op2_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from pactlens.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
