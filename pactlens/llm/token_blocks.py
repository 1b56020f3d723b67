"""Operator 4: token ids in binary files of patched frame-of-reference blocks.

A file is rows of segments; a segment holds whole documents of at least a target number of ids (one long document may
exceed it) as blocks of 128 ids. Of each block the minimum is subtracted, the rest is packed at the width that a
percentile of its values needs, and the few wider values go to the block's exception list. A segment starts with the
index: minimum, width, number of exceptions and start of each block, so one block can be read alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.llm.memo import tidy

BLOCK = 128


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)  # bit lengths


def _bits(d: np.ndarray) -> np.ndarray:
    high = d >> np.uint32(16)
    return np.where(high > 0, _SHORT[high] + np.uint8(16), _SHORT[d & np.uint32(0xFFFF)]) if high.any() else _SHORT[d]


def encode_segment(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Bytes of a segment: counts, block index, exceptions, packed words."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.empty(blocks * BLOCK, np.uint32)
    v[:n] = ids
    if n:
        v[n:] = ids[-1]
    v = v.reshape(blocks, BLOCK)
    base = v.min(axis=1) if n else np.empty(0, np.uint32)
    d = v - base[:, None]
    bits, place = _bits(d), min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(bits, place, axis=1)[:, place] if n else np.empty(0, np.uint8)
    wide = bits > width[:, None]
    counts = wide.sum(axis=1).astype("<u2")
    at_block, at = np.nonzero(wide)
    stops = np.cumsum(2 * width.astype(np.int64))
    starts = stops - 2 * width
    words = np.zeros(int(stops[-1]) if n else 0, "<u8")
    for w in np.unique(width):
        w = int(w)
        if not w:
            continue
        own = np.flatnonzero(width == w)
        x = np.ascontiguousarray(d[own].T).astype(np.uint64) & np.uint64((1 << w) - 1)
        packed = np.zeros((2 * w, len(own)), np.uint64)
        for i in range(BLOCK):
            q, r = divmod(i * w, 64)
            packed[q] |= x[i] << np.uint64(r)
            if r + w > 64:
                packed[q + 1] |= x[i] >> np.uint64(64 - r)
        words[starts[own][:, None] + np.arange(2 * w)] = packed.T
    head = np.array([n, blocks, len(at)], "<u4")
    parts = (head, base.astype("<u4"), width.astype("u1"), counts, starts.astype("<u4"), at.astype("u1"), d[at_block, at].astype("<u4"), words)
    return b"".join(p.tobytes() for p in parts)


def decode_segment(raw: bytes | pa.Buffer, only: np.ndarray | None = None) -> np.ndarray:
    """The ids of a segment, or of the blocks ``only`` (ascending numbers, each whole but for the last of the segment)."""
    n, blocks, wide = (int(x) for x in np.frombuffer(raw, "<u4", 3))
    at = 12

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    base, width, counts, starts = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u4", blocks)
    places, values = take("u1", wide), take("<u4", wide)
    words = np.frombuffer(raw, "<u8", -1, at)
    chosen = np.arange(blocks) if only is None else np.asarray(only)
    d = np.zeros((len(chosen), BLOCK), np.uint32)
    for w in np.unique(width[chosen]):
        w = int(w)
        if not w:
            continue
        own = np.flatnonzero(width[chosen] == w)
        packed = np.ascontiguousarray(words[starts[chosen[own]].astype(np.int64)[:, None] + np.arange(2 * w)].T)
        x, mask = np.empty((BLOCK, len(own)), np.uint32), np.uint64((1 << w) - 1)
        for i in range(BLOCK):
            q, r = divmod(i * w, 64)
            y = packed[q] >> np.uint64(r)
            if r + w > 64:
                y = y | (packed[q + 1] << np.uint64(64 - r))
            x[i] = y & mask
        d[own] = x.T
    row = np.repeat(np.arange(blocks), counts)
    to = np.full(blocks, -1)
    to[chosen] = np.arange(len(chosen))
    there = to[row] >= 0
    d[to[row[there]], places[there]] = values[there]
    out = (d + base[chosen][:, None]).reshape(-1)
    return out[: len(out) - (blocks * BLOCK - n)] if len(chosen) and chosen[-1] == blocks - 1 else out


SEGMENTS = "part int, segment int, base long, n_ids long, doc_ids array<long>, ends array<long>, payload binary"


def write_token_file(docs: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, percentile: float = 0.9, segment_ids: int = 1 << 20, files: int | None = None) -> None:
    """Encode each whole text (null: empty), end it with ``end_id``, and write the ids in ascending ``id_col`` order.

    Rows are dealt by ranges of the id before they are encoded, so what is shuffled is text; a null id sorts first and
    rows of one id are ordered by text. No rows give no segments.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pactlens.llm.token_ids import TokenIds, encoded_runs

        part, number, base = TaskContext.get().partitionId(), 0, 0
        ids, keys, ends, size = [], [], [], 0  # of the open segment

        def closed() -> pa.RecordBatch:
            payload = encode_segment(np.concatenate(ids), percentile)
            columns = [[part], [number], [base], [size], [pa.concat_arrays(keys).to_pylist()], [np.concatenate(ends)], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SEGMENTS.split(", ")])

        for key, found, stops in encoded_runs(TokenIds(tokenizer), batches, end_id):
            at = 0  # of the run's documents
            while at < len(stops):
                before = int(stops[at - 1]) if at else 0
                full = min(len(stops), 1 + int(np.searchsorted(stops, before + segment_ids - size)))  # documents until the segment is full
                ids.append(found[before : stops[full - 1]])
                keys.append(key.slice(at, full - at))
                ends.append(stops[at:full] - before + size)
                size, at = int(ends[-1][-1]), full
                if size >= segment_ids:
                    yield closed()
                    number, base, ids, keys, ends, size = number + 1, base + size, [], [], [], 0
        if keys:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(files, "id").sortWithinPartitions("id", "text")
    dealt.mapInArrow(tidy(segments), SEGMENTS).write.option("compression", "none").parquet(out)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): per document the number of ids before it in the whole file and its ids, little-endian unsigned 32-bit."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    sizes = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # one row per written part: a bounded number

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pactlens.llm.memo import slices

        for b in batches:
            for i in range(b.num_rows):
                base, keys, ends = b.column(0)[i].as_py(), b.column(1)[i].values, b.column(2)[i].values.to_numpy()
                ids = slices(decode_segment(b.column(3)[i].as_buffer()).astype("<u4"), ends)
                yield pa.RecordBatch.from_arrays([keys, pa.array(base + np.concatenate([[0], ends[:-1]])), ids], ["doc_id", "start", "ids"])

    based = rows.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "ends", "payload")
    return based.mapInArrow(tidy(documents), "doc_id long, start long, ids binary")


def op4_token_blocks(spark, sf_dir):
    import uuid

    import public_tokenizers

    from pactlens.llm.common import shared_dir, table

    out = f"{shared_dir(spark).rstrip('/')}/token-file-{uuid.uuid4().hex}"
    write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    docs = read_token_file(spark, out)
    return docs.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
