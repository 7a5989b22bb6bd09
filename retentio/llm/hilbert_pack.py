"""Sequence packing along a space-filling curve.

Each document becomes a hashed vector of its token ids, a fixed projection takes it to
``DIMS`` coordinates, and a Hilbert key orders the cells.  Documents are range-sorted by
(key, doc_id, row), laid end to end along that order and cut every ``SEQUENCE`` ids, so
neighbours on the curve share sequences and only the very last one is padded.

Plan: one pass tokenizes and writes (row, doc_id, key, ids); the sort moves only the narrow
(key, doc_id, row, count) columns; one shuffle join brings the start positions to the ids.
The number of ids per range partition (one row each) is the only global state.

Defined edge cases: null text is empty and yields its end id alone; equal keys are ordered by
doc_id, equal doc_ids by row, so repeated rows are packed one by one; null doc_id is kept as
null; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, lean, written
from .token_ids import encoder, public_path

SEQUENCE = 4096
END_ID = 2
BUCKETS = 256            # hashed vector
DIMS = 4                 # projected coordinates
BITS = 15                # grid cells per coordinate: 2 ** BITS
SEED = 20260101


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer grid cells (rows) on the Hilbert curve of ``2 ** bits`` cells a side.

    Undoes the curve's rotations from the top bit down, then Gray-codes the coordinates and
    interleaves their bits.
    """
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            flip = np.where(x[i] & q, low, 0)
            x[0] = x[0] ^ flip ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c ^ turn) >> b & 1
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert key of each document (its ids follow one another in ``ids``)."""
    rng = np.random.default_rng(SEED)
    matrix = rng.standard_normal((BUCKETS, DIMS))
    out = np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    bucket = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    for at in range(0, len(counts), 2048):
        n = counts[at:at + 2048]
        part = bucket[ends[at] - counts[at]:ends[at + len(n) - 1]]
        cell = np.repeat(np.arange(len(n)), n) * BUCKETS + part
        vector = np.bincount(cell, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS).astype(float)
        vector /= np.maximum(np.linalg.norm(vector, axis=1), 1e-12)[:, None]
        spot = 1 / (1 + np.exp(-1.7 * (vector @ matrix)))          # normal coordinates spread over (0, 1)
        grid = np.clip((spot * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        out[at:at + 2048] = hilbert_key(grid, BITS)
    return out


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text's ids."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id), counts + 1


def _tokenize(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, counts = with_end(*enc.encode(part.column("text")), end_id)
                width = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
                ends = np.cumsum(counts) * np.dtype(width).itemsize
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), part.num_rows,
                    [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()),
                     pa.py_buffer(ids.astype(width).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(curve_keys(ids, counts)), pa.array(counts), packed.cast(pa.binary())],
                    ["doc_id", "key", "doc_tokens", "ids"])
    return run


def _running(batches):
    """Ids before each row of a sorted partition."""
    from pyspark import TaskContext
    pid, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("doc_tokens").to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(np.full(len(n), pid, np.int64)), pa.array(before), batch.column("doc_tokens")],
            ["row", "part", "before", "doc_tokens"])


def _cut(sequence: int):
    def run(batches):
        for batch in batches:
            doc, start, length, crc, total, seq, offset = [], [], [], [], [], [], []
            for doc_id, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "doc_tokens")),
                                          batch.column("ids")):
                raw = np.frombuffer(ids.as_buffer(), f"<u{len(ids.as_buffer()) // n}").astype("<u4")
                done = 0
                while done < n:
                    room = min(sequence - (at + done) % sequence, n - done)
                    doc.append(doc_id)
                    start.append(done)
                    length.append(room)
                    crc.append(zlib.crc32(raw[done:done + room].tobytes()))
                    total.append(n)
                    seq.append((at + done) // sequence)
                    offset.append((at + done) % sequence)
                    done += room
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.column("doc_id").type), *(pa.array(x, pa.int64()) for x in
                                                               (start, length, crc, total, seq, offset))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", "text").mapInArrow(
        lean(_tokenize(vocabulary, end_id)), f"doc_id {kind}, key long, doc_tokens long, ids binary")
    tokens = written(tokens.withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    order = ["key", "doc_id", "row"]
    placed = written(tokens.select(*order, "doc_tokens").repartitionByRange(*order).sortWithinPartitions(*order)
                     .mapInArrow(_running, "row long, part long, before long, doc_tokens long"), "pack-order")
    totals = placed.groupBy("part").agg(F.sum("doc_tokens").alias("n"))     # one row per range partition
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    starts = placed.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("before")).alias("at"))
    return tokens.join(starts.hint("merge"), "row").select("doc_id", "at", "doc_tokens", "ids").mapInArrow(
        lean(_cut(sequence)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                        "sequence_id long, offset long")


def op3_hilbert_pack(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids of the public word vocabulary."""
    return pack(documents(spark, sf_dir, "doc_id", "text"), public_path("word_bpe_49k.json"))
