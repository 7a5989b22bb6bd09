"""Token ids as length-delimited binary records, with a separate offset index.

Shard file: records one after the other, in ascending doc_id order over all shards.  A record is

    length (u64) | masked crc32 of the length (u32) | payload | masked crc32 of the payload (u32)

and its payload ``flags (u8) | doc_id (i64) | ids before it in the shard (i64) | ids``; all numbers
little-endian, ids two bytes wide where the vocabulary allows (flag 2), flag 1: doc_id is not null.
The mask rotates the checksum by 15 bits and adds a constant, so checksums of data that holds
checksums stay useful.  The index (Parquet) has one row per record: shard, offset, length, doc_id,
n_tokens; any selection or order of its rows can be read with :func:`read_records`.

Shards are written by the tasks of a range-partitioned, sorted plan.  Equal and null ids are ordered and split by a hash of
their text, so a repeated task writes the same records.  Every attempt has a shard file of its own, which its index rows
name, and the index holds the rows of the attempts that were committed, so repeated and speculative tasks do no harm.
The folder must be reachable by all executors under the same URI (``spark.checkpoint.dir``).

Defined edge cases: null text is empty and yields its end id alone; repeated rows give one record
each; null doc_id sorts first; ids are integers and come back as longs (other types: ``TypeError``); an empty table gives an
empty index and no rows; a damaged record raises ``ValueError``; other input columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_scratch
from .common import documents
from .hilbert_pack import END_ID, with_end
from .token_ids import encoder, public_path

HEAD, PAYLOAD = "<QI", "<Bqq"
INDEX = "shard string, offset long, length long, doc_id {kind}, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(record: bytes) -> bytes:
    """Payload of a whole framed record, both checksums verified."""
    head = struct.calcsize(HEAD)
    length, crc = struct.unpack_from(HEAD, record)
    payload = record[head:head + length]
    if crc != masked(record[:8]) or len(record) != head + length + 4 \
            or struct.unpack_from("<I", record, head + length)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def filesystem(uri: str):
    """(file system, path) of a shared folder; ``file:/x`` and plain paths are local."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _writer(folder: str, vocabulary: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        context = TaskContext.get()
        enc = encoder(vocabulary)
        narrow = enc.tokenizer.get_vocab_size() <= 1 << 16
        files, base = filesystem(folder)
        shard = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.rec"
        out, offset, before = None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, counts = with_end(*enc.encode(part.column("text")), end_id)
                if not len(counts):
                    continue
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{shard}")
                raw, ends = ids.astype("<u2" if narrow else "<u4"), np.cumsum(counts)
                offsets, lengths, doc_ids = [], [], part.column("doc_id")
                for doc_id, n, end in zip(doc_ids.to_pylist(), counts.tolist(), ends.tolist()):
                    flags = (doc_id is not None) + 2 * narrow
                    record = frame(struct.pack(PAYLOAD, flags, doc_id or 0, before) + raw[end - n:end].tobytes())
                    out.write(record)
                    offsets.append(offset)
                    lengths.append(len(record))
                    offset, before = offset + len(record), before + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(counts)), pa.array(offsets), pa.array(lengths), doc_ids, pa.array(counts)],
                    ["shard", "offset", "length", "doc_id", "n_tokens"])
        if out is not None:
            out.close()
    return run


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write shard files and the offset index of ``docs(doc_id, text)`` under ``folder``; returns the index."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be an integer, not {kind}")
    schema = INDEX.format(kind=kind)
    order = ["doc_id", "tie"]
    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(*order)
               .sortWithinPartitions(*order).select("doc_id", "text"))
    ordered.mapInArrow(_writer(f"{folder}/shards", vocabulary, end_id), schema).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/index")


def _reader(folder: str):
    def run(batches):
        files, base = filesystem(folder)
        name, source = None, None
        for batch in batches:
            doc, shards, before, n_tokens, crc = [], [], [], [], []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, files.open_input_file(f"{base}/{shard}")
                payload = unframe(source.read_at(length, offset))
                flags, doc_id, ahead = struct.unpack_from(PAYLOAD, payload)
                ids = np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=struct.calcsize(PAYLOAD))
                doc.append(doc_id if flags & 1 else None)
                shards.append(shard)
                before.append(ahead)
                n_tokens.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(shards, pa.string()),
                 *(pa.array(x, pa.int64()) for x in (before, n_tokens, crc))],
                ["doc_id", "shard", "before", "n_tokens", "ids_crc32"])
        if source is not None:
            source.close()
    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, in its order per partition: doc_id, shard, before, n_tokens, ids_crc32."""
    return index.select("shard", "offset", "length").mapInArrow(
        _reader(f"{folder}/shards"), "doc_id long, shard string, before long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Write, then read back every record: doc_id, start, n_tokens, ids_crc32, shard."""
    index = write_records(docs, folder, vocabulary)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).persist()        # one row per shard
    try:
        tasks = max(1, totals.count())
    finally:
        totals.unpersist()
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    records = read_records(index.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset"),
                           folder)
    return records.join(F.broadcast(base), "shard").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op9_token_records(spark, sf_dir: str) -> DataFrame:
    """Every document written to record files in ascending doc_id order, and read back."""
    return round_trip(documents(spark, sf_dir, "doc_id", "text"), shared_scratch(spark, "records"),
                      public_path("word_bpe_49k.json"))
