"""BPE, packing and record files against the tokenizers library."""

import hashlib
import random
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from retentio.llm import hilbert_pack, segment_bpe, token_records
from retentio.llm.merges import merges
from retentio.llm.token_ids import encoder, public_path

from .helpers import edge_docs, edge_texts

WORD, BYTE = public_path("word_bpe_49k.json"), public_path("byte_bpe_50k.json")


library = lru_cache(Tokenizer.from_file)


def ids_of(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_texts(n):
    rng = random.Random(2)
    chars = " \n\t'sre\x85\xa0\u2003\u3000aéÉß1!.,<|İΣ"
    return ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_word_ids_equal_the_library():
    texts = edge_texts() + odd_texts(600) + ["x <|endoftext|> <|ENDOFTEXT|> y", "don't we'll | a|b || ."]
    ids, counts = encoder(WORD).encode(pa.array(texts, pa.string()))
    known = Tokenizer.from_file(WORD)
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends):
        assert ids[end - n:end].tolist() == known.encode(text or "", add_special_tokens=False).ids


def test_byte_ids_and_decoding_equal_the_library():
    texts = edge_texts() + odd_texts(600)
    bpe, known = segment_bpe.segment_bpe(BYTE), library(BYTE)
    for text, ids in zip(texts, bpe.encode(texts)):
        expected = known.encode(text or "", add_special_tokens=False).ids
        assert ids == expected
        assert bpe.decode(ids) == known.decode(expected, skip_special_tokens=False) == (text or "")


def test_merges_take_the_leftmost_lowest_rank():
    m = merges(BYTE)
    model = Tokenizer.from_file(BYTE).model
    rng = random.Random(7)
    pieces = ["".join(rng.choice("abcdehstrin") for _ in range(n)) for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 400)]
    for piece, ids in zip(pieces, m.encode([p.encode() for p in pieces])):
        assert np.frombuffer(ids, "<u4").tolist() == [t.id for t in model.tokenize(piece)]


def test_op4_digests_of_odd_rows(spark):
    docs = edge_docs(spark)
    got = sorted(map(tuple, segment_bpe.digests(docs, BYTE).collect()), key=str)
    expected = []
    for row in docs.collect():
        ids = ids_of(BYTE, row.text)
        expected.append((row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert segment_bpe.digests(edge_docs(spark, []), BYTE).count() == 0


def check_pieces(pieces, docs):
    covered, filled = {}, {}
    expected = [(r.doc_id, ids_of(WORD, r.text) + [2]) for r in docs.collect()]
    by_doc = {}
    for doc_id, ids in expected:
        by_doc.setdefault(doc_id, []).append(ids)
    for p in pieces:
        assert any(crc(ids[p.start:p.start + p.length]) == p.ids_crc32 and len(ids) == p.doc_tokens for ids in by_doc[p.doc_id])
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc_id, lists in by_doc.items():
        assert sum(n for _, n in covered[doc_id]) == sum(map(len, lists))
    for sequence, parts in filled.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or sequence == max(filled)


def test_op3_every_id_lies_in_one_piece(spark):
    docs = edge_docs(spark)
    check_pieces(hilbert_pack.pack(docs, WORD).collect(), docs)
    assert hilbert_pack.pack(edge_docs(spark, []), WORD).count() == 0


def test_hilbert_curve_visits_neighbouring_cells():
    bits, dims = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = hilbert_pack.hilbert_key(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_op9_round_trip(spark, tmp_path):
    docs = edge_docs(spark)
    got = token_records.round_trip(docs, f"file:{tmp_path}/records", WORD).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, expected = 0, []
    for row in rows:
        ids = ids_of(WORD, row.text) + [2]
        expected.append((row.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(expected, key=str)
    assert token_records.round_trip(edge_docs(spark, []), f"file:{tmp_path}/none", WORD).count() == 0


def test_records_are_framed_and_checked():
    record = token_records.frame(b"payload")
    assert struct.unpack_from("<Q", record)[0] == 7 and token_records.unframe(record) == b"payload"
    with pytest.raises(ValueError):
        token_records.unframe(record[:-1] + bytes([record[-1] ^ 1]))


def test_op9_ties_and_other_ids(spark, tmp_path):
    """Equal and null ids: the same records in the same order however rows are split; ids of other types."""
    rows = [(None, f"text {i} of none") for i in range(40)] + [(5, f"text {i % 7} of five") for i in range(40)] + [(9, "last"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = [sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_records.round_trip(
        docs.repartition(n), f"file://{tmp_path}/{n}", WORD).collect()) for n in (1, 6)]
    assert found[0] == found[1] and [r[1] for r in found[0]] == [None] * 40 + [1] + [5] * 40 + [9]
    with pytest.raises(TypeError):
        token_records.write_records(docs.selectExpr("string(doc_id) AS doc_id", "text"), f"file://{tmp_path}/x", WORD)
