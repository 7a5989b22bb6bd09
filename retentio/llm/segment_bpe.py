"""Byte-level BPE encoding and decoding with segment trees of pair ranks.

A text is cut at special tokens, then into chunks of one optional space and the run after it,
and each distinct chunk into pre-tokens; unknown pre-tokens are merged by :mod:`.merges`.
Decoding puts the bytes of the ids together and reads them as UTF-8.

Cutting into chunks first keeps the pre-tokenizer's matches: between ASCII white space it never
looks across a chunk's ends, and texts with any other white space are cut by the full pattern.

Defined edge cases: null text is empty (no ids, empty digest of the empty string); texts of any
length are encoded whole; repeated rows give one result each; null doc_id is kept; an empty
table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, lean
from .merges import merges
from .token_ids import public_path

CACHE_PIECES = 500_000
CACHED_CHARS = 48
Entry = tuple[int, bytes, bytes]

# The vocabulary's pre-token pattern, white space spelled out.
_WS = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+"
             rf"|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_GAP = r"(?=[ \t-\r]|\Z)"            # a word's closing mark is a chunk of its own
_CHUNK = (rf" ?[^ \t-\r.,]++(?:{_GAP}|(?<=[^\W_])(?=[.,]{_GAP}))|[.,]{_GAP}"
          r"| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_OTHER_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class SegmentBpe:
    """Encoder and decoder of one vocabulary file.  Each chunk of a text is an entry (number of ids, the ids as
    comma-joined decimals, the bytes that they decode to); entries of short chunks are kept, in bounded number."""

    def __init__(self, path: str):
        import regex
        self.merges = merges(path)
        self.pieces = regex.compile(PRE_TOKEN).findall
        self.chunks = re.compile(_CHUNK).findall
        self.other_space = re.compile(_OTHER_SPACE).search
        self.decimal = [str(i).encode() for i in range(self.merges.size)]
        marks = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.marks = {m: (1, self.decimal[i], self.merges.bytes_of[i]) for m, i in self.merges.special.items()}
        self.cache: dict[str, Entry] = dict(self.marks)

    def _cut(self, text: str) -> list[str]:
        if not text.isascii() and self.other_space(text):
            return self.pieces(text)
        return self.chunks(text)

    def _learn(self, chunks: set[str]) -> dict[str, Entry]:
        """Entries of chunks that are not kept.  A word is a pre-token of its own, any other chunk is cut by the pattern."""
        kept = self.cache
        new = [c for c in chunks if (c[1:] if c[0] == " " else c).isalpha()]
        odd = {c: self.pieces(c) for c in chunks.difference(new)}
        new += set(chain.from_iterable(odd.values())).difference(new, kept)
        packed = self.merges.encode([p.encode("utf-8", "replace") for p in new])
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat, ends = np.frombuffer(b"".join(packed), "<u4").tolist(), np.cumsum(size).tolist()
        decimals, raw = list(map(self.decimal.__getitem__, flat)), list(map(self.merges.bytes_of.__getitem__, flat))
        found = {p: (e - b, b",".join(decimals[b:e]), b"".join(raw[b:e])) for p, b, e in zip(new, [0, *ends], ends)}
        for c, parts in odd.items():
            if len(parts) > 1:
                n, ids, content = zip(*[found.get(p) or kept[p] for p in parts])
                found[c] = (sum(n), b",".join(ids), b"".join(content))
            elif parts[0] not in found:
                found[c] = kept[parts[0]]
        return found

    def entries(self, texts: list[str | None]) -> list[list[Entry]]:
        """The entries of each text, in order."""
        if len(self.cache) > CACHE_PIECES:
            self.cache = dict(self.marks)
        cut: list[list[str]] = []
        for text in texts:
            text = text or ""
            if self.special is not None and (parts := self.special.split(text))[1:]:
                cut.append([c for p in parts for c in ([p] if p in self.marks else self._cut(p))])
            else:
                cut.append(self._cut(text))
        new = self._learn(set(chain.from_iterable(cut)).difference(self.cache))
        self.cache.update(new)
        found = [list(map(self.cache.__getitem__, chunks)) for chunks in cut]
        for c in new:
            if len(c) > CACHED_CHARS:
                del self.cache[c]
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(map(int, b",".join([x[1] for x in found]).split(b","))) if found else [] for found in self.entries(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.merges.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def valid_utf8(raw: bytes) -> bytes:
    """What reading ``raw`` as UTF-8, with replacement, and writing it again gives."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def segment_bpe(path: str) -> SegmentBpe:
    return SegmentBpe(path)


def _digests(path: str, slice_chars: int):
    def run(batches):
        bpe = segment_bpe(path)
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id")
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= slice_chars):
                    chars += len(texts[to] or "")
                    to += 1
                n, ids, decoded = [], [], []
                for found in bpe.entries(texts[at:to]):
                    counts, decimals, raw = zip(*found) if found else ((), (), ())
                    n.append(sum(counts))
                    ids.append(hashlib.sha256(b",".join(decimals)).hexdigest())
                    decoded.append(hashlib.sha256(valid_utf8(b"".join(raw))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(at, to - at), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at = to
    return run


def _ids(path: str):
    def run(batches):
        bpe = segment_bpe(path)
        for batch in batches:
            ids = bpe.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"])
    return run


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded text of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_ids(vocabulary)), f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, slice_chars: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and texts stay inside the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lean(_digests(vocabulary, slice_chars)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_segment_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public byte vocabulary."""
    return digests(documents(spark, sf_dir, "doc_id", "text"), public_path("byte_bpe_50k.json"))
