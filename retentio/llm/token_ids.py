"""Token ids of whole texts by the tokenizers library, a column at a time.

For vocabularies that lower-case and drop white space (``word_bpe_49k.json``): cutting a text at
ASCII white space never changes its ids, as no token, normalisation or special token spans such
a gap.  A batch is cut into chunks and dictionary-encoded by Arrow, only its distinct chunks are
looked up in a bounded cache, only the unknown ones are encoded, and the ids of the texts are put
together by index arithmetic.  Unknown words of lower-case Latin letters go through :mod:`.merges` with the same
vocabulary file, all other chunks through the library.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .merges import merges

CACHE_CHUNKS = 300_000          # entries kept per Python worker; the cache is emptied beyond it
CACHED_BYTES = 64               # longer chunks are encoded each time
COMPARED = 32                   # new words of a batch that the library encodes as well
SLICE_BYTES = 4 << 20           # text handled at a time


class ChunkEncoder:
    """Texts to ids.  Chunks that are not plain letters are encoded together in one text, kept
    apart by a separator word whose one id no other chunk of that text can yield."""

    def __init__(self, path: str, separator: str = "|"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = merges(path)
        self.cache: dict[str, bytes] = {}
        self.separator = separator
        [self.separator_id] = self.tokenizer.encode(separator, add_special_tokens=False).ids
        self.closing = {c: self._whole([c])[0] for c in ".,"}

    def _whole(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        gap = f" {self.separator} "
        for at in range(0, len(chunks), 512):
            block = chunks[at:at + 512]
            [x] = self.tokenizer.encode_batch_fast([gap.join(block)], add_special_tokens=False)
            ids = np.array(x.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.separator_id).tolist()
            if len(ends) != len(block) - 1:
                raise ValueError("separator id inside a chunk")
            packed = ids.tobytes()
            out += [packed[4 * b:4 * e] for b, e in zip([0] + [e + 1 for e in ends], ends + [len(ids)])]
        return out

    def _words(self, words: list[str]) -> None:
        """Cache words of lower-case Latin letters, which normalising and pre-tokenizing leave as they are; the
        first of each batch are compared with the library."""
        for word, ids in zip(words, packed := self.merges.encode([w.encode() for w in words])):
            self.cache[word] = ids
        if self._joined(words[:COMPARED]) != packed[:COMPARED]:
            raise ValueError("the merges disagree with the tokenizer")

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        found: list[bytes | None] = list(map(self.cache.get, chunks))
        plain, closed, odd, alone = [], [], [], []
        for i, known in enumerate(found):
            if known is None:
                c = chunks[i]
                if not c:
                    found[i] = b""
                elif _PLAIN.fullmatch(c):
                    (closed if c[-1] in self.closing else plain).append(i)
                else:
                    (alone if self.separator in c else odd).append(i)
        words = {chunks[i] for i in plain} | {chunks[i][:-1] for i in closed}
        self._words(sorted(w for w in words if w not in self.cache))
        for i in plain:
            found[i] = self.cache[chunks[i]]
        for i in closed:
            found[i] = self.cache[chunks[i][:-1]] + self.closing[chunks[i][-1]]
        for some, encode in ((odd, self._joined), (alone, self._whole)):
            for i, ids in zip(some, encode([chunks[i] for i in some]) if some else []):
                found[i] = ids
                if len(chunks[i]) <= CACHED_BYTES:
                    self.cache[chunks[i]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids per text); null texts have none."""
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for part in _slices(texts):
            special = pc.match_substring(part, "<|")
            low = _translated(part, _LOWER_SPACE)
            if pc.any(special).as_py():                    # special tokens are found before lower-casing
                low = pc.if_else(special, _translated(part, _SPACE), low)
            lists = pc.split_pattern(low, " ")             # empty chunks have no ids
            words = lists.flatten().dictionary_encode()
            packed = self._chunks(words.dictionary.to_pylist())
            size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            pool = np.frombuffer(b"".join(packed), "<u4")
            begin = np.cumsum(size) - size
            at = words.indices.to_numpy(zero_copy_only=False)
            n = size[at]
            ends = np.cumsum(n)
            ids.append(pool[np.repeat(begin[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
            cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            counts.append(np.diff(cuts))
        return np.concatenate(ids), np.concatenate(counts)


_PLAIN = re.compile(r"[a-zß-öø-ÿ]{1,64}[.,]?")    # lower-case letters that no normalisation changes
_SPACE = bytes(0x20 if 9 <= b <= 13 else b for b in range(256))

_LOWER_SPACE = bytes(b + 32 if 65 <= b <= 90 else _SPACE[b] for b in range(256))


def _translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Every byte mapped by ``table`` (which keeps UTF-8 valid); ``texts`` has no nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()),
                                            pa.py_buffer(raw.translate(table)))


def _slices(texts: pa.Array):
    """Null-free parts of at most about SLICE_BYTES of text (a longer text stands alone)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


def slices(batch: pa.RecordBatch, column: str, size: int):
    """Parts of a batch of at most about ``size`` bytes in a text column (a longer text stands alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary file."""
    return ChunkEncoder(path)


def public_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)
