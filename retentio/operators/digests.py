"""MD5 of many short texts at once, on numpy arrays: a lane per text, the same steps for all lanes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ONE_BLOCK = 55                     # bytes of a text that fits one block with its length


def _steps(words: np.ndarray) -> list[np.ndarray]:
    """The four state words after one block; ``words`` holds the 16 words of each lane's block, (16, lanes)."""
    a, b, c, d = (np.full(words.shape[1], s, np.uint32) for s in START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        for part in (a, words[g], np.uint32(SINES[i])):
            np.add(f, part, out=f)
        np.right_shift(f, np.uint32(32 - SHIFTS[i]), out=t)
        np.bitwise_or(np.left_shift(f, np.uint32(SHIFTS[i]), out=f), t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), START)]


class Prefixes:
    """Texts (UTF-8 values one after the other, and their offsets) that suffixes are appended to."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.texts, self.offsets = values, offsets.astype(np.int64)
        self.lengths = np.diff(self.offsets)
        self.longest = int(self.lengths.max(initial=0))
        self.rows = [(int(n), np.flatnonzero(self.lengths == n)) for n in np.unique(self.lengths)] if self.longest <= ONE_BLOCK else []
        self.start = np.zeros((len(self.lengths), 64), np.uint8)
        for n, rows in self.rows:
            self.start[rows, :n] = self.texts[self.offsets[rows][:, None] + np.arange(n)]

    @classmethod
    def of(cls, texts: pa.Array) -> "Prefixes":
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
        _, ends, values = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        return cls(np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8), ends)

    def digests(self, suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """MD5 of every text followed by each suffix, as (suffixes, texts) arrays of its first and its last eight bytes,
        which compare as numbers like the hexadecimal text does."""
        shape = len(suffixes), len(self.lengths)
        if self.longest + max(map(len, suffixes)) > ONE_BLOCK:
            found = np.frombuffer(b"".join(hashlib.md5(self.texts[a:b].tobytes() + s).digest() for s in suffixes
                                           for a, b in zip(self.offsets, self.offsets[1:])), ">u8").reshape(*shape, 2)
            return found[..., 0].astype(np.uint64), found[..., 1].astype(np.uint64)
        block = np.broadcast_to(self.start, (*shape, 64)).copy()
        for one, s in zip(block, suffixes):
            for n, rows in self.rows:
                end = n + len(s)
                one[rows, n:end + 1] = np.frombuffer(s + b"\x80", np.uint8)
                one[rows, 56:58] = np.frombuffer((8 * end).to_bytes(2, "little"), np.uint8)
        words = [w.byteswap().astype(np.uint64) for w in _steps(np.ascontiguousarray(block.reshape(-1, 64).view("<u4").T))]
        return tuple((high << np.uint64(32) | low).reshape(shape) for high, low in (words[:2], words[2:]))


def hash_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places in ascending order of the digests; equal digests keep their order."""
    order = np.argsort(high, kind="stable")
    ranked = high[order]
    return np.lexsort((low, high)) if (ranked[1:] == ranked[:-1]).any() else order
