"""Byte-pair merges by a segment tree over adjacent pair ranks, many pieces in lockstep.

Each piece has a segment tree whose leaves hold the rank of the pair that starts at a symbol
(none: ``NO_PAIR``) with its place as tie-break, so the root is the leftmost lowest-rank merge.
A merge changes three leaves (the pair itself, the one before, the one that vanishes), each a
logarithmic point update.  Trees of one size class are the rows of one array and all rows merge
once per round until no row has a mergeable pair left.  Memory is bounded by ``CELLS``.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

NO_PAIR = np.int64(1) << 60
CELLS = 1 << 16          # leaves handled at a time


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        end = model.get("end_of_word_suffix") or ""
        self.byte_id = np.array([vocab[s] for s in symbols], np.int64)
        self.last_id = np.array([vocab[s + end] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._slots()

    def _slots(self) -> None:
        """Open-addressing table from pair key to rank (the first rank where a pair is listed twice)."""
        self.bits = max(8, int(len(self.key) * 8).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NO_PAIR, np.int64)
        self.probes = 1
        mask = (1 << self.bits) - 1
        for rank, (key, at) in enumerate(zip(self.key.tolist(), self._home(self.key).tolist())):
            n = 1
            while self.slot_key[at] not in (-1, key):
                at, n = (at + 1) & mask, n + 1
            if self.slot_key[at] == -1:
                self.slot_key[at], self.slot_rank[at] = key, rank
            self.probes = max(self.probes, n)

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where it does not merge."""
        key = a * self.size + b
        at = self._home(key)
        there = self.slot_key[at]
        out = np.where(there == key, self.slot_rank[at], NO_PAIR)
        open_ = np.flatnonzero((there != key) & (there != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.slot_key[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as packed ``<u4`` bytes."""
        if not pieces:
            return []
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_id[data]
        ends = np.cumsum(size)
        full = size > 0
        ids[ends[full] - 1] = self.last_id[data[ends[full] - 1]]
        out: list[bytes] = [b""] * len(pieces)
        level = np.zeros(len(pieces), np.int64)
        level[full] = np.ceil(np.log2(np.maximum(size[full] - 1, 1))).astype(np.int64)
        for lv in np.unique(level[full]).tolist():
            rows = np.flatnonzero(full & (level == lv))
            step = max(1, CELLS >> lv)
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                self._merge(ids, ends[some] - size[some], size[some], 1 << lv, some, out)
        return out

    def _merge(self, ids, begin, size, width, where, out) -> None:
        """Merge the pieces ``ids[begin:begin + size]`` (size <= width + 1) and put them into ``out``."""
        n = len(size)
        place = np.arange(width + 2)
        inside = place[None, :] < size[:, None]
        sym = np.full((n, width + 2), -1, np.int64)
        sym[inside] = ids[(begin[:, None] + place[None, :])[inside]]
        after = np.broadcast_to(place + 1, (n, width + 2)).copy()
        before = np.broadcast_to(place - 1, (n, width + 2)).copy()
        tree = np.full((n, 2 * width), NO_PAIR, np.int64)
        two = inside[:, 1:width + 1]
        r = self.rank(sym[:, :width][two], sym[:, 1:width + 1][two])
        leaf = np.broadcast_to(place[:width], (n, width))[two]
        tree[:, width:][two] = np.where(r < NO_PAIR, r * width + leaf, NO_PAIR)
        half = width >> 1
        while half:
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
            half >>= 1
        tree, sym, after, before = tree.ravel(), sym.ravel(), after.ravel(), before.ravel()
        row = np.arange(n)
        root = tree[1::2 * width]
        while True:
            live = root < NO_PAIR
            if not live.any():
                break
            row, root = row[live], root[live]
            base, node = row * (width + 2), row * (2 * width)
            left, new = root % width, self.made[root // width]
            at = base + left
            right = after.take(at)
            then = after.take(base + right)
            first = before.take(at)
            sym[at] = new
            sym[base + right] = -1
            after[at] = then
            before[base + then] = left
            no_next, no_first = then >= size.take(row), first < 0
            a = np.concatenate([new, sym.take(base + np.maximum(first, 0))])
            b = np.concatenate([sym.take(base + then), new])
            rank = self.rank(a, b)
            rank[np.concatenate([no_next, no_first])] = NO_PAIR
            leaf = np.concatenate([left, np.where(no_first, left, first)])
            value = np.where(rank < NO_PAIR, rank * width + leaf, NO_PAIR)
            value[len(row):] = np.where(no_first, value[:len(row)], value[len(row):])
            gone = np.where(no_next & (right >= width), left, np.minimum(right, width - 1))
            tree[node + gone + width] = NO_PAIR              # a last symbol has no leaf of its own
            nodes = np.concatenate([node, node])
            tree[nodes + leaf + width] = value
            # the three paths climb together: a level is redone after the whole level below it
            nodes, leaf = np.concatenate([nodes, node]), np.concatenate([leaf, gone]) + width
            step = width
            while step > 1:
                leaf >>= 1
                under = nodes + 2 * leaf
                tree[nodes + leaf] = np.minimum(tree.take(under), tree.take(under + 1))
                step >>= 1
            root = tree.take(node + 1)
        alive = sym >= 0
        packed = sym[alive].astype("<u4").tobytes()
        stop = np.cumsum(alive.reshape(n, width + 2).sum(1)) * 4
        for i, b, e in zip(where.tolist(), [0, *stop[:-1].tolist()], stop.tolist()):
            out[i] = packed[b:e]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)
