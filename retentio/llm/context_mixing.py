r"""Language-model scoring by logistic context mixing over bits.

Text: words (A-Z lower-cased) joined by one space, then an end byte.  Each byte is eight binary
decisions; for each, predictors of order 0 to 5 look up the counts of their context and node in
hashed tables, their log-odds are summed with weights gated by the predictor's own confidence and
the longest context known, and an adaptive probability map refines the sum.  The probabilities of
all texts add up to one, so a score is the log10 probability of the token sequence.

Learning reads every training document: all 6-byte windows are counted in Spark (the sufficient
statistic of every table).  A seventh of the documents is kept apart from a first set of tables;
on its windows weights learn online in ``SHARDS`` shards (by a hash of the window, keys in order) and
are averaged over shards, ``ROUNDS`` times, and the probability map is counted.  Shards, counts and their
order do not depend on how the rows are split, so neither do the scores.  Final tables hold all training documents.  Sizes: tables have
``2 ** SLOT_BITS`` two-byte cells per order whatever the corpus (about 50 MB in all), so the model
is broadcast; window and word counts grow with the corpus and stay distributed.

Scoring is a function of the window, so each task keeps the costs of windows it has met in a table
of fixed size.

One pass reads the texts and writes slices: the distinct words of some megabytes of documents, the
places of each document's words in them, and packed window counts.  Everything else reads the
slices.  Word counts stay distributed: each slice sends its distinct words to the count table and
gets their counts back, so a document's words are never exploded into rows.

Defined edge cases: null or word-less text is its end token alone; null doc_id is not held out;
repeated rows count and are scored one by one; without training rows the base is that of N = V = 0
and every bit has its neutral estimate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, dropped, written
from .token_ids import slices

FOLDS, HELD, APART = 7, 2, 6       # crc32 folds: held out; kept apart from the first tables
ORDERS = 6                         # contexts of 0 to 5 bytes
SLOT_BITS = 22
BLOCK_BITS = 16
PRIOR = 0.2
MAP_CONTEXTS, MAP_STEPS, MAP_PRIOR = 4096, 24, 24.0
GATE = ORDERS * 16 * ORDERS        # weights of a gate: order, its confidence, the gate's value
ROUNDS = 3
SHARDS = 64
MERGED = 30_000_000                # window rows whose cells one group of a block merges
BATCH = 4096
RATE = 0.03
KNOWN_BITS = 20                    # windows whose costs a task keeps
SLICE = 2 << 20
HELD_WINDOWS = 2_000_000
RUN_TOKENS = 120_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- texts and windows

def canonical(texts: list[str | None]) -> list[bytes]:
    return [b" ".join((t or "").encode("utf-8", "replace").lower().split()) + b"\n" for t in texts]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(window of each byte: five bytes before it and itself, as 48 bits; bytes per text)."""
    pad = b"\0" * (ORDERS - 1)
    raw = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(raw) - ORDERS + 1
    key = np.zeros(n, np.uint64)
    for j in range(ORDERS):
        key = (key << np.uint64(8)) | raw[j:j + n]
    begin = np.cumsum(size + len(pad)) - size - len(pad)
    ends = np.cumsum(size)
    return key[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


def _merged(held: list) -> list:
    """Counts summed by key, keys ascending."""
    key, rest, apart = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [key[starts], *(np.add.reduceat(c[order], starts, dtype=np.uint32) for c in (rest, apart))]


class WindowCounter:
    """Counts of windows, for the documents apart and the rest, with at most HELD_WINDOWS in memory."""

    def __init__(self):
        self.held: list = []

    def add(self, texts: list[bytes], folds: np.ndarray):
        learned = [t for t, f in zip(texts, folds) if f != HELD]
        at, size = 0, 0
        for i, t in enumerate(learned + [None]):
            if t is None or size + len(t) > SLICE:
                if i > at:
                    key, n = windows(learned[at:i])
                    apart = np.repeat(folds[folds != HELD][at:i] == APART, n)
                    self.held.append(_merged([[key, ~apart, apart]]))
                at, size = i, 0
            size += len(t or b"")
        if sum(len(h[0]) for h in self.held) > HELD_WINDOWS:
            self.held = [_merged(self.held)]
            if len(self.held[0][0]) > HELD_WINDOWS // 2:
                yield from self.flush()

    def flush(self):
        if self.held:
            key, rest, apart = _merged(self.held)
            self.held = []
            for at in range(0, len(key), 1 << 17):
                yield [c[at:at + (1 << 17)].astype(kind).tobytes() for c, kind in ((key, "<u8"), (rest, "<u4"), (apart, "<u4"))]


def _unpacked(batches):
    """Packed counts to rows (key, rest, apart)."""
    for batch in batches:
        for key, rest, apart in zip(*(batch.column(c).to_pylist() for c in ("keys", "rest", "apart"))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(key, "<i8")), *(pa.array(np.frombuffer(c, "<u4").astype(np.int64)) for c in (rest, apart))],
                ["key", "rest", "apart"])


# ---------------------------------------------------------------- model

def _context(key: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` bytes before the window's last."""
    bytes_ = (key >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
    return (bytes_ + np.uint64(order + 1)) * _A


def _slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    h = (context ^ (node * _B)) * _A
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slots(batches):
    """Counts per order and cell (slot and bit), combined per task, packed by blocks of slots."""
    held: list = []
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("key", "rest", "apart")])
        if sum(len(h[0]) for h in held) >= 200_000:
            yield from _slot_counts(held)
            held = []
    if held:
        yield from _slot_counts(held)


def _slot_counts(held):
    key, rest, apart = (np.concatenate(c) for c in zip(*held))
    key = key.view(np.uint64)
    sym = key & np.uint64(255)
    for order in range(ORDERS):
        context = _context(key, order)
        cells = []
        for bit in range(7, -1, -1):
            node = (sym | np.uint64(256)) >> np.uint64(bit + 1)
            cells.append(_slot(context, node) << 1 | (sym >> np.uint64(bit) & np.uint64(1)).astype(np.int64))
        found, at = np.unique(np.concatenate(cells), return_inverse=True)
        n = [np.bincount(at, np.tile(c, 8), minlength=len(found)).astype(np.int64) for c in (rest, apart)]
        block = found >> (BLOCK_BITS + 1)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(found)]))
        local = (found & ((2 << BLOCK_BITS) - 1)).astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(cuts), order, np.int32)), pa.array(block[starts]),
             *(pa.array([c[x:y].astype("<u4").tobytes() for x, y in cuts], pa.binary()) for c in (local, *n))],
            ["order", "block", "cells", "rest", "apart"])


def state(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Cell of 16 bits: quantised log-odds and, below, a logarithmic confidence (0: never seen)."""
    n = zeros + ones
    odds = np.log((ones + PRIOR) / (zeros + PRIOR))
    level = np.clip(np.round(odds * 256) + 2048, 0, 4095).astype(np.int64)
    sure = np.where(n > 0, np.minimum(15, 1 + np.floor(np.log2(np.maximum(n, 1)))), 0).astype(np.int64)
    return (level << 4 | sure).astype(np.uint16)


NEUTRAL = 2048 << 4
_ODDS = ((np.arange(65536) >> 4) - 2048).astype(np.float32) / 256


def _block_counts(table: pa.Table) -> np.ndarray:
    counts = np.zeros((2, 2 << BLOCK_BITS), np.int64)
    for cells, rest, apart in zip(*(table.column(c).to_pylist() for c in ("cells", "rest", "apart"))):
        at = np.frombuffer(cells, "<u4")
        counts[0, at] += np.frombuffer(rest, "<u4")
        counts[1, at] += np.frombuffer(apart, "<u4")
    return counts


def _merge(table: pa.Table) -> pa.Table:
    """One row of the counts of a block's share."""
    counts = _block_counts(table)
    at = np.flatnonzero(counts.sum(0))
    packed = [at.astype("<u4"), *(np.minimum(c[at], 0xFFFFFFFF).astype("<u4") for c in counts)]
    return pa.table([table.column(c).slice(0, 1) for c in ("order", "block")] + [pa.array([c.tobytes()], pa.binary()) for c in packed],
                    ["order", "block", "cells", "rest", "apart"])


def _pack(table: pa.Table) -> pa.Table:
    """Cells of one block of slots, for the first and the final tables, compressed."""
    rest, apart = _block_counts(table)
    cells = []
    for n in (rest, rest + apart):
        zeros, ones = n[::2], n[1::2]
        cells.append(compressed(np.where(zeros + ones > 0, state(zeros, ones), np.uint16(NEUTRAL)).astype("<u2")))
    return pa.table({"order": table.column("order").slice(0, 1), "block": table.column("block").slice(0, 1),
                     "first": pa.array(cells[:1], pa.binary()), "final": pa.array(cells[1:], pa.binary())})


def _tables(counted: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, final) cell tables, orders x slots; their size does not depend on the corpus.  The counts of ``rows``
    windows are merged in shares first where there are many.  Blocks travel compressed, a few per task."""
    layout = "order int, block long, cells binary, rest binary, apart binary"
    slots = counted.mapInArrow(_slots, layout)
    if rows > MERGED:
        share = F.pmod(F.monotonically_increasing_id(), F.lit(rows // MERGED + 1))
        slots = slots.withColumn("share", share).groupBy("order", "block", "share").applyInArrow(_merge, layout)
    packed = written(slots.groupBy("order", "block").applyInArrow(_pack, "order int, block long, first binary, final binary"), "lm-tables")
    first = np.full((ORDERS, 1 << SLOT_BITS), NEUTRAL, np.uint16)
    final = first.copy()
    for row in packed.repartition(ORDERS << (SLOT_BITS - BLOCK_BITS - 2), "order", "block").collect():     # fixed size
        at = slice(row.block << BLOCK_BITS, (row.block + 1) << BLOCK_BITS)
        first[row.order, at] = np.frombuffer(zlib.decompress(row.first), np.uint16)
        final[row.order, at] = np.frombuffer(zlib.decompress(row.final), np.uint16)
    dropped(packed)
    return first, final


class Mixer:
    """Tables, gated weights and the adaptive probability map."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.tables = tables
        self.weights = np.full(2 * GATE, 0.15) if weights is None else weights.copy()
        self.refined = refined
        self.rate = np.full(len(self.weights), 1e-5)

    def bits(self, key: np.ndarray):
        """For each bit: (bit, gate per order, log-odds per order, probability of a one, map place and share)."""
        sym = key & np.uint64(255)
        contexts = [_context(key, k) for k in range(ORDERS)]
        before = (key >> np.uint64(8)) & np.uint64(255)
        inside = np.zeros(len(key), np.int64)              # bytes since the last space
        for j in range(ORDERS - 1, 0, -1):
            inside[(key >> np.uint64(8 * j)) & np.uint64(255) == 32] = j
        for bit in range(7, -1, -1):
            node = (sym | np.uint64(256)) >> np.uint64(bit + 1)
            one = (sym >> np.uint64(bit) & np.uint64(1)).astype(np.int64)
            cells = [self.tables[k][_slot(contexts[k], node)] for k in range(ORDERS)]
            sure = [(c & 15).astype(np.int64) for c in cells]
            longest = np.zeros(len(key), np.int64)
            for k in range(1, ORDERS):
                longest[sure[k] > 0] = k
            gates = [(k * 16 + sure[k]) * ORDERS + value + at for at, value in ((0, longest), (GATE, inside))
                     for k in range(ORDERS)]
            odds = [_ODDS[c] for c in cells] * 2
            mixed = sum(self.weights[g] * x for g, x in zip(gates, odds))
            mixed = np.clip(mixed, -11, 11)
            spot = (mixed + 11.5) * ((MAP_STEPS - 1) / 23)
            low = spot.astype(np.int64)
            place = ((before * np.uint64(257) + node) * _A >> np.uint64(52)).astype(np.int64) * MAP_STEPS + low
            yield one, gates, odds, 1 / (1 + np.exp(-mixed)), place, spot - low

    def learn(self, key: np.ndarray, count: np.ndarray) -> None:
        """Online steps over windows seen ``count`` times, with per-weight rates."""
        for at in range(0, len(key), BATCH):
            n = count[at:at + BATCH] / count[at:at + BATCH].sum()
            for one, gates, odds, p, _, _ in self.bits(key[at:at + BATCH]):
                g = np.zeros(len(self.weights))
                for gate, x in zip(gates, odds):
                    g += np.bincount(gate, n * (p - one) * x, minlength=len(g))
                self.rate += g * g
                self.weights -= RATE * g / np.sqrt(self.rate)

    def cost(self, key: np.ndarray) -> np.ndarray:
        """-log10 of the probability of each window's last byte after the bytes before it."""
        out = np.zeros(len(key))
        for one, _, _, p, place, share in self.bits(key):
            if self.refined is not None:
                fine = self.refined[place] * (1 - share) + self.refined[place + 1] * share
                p = 0.5 * (p + fine)
            p = np.clip(p, 1e-5, 1 - 1e-5)
            out -= np.log10(np.where(one == 1, p, 1 - p))
        return out


def compressed(tables: np.ndarray) -> bytes:
    """Tables as they are broadcast: most cells of a small corpus are empty, and every executor keeps a copy on disk."""
    return zlib.compress(tables.tobytes(), 1)


_TABLES: dict = {}


def tables_of(packed: bytes) -> np.ndarray:
    """Tables of a broadcast value, unpacked once per worker process."""
    if _TABLES.get("packed") is not packed:
        _TABLES.update(packed=packed, tables=np.frombuffer(zlib.decompress(packed), np.uint16).reshape(ORDERS, -1))
    return _TABLES["tables"]


def _train(sent, weights):
    """Weights that each shard of the task's rows (shard, key, apart), sorted, learns from ``weights``."""
    def run(batches):
        shard, held, mixer, seen = None, [], None, 0

        def step(size):
            key, count = (np.concatenate(c) for c in zip(*held))
            whole = len(key) if size is None else len(key) // size * size
            mixer.learn(key[:whole], count[:whole])
            held[:] = [(key[whole:], count[whole:])]
            return int(count[:whole].sum())

        def result():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([mixer.weights.tolist()], pa.list_(pa.float64())),
                                               pa.array([seen])], ["shard", "weights", "seen"])
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            key, count = batch.column("key").to_numpy().view(np.uint64), batch.column("apart").to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if e > b and shards[b] != shard:
                    if shard is not None:
                        seen += step(None)
                        yield result()
                    shard, held, mixer, seen = int(shards[b]), [], Mixer(tables_of(sent.value), weights), 0
                held.append((key[b:e], count[b:e]))
                if sum(len(k) for k, _ in held) >= 8 * BATCH:
                    seen += step(BATCH)             # whole steps, wherever the batches of rows end
        if shard is not None:
            seen += step(None)
            yield result()
    return run


def _map_counts(sent, weights):
    def run(batches):
        mixer = Mixer(tables_of(sent.value), weights)
        total = np.zeros((2, MAP_CONTEXTS * MAP_STEPS))
        for batch in batches:
            key, count = batch.column("key").to_numpy().view(np.uint64), batch.column("apart").to_numpy()
            for at in range(0, len(key), 1 << 14):
                n = count[at:at + (1 << 14)]
                for one, _, _, _, place, share in mixer.bits(key[at:at + (1 << 14)]):
                    near = place + (share >= 0.5)
                    total[0] += np.bincount(near, n * (one == 0), minlength=total.shape[1])
                    total[1] += np.bincount(near, n * one, minlength=total.shape[1])
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])],
                                         ["place", "zeros", "ones"])
    return run


def fit(packed: DataFrame) -> Mixer:
    """Learn from packed window counts ``(keys, rest, apart)`` of the training documents."""
    spark = packed.sparkSession
    counted = written(packed.mapInArrow(_unpacked, "key long, rest long, apart long")
                      .groupBy("key").agg(F.sum("rest").alias("rest"), F.sum("apart").alias("apart")), "lm-windows")
    first, final = _tables(counted, counted.count())
    sent = spark.sparkContext.broadcast(compressed(first))
    del first
    lesson = written(counted.filter("apart > 0").select(F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int").alias("shard"), "key", "apart")
                     .repartition("shard").sortWithinPartitions("shard", "key"), "lm-lesson")
    dropped(counted)
    in_order = lesson.repartition("shard").sortWithinPartitions("shard", "key")
    mixer = Mixer(final)
    for _ in range(ROUNDS):
        rows = sorted(in_order.mapInArrow(_train(sent, mixer.weights), "shard int, weights array<double>, seen long").collect())   # one per shard
        if rows:
            mixer.weights = np.average([r.weights for r in rows], axis=0, weights=[r.seen for r in rows])
    found = (lesson.mapInArrow(_map_counts(sent, mixer.weights), "place long, zeros double, ones double")
             .groupBy("place").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect())     # fixed size
    middle = 1 / (1 + np.exp(-(np.arange(MAP_STEPS) * (23 / (MAP_STEPS - 1)) - 11.5)))
    base = np.tile(middle, MAP_CONTEXTS)
    zeros, ones = np.zeros(len(base)), np.zeros(len(base))
    for r in found:
        zeros[r.place], ones[r.place] = r.zeros, r.ones
    mixer.refined = np.append((ones + MAP_PRIOR * base) / (zeros + ones + MAP_PRIOR), 0.5)
    sent.destroy()
    dropped(lesson)
    return mixer


class WindowCosts:
    """Costs of windows, kept in a table of fixed size."""

    def __init__(self, mixer: Mixer):
        self.mixer = mixer
        self.known = np.full(1 << KNOWN_BITS, np.iinfo(np.uint64).max, np.uint64)
        self.costs = np.zeros(1 << KNOWN_BITS)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(-log10 probability, bytes) of each text."""
        key, size = windows(texts)
        at = (key * _B >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        cost = self.costs[at]
        new = np.flatnonzero(self.known[at] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            found = np.concatenate([self.mixer.cost(fresh[i:i + (1 << 14)]) for i in range(0, len(fresh), 1 << 14)])
            cost[new] = found[back]
            home = (fresh * _B >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
            self.known[home], self.costs[home] = fresh, found
        return np.add.reduceat(cost, np.cumsum(size) - size), size


_COSTS: dict = {}


def window_costs(sent) -> WindowCosts:
    """One table per worker process and model (``sent`` is its broadcast variable)."""
    packed, weights, refined = sent.value
    if _COSTS.get("packed") is not packed:
        _COSTS.update(packed=packed, costs=WindowCosts(Mixer(tables_of(packed), weights, refined)))
    return _COSTS["costs"]


# ---------------------------------------------------------------- one pass over the texts, one over its slices

def _varints(places: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Places of each document, seven bits a byte, the high bit where more follow."""
    width = 1 + sum((places >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(5):
        some = np.flatnonzero(width > i)
        if len(some):
            out[ends[some] - width[some] + i] = (places[some] >> 7 * i & 127) | np.where(width[some] > i + 1, 128, 0)
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    raw = out.tobytes()
    return [raw[b:e] for b, e in zip(cuts, cuts[1:])]


def _places(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], raw[:-1] < 128])) if len(raw) else np.zeros(0, np.int64)
    out = (raw[first] & 127).astype(np.int64)
    width = np.diff(np.append(first, len(raw)))
    for i in range(1, int(width.max(initial=0))):
        some = np.flatnonzero(width > i)
        out[some] |= (raw[first[some] + i] & 127).astype(np.int64) << 7 * i
    return out


SLICED = ("kind int, slice long, doc_id {doc_id}, fold int, places binary, words array<string>, learned array<long>, "
          "keys binary, rest binary, apart binary")
WORDS, DOCUMENT, WINDOWS = 0, 1, 2


def _sliced(batches):
    """Per slice of documents one row of its distinct words with their training counts, per document one row with the
    places of its words in it; and packed window counts."""
    from pyspark import TaskContext
    pid, number, counter, ids = TaskContext.get().partitionId(), 0, WindowCounter(), None
    _TABLES.clear()            # a model that an earlier query left in this worker
    _COSTS.clear()

    def rows(kind, n, **columns):
        types = {"kind": pa.int32(), "slice": pa.int64(), "doc_id": ids, "fold": pa.int32(), "places": pa.binary(),
                 "words": pa.list_(pa.string()), "learned": pa.list_(pa.int64()), "keys": pa.binary(), "rest": pa.binary(),
                 "apart": pa.binary()}
        columns["kind"] = [kind] * n
        return pa.RecordBatch.from_arrays(
            [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), t)
             for c, t in types.items()], list(types))

    for batch in batches:
        ids = batch.schema.field("doc_id").type
        for part in slices(batch, "text", 6 * SLICE):
            texts, folds = canonical(part.column("text").to_pylist()), part.column("fold").to_numpy()
            for packed in counter.add(texts, folds):
                yield rows(WINDOWS, 1, **{c: [x] for c, x in zip(("keys", "rest", "apart"), packed)})
            size = np.array([t.count(b" ") + (len(t) > 1) for t in texts], np.int64)
            joined = b" ".join(t[:-1] for t in texts if len(t) > 1)
            words = pc.split_pattern(pa.array([joined], pa.large_binary()).cast(pa.large_string()), " ").flatten()
            words = (words if len(joined) else words.slice(0, 0)).dictionary_encode()
            at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            often = np.argsort(-np.bincount(at, minlength=len(words.dictionary)), kind="stable")       # frequent words: small places
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            at, spelt = rank[at], words.dictionary.take(pa.array(often))
            n = np.bincount(at[np.repeat(folds != HELD, size)], minlength=len(often)).astype(np.int64)
            slice_id = pid << 32 | number
            number += 1
            yield rows(WORDS, 1, slice=[slice_id], words=[spelt.to_pylist()], learned=[n.tolist()])
            yield rows(DOCUMENT, part.num_rows, slice=[slice_id] * part.num_rows, doc_id=part.column("doc_id"),
                       fold=part.column("fold"), places=_varints(at, size))
    for packed in counter.flush():
        yield rows(WINDOWS, 1, **{c: [x] for c, x in zip(("keys", "rest", "apart"), packed)})


def _scored(sent, neutral: float, end: float):
    """Scores of a slice's documents; ``end``: log10 of the end token's count plus one."""
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        model = window_costs(sent)
        [words] = docs.column("words").drop_null().to_pylist()
        docs = docs.filter(docs.column("places").is_valid())
        word, count = np.empty(len(words), object), np.zeros(len(words), np.int64)
        word[:] = [w.encode("utf-8", "replace") for w in words]
        count[counts.column("pos").to_numpy()] = counts.column("c").to_numpy()
        gain, known = np.log10(count + 1.0), count > 0
        places = list(map(_places, docs.column("places").to_pylist()))
        tokens = np.array([len(p) + 1 for p in places], np.int64)
        seen = [int(known[p].sum()) + (end > 0) for p in places]
        base = [float(gain[p].sum()) + end - n * neutral for p, n in zip(places, tokens.tolist())]
        cost, size = [np.zeros(0)], [np.zeros(0, np.int64)]
        for at, to in _runs(tokens):
            c, n = model.texts([b" ".join(word[p].tolist()) + b"\n" for p in places[at:to]])
            cost.append(c)
            size.append(n)
        cost, size = np.concatenate(cost), np.concatenate(size)
        fold = docs.column("fold").to_numpy()
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": pa.array(fold == HELD), "n_tokens": pa.array(tokens),
                         "n_known": pa.array(seen, pa.int64()), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(-cost), "bits_per_byte": pa.array(cost * np.log2(10) / np.maximum(size, 1))})
    return run


def _runs(tokens: np.ndarray):
    """Ranges of documents of about RUN_TOKENS tokens."""
    at, total = 0, 0
    for i, n in enumerate(tokens.tolist()):
        if i > at and total + n > RUN_TOKENS:
            yield at, i
            at, total = i, 0
        total += n
    if len(tokens) > at:
        yield at, len(tokens)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    fold = F.coalesce(crc_mod(F.col("doc_id"), FOLDS), F.lit(0)).cast("int")
    sliced = written(docs.select("doc_id", "text", fold.alias("fold")).mapInArrow(_sliced, SLICED.format(doc_id=kind)), "lm-slices", compression="zstd")
    mixer = fit(sliced.filter(F.col("kind") == WINDOWS).select("keys", "rest", "apart"))
    found = (sliced.filter(F.col("kind") == WORDS).select("slice", F.posexplode(F.arrays_zip("words", "learned")))
             .select(F.col("slice").alias("part"), "pos", F.col("col.words").alias("word"), F.col("col.learned").alias("n")))
    counts = written(found.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    texts = sliced.filter(F.col("kind") != WINDOWS).select("slice", "doc_id", "fold", "places", "words")
    ends = sliced.filter((F.col("kind") == DOCUMENT) & (F.col("fold") != HELD)).count()
    total, distinct = words + ends, distinct + (ends > 0)
    known = found.join(counts, "word", "left").select("part", "pos", F.coalesce("c", F.lit(0)).alias("c"))
    sent = spark.sparkContext.broadcast((compressed(mixer.tables), mixer.weights, mixer.refined))
    scored = texts.groupBy("slice").cogroup(known.groupBy("part")).applyInArrow(
        _scored(sent, float(np.log10(total + distinct + 1)), float(np.log10(ends + 1))),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score", "bits_per_byte")


def op2_context_mixing(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, learned outside the held-out fold."""
    return score(documents(spark, sf_dir, "doc_id", "text"))
