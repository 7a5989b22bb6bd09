"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints: for each of 64 bits, whether over half of the shingle hashes have it.  Equal
fingerprints collapse to one row.  Two fingerprints at ``BITS`` = 3 or fewer differing bits agree
on at least three of six blocks, so each is listed under its 20 choices of three blocks (about 32
bits a key) and pairs are sought inside the lists only:

* up to ``PAIRED`` rows: a join of the list with itself, Hamming distance verified;
* up to ``GROUPED`` rows: one numpy comparison per list that emits only a spanning forest;
* beyond: the list is split again by 20 choices of three out of six blocks of its remaining 32
  bits.  Fingerprints are distinct, so such a list has at most 2 ** 17 rows, whatever the input.

Links go through :mod:`.components`.  No list is dropped or capped.

Defined edge cases: null or word-less text has fingerprint zero and links like any other; fewer
words than a shingle: the whole sequence is hashed; repeated rows and ids give one result each;
component_id is the smallest non-null doc_id of the component; an empty table gives no rows;
other input columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, numbered, written
from .components import components

SHINGLE = 3
BITS = 3
SEED = 42
PAIRED = 48
GROUPED = 4096
# bit ranges (first, width) of the six blocks, and of the six blocks of a 32-bit rest
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))),
                         np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])
    return run


def _choices(widths: list[tuple[int, int]], keep: int) -> list[int]:
    """Bit masks of every choice of ``keep`` blocks."""
    ones = [((1 << w) - 1) << b for b, w in widths]
    return [sum(c) for c in combinations(ones, keep)]


MASKS = _choices(BLOCKS, len(BLOCKS) - BITS)


def _sub_masks(mask: int) -> list[int]:
    """Masks that add to ``mask`` every choice of three out of six blocks of the bits it lacks."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cut = [rest[len(rest) * i // 6:len(rest) * (i + 1) // 6] for i in range(6)]
    return [mask | sum(1 << b for part in c for b in part) for c in combinations(cut, 6 - BITS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _listed(fps: DataFrame, masks: Column) -> DataFrame:
    """Rows (mask, key, fp): the fingerprint's bits under each mask."""
    return (fps.select("fp", F.explode(masks).alias("mask"))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of lists with at least two rows, and the list's size."""
    sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("size")).filter("size > 1")
    return rows.join(sizes, ["mask", "key"])


def _forest(bits: int):
    """Links that span the parts of one list: each row to the first earlier row of its part that is near."""
    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        part = np.arange(len(fps))
        a, b = [], []
        for i in range(1, len(fps)):
            near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= bits)
            roots = np.unique(part[near])
            for r in roots.tolist():          # joins each earlier part that row i touches
                a.append(i)
                b.append(int(near[np.argmax(part[near] == r)]))
            if len(roots):
                part[np.isin(part[:i], roots).nonzero()[0]] = roots[0]
                part[i] = roots[0]
        signed = fps.view(np.int64)
        return pa.table({"a": signed[a] if a else np.zeros(0, np.int64), "b": signed[b] if b else np.zeros(0, np.int64)})
    return run


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of ``fps(fp)`` (distinct) within ``bits`` <= 3."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"at most {BITS} bits")
    masks = F.array(*(F.lit(_signed(m)) for m in MASKS))
    lists = written(_sized(_listed(fps, masks)), "simhash-lists")
    short = lists.filter(F.col("size") <= PAIRED)
    pairs = (short.alias("x").join(short.alias("y"), ["mask", "key"])
             .filter((F.col("x.fp") < F.col("y.fp"))
                     & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits))
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    middle = lists.filter((F.col("size") > PAIRED) & (F.col("size") <= GROUPED))
    forest = middle.groupBy("mask", "key").applyInArrow(_forest(bits), "a long, b long")
    found = pairs.union(forest)
    long = lists.filter(F.col("size") > GROUPED)
    if not long.isEmpty():
        sub = F.lit(None)
        for m in MASKS:
            sub = F.when(F.col("mask") == _signed(m), F.array(*(F.lit(_signed(s)) for s in _sub_masks(m)))).otherwise(sub)
        again = _sized(_listed(long.select("fp", "mask").withColumn("subs", sub).select("fp", "subs"), F.col("subs")).distinct())
        found = found.union(again.groupBy("mask", "key").applyInArrow(_forest(bits), "a long, b long"))
    return found.distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (hex), component_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = written(docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long"),
                     "simhash")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(groups.select("fp"), bits))
    member = (groups.join(parts, groups["fp"] == parts["node"], "left")
              .select("fp", F.coalesce("component", "fp").alias("part"), "least"))
    least = member.groupBy("part").agg(F.min("least").alias("component_id"))
    named = written(member.select("fp", "part").join(least, "part").select("fp", "component_id"), "simhash-parts")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(documents(spark, sf_dir, "doc_id", "text"))


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one with the smallest doc_id.

    Rows without doc_id stay only if their component has no doc_id at all; of rows that share the
    smallest doc_id one stays."""
    rows, row = numbered(docs, "simhash-docs")
    found = simhash_components(rows.select(F.col(row).alias("doc_id"), "text"))
    tagged = rows.select(F.col(row).alias("row"), "doc_id").join(
        found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("part")), "row")
    first = tagged.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k"))
    return rows.join(first.select(F.col("k.row").alias(row)), row, "left_semi").select(*docs.columns)
