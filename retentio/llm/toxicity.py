"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the hashed presence of its words, adjacent pairs and pairs one word apart
(A-Z lower-cased, closing marks cut off), ``2 ** HASH_BITS`` buckets.  Fitting is online with
per-coordinate rates; the L1 term leaves few non-zero weights, which are broadcast (at most
one float per bucket).

Only the fit is bounded: about ``FIT_ROWS`` labelled documents, chosen by a hash of doc_id among those
outside the held-out fold (so few that their ids are broadcast and no other text is shuffled), pass through
one task in hash order, ``EPOCHS`` times; their features are made by all tasks.  Scoring reads every whole
text and neither labels nor other columns.

Defined edge cases: null or empty text has the bias alone; a label that is null, not 0/1 or
contradicted by another row of the same doc_id is not learned from; of several texts with one labelled
doc_id the smallest is learned from; rows with null doc_id are scored, with held_out false; repeated rows
get one score each; unless labels of both classes can be learned from, nothing tells toxic texts apart and
every score is 0, so no document is rejected; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, lean
from .token_ids import slices

HASH_BITS = 20
FIT_ROWS = 30_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2.0, 1.0
SLICE_BYTES = 1 << 20
_EDGE = b".,;:!?\"'()[]{}<>*-"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Feature buckets of texts; keeps the hashes of words it has met (bounded)."""

    KEPT = 300_000

    def __init__(self, bits: int = HASH_BITS):
        self.shift, self.cache = np.uint64(64 - bits), {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        import xxhash
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > self.KEPT:
                self.cache.clear()
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    found[i] = h = xxhash.xxh64_intdigest(w.strip(_EDGE) or w, 7)
                    if len(w) <= 64:
                        self.cache[w] = h
        return np.array(found, np.uint64)

    def buckets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text number) of every word, pair and skip pair, repeats included."""
        split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        owner = np.repeat(np.arange(len(split)), size)
        h = self._words([w for words in split for w in words])
        out, owners = [h], [owner]
        for gap, salt in ((1, 0x51ED270B27D4EB4F), (2, 0x2545F4914F6CDD1D)):
            same = owner[:-gap] == owner[gap:]
            out.append(((h[:-gap] * _MIX) ^ (h[gap:] + np.uint64(salt)))[same])
            owners.append(owner[:-gap][same])
        mixed = np.concatenate(out)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
        return (mixed >> self.shift).astype(np.int32), np.concatenate(owners)


def _features(batches):
    hasher = Hasher()
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            n = part.num_rows
            bucket, owner = hasher.buckets(part.column("text").to_pylist())
            key = np.unique(owner.astype(np.int64) << 32 | bucket)
            counts = np.bincount(key >> 32, minlength=n)
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), n,
                [None, pa.py_buffer(np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32).tobytes()),
                 pa.py_buffer((key & 0xFFFFFFFF).astype(np.int32).tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("order", "toxic")] + [packed],
                                             ["order", "toxic", "features"])


class Ftrl:
    """FTRL-proximal: ``z`` and ``n`` per coordinate; weights follow from them.  The last one is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit(batches):
    model = Ftrl(1 << HASH_BITS)
    for batch in batches:
        for label, features in zip(batch.column("toxic").to_pylist(), batch.column("features")):
            model.learn(np.frombuffer(features.as_buffer(), np.int32), label)
    w = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["bucket", "weight"])


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Non-zero weights (bucket, weight); bucket ``2 ** HASH_BITS`` is the bias.  None without labels of both classes."""
    usable = (labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
              .filter("toxic = most AND toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int"))
              .filter(crc_mod(F.col("doc_id"), 5) != 0))
    classes = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}        # at most two rows
    if len(classes) < 2:
        return docs.sparkSession.createDataFrame([], "bucket long, weight double")
    part = min(1.0, FIT_ROWS / sum(classes.values()))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = usable.withColumn("order", order).filter(F.col("order") < int(part * (1 << 40)))
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "order", "toxic").agg(F.min("text").alias("text")))
    features = rows.select("order", "toxic", "text").mapInArrow(lean(_features), "order long, toxic int, features binary")
    passes = features.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    return (passes.repartition(1).sortWithinPartitions("epoch", "order").select("toxic", "features")
            .mapInArrow(_fit, "bucket long, weight double"))


def _scorer(weights, below: float | None):
    """Batches to (doc_id, score), or to their rows scored under ``below``."""
    def run(batches):
        at, values = weights.value
        table = np.zeros((1 << HASH_BITS) + 1)
        table[at] = values
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n = part.num_rows
                bucket, owner = hasher.buckets(part.column("text").to_pylist())
                hit = table[bucket] != 0
                key = np.unique(owner[hit].astype(np.int64) << 32 | bucket[hit])     # presence, not count
                total = np.bincount(key >> 32, table[key & 0xFFFFFFFF], minlength=n)
                score = np.where(np.isinf(table[-1]), 0.0, 1 / (1 + np.exp(-np.clip(total + table[-1], -35, 35))))
                if below is not None:
                    yield part.filter(pa.array(score < below))
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])
    return run


def _sent(spark, weights: DataFrame):
    rows = sorted(weights.collect()) or [(1 << HASH_BITS, -np.inf)]             # at most one per bucket
    return spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])))


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, score of every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_scorer(_sent(docs.sparkSession, weights), None)),
                                                    f"doc_id {kind}, score double")


def below(docs: DataFrame, weights: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns as they are."""
    return docs.mapInArrow(lean(_scorer(_sent(docs.sparkSession, weights), threshold)), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "toxic")
    return toxicity(documents(spark, sf_dir, "doc_id", "text"), labels)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "toxic")
    return below(docs, fit(docs, labels))
