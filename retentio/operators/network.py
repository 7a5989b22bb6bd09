"""Multilayer perceptron (M3e): ReLU layers, L2 penalty, Adam, early stopping on held-out accuracy.

Rows are dealt by a hash of their values into a fixed number of shards and, sorted by it, packed into blocks.  An epoch is one Spark
job: every shard takes its mini-batches from the shared weights, and the driver averages the shards' weights and
moments in shard order (a few thousand numbers each, at most ``SHARDS`` shards).  A table of up to ``shardRows`` rows is
one shard, which is plain mini-batch Adam.  Equal rows share a shard, which a task streams block by block.  Shards, order and batches depend on the rows alone, so the weights do not
depend on how Spark splits the table.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SEED, TARGET
from ..session import remove_scratch, shared_scratch, ship

SHARDS = 64
BLOCK_ROWS = 4096
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
TOLERANCE = 1e-4


def unpacked(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights inputs × outputs, intercepts) of each layer, as views of one vector."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def initial(layers: list[int], seed: int) -> np.ndarray:
    """Uniform weights within ``sqrt(6 / (inputs + outputs))``."""
    random = np.random.RandomState(seed)
    return np.concatenate([random.uniform(-1, 1, a * b + b) * np.sqrt(6 / (a + b)) for a, b in zip(layers, layers[1:])])


def forward(flat: np.ndarray, layers: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer; the last are logits."""
    held = [x]
    parts = unpacked(flat, layers)
    for i, (w, b) in enumerate(parts):
        z = held[-1] @ w + b
        held.append(np.maximum(z, 0) if i + 1 < len(parts) else z)
    return held


def loss_and_gradient(flat: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Mean log-loss plus ``alpha / 2`` of the squared weights over the number of rows, and its gradient."""
    held, n = forward(flat, layers, x), len(y)
    z = held[-1][:, 0]
    gradient = np.empty_like(flat)
    parts, slots = unpacked(flat, layers), unpacked(gradient, layers)
    loss = np.mean(np.logaddexp(0, z) - y * z) + alpha / 2 / n * sum((w * w).sum() for w, _ in parts)
    back = ((1 / (1 + np.exp(-z)) - y) / n)[:, None]
    for i in range(len(parts) - 1, -1, -1):
        slots[i][0][:] = held[i].T @ back + alpha / n * parts[i][0]
        slots[i][1][:] = back.sum(0)
        if i:
            back = (back @ parts[i][0].T) * (held[i] > 0)
    return float(loss), gradient


def _blocked(batches):
    """Sorted rows (shard, held, x, y) → blocks (shard, held, number, x, y) of up to ``BLOCK_ROWS`` rows of one kind."""
    key, number, rows = None, 0, ([], [])

    def block():
        return pa.RecordBatch.from_pylist([{"shard": key[0], "held": key[1], "number": number, "x": np.array(rows[0]).tobytes(),
                                            "y": np.array(rows[1]).tobytes()}], BLOCK)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "held", "x", "y"))):
            if key != row[:2] or len(rows[1]) == BLOCK_ROWS:
                if key is not None:
                    yield block()
                number = number + 1 if key == row[:2] else 0
                key, rows = row[:2], ([], [])
            rows[0].append(row[2])
            rows[1].append(row[3])
    if key is not None:
        yield block()


BLOCK = pa.schema([("shard", pa.int32()), ("held", pa.int32()), ("number", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
RESULT = pa.schema([("shard", pa.int32()), ("steps", pa.int64()), ("rows", pa.int64()), ("loss", pa.float64()),
                    ("hits", pa.int64()), ("tested", pa.int64()), ("state", pa.binary())])


def _epoch(state: np.ndarray, steps: int, number: int, layers: list[int], s: dict):
    """One epoch of each shard: held-out blocks are judged with the incoming weights, the others move a copy of them."""
    def run(batches):
        shard, mine = None, None

        def result():
            return pa.RecordBatch.from_pylist([{**mine, "shard": shard, "state": mine["state"].tobytes()}], RESULT)

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if shard is not None:
                        yield result()
                    shard = row["shard"]
                    mine = {"steps": steps, "rows": 0, "loss": 0.0, "hits": 0, "tested": 0, "state": state.copy()}
                y = np.frombuffer(row["y"])
                x = np.frombuffer(row["x"]).reshape(len(y), layers[0])
                if row["held"]:
                    mine["hits"] += int(((forward(state[0], layers, x)[-1][:, 0] >= 0) == (y == 1)).sum())
                    mine["tested"] += len(y)
                    continue
                weights, first, second = mine["state"]
                order = np.random.RandomState([s["seed"], number, shard, row["number"]]).permutation(len(y))
                for at in range(0, len(y), s["batchRows"]):
                    pick = order[at:at + s["batchRows"]]
                    loss, gradient = loss_and_gradient(weights, layers, x[pick], y[pick], s["alpha"])
                    mine["steps"] += 1
                    first += (1 - BETA1) * (gradient - first)
                    second += (1 - BETA2) * (gradient * gradient - second)
                    rate = s["stepSize"] * np.sqrt(1 - BETA2 ** mine["steps"]) / (1 - BETA1 ** mine["steps"])
                    weights -= rate * first / (np.sqrt(second) + EPSILON)
                    mine["loss"] += loss * len(pick)
                    mine["rows"] += len(pick)
        if shard is not None:
            yield result()
    return run


class _Shared(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", typeConverter=TypeConverters.toString)


class Perceptron(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """ReLU network with one logistic output.

    A tenth of the rows (by hash) is held out; training stops when their accuracy has not risen by more than ``1e-4``
    for ``patience`` epochs, and the best weights are kept.  Without held-out rows it runs ``maxIter`` epochs.  Rows with
    a null label are left out; NaN features count as 0; a table without usable rows is an error.
    """

    labelCol = Param(Params._dummy(), "labelCol", "0/1 column", typeConverter=TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "widths of the hidden layers", typeConverter=TypeConverters.toListInt)
    alpha = Param(Params._dummy(), "alpha", "L2 penalty", typeConverter=TypeConverters.toFloat)
    stepSize = Param(Params._dummy(), "stepSize", "Adam's rate", typeConverter=TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "epochs at most", typeConverter=TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "epochs without a rise", typeConverter=TypeConverters.toInt)
    batchRows = Param(Params._dummy(), "batchRows", "rows of a mini-batch", typeConverter=TypeConverters.toInt)
    shardRows = Param(Params._dummy(), "shardRows", "rows up to which a table is one shard", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol: str = "selected", labelCol: str = TARGET, hidden: list = (64, 32), alpha: float = 0.001,
                 stepSize: float = 0.001, maxIter: int = 90, patience: int = 10, batchRows: int = 200, shardRows: int = 32_768,
                 seed: int = SEED):
        super().__init__()
        self._setDefault(featuresCol="selected", labelCol=TARGET, hidden=[64, 32], alpha=0.001, stepSize=0.001, maxIter=90,
                         patience=10, batchRows=200, shardRows=32_768, seed=SEED)
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> "PerceptronModel":
        get, spark = self.getOrDefault, df.sparkSession
        ship(spark)
        x = F.transform(vector_to_array(F.col(get("featuresCol"))), lambda v: F.nanvl(v, F.lit(0.0)))
        rows = df.select(x.alias("x"), F.col(get("labelCol")).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        path = shared_scratch(spark, "network-rows")
        rows.withColumn("h", F.xxhash64("x", "y", F.lit(get("seed")))).write.parquet(path)
        rows = spark.read.parquet(path)
        count, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
        try:
            if not count:
                raise ValueError("a classifier needs rows")
            shards = min(SHARDS, -(-count // get("shardRows")))
            dealt = rows.select(F.pmod(F.shiftrightunsigned("h", 8), F.lit(shards)).cast("int").alias("shard"),
                                (F.pmod("h", F.lit(10)) == 0).cast("int").alias("held"), "h", "x", "y")
            sorted_ = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "held", "h", "x", "y")
            sorted_.mapInArrow(_blocked, "shard int, held int, number int, x binary, y binary").write.parquet(path + "-blocks")
            blocks = (spark.read.parquet(path + "-blocks").repartition(shards, "shard")
                      .sortWithinPartitions("shard", F.desc("held"), "number"))
            return self._trained(blocks, [width, *get("hidden"), 1])
        finally:
            remove_scratch(spark, path)
            remove_scratch(spark, path + "-blocks")

    def _trained(self, blocks: DataFrame, layers: list[int]) -> "PerceptronModel":
        settings = {p: self.getOrDefault(p) for p in ("alpha", "stepSize", "batchRows", "seed")}
        start = initial(layers, settings["seed"])
        state, steps = np.array([start, np.zeros_like(start), np.zeros_like(start)]), 0
        best, kept, waited, losses, scores = -1.0, start, 0, [], []
        for number in range(self.getOrDefault("maxIter") + 1):        # each job judges the epoch before its own
            got = blocks.mapInArrow(_epoch(state, steps, number, layers, settings),
                                    "shard int, steps long, rows long, loss double, hits long, tested long, state binary").collect()
            got = sorted((r for r in got), key=lambda r: r["shard"])
            tested = sum(r["tested"] for r in got)
            if number and tested:
                scores.append(sum(r["hits"] for r in got) / tested)
                waited = 0 if scores[-1] > best + TOLERANCE else waited + 1
                if scores[-1] > best:
                    best, kept = scores[-1], state[0]
            elif number:
                kept = state[0]
            n = sum(r["rows"] for r in got)
            if number == self.getOrDefault("maxIter") or waited >= self.getOrDefault("patience") or not n:
                break
            losses.append(sum(r["loss"] for r in got) / n)
            state = sum(np.frombuffer(r["state"]).reshape(state.shape) * (r["rows"] / n) for r in got)
            steps = max(r["steps"] for r in got)
        told = {"layers": layers, "weights": [float(v) for v in kept], "losses": losses, "scores": scores}
        return PerceptronModel(network=json.dumps(told), featuresCol=self.getOrDefault("featuresCol"))


class PerceptronModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability``, a vector of both classes' probabilities."""

    network = Param(Params._dummy(), "network", "layers, weights and history (JSON)", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, network: str = "{}", featuresCol: str = "selected"):
        super().__init__()
        self._setDefault(network="{}", featuresCol="selected")
        self._set(**self._input_kwargs)

    def told(self) -> dict:
        return json.loads(self.getOrDefault("network"))

    def scored_by_expressions(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``rule_probability`` by array functions alone, to check the model."""
        told = self.told()
        parts = unpacked(np.array(told["weights"]), told["layers"])
        h = F.transform(vector_to_array(F.col(self.getOrDefault("featuresCol"))), lambda v: F.nanvl(v, F.lit(0.0)))
        for i, (w, b) in enumerate(parts):
            units = F.from_json(F.lit(json.dumps([[*column, c] for column, c in zip(w.T.tolist(), b.tolist())])), "array<array<double>>")

            def layer(given):
                sums = F.transform(units, lambda u: F.aggregate(F.zip_with(u, given, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q))
                return sums if i + 1 == len(parts) else F.transform(sums, lambda v: F.greatest(v, F.lit(0.0)))
            # the layer's input is the variable of a one-element transform: worked out once a row, not once a unit
            h = F.transform(F.array(F.concat(h, F.array(F.lit(1.0)))), layer)[0]
        return rows.withColumn("rule_probability", 1 / (1 + F.exp(-h[0])))

    def _transform(self, df: DataFrame) -> DataFrame:
        told = self.told()
        weights, layers = np.array(told["weights"]), told["layers"]

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, layers[0]))
            rows = np.where(np.isnan(rows), 0.0, rows)
            return pd.Series(1 / (1 + np.exp(-forward(weights, layers, rows)[-1][:, 0])))

        p = probability(vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        return df.withColumn("probability", p).withColumn("probability", array_to_vector(F.array(1 - F.col("probability"), F.col("probability"))))
