"""Segmentation (K1-K4): K-Means over preprocessed vectors, PCA scores, badges.

K-Means starts many times from k-means++ seeds; all starts share every pass over the vectors: a task computes the
distances to all centres of all starts that still move and returns their sums, so a pass costs one scan whatever
the number of starts.  Seeds are drawn in the same way, for all starts at once: the row with the smallest exponential
key, ``-log(u) / weight`` with ``u`` from a hash of the row's key and the start, is a draw in proportion to the weight.
PCA is fitted on mean-centred vectors (Spark's PCA does not centre) and each component's sign is fixed so that its
largest-magnitude loading is positive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ID, SEED
from ..session import cut_lineage, ship

STARTS = 20
PARALLEL_FITS = 4
MAX_PASSES = 300
TOLERANCE = 1e-4                   # of the mean variance: a start that moves less has settled
SETTLED = 1e-20
TIED = 1e-9                        # costs that differ by less are equal: sums depend on the order of rows by so much
DIRECT_SUMS = 64                   # partial sums that the driver adds itself


@dataclass
class Clusters:
    """Centres of the best start, its cost, and the cost of every start."""
    centres: np.ndarray
    cost: float
    costs: list[float]
    passes: int
    features: str = field(default="features")

    def _distance(self, centre) -> Column:
        x = vector_to_array(F.col(self.features))
        return F.aggregate(F.zip_with(x, F.lit([float(v) for v in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``cluster_id``, the nearest centre (the first of equally near ones), and ``distance``, its square."""
        found = F.array_min(F.array(*(F.struct(self._distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres))))
        return df.withColumn("_near", found).select(*df.columns, F.col("_near.i").alias("cluster_id"), F.col("_near.d").alias("distance"))


def _matrix(batch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres."""
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) per row key and salt."""
    with np.errstate(over="ignore"):
        z = key.view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _drawn(chosen: np.ndarray | None, starts: int, trials: int, salt: int):
    """Per start the ``trials`` rows with the smallest keys; the weight of a row is its distance to ``chosen``."""
    def run(batches):
        import pyarrow as pa
        best = [[] for _ in range(starts)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, key = _matrix(batch), batch.column("h").to_numpy()
            for s in range(starts):
                weight = np.ones(len(x)) if chosen is None else _squares(x, chosen[s]).min(1)
                with np.errstate(divide="ignore"):
                    order = -np.log(_uniform(key, salt * starts + s)) / weight
                for i in np.argsort(order, kind="stable")[:trials].tolist():
                    if np.isfinite(order[i]):
                        best[s].append((float(order[i]), int(key[i]), x[i].tolist()))
                best[s] = sorted(best[s])[:trials]
        rows = [(s, *r) for s, found in enumerate(best) for r in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], ["start", "key", "h", "x"])
    return run


def _moved(centres: np.ndarray):
    """Per start and centre the sum and number of its rows, and the cost: (starts, k, d + 2)."""
    starts, k, d = centres.shape

    def run(batches):
        import pyarrow as pa
        total = np.zeros((starts, k, d + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            if starts == 1:                            # the start that is kept: distances term by term
                far = _squares(x, centres[0])[:, None]
            else:                                      # all starts in one product; their ranks need no more digits
                middle = centres.mean((0, 1))
                moved, c = x - middle, (centres - middle).reshape(-1, d)
                far = ((moved * moved).sum(1)[:, None] - 2 * (moved @ c.T) + (c * c).sum(1)).reshape(-1, starts, k)
                np.maximum(far, 0, out=far)
            near = far.argmin(2)
            mine = (near[:, :, None] == np.arange(k)).astype(np.float64).reshape(len(x), -1)
            total[:, :, :-2] += (mine.T @ x).reshape(starts, k, d)
            total[:, :, -2] += mine.sum(0).reshape(starts, k)
            total[:, :, -1] += (mine.reshape(far.shape) * far).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])
    return run


def _merged(table):
    import pyarrow as pa
    return pa.table({"sums": pa.array([sum(np.frombuffer(s.as_buffer()) for s in table.column("sums")).tobytes()], pa.binary())})


def _sums(rows: DataFrame, centres: np.ndarray, tasks: int) -> np.ndarray:
    sums = rows.mapInArrow(_moved(centres), "sums binary")
    if tasks > DIRECT_SUMS:
        part = F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(int(tasks ** 0.5)))
        sums = sums.groupBy(part.alias("k")).applyInArrow(_merged, "sums binary")
    found = [np.frombuffer(r[0]) for r in sums.collect()]                  # one row a task or a group of tasks
    return sum(found).reshape(*centres.shape[:2], -1)


def _seeds(rows: DataFrame, k: int, starts: int, seed: int, tasks: int) -> np.ndarray:
    """k-means++ centres of every start: further ones are the better of a few draws, by the cost they leave."""
    def draw(chosen, trials, salt):
        found = sorted(rows.mapInArrow(_drawn(chosen, starts, trials, salt), "start int, key double, h long, x array<double>").collect())
        return [[r.x for r in found if r.start == s][:trials] for s in range(starts)]     # ``trials`` rows a task and start
    chosen = np.array([c[:1] for c in draw(None, 1, seed)])
    trials = 2 + int(np.log(k))
    for j in range(1, k):
        more = draw(chosen, trials, seed + j)
        more = [[*m, *([m[-1]] if m else chosen[s][:1].tolist()) * (trials - len(m))] for s, m in enumerate(more)]
        tried = np.concatenate([np.concatenate([chosen, np.array([[m[t]] for m in more])], axis=1) for t in range(trials)])
        cost = _sums(rows, tried, tasks)[:, :, -1].sum(1).reshape(trials, starts)
        best = cost.argmin(0)
        chosen = np.stack([tried[best[s] * starts + s] for s in range(starts)])
    return chosen


def kmeans_best(vectors: DataFrame, k: int = 2, starts: int = STARTS, seed: int = SEED, features: str = "features",
                key: str | None = None) -> Clusters:
    """K1: the best of ``starts`` runs by cost (of equal costs the first).  ``key`` identifies rows for the draws
    (default: the customer id, or the vector itself).  A centre that loses all its rows stays where it is."""
    ship(vectors.sparkSession)
    x = vector_to_array(F.col(features))
    key = key or (ID if ID in vectors.columns else None)
    rows = vectors.select(x.alias("x"), F.xxhash64(F.col(key) if key else x).alias("h")).persist()
    try:
        tasks = rows.rdd.getNumPartitions()
        n = rows.count()
        if not n:
            raise ValueError("no rows to cluster")
        centres = _seeds(rows, k, starts, seed, tasks)
        d = centres.shape[2]
        spread = rows.agg(*(F.var_pop(F.col("x")[i]) for i in range(d))).first()
        small = TOLERANCE * float(np.mean(spread))
        moving, costs, passes = list(range(starts)), [0.0] * starts, 0

        def advance(some, bound):
            nonlocal passes
            total = _sums(rows, centres[some], tasks)
            passes += 1
            still = []
            for s, t in zip(some, total):
                new = np.where(t[:, -2:-1] > 0, t[:, :-2] / np.maximum(t[:, -2:-1], 1), centres[s])
                costs[s], shift = float(t[:, -1].sum()), float(((new - centres[s]) ** 2).sum())
                centres[s] = new
                if shift > bound:
                    still.append(s)
            return still
        while moving and passes < MAX_PASSES:
            moving = advance(moving, small)
        costs[:] = _sums(rows, centres, tasks)[:, :, -1].sum(1).tolist()
        best = int(np.flatnonzero(np.array(costs) <= min(costs) * (1 + TIED))[0])
        last = [best]
        while last and passes < MAX_PASSES:                     # to a fixed point: every centre is the mean of its rows
            last = advance([best], SETTLED)
        costs[best] = float(_sums(rows, centres[[best]], tasks)[0, :, -1].sum())
        return Clusters(centres[best].copy(), costs[best], list(costs), passes, features)
    finally:
        rows.unpersist()


def pca_scores(vectors: DataFrame, components: int = 3, features: str = "features"):
    """K2/K3: centred PCA scores with deterministic signs, and explained-variance ratios."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(vectors)
    cv = centred.transform(vectors)
    pca = PCA(k=components, inputCol="_centred", outputCol="_pc").fit(cv)
    loadings = pca.pc.toArray()                      # (n_features × components): small
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(components)]
    scored = pca.transform(cv)
    arr = vector_to_array(F.col("_pc"))
    cols = {f"pc{j + 1}": arr[j] * F.lit(signs[j]) for j in range(components)}
    return scored.withColumns(cols).drop("_centred", "_pc"), list(map(float, pca.explainedVariance.toArray()))


def segment(prepared: DataFrame, k: int = 2, starts: int = STARTS, components: int = 3):
    """``prepared`` with cluster label (as text), squared distance to its centre and PCA scores; also the fitted
    clusters and the explained variance."""
    rows = cut_lineage(prepared)
    clusters = kmeans_best(rows, k, starts)
    labelled = clusters.transform(rows).withColumn("cluster", F.col("cluster_id").cast("string"))
    scored, explained = pca_scores(labelled, components)
    return scored.drop("cluster_id"), clusters, explained


def explained_totals(explained: list[float]) -> tuple[float, float]:
    """K3: explained variance of the first 2 and 3 components, in %."""
    return float(sum(explained[:2]) * 100), float(sum(explained[:3]) * 100)


def segment_badges(profile: DataFrame, segment: str) -> DataFrame:
    """K4: high-risk badge when churn ≥ mean of segment churn rates; rank label by churn."""
    w_all = Window.partitionBy(F.lit(1))                            # k segment rows
    rank = F.row_number().over(Window.orderBy(F.desc("churn_rate"), segment)).cast("long")   # k segment rows
    return (profile.withColumn("is_high_risk", F.col("churn_rate") >= F.avg("churn_rate").over(w_all))
            .withColumn("rank", rank)
            .withColumn("badge", F.when(F.col("rank") == 1, "highest_risk_segment")
                        .when(F.col("rank") == 2, "lowest_risk_segment")
                        .otherwise(F.concat(F.lit("segment "), F.col(segment).cast("string")))))
