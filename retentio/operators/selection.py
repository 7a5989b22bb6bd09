"""ANOVA F feature selection (I10), selected-feature table (I11), relevance.

The F statistic needs, per feature and class, the count, mean and centred
second moment (mergeable, so large values with a small spread lose nothing).
They come from ONE ``groupBy(label)`` over the wide transformed frame (partial
aggregation leaves one row per class per partition), so no long-form explode
or per-feature shuffle is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SELECTED_FEATURES_K, TARGET
from ..functions.schema import feature_origin, pretty_label


def anova_f(df: DataFrame, features: dict, label: str = TARGET) -> dict[str, float | None]:
    """One-way ANOVA F of each feature expression across the label classes."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, (name, expr) in enumerate(features.items()):
        aggs += [F.avg(expr).alias(f"m{i}"), F.var_pop(expr).alias(f"v{i}")]
    rows = df.groupBy(label).agg(*aggs).collect()          # one row per class
    out = {}
    k = len(rows)
    n = sum(r["_n"] for r in rows)
    for i, name in enumerate(features):
        means = [math.nan if r[f"m{i}"] is None else r[f"m{i}"] for r in rows]
        shift = [m - means[0] for m in means]              # equal means differ by exactly 0
        middle = sum(r["_n"] * d for r, d in zip(rows, shift)) / n if n else math.nan
        ssbn = sum(r["_n"] * (d - middle) ** 2 for r, d in zip(rows, shift))
        sswn = sum(r["_n"] * (math.nan if r[f"v{i}"] is None else r[f"v{i}"]) for r in rows)
        if k < 2 or n <= k:
            out[name] = None
            continue
        out[name] = f_score(ssbn / (k - 1), sswn / (n - k))
    return out


def f_score(between: float, within: float) -> float | None:
    """F of the two mean squares: infinite for classes without spread that differ, undefined for 0/0."""
    if math.isnan(between) or math.isnan(within):
        return None
    if within == 0:
        return math.inf if between > 0 else None
    return between / within


def best_positions(scores: list) -> list[int]:
    """Feature positions, best score first: missing scores last, equal scores by position."""
    return sorted(range(len(scores)), key=lambda i: (scores[i] is None, -(scores[i] or 0.0), i))


def score_table(spark, scores: dict[str, float | None], order: list[str], k: int = SELECTED_FEATURES_K,
                categorical=None) -> DataFrame:
    """(feature, position, base variable, f_score, selected); top-k by score.

    The order is that of the fitted selector (:func:`best_positions`).
    """
    values = [scores.get(name) for name in order]
    rows = [(order[i], i, values[i], rank) for rank, i in enumerate(best_positions(values), 1)]
    df = spark.createDataFrame(rows, "feature string, position int, f_score double, rank int")
    return (df.withColumn("selected", F.col("rank") <= min(k, len(order)))
            .withColumn("base_variable", feature_origin(F.col("feature"), categorical)))


def selected_features(table: DataFrame) -> DataFrame:
    """Selected features with base variable and score, best first."""
    return (table.where("selected").select("feature", "base_variable", "f_score")
            .orderBy(F.desc("f_score"), "feature"))


def variable_relevance(table: DataFrame, top: int = 10) -> DataFrame:
    """Max score per base variable, top ``top``, relative to the best (1 decimal, half-even)."""
    best = (table.where("selected").groupBy("base_variable").agg(F.max("f_score").alias("score"))
            .orderBy(F.desc("score"), "base_variable").limit(top))
    top_score = F.max("score").over(Window.partitionBy(F.lit(1)))            # ≤ top rows
    return best.select(
        "base_variable", pretty_label(F.col("base_variable")).alias("label"),
        F.when(top_score == float("inf"), F.when(F.col("score") == float("inf"), 100.0).otherwise(0.0))
        .otherwise(F.bround(F.col("score") / F.coalesce(F.nullif(top_score, F.lit(0.0)), F.lit(1.0)) * 100, 1))
        .alias("relevance"))
