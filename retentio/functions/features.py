"""Derived business features (F1-F7) as column expressions.

Bins are right-closed ``(a, b]`` like the original, so they are written as
``when`` chains (``Bucketizer`` is left-closed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CURRENT_BINS, LEGACY_BINS, LEGACY_INCLUDE_LOWEST
from .schema import complete


def right_closed_bins(c: Column, edges: list, labels: list[str], include_lowest: bool = False) -> Column:
    chain = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = c.isNotNull()
        if lo is not None:
            cond = cond & ((c >= lo) if (include_lowest and i == 0) else (c > lo))
        if hi is not None:
            cond = cond & (c <= hi)
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
    return chain


def feature_exprs(profile: str = "current") -> dict:
    bins = LEGACY_BINS if profile == "legacy" else CURRENT_BINS
    out = {
        "uses_app": F.coalesce(F.col("mobile_app_usage") > 0, F.lit(False)).cast("int"),      # F1
        "has_credit": F.coalesce(F.col("credit_balance") > 0, F.lit(False)).cast("int"),
    }
    for name, (src, edges, labels) in bins.items():                                        # F2-F6
        lowest = profile == "legacy" and name in LEGACY_INCLUDE_LOWEST
        out[name] = right_closed_bins(F.col(src), edges, labels, lowest)
    return out


def add_features(df: DataFrame, profile: str = "current") -> DataFrame:
    """stateless feature step (completes absent base columns first)."""
    return complete(df).withColumns(feature_exprs(profile))
