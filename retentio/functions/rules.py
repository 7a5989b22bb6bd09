"""Business validity rules (C1-C3): out-of-range values become NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_RANGE, NON_NEGATIVE_COLUMNS, RATE_COLUMNS


def rule_exprs(columns: list[str]) -> dict:
    lo, hi = AGE_RANGE
    out = {}
    if "age" in columns:
        out["age"] = F.when(F.col("age").between(lo, hi), F.col("age"))          # C1
    for c in RATE_COLUMNS:
        if c in columns:
            out[c] = F.when(F.col(c).between(0.0, 100.0), F.col(c))              # C2
    for c in NON_NEGATIVE_COLUMNS:
        if c in columns:
            out[c] = F.when(F.col(c) >= 0, F.col(c))                              # C3
    return out


def apply_rules(df: DataFrame) -> DataFrame:
    return df.withColumns(rule_exprs(df.columns))
