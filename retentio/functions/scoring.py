"""Rule scorer (F8) and the scoring projections (M7-M9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    ACTIVE_LABEL, CHURN_LABEL, DEFAULT_THRESHOLD, RISK_ACTIONS, RISK_HIGH_AT, RISK_MEDIUM_AT,
    SCORE_OFFSET, SCORE_WEIGHTS,
)


def rule_logit(values: dict[str, Column] | None = None) -> Column:
    """Linear churn score over ``values`` (default: the columns); a NULL term counts as 0."""
    values = values or {}
    s = None
    for c, w in SCORE_WEIGHTS:
        term = F.lit(w) * F.coalesce(values.get(c, F.col(c)), F.lit(0.0))
        s = term if s is None else s + term
    return s


def rule_probability(values: dict[str, Column] | None = None) -> Column:
    """F8: ``1 / (1 + exp(-(score - offset)))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(rule_logit(values) - F.lit(SCORE_OFFSET))))


def risk_level(p: Column) -> Column:
    """M7: high ≥ .70, medium ≥ .40, else low."""
    return (F.when(p >= RISK_HIGH_AT, "high").when(p >= RISK_MEDIUM_AT, "medium")
            .when(p.isNotNull(), "low"))


def risk_action(level: Column) -> Column:
    """M8: retention action text per risk level."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in RISK_ACTIONS.items() for x in kv]), level)


def decision(p: Column, threshold: float | Column = DEFAULT_THRESHOLD) -> Column:
    """M9: churn when ``p >= threshold``."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(p >= t, CHURN_LABEL).otherwise(ACTIVE_LABEL)
