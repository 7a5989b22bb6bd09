"""Portfolio scoring (M5-M9) for any scorer: the rule scorer or a fitted pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_THRESHOLD, SCORE_WEIGHTS
from ..functions.rules import rule_exprs
from ..functions.schema import normalize
from ..functions.scoring import decision, risk_action, risk_level, rule_probability
from ..session import compiled


class RuleScorer:
    """Deterministic logit scorer (F8) applied to rule-cleaned values."""

    name = "rule_score"
    reads = tuple(c for c, _ in SCORE_WEIGHTS)         # columns that the probability depends on

    def probability_column(self, df: DataFrame) -> Column:
        return rule_probability(rule_exprs(df.columns))

    def with_probability(self, df: DataFrame, out: str = "probability") -> DataFrame:
        return df.withColumn(out, self.probability_column(df))


class PipelineScorer:
    """Wraps a fitted ``PipelineModel`` whose last stage emits ``probability``."""

    def __init__(self, model, name: str = "model"):
        self.model = model
        self.name = name

    def with_probability(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """The pipeline's own stages normalise, clean and derive features; input columns are kept."""
        from pyspark.ml.functions import vector_to_array
        compiled(df.sparkSession)
        cols = df.columns
        hidden = {c: f"__in_{c}" for c in cols}
        scored = self.model.transform(df.withColumns({v: F.col(c) for c, v in hidden.items()}))
        return scored.select(*[F.col(v).alias(c) for c, v in hidden.items()],
                             vector_to_array(F.col("probability"))[1].alias(out))


def predict_probabilities(scorer, df: DataFrame) -> DataFrame:
    """M5: the input rows plus ``probability``."""
    return scorer.with_probability(normalize(df))


def prediction_output(scorer, df: DataFrame, threshold: float | Column = DEFAULT_THRESHOLD,
                      normalized: bool = False) -> DataFrame:
    """M6: all input columns + probability, risk level, decision and action in one projection.

    ``normalized=True`` skips P1-P4 for frames that already went through them.
    """
    scored = scorer.with_probability(df if normalized else normalize(df))
    p = F.col("probability")
    return scored.withColumns({
        "risk_level": risk_level(p),
        "decision": decision(p, threshold),
        "action": risk_action(risk_level(p)),
    })
