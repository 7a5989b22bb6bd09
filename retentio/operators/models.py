"""Pipeline stages and classifiers (I12, M1-M5) on ``pyspark.ml``.

The training pipeline mirrors the original composition
rules → features → column-group preprocessing → ANOVA top-k → classifier,
with every stage a ``pyspark.ml`` Estimator/Transformer so the fitted
``PipelineModel`` saves and loads as one object.

The final model is the leaf-wise histogram booster of :mod:`.booster`, the
multilayer perceptron that of :mod:`.network`.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SEED, SELECTED_FEATURES_K, TARGET
from ..functions.features import add_features
from ..functions.rules import apply_rules
from ..functions.schema import complete, normalize
from .booster import STOP_ROWS, LeafwiseBooster
from .network import Perceptron
from .prep import ChurnPreprocessor
from .selection import anova_f, best_positions


class BusinessRules(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Normalise (P1-P5) and null out invalid values (C1-C3); stateless."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return apply_rules(complete(normalize(df)))


class BusinessFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Derived business features (F1-F7); stateless."""

    profile = Param(Params._dummy(), "profile", "current | legacy", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, profile: str = "current"):
        super().__init__()
        self._setDefault(profile="current")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return add_features(df, self.getOrDefault("profile"))


class _Sel(Params):
    k = Param(Params._dummy(), "k", "features kept", typeConverter=TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "input vector", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "selected vector", typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", typeConverter=TypeConverters.toString)


class AnovaSelector(Estimator, _Sel, DefaultParamsReadable, DefaultParamsWritable):
    """Keep the ``k`` features with the largest one-way ANOVA F (``min(k, n)``)."""

    @keyword_only
    def __init__(self, k: int = SELECTED_FEATURES_K, featuresCol: str = "features", outputCol: str = "selected",
                 labelCol: str = TARGET):
        super().__init__()
        self._setDefault(k=SELECTED_FEATURES_K, featuresCol="features", outputCol="selected", labelCol=TARGET)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "AnovaSelectorModel":
        arr = vector_to_array(F.col(self.getOrDefault("featuresCol")))
        size = len(df.select(self.getOrDefault("featuresCol")).first()[0])
        scores = anova_f(df, {i: arr[i] for i in range(size)}, self.getOrDefault("labelCol"))
        order = best_positions([scores[i] for i in range(size)])
        keep = sorted(order[:min(self.getOrDefault("k"), size)])
        return AnovaSelectorModel(indices=json.dumps(keep), scores=json.dumps([scores[i] for i in range(size)]),
                                  featuresCol=self.getOrDefault("featuresCol"),
                                  outputCol=self.getOrDefault("outputCol"))


class AnovaSelectorModel(Model, _Sel, DefaultParamsReadable, DefaultParamsWritable):
    indices = Param(Params._dummy(), "indices", "kept positions (JSON)", typeConverter=TypeConverters.toString)
    scores = Param(Params._dummy(), "scores", "F per position (JSON)", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, indices: str = "[]", scores: str = "[]", featuresCol: str = "features",
                 outputCol: str = "selected"):
        super().__init__()
        self._setDefault(indices="[]", scores="[]", featuresCol="features", outputCol="selected")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        slicer = VectorSlicer(inputCol=self.getOrDefault("featuresCol"), outputCol=self.getOrDefault("outputCol"),
                              indices=json.loads(self.getOrDefault("indices")))
        return slicer.transform(df)


VALIDATION_FRACTION = 0.1


def validation_flag(seed: int = SEED) -> "F.Column":
    """Deterministic 10 % validation rows (hash of the key), used for early stopping."""
    from .sampling import hash_key
    h = F.conv(F.substring(hash_key(seed + 1), 1, 4), 16, 10).cast("int")
    return h < int(VALIDATION_FRACTION * 65536)


def with_validation(train: DataFrame, column: str, rows: int, early_stopping: bool | None = None) -> tuple[DataFrame, str | None]:
    """``train`` with the validation flag where early stopping applies (None: above ``STOP_ROWS`` rows), and its name."""
    if rows > STOP_ROWS if early_stopping is None else early_stopping:
        return train.withColumn(column, validation_flag()), column
    return train, None


def classifier(name: str, n_rows: int | None = None, features: str = "selected", label: str = TARGET, weight: str = "weight",
               validation: str | None = None):
    """The candidate classifiers with the original hyper-parameters mapped to Spark ML.

    ``validation`` names a boolean column of held-out rows: the final booster then stops when their loss has not
    improved for ten trees.
    """
    if name == "hist_gradient_boosting":      # M2 (final): balanced weights
        return LeafwiseBooster(featuresCol=features, labelCol=label, weightCol=weight, validationIndicatorCol=validation or "")
    if name == "logistic_regression":         # M3b
        return LogisticRegression(featuresCol=features, labelCol=label, weightCol=weight, maxIter=600,
                                  regParam=1.0 / max(n_rows or 1, 1), standardization=False)
    if name == "random_forest":               # M3c
        return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol=weight, numTrees=160,
                                      maxDepth=12, minInstancesPerNode=12, seed=SEED)
    if name == "gradient_boosting":           # M3d: unweighted
        return GBTClassifier(featuresCol=features, labelCol=label, maxIter=130, stepSize=0.06, maxDepth=3, seed=SEED)
    if name == "mlp":                         # M3e
        return Perceptron(featuresCol=features, labelCol=label)
    raise ValueError(name)


def checked_by_rules(name: str, fitted, rows: DataFrame, scratch: str) -> DataFrame:
    """``rows`` (with a features column) plus ``rule_probability``, recomputed by SQL functions from what the fitted
    classifier exports: coefficients, tree nodes or network weights.  ``scratch`` is a folder for the exported trees."""
    if name == "hist_gradient_boosting":
        return fitted.scored_by_rules(rows)
    if name == "mlp":
        return fitted.scored_by_expressions(rows)
    x = vector_to_array(F.col(fitted.getOrDefault("featuresCol")))
    if name == "logistic_regression":
        dot = F.aggregate(F.zip_with(x, F.lit([float(c) for c in fitted.coefficients]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return rows.withColumn("rule_probability", 1 / (1 + F.exp(-dot - fitted.intercept)))
    fitted.write().overwrite().save(scratch)
    spark = rows.sparkSession
    # nodes of a bounded number of trees of bounded depth: at most 160 x 2^13
    node = spark.read.parquet(f"{scratch}/data").select("treeID", "nodeData.*")
    weight = spark.read.parquet(f"{scratch}/treesMetadata").toDF("treeID", "_metadata", "_weight").select("treeID", "_weight")
    stats = F.col("impurityStats")
    share = stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b) if name == "random_forest" else F.col("prediction")
    node = node.join(F.broadcast(weight), "treeID").select(
        "treeID", F.col("id").alias("_at"), "leftChild", "rightChild", F.col("split.featureIndex").alias("_f"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("_cut"), (share * F.col("_weight")).alias("_share"), "_weight")
    tables = F.broadcast(node)
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    trees = fitted.getNumTrees if not callable(fitted.getNumTrees) else fitted.getNumTrees()
    walk = keyed.select("_row", x.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("treeID"), F.lit(0).alias("_at"))
    for _ in range(fitted.getOrDefault("maxDepth")):
        left = F.get("_x", F.col("_f")) <= F.col("_cut")
        walk = walk.join(tables, ["treeID", "_at"]).select("_row", "_x", "treeID", F.when(F.col("leftChild") < 0, F.col("_at")).when(
            left, F.col("leftChild")).otherwise(F.col("rightChild")).alias("_at"))
    total = walk.join(tables, ["treeID", "_at"]).groupBy("_row").agg(F.sum("_share").alias("_s"), F.sum("_weight").alias("_w"))
    p = F.col("_s") / F.col("_w") if name == "random_forest" else 1 / (1 + F.exp(-2 * F.col("_s")))
    return keyed.join(total, "_row").withColumn("rule_probability", p).drop("_row", "_s", "_w")


def logistic_gradient(fitted, rows: DataFrame, label: str = TARGET, weight: str = "weight") -> float:
    """Largest entry of the gradient of the weighted mean log-loss with L2 at a fitted logistic regression (intercept
    included); ``rows`` are the fitted ones."""
    scored = checked_by_rules("logistic_regression", fitted, rows, "").select(
        F.concat(vector_to_array(F.col(fitted.getOrDefault("featuresCol"))), F.array(F.lit(1.0))).alias("x"),
        (F.col(weight) * (F.col("rule_probability") - F.col(label))).alias("e"), F.col(weight).alias("w"))
    total = scored.agg(F.sum("w")).first()[0]
    sums = scored.select("e", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("e") * F.col("v")).alias("g"))
    beta = [fitted.getOrDefault("regParam") * float(c) for c in fitted.coefficients] + [0.0]
    return sums.agg(F.max(F.abs(F.col("g") / total + F.element_at(F.lit(beta), F.col("i") + 1)))).first()[0]


CANDIDATES = [
    ("logistic_regression", "machine_learning"),
    ("random_forest", "machine_learning"),
    ("gradient_boosting", "machine_learning"),
    ("mlp", "deep_learning"),
    ("hist_gradient_boosting", "machine_learning_selected"),
]


def training_pipeline(clf, profile: str = "current", k: int = SELECTED_FEATURES_K) -> Pipeline:
    """Rules → features → preprocessing → ANOVA top-k → classifier."""
    return Pipeline(stages=[
        BusinessRules(), BusinessFeatures(profile=profile), ChurnPreprocessor(profile=profile),
        AnovaSelector(k=k), clf,
    ])


def probability_of(scored: DataFrame) -> F.Column:
    """M5: probability of the churn class from the classifier output."""
    return vector_to_array(F.col("probability"))[1]
