"""Training job (split → fit → evaluate → importance → persist) and model comparison (M4).

One function trains, for the command line and for the registered queries.  Results are cached per
input path within the application (the original caches the fitted model and the comparison the same
way), so several reports share one fit.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import COMPARISON_MAX_ROWS, ID, MODEL_COMMENTS, TARGET
from ..functions.schema import require_target
from ..operators import evaluate as E
from ..operators import sampling as S
from ..operators.importance import permutation_importance
from ..operators.models import (
    CANDIDATES, AnovaSelector, BusinessFeatures, BusinessRules, classifier, probability_of, training_pipeline,
    with_validation,
)
from ..operators.prep import ChurnPreprocessor
from ..operators.scoring import PipelineScorer
from ..operators.segment import PARALLEL_FITS
from ..session import compiled, written
from ..sources.files import is_missing
from . import portfolio as P

FINAL = "hist_gradient_boosting"
_CACHE: dict = {}


@dataclass
class Trained:
    model: PipelineModel
    split: DataFrame          # customers with a split column (written)
    test_scored: DataFrame    # test rows with probability (written)
    classifier_name: str = FINAL
    early_stopping: bool = False


def fit_final(data: DataFrame, classifier_name: str = FINAL, early_stopping: bool | None = None) -> Trained:
    """Split, fit the whole pipeline on the training rows and score the test rows.

    ``early_stopping`` holds out a tenth of the training rows (by hash) and stops the final booster when their loss
    no longer falls; None: above 10,000 training rows, like the original's library.
    """
    require_target(data)
    compiled(data.sparkSession)
    split = written(S.stratified_split(data), "split")
    train = E.with_weights(split.where(F.col("split") == "train"))
    rows, validation = train.count(), None
    if classifier_name == FINAL:
        train, validation = with_validation(train, "_validation", rows, early_stopping)
    clf = classifier(classifier_name, n_rows=rows, validation=validation)
    model = training_pipeline(clf).fit(train)
    test = split.where(F.col("split") == "test").drop("split")
    scored = written(PipelineScorer(model, classifier_name).with_probability(test), "test-scored")
    return Trained(model, split, scored, classifier_name, validation is not None)


def train_final(spark: SparkSession, sf_dir: str, classifier_name: str = FINAL) -> Trained:
    """:func:`fit_final` on the derived customer table, cached."""
    key = ("final", spark.sparkContext.applicationId, sf_dir, classifier_name)
    if key not in _CACHE:
        _CACHE[key] = fit_final(P.customers(spark, sf_dir), classifier_name)
    return _CACHE[key]


def final_metrics(t: Trained) -> DataFrame:
    """Held-out metrics of the final pipeline."""
    return E.evaluate(t.test_scored)


def model_importance(t: Trained) -> DataFrame:
    """E6 with the fitted pipeline as scorer, over all test rows."""
    test = t.split.where(F.col("split") == "test").drop("split")
    return permutation_importance(test, PipelineScorer(t.model))


def save_model(t: Trained, path: str) -> None:
    """Persist the fitted pipeline."""
    t.model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline; a missing path raises a clear error."""
    try:
        SparkSession.active().read.text(f"{path}/metadata").schema
    except AnalysisException as exc:
        if is_missing(exc):
            raise FileNotFoundError(f"no trained model at {path}; run the training job first") from exc
        raise
    return PipelineModel.load(path)


PARTS = {"training": "json", "metrics": "json", "report": "json", "importance": "json", "test_predictions": "parquet"}


def training_record(spark: SparkSession, t: Trained) -> DataFrame:
    """One row: time, shape, row counts, target, classifier and its parameters."""
    counts = {r["split"]: r["count"] for r in t.split.groupBy("split").count().collect()}
    stage = t.model.stages[-1]
    params = {p.name: str(v) for p, v in stage.extractParamMap().items() if p.name not in ("trees", "losses")}
    columns = [c for c in t.split.columns if c not in ("split", "weight")]
    row = (datetime.now(timezone.utc).isoformat(timespec="seconds"), sum(counts.values()), len(columns),
           counts.get("train", 0), counts.get("test", 0), TARGET, t.classifier_name, t.early_stopping, params)
    return spark.createDataFrame([row], "trained_at string, dataset_rows long, dataset_columns long, train_rows long, "
                                        "test_rows long, target string, classifier string, early_stopping boolean, "
                                        "parameters map<string,string>")


def save_metadata(spark: SparkSession, t: Trained, folder: str, importance: DataFrame | None = None) -> None:
    """Training record, metrics with the confusion cells, report and importance as JSON, test predictions as
    Parquet; the importance is computed unless given."""
    importance = model_importance(t) if importance is None else importance
    training_record(spark, t).write.mode("overwrite").json(f"{folder}/training")
    final_metrics(t).write.mode("overwrite").json(f"{folder}/metrics")
    E.classification_report(t.test_scored).write.mode("overwrite").json(f"{folder}/report")
    importance.orderBy(F.desc("importance_mean"), "variable").write.mode("overwrite").json(f"{folder}/importance")
    t.test_scored.select(ID, TARGET, F.round("probability", 4).alias("probability")) \
        .write.mode("overwrite").parquet(f"{folder}/test_predictions")


def read_metadata(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Read back; absent parts come back as empty frames."""
    out = {}
    for part, fmt in PARTS.items():
        try:
            out[part] = getattr(spark.read, fmt)(f"{folder}/{part}")
        except AnalysisException as exc:
            if not is_missing(exc):
                raise
            out[part] = spark.createDataFrame([], "empty string")
    return out


@dataclass
class Compared:
    models: dict              # fitted candidates by name
    train: DataFrame          # fitted rows: id, target, weight, vector (written)
    test: DataFrame           # held-out rows: id, target, vector (written)
    scored: DataFrame         # (model, kind, id, target, probability) of every held-out row (written)
    fit_rows: int


def fit_candidates(spark: SparkSession, sf_dir: str, candidates=CANDIDATES, max_fit_rows: int = COMPARISON_MAX_ROWS) -> Compared:
    """One split, preprocessing fitted once, every candidate fitted on the same rows (at most ``max_fit_rows``, class
    shares kept); all of them score the held-out rows in one scan."""
    key = ("candidates", spark.sparkContext.applicationId, sf_dir, tuple(candidates), max_fit_rows)
    if key in _CACHE:
        return _CACHE[key]
    compiled(spark)
    split = written(S.stratified_split(P.customers(spark, sf_dir)), "compare-split")
    train = E.with_weights(S.stratified_downsample(split.where(F.col("split") == "train"), max_fit_rows))
    test = split.where(F.col("split") == "test")
    prep = Pipeline(stages=[BusinessRules(), BusinessFeatures(), ChurnPreprocessor(), AnovaSelector()]).fit(train)
    train_v = written(prep.transform(train).select(ID, TARGET, "weight", "selected"), "compare-train")
    test_v = written(prep.transform(test).select(ID, TARGET, "selected"), "compare-test")
    n_train = train_v.count()
    major = float(E.majority_class(train))

    def fitted(item):
        name, _ = item
        rows, validation = with_validation(train_v, "_validation", n_train) if name == FINAL else (train_v, None)
        return classifier(name, n_rows=n_train, validation=validation).fit(rows)

    # independent fits on the shared written vectors, submitted side by side; order kept
    with ThreadPoolExecutor(max_workers=PARALLEL_FITS) as pool:
        models = dict(zip([name for name, _ in candidates], pool.map(fitted, candidates)))
    wide, given = test_v, [F.struct(F.lit("majority_baseline").alias("model"), F.lit("baseline").alias("kind"),
                                    F.lit(major).alias("probability"))]
    for name, kind in candidates:                  # one column per candidate, all in one stage
        wide = models[name].transform(wide)
        wide = wide.select(*test_v.columns, *[f"p_{n}" for n in models if f"p_{n}" in wide.columns],
                           probability_of(wide).alias(f"p_{name}"))
        given.append(F.struct(F.lit(name).alias("model"), F.lit(kind).alias("kind"), F.col(f"p_{name}").alias("probability")))
    scored = written(wide.select(ID, TARGET, F.explode(F.array(*given)).alias("s")).select("s.model", "s.kind", ID, TARGET, "s.probability"),
                     "compare-scored")
    _CACHE[key] = Compared(models, train_v, test_v, scored, n_train)
    return _CACHE[key]


def compare_models(spark: SparkSession, sf_dir: str, candidates=CANDIDATES, max_fit_rows: int = COMPARISON_MAX_ROWS) -> DataFrame:
    """M4: metrics of every candidate and of the majority baseline on all held-out rows, best AUC first."""
    c = fit_candidates(spark, sf_dir, candidates, max_fit_rows)
    comments = F.create_map(*[F.lit(x) for kv in MODEL_COMMENTS.items() for x in kv])
    return (E.evaluate(c.scored, groups=["model", "kind"])
            .withColumns({"fit_rows": F.lit(c.fit_rows).cast("long"), "test_rows": F.lit(c.test.count()).cast("long")})
            .withColumn("selected", F.col("model") == FINAL)
            .withColumn("comment", F.element_at(comments, F.col("model")))
            .orderBy(F.desc("roc_auc"), "model"))
