"""Model floor on a separable frame, segmentation properties, empty inputs, count identities."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from retentio.constants import ID, TARGET
from retentio.operators import evaluate as E
from retentio.operators import reports, segment
from retentio.operators.models import classifier
from retentio.plans import portfolio as P


def _blobs(spark, n=200):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        y = i % 2
        centre = 2.5 if y else -2.5
        rows.append((i, y, float(rng.normal(centre, 1)), float(rng.normal(centre, 1)), float(rng.normal(0, 1))))
    df = spark.createDataFrame(rows, f"{ID} long, {TARGET} int, a double, b double, c double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="selected").transform(df)


def test_learned_models_beat_the_majority_baseline(spark):
    df = E.with_weights(_blobs(spark))
    for name in ("logistic_regression", "random_forest"):
        model = classifier(name, n_rows=200).fit(df)
        scored = model.transform(df).withColumn("probability", vector_to_array("probability")[1])
        assert E.roc_auc(scored).first()["roc_auc"] > 0.9


def test_kmeans_multistart_and_centred_pca(spark):
    df = _blobs(spark).withColumnRenamed("selected", "features")
    found = segment.kmeans_best(df, k=2, starts=3)
    singles = [KMeans(k=2, seed=42 + i, featuresCol="features").fit(df).summary.trainingCost for i in range(3)]
    assert found.cost <= min(singles) + 1e-9 and found.cost <= min(found.costs) * (1 + segment.TIED)
    scored, explained = segment.pca_scores(df, components=2)
    means = scored.agg(F.avg("pc1"), F.avg("pc2")).first()
    assert abs(means[0]) < 1e-9 and abs(means[1]) < 1e-9
    assert 0 < sum(explained) <= 1.0 + 1e-12


def test_kmeans_equals_lloyd_in_numpy_for_any_split(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.6, size=(80, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 0), (4, 4, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{ID} long, a array<double>").withColumn(
        "features", array_to_vector("a"))
    found = [segment.kmeans_best(df.repartition(n), k=4, starts=6) for n in (1, 5)]
    assert np.allclose(found[0].centres, found[1].centres) and np.allclose(found[0].costs, found[1].costs)
    best = found[0]
    near = ((x[:, None] - best.centres[None]) ** 2).sum(2)
    label = near.argmin(1)
    assert np.allclose(best.centres, [x[label == j].mean(0) for j in range(4)]) and abs(near.min(1).sum() - best.cost) < 1e-6
    rows = best.transform(df).select(ID, "cluster_id", "distance").collect()
    assert all(r[1] == label[r[0]] and abs(r[2] - near[r[0]].min()) < 1e-9 for r in rows)
    seeds = segment._seeds(df.select(F.col("a").alias("x"), F.xxhash64(ID).alias("h")), 4, 200, 1, 4)
    spread = [len({int(((x - c) ** 2).sum(1).argmin()) // 80 for c in s}) for s in seeds]
    assert np.mean(np.array(spread) == 4) > 0.6                      # k-means++ finds all four groups in most starts


def test_kmeans_of_equal_rows_and_none(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], f"{ID} long, a array<double>").withColumn("features", array_to_vector("a"))
    found = segment.kmeans_best(same, k=2, starts=2)
    assert found.cost == 0 and found.transform(same).select("cluster_id").distinct().count() == 1
    try:
        segment.kmeans_best(same.limit(0))
        raise AssertionError
    except ValueError as e:
        assert "no rows" in str(e)


def test_empty_inputs(spark, sf_small):
    scored = P.rule_scored(spark, sf_small).limit(0)
    bal = reports.batch_balance(scored).first()
    assert bal["total"] == 0 and bal["active_pct"] == 0.0 and bal["churn_pct"] == 0.0
    assert [r["customers"] for r in reports.level_counts(scored).collect()] == [0, 0, 0]
    empty = P.customers(spark, sf_small).limit(0)
    bounds = {r["variable"]: (r["low"], r["high"], r["default"]) for r in reports.numeric_bounds(empty).collect()}
    assert set(bounds.values()) == {(0.0, 1.0, 0.0)}
    assert {r["mode"] for r in reports.safe_modes(empty, ["country"]).collect()} == {""}


def test_risk_counts_sum_to_total(spark, sf_small):
    scored = P.rule_scored(spark, sf_small)
    n = scored.count()
    assert sum(r["customers"] for r in reports.level_counts(scored).collect()) == n
    bal = reports.batch_balance(scored).first()
    assert bal["high"] + bal["medium"] + bal["low"] == n
    assert abs(bal["active_pct"] + bal["churn_pct"] - 100.0) < 1e-6


def test_legacy_profile_pipeline_trains_and_scores(spark, sf_small):
    from retentio.operators.models import training_pipeline
    from retentio.operators.scoring import PipelineScorer
    data = E.with_weights(P.customers(spark, sf_small))
    model = training_pipeline(classifier("logistic_regression", n_rows=150), profile="legacy").fit(data)
    out = PipelineScorer(model).with_probability(P.customers(spark, sf_small))
    probs = [r["probability"] for r in out.select("probability").collect()]
    assert len(probs) == 150 and all(0.0 <= p <= 1.0 for p in probs)
    names = model.stages[2].feature_names
    assert any(n.startswith("cat__age_group_") for n in names) and any(n.startswith("num__") for n in names)


def test_probabilities_follow_from_exported_parts(spark, tmp_path):
    """Each candidate's probabilities equal those of its exported coefficients, nodes or weights; another fit's differ."""
    import random
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    from retentio.operators.models import CANDIDATES, checked_by_rules, logistic_gradient
    draw = random.Random(5)
    rows = [(Vectors.dense([draw.random() for _ in range(3)]), 1.0) for _ in range(300)]
    df = spark.createDataFrame([(v, w, int(v[0] + 0.3 * draw.random() > 0.6)) for v, w in rows], ["selected", "weight", "churned"])
    few = df.limit(120)
    for name, _ in CANDIDATES:
        one, other = (classifier(name, n_rows=n).fit(x) for n, x in ((300, df), (120, few)))
        scored = one.transform(df).select("selected", vector_to_array("probability")[1].alias("p"))
        for model, equal in ((one, True), (other, False)):
            ruled = checked_by_rules(name, model, scored, str(tmp_path / f"{name}{equal}"))
            far = ruled.agg(F.max(F.abs(F.col("p") - F.col("rule_probability"))).alias("far"), F.count("rule_probability").alias("n")).first()
            assert far["n"] == 300 and (far["far"] < 1e-9) == equal, (name, equal, far)
        if name == "logistic_regression":
            assert logistic_gradient(one, df) < 1e-3 < logistic_gradient(other, df)


def test_wide_projections_of_the_stages_are_compiled(spark):
    """Stage code above HotSpot's limit is never compiled; scoring lowers Spark's limit, unless the session has its own."""
    from pyspark.ml import PipelineModel
    from retentio.operators.models import BusinessRules
    from retentio.operators.scoring import PipelineScorer
    from retentio.session import HUGE_METHOD
    df = spark.range(3).selectExpr("id AS customer_id", "double(id) AS age")

    class Half(PipelineModel):
        def transform(self, rows, params=None):
            from pyspark.ml.functions import array_to_vector
            rows = BusinessRules().transform(rows)
            return rows.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))
    before = spark.conf.get(HUGE_METHOD, None)
    try:
        for given, expected in ((None, "8000"), ("20000", "20000")):
            spark.conf.unset(HUGE_METHOD)
            if given:
                spark.conf.set(HUGE_METHOD, given)
            assert PipelineScorer(Half([])).with_probability(df).where("probability = 0.5").count() == 3
            assert spark.conf.get(HUGE_METHOD) == expected
    finally:
        spark.conf.unset(HUGE_METHOD) if before is None else spark.conf.set(HUGE_METHOD, before)
