import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retentio.operators import network as N


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes that no plane parts."""
    random = np.random.RandomState(1)
    x = random.uniform(-1, 1, (1500, 3))
    rows = [(Vectors.dense(v), int(v[0] ** 2 + v[1] ** 2 < 0.6)) for v in x.tolist()]
    return spark.createDataFrame(rows, ["selected", "churned"]).cache()


def test_gradient_equals_finite_differences():
    random, layers = np.random.RandomState(0), [4, 5, 3, 1]
    flat, x, y = N.initial(layers, 3), random.normal(size=(20, 4)), random.randint(0, 2, 20).astype(float)
    _, gradient = N.loss_and_gradient(flat, layers, x, y, 0.3)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (N.loss_and_gradient(flat + s, layers, x, y, 0.3)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-6


def test_weights_do_not_depend_on_partitions(rings):
    fitted = [N.Perceptron(hidden=[8], maxIter=4, shardRows=400).fit(rings.repartition(n)).told() for n in (1, 8)]
    assert fitted[0] == fitted[1] and len(fitted[0]["losses"]) == 4


def test_it_learns_stops_and_expressions_agree(rings, tmp_path):
    model = N.Perceptron(maxIter=60, patience=5, stepSize=0.01).fit(rings)
    told = model.told()
    assert told["losses"][-1] < 0.3 * told["losses"][0] and max(told["scores"]) > 0.9 and len(told["scores"]) <= 60
    model.write().overwrite().save(str(tmp_path / "m"))
    again = N.PerceptronModel.load(str(tmp_path / "m"))
    both = again.scored_by_expressions(model.transform(rings))
    from pyspark.ml.functions import vector_to_array
    far = both.agg(F.max(F.abs(vector_to_array("probability")[1] - F.col("rule_probability")))).first()[0]
    assert far < 1e-9


def test_odd_rows(spark, rings):
    odd = rings.limit(50).union(spark.createDataFrame([(Vectors.dense([float("nan"), 0, 0]), 1), (Vectors.dense([0, 0, 0]), None)],
                                                      rings.schema))
    model = N.Perceptron(hidden=[4], maxIter=2).fit(odd)
    assert model.transform(odd).count() == 52
    with pytest.raises(ValueError):
        N.Perceptron().fit(rings.where("churned > 5"))


def test_expressions_work_out_each_layer_once(rings):
    """A layer's input is worked out once a row; written inside the units' lambda it would be worked out once a unit."""
    import time
    model = N.Perceptron(hidden=[64, 32], maxIter=1).fit(rings)
    rows = rings.crossJoin(rings.sparkSession.range(4)).coalesce(1).cache()
    rows.count()
    started = time.time()
    found = model.scored_by_expressions(rows)
    assert found.agg(F.count("rule_probability")).first()[0] == 6000
    assert time.time() - started < 30
