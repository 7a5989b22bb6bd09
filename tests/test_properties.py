"""Property tests: exact quantiles and AUC against brute force, partition independence."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from retentio.operators import evaluate as E
from retentio.operators import stats

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(finite, min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.77, 1.0]))
def test_quantile_matches_numpy(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = stats.exact_quantiles(df, ["x"], [q])[("x", q)]
    assert np.isclose(got, np.quantile(values, q), rtol=1e-12, atol=1e-9)


def _auc_brute(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.2, 0.5, 0.7, 0.9, 0.33])),
                min_size=2, max_size=40))
def test_auc_matches_pairwise_count(spark, rows):
    df = spark.createDataFrame(rows, "churned int, probability double")
    got = E.roc_auc(df).first()["roc_auc"]
    want = _auc_brute([r[0] for r in rows], [r[1] for r in rows])
    assert (got is None and want is None) or np.isclose(got, want)


def test_results_independent_of_partitioning(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 500), rng.random(500))]
    df = spark.createDataFrame(rows, "churned int, probability double")
    a1 = E.roc_auc(df.repartition(1)).first()["roc_auc"]
    a8 = E.roc_auc(df.repartition(8)).first()["roc_auc"]
    q1 = stats.exact_quantiles(df.repartition(1), ["probability"], [0.1, 0.5, 0.9])
    q8 = stats.exact_quantiles(df.repartition(8), ["probability"], [0.1, 0.5, 0.9])
    assert a1 == a8 and q1 == q8


def test_threshold_sweep_matches_brute_force(spark):
    from retentio.operators.reports import threshold_sweep
    ts = [round(0.10 + 0.01 * i, 2) for i in range(81)]
    ps = ts + [t - 1e-12 for t in ts] + [t + 1e-12 for t in ts] + [0.0, 1.0, 0.05, 0.95, 0.29, 0.57]
    df = spark.createDataFrame([(float(p),) for p in ps], "probability double")
    got = {r["threshold"]: (r["predicted_churn"], r["predicted_active"]) for r in threshold_sweep(df, ts).collect()}
    for t in ts:
        want = sum(1 for p in ps if p >= t)
        assert got[t] == (want, len(ps) - want), t
