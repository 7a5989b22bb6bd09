import math
import random

import numpy as np
import pandas as pd

from retentio.operators import stats


def test_exact_quantiles_match_numpy_linear_with_narrowing(spark, monkeypatch):
    random.seed(1)
    vals = [random.lognormvariate(0, 2) for _ in range(3000)] + [5.0] * 1000   # heavy tail + hot value
    df = spark.createDataFrame([(v, -v if i % 3 else None) for i, v in enumerate(vals)], "a double, b double")
    monkeypatch.setattr(stats, "FINAL_RANGE_ROWS", 40)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = stats.exact_quantiles(df, ["a", "b"], probs)
    b = [-v for i, v in enumerate(vals) if i % 3]
    for q in probs:
        assert math.isclose(got[("a", q)], float(np.quantile(vals, q)), rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(got[("b", q)], float(np.quantile(b, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0)], "a double, b double")
    got = stats.exact_quantiles(df, ["a", "b"], [0.5])
    assert got[("a", 0.5)] is None and got[("b", 0.5)] == 3.0
    m = stats.moments(df, ["a", "b"])
    assert m["a"]["n"] == 0 and m["b"]["skew"] is None


def test_modes_tie_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "x string")
    assert stats.modes(df, ["x"])["x"] == "a"


def test_sample_skewness_matches_pandas(spark):
    vals = [1.0, 2.0, 10.0, 3.0, 7.5, 0.2]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert math.isclose(stats.moments(df, ["x"])["x"]["skew"], pd.Series(vals).skew(), rel_tol=1e-9)


def test_approx_method_runs_and_is_close(spark):
    import random
    random.seed(5)
    vals = [random.gauss(50, 10) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    exact = stats.quantiles(df, ["x"], [0.25, 0.5, 0.75])
    approx = stats.quantiles(df, ["x"], [0.25, 0.5, 0.75], method="approx")
    for q in (0.25, 0.5, 0.75):
        assert abs(exact[("x", q)] - approx[("x", q)]) < 0.5


def test_preprocessor_approx_profile(spark, sf_small):
    from retentio.operators.prep import ChurnPreprocessor
    from retentio.plans import portfolio as P
    df = P.featured(spark, sf_small)
    m = ChurnPreprocessor(quantileMethod="approx").fit(df)
    assert len(m.feature_names) > 30
    assert m.transform(df).select("features").first()[0].size == len(m.feature_names)


def test_wrong_supplied_counts_fall_back_to_measured(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    got = stats.exact_quantiles(df, ["x"], [0.5, 1.0], counts={"x": (25, None, None)})
    assert got[("x", 0.5)] == 4.5 and got[("x", 1.0)] == 9.0


def test_sketch_ranges_hold_the_ranks_and_few_values(spark, monkeypatch):
    monkeypatch.setattr(stats, "FINAL_RANGE_ROWS", 10_000)
    df = spark.range(0, 200_000, 1, 7).selectExpr(
        "CAST(pmod(xxhash64(id), 1000003) AS double) AS a", "exp(pmod(xxhash64(id), 41)) AS b",
        "CASE WHEN id % 3 = 0 THEN 7d WHEN id % 5 = 0 THEN double('NaN') ELSE id END AS hot")
    probs, pdf = [0.0, 0.01, 0.5, 0.99, 1.0], df.toPandas()
    counts, ranges = stats._sketched(df, {c: probs for c in df.columns})
    assert counts["a"][0] == 200_000 and counts["hot"][0] == int(pdf["hot"].notna().sum())
    wanted = {(c, q): set(stats._positions(counts[c][0], q)[:2]) for c in df.columns for q in probs}
    cells = stats._first_cells(df, counts, ranges, wanted)
    assert len(cells) == 15 and all(cell[4] < 8_000 for cell in cells if cell[0] == "a")
    got = stats.exact_quantiles(df, df.columns, probs)
    for (c, q), v in got.items():
        assert math.isclose(v, pdf[c].quantile(q), rel_tol=1e-12, abs_tol=1e-12), (c, q)


def test_a_range_without_its_ranks_is_not_used(spark, monkeypatch):
    monkeypatch.setattr(stats, "FINAL_RANGE_ROWS", 100)
    df = spark.range(5000).selectExpr("CAST(id AS double) AS a")
    wanted = {("a", 0.5): {2499, 2500}}
    cells = stats._first_cells(df, {"a": (5000, 0.0, 4999.0)}, {("a", 0.5): (10.0, 20.0)}, wanted)
    assert cells == [("a", 0.0, 4999.0, 0, 5000, [2499, 2500])]
    assert stats._select_ranks(df, cells) == {("a", 2499): 2499.0, ("a", 2500): 2500.0}
