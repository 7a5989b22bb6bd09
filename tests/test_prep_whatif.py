import math

from pyspark.sql import functions as F

from retentio.constants import ID
from retentio.operators import stats
from retentio.operators.importance import permutation_importance
from retentio.operators.prep import ChurnPreprocessor
from retentio.operators.scoring import RuleScorer
from retentio.operators.whatif import risk_signals, what_if
from retentio.plans import portfolio as P
from retentio.operators import sampling as S


def test_preprocessor_properties(spark, sf_small):
    df = P.featured(spark, sf_small)
    model = ChurnPreprocessor().fit(df)
    fitted = model.fitted
    cols = model.feature_columns()
    out = df.select(ID, *[e.alias(n) for n, e in cols.items()])
    # robust-scaled capped values: median 0 (values are capped, then centred on their median)
    cap = "num_cap__pages_per_session"
    med = stats.exact_quantiles(out, [cap], [0.5])[(cap, 0.5)]
    assert abs(med) < 1e-12
    # capped values within the fences, expressed on the scaled axis
    p = fitted["numeric"]["pages_per_session"]
    lo, hi = (p["lo"] - p["center"]) / p["scale"], (p["hi"] - p["center"]) / p["scale"]
    mn, mx = out.agg(F.min(cap), F.max(cap)).first()
    assert lo - 1e-9 <= mn and mx <= hi + 1e-9
    # one-hot rows sum to 1 for a level seen in training, 0 for an unseen level
    gender = [n for n in cols if n.startswith("cat_nom__gender_")]
    sums = out.select(sum(F.col(f"`{n}`") for n in gender).alias("s")).distinct().collect()
    assert {r["s"] for r in sums} == {1.0}
    unseen = spark.createDataFrame([("zz", "nope")], "gender string, recency_segment string")
    row = unseen.select(*[cols[n].alias(n) for n in gender + ["cat_ord__recency_segment"]]).first()
    assert sum(row[n] for n in gender) == 0.0 and row["cat_ord__recency_segment"] == -1.0


def test_signals_and_what_if(spark):
    ref = spark.createDataFrame([(float(i), float(i), float(i), float(i), float(i), float(i), float(i)) for i in range(100)],
                                "customer_id double, cart_abandonment_rate double, days_since_last_purchase double, "
                                "email_open_rate double, customer_service_calls double, mobile_app_usage double, "
                                "lifetime_value double")
    ref = ref.withColumn(ID, F.col(ID).cast("long"))
    cust = spark.createDataFrame([(1, 99.0, 99.0, 0.0, 99.0, 0.0, 0.0), (2, 50.0, 50.0, 50.0, 50.0, 50.0, 50.0),
                                  (3, None, None, None, None, None, None)], ref.schema)
    sig = risk_signals(cust, ref).groupBy(ID).agg(F.count(F.lit(1)).alias("n"),
                                                 F.first("signal").alias("s")).collect()
    got = {r[ID]: (r["n"], r["s"]) for r in sig}
    assert got[1][0] == 6 and got[2] == (1, "no_strong_signal") and got[3] == (1, "no_strong_signal")
    wi = what_if(cust, ref).where(F.col(ID) == 1).collect()
    assert len(wi) == 4
    for r in wi:
        assert math.isclose(r["reduction"], r["current_probability"] - r["simulated_probability"], abs_tol=2e-6)
        assert r["reading"] == ("prioritise" if r["simulated_probability"] < r["current_probability"] else "monitor")


def test_unused_variable_has_zero_importance(spark, sf_small):
    split = S.stratified_split(P.featured(spark, sf_small))
    test = split.where("split = 'test'").drop("split")
    imp = {r["variable"]: r for r in permutation_importance(test, RuleScorer(), columns=["age", "returns_rate"],
                                                             repeats=3).collect()}
    assert imp["age"]["importance_mean"] == 0.0 and imp["age"]["importance_std"] == 0.0
    assert "returns_rate" in imp


def test_generic_what_if_equals_rule_projection(spark, sf_small):
    from retentio.operators.whatif import what_if_scored
    df = P.customers(spark, sf_small)
    a = {(r[ID], r["scenario"]): tuple(r)[2:] for r in what_if(df, df).collect()}
    b = {(r[ID], r["scenario"]): tuple(r)[2:] for r in what_if_scored(df, df, RuleScorer()).collect()}
    assert a == b and len(a) == 4 * df.count()


def test_standalone_stages_compose_to_the_bundled_preprocessor(spark, sf_small):
    from pyspark.ml import Pipeline
    from retentio.constants import CAP_COLUMNS, LOG_COLUMNS
    from retentio.operators.prep import ExactRobustScaler, IQRCapper, Log1p, SkewImputer
    df = P.featured(spark, sf_small)
    bundled = ChurnPreprocessor().fit(df)
    cap = Pipeline(stages=[SkewImputer(inputCols=CAP_COLUMNS), IQRCapper(inputCols=CAP_COLUMNS),
                           ExactRobustScaler(inputCols=CAP_COLUMNS)]).fit(df).transform(df)
    log = Pipeline(stages=[SkewImputer(inputCols=LOG_COLUMNS), Log1p(inputCols=LOG_COLUMNS),
                           ExactRobustScaler(inputCols=LOG_COLUMNS)]).fit(df).transform(df)
    cols = bundled.feature_columns()
    ref = df.select(ID, *[cols[f"num_cap__{c}"].alias(c) for c in CAP_COLUMNS],
                    *[cols[f"num_log__{c}"].alias(c) for c in LOG_COLUMNS]).collect()
    got_cap = {r[ID]: r for r in cap.select(ID, *CAP_COLUMNS).collect()}
    got_log = {r[ID]: r for r in log.select(ID, *LOG_COLUMNS).collect()}
    for r in ref:
        for c in CAP_COLUMNS:
            assert abs(r[c] - got_cap[r[ID]][c]) < 1e-9
        for c in LOG_COLUMNS:
            assert abs(r[c] - got_log[r[ID]][c]) < 1e-9


def test_anova_of_large_values_with_a_small_spread(spark):
    from retentio.operators.selection import anova_f
    rows = [(i % 3, float((i * 7) % 11) / 10) for i in range(60)]
    near = spark.createDataFrame(rows, "y int, x double")
    x = F.col("x")
    scores = anova_f(near, {"near": x, "far": x + F.lit(1e9), "same": F.lit(1e9), "apart": F.col("y") + F.lit(1e9)}, "y")
    means = {y: sum(v for c, v in rows if c == y) / 20 for y in range(3)}
    middle = sum(means.values()) / 3
    expected = (sum(20 * (m - middle) ** 2 for m in means.values()) / 2) / (sum((v - means[y]) ** 2 for y, v in rows) / 57)
    assert abs(scores["near"] - expected) < 1e-9 and abs(scores["far"] - expected) < 1e-5
    assert scores["same"] is None and scores["apart"] == float("inf")
