from pyspark.sql import functions as F

from retentio.functions.features import add_features
from retentio.functions.rules import apply_rules
from retentio.functions.schema import (complete, feature_origin, model_input, normalize, pretty_label,
                                       require_target)


def test_english_and_spanish_headers_and_dirty_cells(spark):
    df = spark.createDataFrame(
        [("abc", "1", "Female", " 5 "), ("NaN", "x", "NA", "1e3"), ("", "", None, "7"), ("30", "0.9", "Male", "-1")],
        "Age string, Churned string, Genero string, Tasa_Abandono_Carrito string")
    out = normalize(df).collect()
    assert [r["age"] for r in out] == [None, None, None, 30.0]
    assert [r["churned"] for r in out] == [1, 0, 0, 0]
    assert [r["gender"] for r in out] == ["Female", None, None, "Male"]
    assert [r["cart_abandonment_rate"] for r in out] == [5.0, 1000.0, 7.0, -1.0]


def test_completion_only_for_absent_columns(spark):
    df = spark.createDataFrame([(None, 40.0)], "gender string, age double")
    out = complete(df).first()
    assert out["gender"] is None                    # present column: cell untouched
    assert out["country"] == "Unknown" and out["signup_quarter"] == "Q1"
    assert out["payment_method_diversity"] == "Unknown" and out["lifetime_value"] is None
    assert "churned" not in model_input(spark.createDataFrame([(1, 1.0)], "Churned int, Age double")).columns


def test_required_target(spark):
    import pytest
    require_target(spark.createDataFrame([(1,)], "Fuga_Cliente int"))
    with pytest.raises(ValueError):
        require_target(spark.createDataFrame([(1.0,)], "Age double"))


def test_rules(spark):
    df = spark.createDataFrame([(17.0, 101.0, -1.0), (18.0, 100.0, 0.0), (100.0, 0.0, 5.0), (100.5, -0.1, None)],
                               "age double, returns_rate double, credit_balance double")
    out = apply_rules(df).collect()
    assert [r["age"] for r in out] == [None, 18.0, 100.0, None]
    assert [r["returns_rate"] for r in out] == [None, 100.0, 0.0, None]
    assert [r["credit_balance"] for r in out] == [None, 0.0, 5.0, None]


def test_bin_edges_right_closed(spark):
    rows = [(17.0, 0.0, 30.0, 1000.0), (17.5, 5.0, 60.0, 2500.0), (18.0, 15.0, 90.0, 5000.0),
            (25.0, 30.0, 91.0, 5001.0), (25.5, 31.0, None, None), (100.0, None, 0.0, -5.0), (101.0, 5.5, 30.5, 0.0)]
    df = spark.createDataFrame(rows, "age double, total_purchases double, days_since_last_purchase double, "
                                     "lifetime_value double")
    out = add_features(df).collect()
    assert [r["age_group"] for r in out] == [None, "young", "young", "young", "young_adult", "senior_adult", None]
    assert [r["purchase_segment"] for r in out] == ["occasional", "occasional", "regular", "frequent", "vip", None,
                                                    "regular"]
    assert [r["recency_segment"] for r in out] == ["recent", "medium", "risk", "inactive", None, "recent", "medium"]
    assert [r["ltv_segment"] for r in out] == ["low", "medium", "high", "very_high", None, "low", "low"]
    assert [r["uses_app"] for r in out] == [0] * 7        # absent mobile_app_usage → NULL → 0
    legacy = add_features(df, "legacy").collect()
    assert [r["age_group"] for r in legacy][:4] == ["young", "young", "young", "young"]
    assert legacy[6]["age_group"] == "senior"


def test_labels_and_origin(spark):
    names = ["cat_nom__age_group_young_adult", "num_log__lifetime_value", "cat_nom__gender_Female",
             "something_else", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    out = df.select(pretty_label(F.col("n")).alias("l"), feature_origin(F.col("n")).alias("o")).collect()
    assert [r["l"] for r in out] == ["Age Group: young adult", "Customer Lifetime Value", "Gender: Female",
                                     "something else", ""]
    assert [r["o"] for r in out][:4] == ["age_group", "lifetime_value", "gender", "something_else"]


def test_only_plain_numbers_parse_and_the_target_never_fails(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from retentio.functions.schema import to_double, to_target
    cells = ["1d", "2f", "Infinity", "-inf", "1e400", "0x10", "1_0", " 5 ", "1e3", "-.5", "7.", "", None, "1e12", "1.9"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    rows = df.select(to_double(F.col("c"), T.StringType()).alias("v"), to_target(F.col("c"), T.StringType()).alias("t")) \
        .collect()
    assert [r["v"] for r in rows] == [None] * 7 + [5.0, 1000.0, -0.5, 7.0, None, None, 1e12, 1.9]
    assert [r["t"] for r in rows] == [0] * 7 + [5, 1000, 0, 7, 0, 0, 0, 1]


def test_anova_of_separators_constants_and_ties(spark):
    import math
    from pyspark.sql import functions as F
    from retentio.operators.selection import anova_f, best_positions, score_table, variable_relevance
    rows = [(0, 1.0, 3.0, 1.0, 1.0), (0, 1.0, 3.0, 2.0, 2.0), (1, 2.0, 3.0, 5.0, 5.0), (1, 2.0, 3.0, 6.0, 6.0)]
    df = spark.createDataFrame(rows, "churned int, sep double, const double, a double, b double")
    names = ["a", "const", "sep", "b"]
    scores = anova_f(df, {n: F.col(n) for n in names})
    assert scores["sep"] == math.inf and scores["const"] is None and scores["a"] == scores["b"] == 32.0
    assert best_positions([scores[n] for n in names]) == [2, 0, 3, 1]
    table = score_table(spark, scores, names, k=2)
    assert {r["feature"] for r in table.where("selected").collect()} == {"sep", "a"}
    assert [r["relevance"] for r in variable_relevance(table).orderBy("relevance").collect()] == [0.0, 100.0]
