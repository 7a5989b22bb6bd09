"""Registered queries (Spark) and their DuckDB twins.

Query names are ``<survey id>_<name>``.  Double outputs are rounded to 6
decimals on both sides so that summation order cannot change a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    BASE_NUMERIC, CATEGORICAL, ID, IMPORTANCE_COLUMNS, NO_SIGNAL, PREDICTION_COLUMNS, PRESETS, SCENARIOS, SCORE_WEIGHTS, SIGNALS,
    TARGET,
)
from ..functions.schema import feature_origin, pretty_label
from ..functions.scoring import decision, risk_action, risk_level
from ..operators import evaluate as E
from ..operators import importance as IMP
from ..operators import reports
from ..operators import sampling as S
from ..operators import segment as SEG
from ..operators import selection as SEL
from ..operators import whatif as W
from ..operators.models import CANDIDATES, BusinessFeatures, BusinessRules, checked_by_rules, logistic_gradient
from ..operators.prep import ChurnPreprocessor
from ..operators.scoring import PipelineScorer, RuleScorer, predict_probabilities, prediction_output
from ..session import shared_scratch, written
from ..sources import files as FS
from ..sources.customers import source_frame
from ..streaming.scoring import start_scoring_stream, start_upload_stream
from . import bundle as BU
from . import oracle as O
from . import portfolio as P
from . import sample_uploads as UP
from . import training as TR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = O.decimal_rounding(sql)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (hash-stable outputs)."""
    return df.select(*[
        reports.round6(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) AS {alias or expr}"


CUSTOMER_COLUMNS = [ID] + BASE_NUMERIC[:1] + ["gender", "country", "city"] + BASE_NUMERIC[1:] + [
    "payment_method_diversity", "signup_quarter", TARGET]
_DOUBLES = set(BASE_NUMERIC)


def _select_rounded(cols, source: str) -> str:
    return "SELECT " + ", ".join(r(c) if c in _DOUBLES else c for c in cols) + f" FROM {source}"


# --- adapter ---------------------------------------------------------------

@register("fixture_customers", O.with_(O.CUSTOMERS) + _select_rounded(CUSTOMER_COLUMNS, "customers"))
def q_fixture_customers(spark, sf):
    return rounded(P.customers(spark, sf).select(*CUSTOMER_COLUMNS))


# --- scoring ---------------------------------------------------------------

SCORED_SQL = O.with_(O.CUSTOMERS, O.scored_cte())


@register("m6_rule_scoring", SCORED_SQL + "SELECT customer_id, round(probability, 6) AS probability, "
          "risk_level, decision, action FROM scored")
def q_m6(spark, sf):
    s = P.rule_scored(spark, sf)
    return rounded(s.select(ID, "probability", "risk_level", "decision", "action"))


@register("a5_country_risk", SCORED_SQL + """
SELECT country, round(avg(probability), 6) AS mean_probability, count(*) AS customers
FROM scored WHERE country IS NOT NULL GROUP BY country
ORDER BY mean_probability DESC, country LIMIT 12""")
def q_a5(spark, sf):
    return reports.country_risk(P.rule_scored(spark, sf))


# --- portfolio reports (A1-A18) ------------------------------------------------

@register("a1_portfolio_kpis", SCORED_SQL + """
SELECT count(*) AS customers, round(avg(churned) * 100, 6) AS churn_pct,
       count(*) FILTER (WHERE risk_level = 'high') AS high_risk,
       count(*) FILTER (WHERE risk_level = 'medium') AS medium_risk,
       round(avg(probability) * 100, 6) AS mean_probability_pct
FROM scored""")
def q_a1(spark, sf):
    return reports.portfolio_kpis(P.rule_scored(spark, sf))


_NULLS = " + ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT)" for c in CUSTOMER_COLUMNS)


@register("a2_dataset_kpis", O.with_(O.CUSTOMERS) + f"""
SELECT count(*) AS rows, CAST({len(CUSTOMER_COLUMNS)} AS BIGINT) AS columns,
       round(avg(churned) * 100, 6) AS churn_pct, CAST({_NULLS} AS BIGINT) AS null_cells
FROM customers""")
def q_a2(spark, sf):
    return reports.dataset_kpis(P.customers(spark, sf))


@register("a3_target_distribution", O.with_(O.CUSTOMERS) + """
SELECT status, count(*) AS customers FROM (
  SELECT CASE WHEN churned = 1 THEN 'churn' WHEN churned = 0 THEN 'active' END AS status FROM customers)
WHERE status IS NOT NULL GROUP BY status""")
def q_a3(spark, sf):
    return reports.target_distribution(P.customers(spark, sf))


@register("a4_risk_distribution", SCORED_SQL + """
SELECT d.position, d.risk_level, coalesce(c.n, 0) AS customers
FROM (VALUES (0, 'low'), (1, 'medium'), (2, 'high')) d(position, risk_level)
LEFT JOIN (SELECT risk_level, count(*) AS n FROM scored GROUP BY risk_level) c USING (risk_level)""")
def q_a4(spark, sf):
    return reports.level_counts(P.rule_scored(spark, sf))


_NULL_WIDE = ", ".join(f"avg(CAST({c} IS NULL AS DOUBLE)) * 100 AS {c}" for c in CUSTOMER_COLUMNS)


@register("a6_null_share", O.with_(O.CUSTOMERS, f"wide AS (SELECT {_NULL_WIDE} FROM customers)") + f"""
SELECT variable, round(null_pct, 6) AS null_pct, {O.label_sql('variable')} AS label FROM (
{O.unpivot_sql('wide', CUSTOMER_COLUMNS, value='null_pct')})
ORDER BY round(null_pct, 6) DESC, variable LIMIT 12""")
def q_a6(spark, sf):
    return reports.null_share(P.customers(spark, sf))


@register("a7_batch_balance", SCORED_SQL + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE risk_level = 'high') AS high,
       count(*) FILTER (WHERE risk_level = 'medium') AS medium,
       count(*) FILTER (WHERE risk_level = 'low') AS low,
       coalesce(round(count(*) FILTER (WHERE decision = 'active') * 100.0::DOUBLE / nullif(count(*), 0), 6), 0)
         AS active_pct,
       coalesce(round(count(*) FILTER (WHERE decision = 'churn') * 100.0::DOUBLE / nullif(count(*), 0), 6), 0)
         AS churn_pct
FROM scored""")
def q_a7(spark, sf):
    return reports.batch_balance(P.rule_scored(spark, sf))


@register("a8_campaign_advice", SCORED_SQL + """,
counts AS (SELECT count(*) FILTER (WHERE risk_level = 'high') AS h,
                  count(*) FILTER (WHERE risk_level = 'medium') AS m FROM scored)
SELECT 1 AS line, printf('Prioritise immediate contact with the %d high-risk customers.', h) AS advice
FROM counts WHERE h > 0
UNION ALL SELECT 2, printf('Launch preventive campaigns for the %d medium-risk customers.', m) FROM counts WHERE m > 0
UNION ALL SELECT 3, 'Download the CSV to plan retention actions per customer.'""".replace(SCORED_SQL + ",", SCORED_SQL[:-1] + ",", 1))
def q_a8(spark, sf):
    return reports.campaign_advice(P.rule_scored(spark, sf))


_PROFILE_SQL = ", ".join(f"round(avg({src}), 6) AS {name}" for name, src in reports.PROFILE_MEANS)


@register("a9_segment_profile", O.with_(*O.BASE) + f"""
SELECT *, round(customers * 100.0::DOUBLE / sum(customers) OVER (), 6) AS pct_customers FROM (
  SELECT recency_segment, count(*) AS customers, round(avg(churned), 6) AS churn_rate, {_PROFILE_SQL}
  FROM featured GROUP BY recency_segment)""")
def q_a9(spark, sf):
    return reports.segment_profile(P.featured(spark, sf), "recency_segment")


@register("a10_segment_count", O.with_(*O.BASE) + """
SELECT count(DISTINCT recency_segment) AS segments FROM featured""")
def q_a10(spark, sf):
    return reports.segment_count(P.featured(spark, sf), "recency_segment")


def _bounds_sql(source: str) -> str:
    parts = []
    for c in BASE_NUMERIC:
        parts.append(f"SELECT '{c}' AS variable, quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.5) AS med, "
                     f"quantile_cont({c}, 0.99) AS hi FROM {source}")
    return ("SELECT variable, round(CASE WHEN lo IS NULL THEN 0 ELSE lo END, 6) AS low, "
            "round(CASE WHEN lo IS NULL THEN 1 WHEN lo = hi THEN lo + 1 ELSE hi END, 6) AS high, "
            "round(CASE WHEN lo IS NULL THEN 0 ELSE med END, 6) AS \"default\" FROM (\n"
            + "\nUNION ALL ".join(parts) + ")")


@register("a11_numeric_bounds", O.with_(O.CUSTOMERS) + _bounds_sql("customers"))
def q_a11(spark, sf):
    return reports.numeric_bounds(P.customers(spark, sf))


A12_PROBS = [0.1, 0.25, 0.75, 0.9]


@register("a12_quantiles", O.with_(O.CUSTOMERS) + "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({q} AS DOUBLE) AS q, round(coalesce(quantile_cont({c}, {q}), 0), 6) AS value "
    f"FROM customers" for c in BASE_NUMERIC for q in A12_PROBS))
def q_a12(spark, sf):
    return reports.quantile_values(P.customers(spark, sf), BASE_NUMERIC, A12_PROBS)


MODE_COLUMNS = ["gender", "country", "city", "signup_quarter", "payment_method_diversity"]


def _mode_sql(c: str, source: str) -> str:
    return (f"coalesce((SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1), '')")


@register("a13_safe_mode", O.with_(O.CUSTOMERS) + "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, {_mode_sql(c, 'customers')} AS mode" for c in MODE_COLUMNS))
def q_a13(spark, sf):
    return reports.safe_modes(P.customers(spark, sf), MODE_COLUMNS)


@register("a14_sorted_options", O.with_(O.CUSTOMERS) + f"""
SELECT variable, option, row_number() OVER (PARTITION BY variable ORDER BY option) AS position FROM (
  SELECT DISTINCT variable, option FROM (
{O.unpivot_sql('customers', MODE_COLUMNS, value='option')}) WHERE option IS NOT NULL)""")
def q_a14(spark, sf):
    return reports.sorted_options(P.customers(spark, sf), MODE_COLUMNS)


_TYPICAL = ", ".join(
    [f"(SELECT round(coalesce(quantile_cont({c}, 0.5), 0), 6) FROM customers) AS {c}" for c in BASE_NUMERIC]
    + [f"{_mode_sql(c, 'customers')} AS {c}" for c in ["gender", "country", "signup_quarter",
                                                       "payment_method_diversity", "city"]])


@register("a15_typical_customer", O.with_(O.CUSTOMERS) + f"SELECT {_TYPICAL}")
def q_a15(spark, sf):
    return reports.typical_customer(P.customers(spark, sf))


HIST_COLUMN = "days_since_last_purchase"


@register("a16_class_histogram", O.with_(O.CUSTOMERS, f"""
rng AS (SELECT min({HIST_COLUMN}) AS mn,
  CASE WHEN max({HIST_COLUMN}) > min({HIST_COLUMN}) THEN (max({HIST_COLUMN}) - min({HIST_COLUMN})) / 45 ELSE 1 END AS w
  FROM customers)""") + f"""
SELECT status, bin, round(mn + bin * w, 6) AS bin_start, count(*) AS customers FROM (
  SELECT CASE WHEN churned = 1 THEN 'churn' WHEN churned = 0 THEN 'active' END AS status,
         CAST(least(floor(({HIST_COLUMN} - mn) / w), 44) AS INTEGER) AS bin, mn, w
  FROM customers, rng WHERE {HIST_COLUMN} IS NOT NULL)
WHERE status IS NOT NULL GROUP BY status, bin, mn, w""")
def q_a16h(spark, sf):
    return reports.class_histogram(P.customers(spark, sf), HIST_COLUMN)


@register("a16_class_box", O.with_(O.CUSTOMERS, f"""
t AS (SELECT CASE WHEN churned = 1 THEN 'churn' WHEN churned = 0 THEN 'active' END AS status, {HIST_COLUMN} AS x
      FROM customers WHERE {HIST_COLUMN} IS NOT NULL),
q AS (SELECT status, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
      FROM t WHERE status IS NOT NULL GROUP BY status)""") + """
SELECT q.status, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 6) AS lower_whisker,
       round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 6) AS upper_whisker
FROM t JOIN q USING (status) GROUP BY q.status, q1, med, q3""")
def q_a16b(spark, sf):
    return reports.class_box(P.customers(spark, sf), HIST_COLUMN)


SCATTER = dict(x="cart_abandonment_rate", y="email_open_rate", color="risk_level",
               hover=["total_purchases", "lifetime_value", "customer_service_calls"])


@register("a17_scatter_extract", SCORED_SQL + f"""
SELECT customer_id, {', '.join(r(c) for c in [SCATTER['x'], SCATTER['y']])}, risk_level,
       {', '.join(r(c) for c in SCATTER['hover'])}
FROM scored ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id LIMIT 6000""")
def q_a17(spark, sf):
    return rounded(reports.scatter_extract(P.rule_scored(spark, sf), **SCATTER))


_RANK_REST = [c for c in CUSTOMER_COLUMNS]


@register("a18_ranked_portfolio", SCORED_SQL + f"""
SELECT round(probability, 6) AS probability, risk_level, decision,
       {', '.join(r(c) if c in _DOUBLES else c for c in _RANK_REST)}
FROM scored ORDER BY probability DESC, customer_id LIMIT 200""")
def q_a18(spark, sf):
    return rounded(reports.ranked(P.rule_scored(spark, sf)))


# --- projections / samples -----------------------------------------------------

FEATURE_COLUMNS = [ID, *PREDICTION_COLUMNS]


@register("p7_feature_projection", O.with_(*O.BASE) + "SELECT "
          + ", ".join(r(c) if c in _DOUBLES else c for c in FEATURE_COLUMNS) + " FROM featured")
def q_p7(spark, sf):
    return rounded(P.featured(spark, sf).select(*FEATURE_COLUMNS))


@register("f6_legacy_features", O.with_(O.CUSTOMERS, O.CLEAN, O.features_cte(legacy=True)) + """
SELECT customer_id, uses_app, has_credit, age_group, purchase_segment, recency_segment, ltv_segment FROM featured""")
def q_f6(spark, sf):
    return P.featured(spark, sf, "legacy").select(ID, "uses_app", "has_credit", "age_group", "purchase_segment",
                                                  "recency_segment", "ltv_segment")


@register("s6_template_preview", O.with_(O.CUSTOMERS) + "SELECT "
          + ", ".join(r(c) if c in _DOUBLES else c for c in CUSTOMER_COLUMNS if c != TARGET)
          + " FROM customers ORDER BY customer_id LIMIT 5")
def q_s6(spark, sf):
    return rounded(FS.template_preview(P.customers(spark, sf)))


# --- split, preprocessing fit tables and transformed matrix (L1, L2, I1-I9, I13) ----


SPLIT_SQL = O.with_(*O.BASE, O.split_cte())


@register("l1_stratified_split", SPLIT_SQL + "SELECT customer_id, churned, split FROM split")
def q_l1(spark, sf):
    return S.stratified_split(P.featured(spark, sf)).select(ID, TARGET, "split")


DOWNSAMPLE_ROWS = 100                     # below every table size, so rows are dropped


@register("l2_stratified_downsample", O.with_(O.CUSTOMERS) + f"""
SELECT customer_id, churned FROM (
  SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY
           md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id) AS place,
         count(*) OVER (PARTITION BY churned) AS m, count(*) OVER () AS n FROM customers)
WHERE place <= floor({DOWNSAMPLE_ROWS} * m / n + 0.5)""")
def q_l2(spark, sf):
    return S.stratified_downsample(P.customers(spark, sf), DOWNSAMPLE_ROWS).select(ID, TARGET)


_FITTED: dict = {}


def _fitted(spark, sf, profile="current"):
    """Fitted preprocessor and split customers, once per application, table and profile."""
    key = (spark.sparkContext.applicationId, sf, profile)
    if key not in _FITTED:
        split = written(S.stratified_split(P.featured(spark, sf, profile)), "split")
        _FITTED[key] = ChurnPreprocessor(profile=profile).fit(split.where(F.col("split") == "train")), split
    return _FITTED[key]


PREP_SQL = O.with_(*O.BASE, *O.prep_ctes())
LEGACY_SQL = O.with_(O.CUSTOMERS, O.CLEAN, O.features_cte(legacy=True), *O.prep_ctes(legacy=True))


@register("i1_imputer_fill", PREP_SQL + """
SELECT variable, strategy, round(fill, 6) AS fill, round(skew, 6) AS skew FROM fill_num""")
def q_i1(spark, sf):
    m, _ = _fitted(spark, sf)
    rows = [(c, p["strategy"], p["fill"], p["skew"]) for c, p in m.fitted["numeric"].items()]
    return rounded(spark.createDataFrame(rows, "variable string, strategy string, fill double, skew double"))


@register("i2_mode_fill", PREP_SQL + "SELECT variable, fill FROM fill_cat")
def q_i2(spark, sf):
    m, _ = _fitted(spark, sf)
    s = m.fitted
    rows = [(c, None if p["fill"] is None else str(p["fill"] if grp != "binary" else int(p["fill"])))
            for grp in ("binary", "nominal", "ordinal") for c, p in s[grp].items()]
    return spark.createDataFrame(rows, "variable string, fill string")


@register("i4_iqr_fences", PREP_SQL + "SELECT variable, round(lo, 6) AS lo, round(hi, 6) AS hi FROM fences")
def q_i4(spark, sf):
    m, _ = _fitted(spark, sf)
    rows = [(c, p["lo"], p["hi"]) for c, p in m.fitted["numeric"].items() if "lo" in p]
    return rounded(spark.createDataFrame(rows, "variable string, lo double, hi double"))


@register("i6_scaler_stats", PREP_SQL + "SELECT variable, round(center, 6) AS center, round(scale, 6) AS scale "
          "FROM scaler")
def q_i6(spark, sf):
    m, _ = _fitted(spark, sf)
    rows = [(c, p["center"], p["scale"]) for c, p in m.fitted["numeric"].items()]
    return rounded(spark.createDataFrame(rows, "variable string, center double, scale double"))


@register("i7_onehot_levels", PREP_SQL + "SELECT variable, CAST(position AS BIGINT) AS position, level FROM levels")
def q_i7(spark, sf):
    m, _ = _fitted(spark, sf)
    rows = [(c, i, lv) for c, p in m.fitted["nominal"].items() for i, lv in enumerate(p["levels"])]
    return spark.createDataFrame(rows, "variable string, position long, level string")


@register("i9_transformed_long", PREP_SQL + "SELECT customer_id, feature, round(value, 6) AS value FROM tx")
def q_i9(spark, sf):
    m, split = _fitted(spark, sf)
    return rounded(m.long_form(split))


@register("i13_legacy_scaler", LEGACY_SQL + """
SELECT f.variable, round(f.fill, 6) AS fill, round(s.center, 6) AS center, round(s.scale, 6) AS scale
FROM fill_num f JOIN scaler s USING (variable)""")
def q_i13(spark, sf):
    m, _ = _fitted(spark, sf, "legacy")
    rows = [(c, p["fill"], p["center"], p["scale"]) for c, p in m.fitted["numeric"].items()]
    return rounded(spark.createDataFrame(rows, "variable string, fill double, center double, scale double"))


@register("i13_legacy_transformed_long", LEGACY_SQL + "SELECT customer_id, feature, round(value, 6) AS value FROM tx")
def q_i13l(spark, sf):
    m, split = _fitted(spark, sf, "legacy")
    return rounded(m.long_form(split))


# --- evaluation of the rule scorer and the majority baseline (E1-E5, E4, E9, M1, M3a) ----

METRIC_COLUMNS = ["tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "balanced_accuracy",
                  "detection_rate_pct", "missed", "roc_auc"]


def _rule_split(spark, sf):
    split = S.stratified_split(P.featured(spark, sf))
    return RuleScorer().with_probability(split)


EVAL_SQL = O.with_(*O.BASE, O.split_cte(),
                   f"t AS (SELECT churned AS y, {O.score_sql()} AS p FROM split WHERE split = 'test')")


@register("e1_e5_rule_evaluation", EVAL_SQL + O.eval_sql("t"))
def q_e1(spark, sf):
    test = _rule_split(spark, sf).where(F.col("split") == "test")
    return rounded(E.evaluate(test).select(*METRIC_COLUMNS))


@register("e4_classification_report", EVAL_SQL + """,
cm AS (SELECT CAST(count(*) FILTER (WHERE y = 0 AND p < 0.5) AS DOUBLE) AS tn,
              CAST(count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS DOUBLE) AS fp,
              CAST(count(*) FILTER (WHERE y = 1 AND p < 0.5) AS DOUBLE) AS fn,
              CAST(count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS DOUBLE) AS tp FROM t),
per AS (
  SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall,
         coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1, tn + fp AS support FROM cm
  UNION ALL
  SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM cm),
allr AS (
  SELECT * FROM per
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM per
  UNION ALL SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn),
                   (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM cm)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(support, 6) AS support FROM allr""".replace(EVAL_SQL + ",", EVAL_SQL.rstrip() + ",", 1))
def q_e4(spark, sf):
    test = _rule_split(spark, sf).where(F.col("split") == "test")
    return rounded(E.classification_report(test))


@register("m1_class_weights", SPLIT_SQL + """
SELECT churned, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
FROM (SELECT churned, count(*) AS n_c FROM split WHERE split = 'train' GROUP BY churned)""")
def q_m1(spark, sf):
    train = S.stratified_split(P.featured(spark, sf)).where(F.col("split") == "train")
    return rounded(E.class_weights(train))


BASELINE_SQL = O.with_(*O.BASE, O.split_cte(), """
maj AS (SELECT churned AS c FROM split WHERE split = 'train' GROUP BY churned ORDER BY count(*) DESC, churned LIMIT 1)""",
                       "b AS (SELECT churned AS y, CAST((SELECT c FROM maj) AS DOUBLE) AS p FROM split WHERE split = 'test')")


def _baseline_frame(spark, sf):
    split = S.stratified_split(P.featured(spark, sf))
    major = E.majority_class(split.where(F.col("split") == "train"))
    return split.where(F.col("split") == "test").withColumn("probability", F.lit(float(major)))


@register("m3a_majority_baseline", BASELINE_SQL + O.eval_sql("b"))
def q_m3a(spark, sf):
    return rounded(E.evaluate(_baseline_frame(spark, sf)).select(*METRIC_COLUMNS))


@register("e9_leaderboard", O.with_(*O.BASE, O.split_cte(), """
maj AS (SELECT churned AS c FROM split WHERE split = 'train' GROUP BY churned ORDER BY count(*) DESC, churned LIMIT 1)""",
                                    "b AS (SELECT churned AS y, CAST((SELECT c FROM maj) AS DOUBLE) AS p FROM split "
                                    "WHERE split = 'test')",
                                    f"t AS (SELECT churned AS y, {O.score_sql()} AS p FROM split WHERE split = 'test')")
          + "SELECT * FROM (" + O.eval_sql("t", "rule_score") + "\nUNION ALL " + O.eval_sql("b", "majority_baseline")
          + ") ORDER BY roc_auc DESC, model LIMIT 5")
def q_e9(spark, sf):
    rule = _rule_split(spark, sf).where(F.col("split") == "test").withColumn("model", F.lit("rule_score"))
    base = _baseline_frame(spark, sf).withColumn("model", F.lit("majority_baseline"))
    both = rule.select("model", TARGET, "probability").unionByName(base.select("model", TARGET, "probability"))
    board = rounded(E.evaluate(both, groups=["model"]).select("model", *METRIC_COLUMNS))
    return E.leaderboard_top(board)


# --- ANOVA selection (I10, I11, E8) ---------------------------------------------------


ANOVA_SQL = O.with_(*O.BASE, *O.prep_ctes(), *O.anova_ctes())


def _anova_table(spark, sf):
    model, split = _fitted(spark, sf)
    train = split.where(F.col("split") == "train")
    scores = SEL.anova_f(train, model.feature_columns())
    return SEL.score_table(spark, scores, model.feature_names)


@register("i10_anova_scores", ANOVA_SQL + "SELECT feature, base_variable, round(f_score, 6) AS f_score, selected "
          "FROM anova")
def q_i10(spark, sf):
    return rounded(_anova_table(spark, sf).select("feature", "base_variable", "f_score", "selected"))


@register("i11_selected_features", ANOVA_SQL + "SELECT feature, base_variable, round(f_score, 6) AS f_score "
          "FROM anova WHERE selected")
def q_i11(spark, sf):
    return rounded(SEL.selected_features(_anova_table(spark, sf)))


@register("e8_variable_relevance", ANOVA_SQL + f""",
best AS (SELECT base_variable, max(f_score) AS score FROM anova WHERE selected GROUP BY base_variable
         ORDER BY score DESC, base_variable LIMIT 10)
SELECT base_variable, {O.label_sql('base_variable')} AS label,
       round_even(score / coalesce(nullif(max(score) OVER (), 0), 1) * 100, 1) AS relevance FROM best""".replace(
    ANOVA_SQL + ",", ANOVA_SQL.rstrip() + ",", 1))
def q_e8(spark, sf):
    return SEL.variable_relevance(_anova_table(spark, sf))


# --- what-if, presets, bounds and signals (W1-W4) --------------------------------------



def _qsql(c: str, q: float, source: str = "customers") -> str:
    return f"coalesce((SELECT quantile_cont({c}, {q}) FROM {source}), 0)"


@register("w2_clamp_bounds", O.with_(O.CUSTOMERS, "bounds AS (" + _bounds_sql("customers") + ")") + "SELECT customer_id, "
          + ", ".join(f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, "
                      f"(SELECT low FROM bounds WHERE variable = '{c}')), "
                      f"(SELECT high FROM bounds WHERE variable = '{c}')) END, 6) AS {c}" for c in BASE_NUMERIC)
          + " FROM customers")
def q_w2(spark, sf):
    df = P.customers(spark, sf)
    return rounded(W.clamp(df, W.bounds_of(df)).select(ID, *BASE_NUMERIC))


def _preset_sql() -> str:
    parts = []
    cats = ["gender", "country", "signup_quarter", "payment_method_diversity", "city"]
    for name, ov in PRESETS:
        ovd = dict(ov)
        cols = [f"round({_qsql(c, ovd[c])}, 6) AS {c}" if c in ovd else
                f"round(coalesce((SELECT quantile_cont({c}, 0.5) FROM customers), 0), 6) AS {c}" for c in BASE_NUMERIC]
        cols += [f"{_mode_sql(c, 'customers')} AS {c}" for c in cats]
        parts.append(f"SELECT '{name}' AS preset, " + ", ".join(cols))
    return "\nUNION ALL ".join(parts)


@register("w1_scenario_presets", O.with_(O.CUSTOMERS) + _preset_sql())
def q_w1(spark, sf):
    df = P.customers(spark, sf)
    return rounded(W.presets(df, reports.typical_customer(df)))


def _signals_sql() -> str:
    parts = []
    for name, c, op, q, crit, reading in SIGNALS:
        parts.append(f"SELECT customer_id, '{name}' AS signal, '{c}' AS variable, round({c}, 6) AS customer_value, "
                     f"'{crit}' AS criterion, '{reading}' AS reading FROM customers WHERE {c} {op} {_qsql(c, q)}")
    fired = "\nUNION ALL ".join(parts)
    none = (f"SELECT customer_id, '{NO_SIGNAL[0]}', '{NO_SIGNAL[1]}', CAST(NULL AS DOUBLE), '{NO_SIGNAL[2]}', "
            f"'{NO_SIGNAL[3]}' FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM fired)")
    return f"fired AS ({fired})\nSELECT * FROM fired UNION ALL {none}"


@register("w3_risk_signals", O.with_(O.CUSTOMERS, _signals_sql().split("\nSELECT * FROM fired")[0])
          + "SELECT * FROM fired UNION ALL " + _signals_sql().split("UNION ALL ")[-1])
def q_w3(spark, sf):
    df = P.customers(spark, sf)
    return rounded(W.risk_signals(df, df))


def _whatif_sql() -> str:
    scen = ", ".join(f"('{name}')" for name, _ in SCENARIOS)
    sim_cols = []
    for c in {c for _, ov in SCENARIOS for c, _ in ov}:
        whens = " ".join(f"WHEN '{name}' THEN {_qsql(c, q)}" for name, ov in SCENARIOS for cc, q in ov if cc == c)
        sim_cols.append(f"CASE scenario {whens} ELSE {c} END AS {c}")
    return (f"scen AS (SELECT * FROM (VALUES {scen}) v(scenario)),\n"
            f"sim AS (SELECT customers.* REPLACE ({', '.join(sim_cols)}), scenario,"
            f" {O.score_sql()} AS current FROM customers CROSS JOIN scen),\n"
            f"res AS (SELECT customer_id, scenario, current, {O.score_sql()} AS simulated FROM sim)")


@register("w4_what_if", O.with_(O.CUSTOMERS, _whatif_sql()) + """
SELECT customer_id, scenario, round(current, 6) AS current_probability, round(simulated, 6) AS simulated_probability,
       round(current - simulated, 6) + 0.0 AS reduction,
       CASE WHEN simulated < current THEN 'prioritise' ELSE 'monitor' END AS reading FROM res""")
def q_w4(spark, sf):
    df = P.customers(spark, sf)
    return W.what_if(df, df)


# --- permutation importance (E6, E7) ---------------------------------------------------



def _auc_sql(src: str, groups: str) -> str:
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    return (f"SELECT {g}sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM ("
            f" SELECT {g}pos, neg, coalesce(sum(neg) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING"
            f" AND 1 PRECEDING), 0) AS below FROM ("
            f"  SELECT {g}p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {src}"
            f"  GROUP BY {g}p)){' GROUP BY ' + groups if groups else ''}")


def _importance_sql() -> str:
    hk = "md5(CAST(customer_id AS VARCHAR) || ':42')"
    vals = ", ".join(f"('{c}')" for c in IMPORTANCE_COLUMNS)
    score_vals = {c: f"(CASE WHEN cp.variable = '{c}' THEN d.{c} ELSE cp.{c} END)" for c, _ in SCORE_WEIGHTS}
    return ",\n".join([
        f"smp AS (SELECT *, CAST('0x' || substr({hk}, 1, 8) AS BIGINT)"
        f" % CAST(greatest(1, ceil(count(*) OVER () / {IMP.ROWS_PER_BUCKET}.0)) AS BIGINT) AS bucket"
        " FROM split WHERE split = 'test')",
        f"grid AS (SELECT v.variable, r.range AS rep FROM (VALUES {vals}) v(variable) CROSS JOIN range(8) r)",
        "cp AS (SELECT smp.*, grid.variable, grid.rep, row_number() OVER (PARTITION BY grid.variable, grid.rep, bucket ORDER BY"
        " md5(CAST(customer_id AS VARCHAR) || ':' || grid.variable || ':' || CAST(grid.rep AS VARCHAR)), customer_id)"
        " AS b, count(*) OVER (PARTITION BY grid.variable, grid.rep, bucket) AS m FROM smp CROSS JOIN grid)",
        f"pm AS (SELECT cp.variable, cp.rep, cp.churned AS y, {O.score_sql(score_vals)} AS p"
        " FROM cp JOIN cp d ON d.variable = cp.variable AND d.rep = cp.rep AND d.bucket = cp.bucket"
        " AND d.b = CASE WHEN cp.b = cp.m THEN 1 ELSE cp.b + 1 END)",
        f"pa AS ({_auc_sql('pm', 'variable, rep')})",
        f"bs AS (SELECT churned AS y, {O.score_sql()} AS p FROM smp)",
        f"ba AS ({_auc_sql('bs', '')})",
        "imp AS (SELECT variable, avg(ba.auc - pa.auc) AS importance_mean, stddev_pop(ba.auc - pa.auc) AS importance_std"
        " FROM pa, ba GROUP BY variable)",
    ])


IMPORTANCE_SQL = O.with_(*O.BASE, O.split_cte(), _importance_sql())


def _importance(spark, sf):
    split = S.stratified_split(P.featured(spark, sf))
    test = split.where(F.col("split") == "test").drop("split")
    return IMP.permutation_importance(test, RuleScorer())


@register("e6_permutation_importance", IMPORTANCE_SQL + "SELECT variable, round(importance_mean, 6) + 0.0 AS "
          "importance_mean, round(importance_std, 6) + 0.0 AS importance_std FROM imp")
def q_e6(spark, sf):
    return rounded(_importance(spark, sf))


@register("e7_importance_top8", IMPORTANCE_SQL + f"""
SELECT variable, round(importance_mean, 6) + 0.0 AS importance_mean, round(importance_std, 6) + 0.0 AS importance_std,
       {O.label_sql('variable')} AS label
FROM imp ORDER BY importance_mean DESC, variable LIMIT 8""")
def q_e7(spark, sf):
    return rounded(IMP.top_importance(_importance(spark, sf)))


# --- trained models, persistence (M2-M6, S4, S5, E6 with a model) — rows-only checks ----



@register("m2_final_model_metrics")
def q_m2(spark, sf):
    return rounded(TR.final_metrics(TR.train_final(spark, sf)).select(*METRIC_COLUMNS))


@register("m4_model_comparison")
def q_m4(spark, sf):
    return rounded(TR.compare_models(spark, sf).select("model", "kind", "fit_rows", "test_rows", "selected", "comment",
                                                       *METRIC_COLUMNS))


@register("m5_model_probabilities")
def q_m5(spark, sf):
    t = TR.train_final(spark, sf)
    return rounded(predict_probabilities(PipelineScorer(t.model), P.customers(spark, sf)).select(ID, "probability"))


@register("m6_model_scoring")
def q_m6m(spark, sf):
    t = TR.train_final(spark, sf)
    out = prediction_output(PipelineScorer(t.model), P.customers(spark, sf))
    return rounded(out.select(ID, "probability", "risk_level", "decision", "action"))


@register("s4_model_roundtrip")
def q_s4(spark, sf):
    t = TR.train_final(spark, sf)
    path = shared_scratch(spark, "model")
    TR.save_model(t, path)
    again = PipelineScorer(TR.load_model(path)).with_probability(
        t.split.where(F.col("split") == "test").drop("split")).select(ID, F.col("probability").alias("reloaded"))
    return rounded(t.test_scored.select(ID, "probability").join(again, ID)
                   .withColumn("identical", F.col("probability") == F.col("reloaded")))


@register("s5_metadata_roundtrip")
def q_s5(spark, sf):
    parts = _metadata(spark, sf)
    return rounded(parts["metrics"].select(*METRIC_COLUMNS))


def _metadata(spark, sf):
    t = TR.train_final(spark, sf)
    folder = shared_scratch(spark, "metadata")
    TR.save_metadata(spark, t, folder)
    return TR.read_metadata(spark, folder)


@register("e6_model_importance")
def q_e6m(spark, sf):
    return rounded(TR.model_importance(TR.train_final(spark, sf)))


# --- segmentation (K1-K4, A9/A10 on clusters) -------------------------------------------


_SEG_CACHE: dict = {}


def _segmented(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key in _SEG_CACHE:
        return _SEG_CACHE[key]
    data = P.customers(spark, sf)
    prep = Pipeline(stages=[BusinessRules(), BusinessFeatures(), ChurnPreprocessor()]).fit(data.drop(TARGET))
    kept = {c: f"_in_{c}" for c in data.columns}          # the stages overwrite columns; carry the originals along
    vectors = prep.transform(data.withColumns({v: F.col(c) for c, v in kept.items()}))
    seg, clusters, explained = SEG.segment(vectors.select(*[F.col(v).alias(c) for c, v in kept.items()], "features"))
    out = (written(seg, "segments"), clusters, explained)
    _SEG_CACHE[key] = out
    return out


@register("k1_k2_segments")
def q_k1(spark, sf):
    seg, _, _ = _segmented(spark, sf)
    return rounded(seg.select(ID, "cluster", "pc1", "pc2", "pc3"))


@register("k3_explained_variance")
def q_k3(spark, sf):
    seg, clusters, explained = _segmented(spark, sf)
    two, three = SEG.explained_totals(explained)
    counts = seg.agg(F.countDistinct("cluster").alias("clusters"))
    return rounded(counts.select("clusters", F.lit(two).alias("variance_2d_pct"), F.lit(three).alias("variance_3d_pct"),
                                 F.lit(clusters.cost).alias("kmeans_cost")))


@register("a9_cluster_profile")
def q_a9c(spark, sf):
    seg, _, _ = _segmented(spark, sf)
    return SEG.segment_badges(reports.segment_profile(seg, "cluster"), "cluster")


@register("k4_segment_badges", O.with_(*O.BASE) + f"""
SELECT *, churn_rate >= avg(churn_rate) OVER () AS is_high_risk,
       row_number() OVER (ORDER BY churn_rate DESC, recency_segment) AS rank,
       CASE row_number() OVER (ORDER BY churn_rate DESC, recency_segment) WHEN 1 THEN 'highest_risk_segment'
            WHEN 2 THEN 'lowest_risk_segment' ELSE 'segment ' || recency_segment END AS badge
FROM (SELECT *, round(customers * 100.0::DOUBLE / sum(customers) OVER (), 6) AS pct_customers FROM (
  SELECT recency_segment, count(*) AS customers, round(avg(churned), 6) AS churn_rate, {_PROFILE_SQL}
  FROM featured GROUP BY recency_segment))""")
def q_k4(spark, sf):
    return SEG.segment_badges(reports.segment_profile(P.featured(spark, sf), "recency_segment"), "recency_segment")


# --- file sources and sinks (S1, S2, S3, P5 with Spanish headers) -------------------------



def _dirty_case(c: str) -> str:
    from ..constants import HEADER_ALIASES
    eng = {v[0]: k for k, v in HEADER_ALIASES.items()}
    for header, m, cell in UP.DIRT:
        if eng[header] == c:
            val = {"abc": "NULL", "NaN": "NULL", "": "NULL", "x": "0", " 5 ": "5.0", "1e3": "1000.0", "NA": "NULL"}[cell]
            return f"CASE WHEN customer_id % {m} = 0 THEN {val} ELSE {c} END"
    return c


@register("s1_csv_scan", O.with_(O.CUSTOMERS) + "SELECT " + ", ".join(
    f"round({_dirty_case(c)}, 6) AS {c}" if c in _DOUBLES else f"{_dirty_case(c)} AS {c}" for c in CUSTOMER_COLUMNS)
    + " FROM customers")
def q_s1(spark, sf):
    path = shared_scratch(spark, "csv-upload")
    dirty = UP.with_dirty_cells(FS.as_text(source_frame(spark, sf, "english")))
    # one folder, two headers: Spanish names in another order for every third customer
    third = F.col(ID).cast("long") % 3 == 0
    spanish = UP.with_dirty_cells(FS.as_text(source_frame(spark, sf, "english"))).where(third).toDF(
        *FS.as_text(source_frame(spark, sf, "spanish")).columns)
    dirty.where(~third).write.mode("overwrite").option("header", True).csv(path)
    spanish.select(*reversed(spanish.columns)).write.mode("append").option("header", True).csv(path)
    back = FS.read_customers(spark, path).withColumn(ID, F.col(ID).cast("long"))
    return rounded(back.select(*CUSTOMER_COLUMNS))


SHORT_EVERY, LONG_EVERY = 101, 37


@register("s2_batch_rejects", O.with_(O.CUSTOMERS) + f"""
SELECT count(*) FILTER (WHERE customer_id % {LONG_EVERY} <> 0 OR customer_id % {SHORT_EVERY} = 0) AS good_rows,
       count(*) FILTER (WHERE customer_id % {LONG_EVERY} = 0 AND customer_id % {SHORT_EVERY} <> 0) AS rejected_rows,
       count(*) FILTER (WHERE customer_id % {SHORT_EVERY} <> 0 AND customer_id % {LONG_EVERY} <> 0
                        AND country IS NOT NULL) AS quoted_rows,
       round(avg(lifetime_value) FILTER (WHERE customer_id % {SHORT_EVERY} <> 0 AND customer_id % {LONG_EVERY} <> 0), 6)
         AS good_mean_ltv
FROM customers""")
def q_s2(spark, sf):
    path = shared_scratch(spark, "batch-upload")
    text = FS.as_text(source_frame(spark, sf, "english"))
    UP.write_csv_lines(text, path, SHORT_EVERY, LONG_EVERY, quoted="Country")
    good, rejects = FS.read_batch(spark, path, columns=text.columns)
    quoted = F.col("country").startswith('"') & F.col("country").endswith('"') & (F.length("country") > 2)
    g = good.agg(F.count(F.lit(1)).alias("good_rows"), F.count_if(quoted).alias("quoted_rows"),
                 F.avg("lifetime_value").alias("good_mean_ltv"))
    return rounded(g.withColumn("rejected_rows", F.lit(rejects.count()).cast("long")))


@register("s3_scored_csv_sink", SCORED_SQL + "SELECT customer_id, round(probability, 6) AS probability, risk_level, "
          "decision, action FROM scored")
def q_s3(spark, sf):
    path = shared_scratch(spark, "scored-csv")
    FS.write_scored_csv(rounded(P.rule_scored(spark, sf)), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(F.col(ID).cast("long").alias(ID), F.col("probability").cast("double").alias("probability"),
                       "risk_level", "decision", "action")


SPANISH_PARTIAL = ["Edad", "Pais", "Total_Compras", "Valor_Vida_Util", "Fuga_Cliente"]


@register("p5_spanish_partial_scoring", O.with_(O.CUSTOMERS, """
part AS (SELECT customer_id, age, country, total_purchases, lifetime_value, churned FROM customers)""") + f"""
SELECT customer_id, round(age, 6) AS age, country, 'Unknown' AS gender, 'Q1' AS signup_quarter,
       'Unknown' AS payment_method_diversity, round({O.score_sql()}, 6) AS probability FROM (
  SELECT *, CAST(NULL AS DOUBLE) AS cart_abandonment_rate, CAST(NULL AS DOUBLE) AS days_since_last_purchase,
         CAST(NULL AS DOUBLE) AS customer_service_calls, CAST(NULL AS DOUBLE) AS returns_rate,
         CAST(NULL AS DOUBLE) AS email_open_rate, CAST(NULL AS DOUBLE) AS login_frequency,
         CAST(NULL AS DOUBLE) AS mobile_app_usage FROM part)""")
def q_p5(spark, sf):
    src = source_frame(spark, sf, "spanish").select(ID, *SPANISH_PARTIAL)
    from ..functions.schema import complete, normalize
    out = prediction_output(RuleScorer(), complete(normalize(src)))
    return rounded(out.select(ID, "age", "country", "gender", "signup_quarter", "payment_method_diversity",
                              "probability"))


# --- streaming scoring ----------------------------------------------------------------------



@register("m6_stream_scoring", SCORED_SQL + "SELECT customer_id, round(probability, 6) AS probability, risk_level, "
          "decision FROM scored")
def q_stream(spark, sf):
    src = shared_scratch(spark, "stream-in")
    text = FS.as_text(source_frame(spark, sf, "english"))
    text.write.mode("overwrite").option("header", True).csv(src)
    sink, ckpt = shared_scratch(spark, "stream-out"), shared_scratch(spark, "stream-ckpt")
    q = start_scoring_stream(spark, src, text.columns, sink, ckpt)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return rounded(out.select(F.col(ID).cast("long").alias(ID), "probability", "risk_level", "decision"))


@register("m6_upload_stream_scoring", SCORED_SQL + "SELECT customer_id, round(probability, 6) AS probability, risk_level, "
          "decision FROM scored")
def q_upload_stream(spark, sf):
    """A folder whose files have English or Spanish headers, in two column orders, scored as one stream."""
    src = shared_scratch(spark, "uploads-in")
    english, third = FS.as_text(source_frame(spark, sf, "english")), F.col(ID).cast("long") % 3 == 0
    spanish = FS.as_text(source_frame(spark, sf, "spanish")).where(third)
    english.where(~third).write.mode("overwrite").option("header", True).csv(src)
    spanish.select(*reversed(spanish.columns)).write.mode("append").option("header", True).csv(src)
    sink, ckpt = shared_scratch(spark, "uploads-out"), shared_scratch(spark, "uploads-ckpt")
    start_upload_stream(spark, src, sink, ckpt).awaitTermination()
    return rounded(spark.read.parquet(sink).select(F.col(ID).cast("long").alias(ID), "probability", "risk_level", "decision"))


# --- labels and lineage of transformed features (P9, P10), importance sample (L4), legacy profile (A9) ----



@register("p9_p10_feature_labels", PREP_SQL + f"""
SELECT feature, {O.label_sql('feature')} AS label, {O.origin_sql('feature', CATEGORICAL)} AS base_variable
FROM (SELECT DISTINCT feature FROM tx)""")
def q_p9(spark, sf):
    m, _ = _fitted(spark, sf)
    names = spark.createDataFrame([(n,) for n in m.feature_names], "feature string")
    return names.select("feature", pretty_label(F.col("feature")).alias("label"),
                        feature_origin(F.col("feature")).alias("base_variable"))


SAMPLE_ROWS = 25                          # below every test split


@register("l4_importance_sample", SPLIT_SQL + f"""
SELECT customer_id, churned FROM split WHERE split = 'test'
ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id LIMIT {SAMPLE_ROWS}""")
def q_l4(spark, sf):
    split = S.stratified_split(P.featured(spark, sf))
    return S.sample_rows(split.where(F.col("split") == "test"), SAMPLE_ROWS).select(ID, TARGET)


_LEGACY_PROFILE_SQL = ", ".join(f"round(avg({src}), 6) AS {name}" for name, src in reports.PROFILE_MEANS[:-1])


@register("a9_segment_profile_legacy", O.with_(O.CUSTOMERS, O.CLEAN, O.features_cte(legacy=True)) + f"""
SELECT *, round(customers * 100.0::DOUBLE / sum(customers) OVER (), 6) AS pct_customers FROM (
  SELECT purchase_segment, count(*) AS customers, round(avg(churned), 6) AS churn_rate, {_LEGACY_PROFILE_SQL}
  FROM featured GROUP BY purchase_segment)""")
def q_a9l(spark, sf):
    return reports.segment_profile(P.featured(spark, sf, "legacy"), "purchase_segment", with_app=False)


# --- decision-threshold sweep (M9) and what-if with the fitted model (W4) ------------------

THRESHOLDS = [round(0.10 + 0.01 * i, 2) for i in range(81)]      # the user range .10-.90, step .01


@register("m9_threshold_sweep", SCORED_SQL + """
SELECT CAST(t.threshold AS DOUBLE) AS threshold,
       count(*) FILTER (WHERE s.probability >= t.threshold) AS predicted_churn,
       count(*) FILTER (WHERE s.probability < t.threshold) AS predicted_active
FROM scored s CROSS JOIN (SELECT round(0.10 + 0.01 * range, 2) AS threshold FROM range(81)) t
GROUP BY t.threshold""")
def q_m9(spark, sf):
    return reports.threshold_sweep(P.rule_scored(spark, sf), THRESHOLDS)


@register("w4_model_what_if")
def q_w4m(spark, sf):
    t = TR.train_final(spark, sf)
    df = P.customers(spark, sf)
    return W.what_if_scored(df, df, PipelineScorer(t.model))


@register("m6_model_stream_scoring")
def q_stream_model(spark, sf):
    t = TR.train_final(spark, sf)
    src = shared_scratch(spark, "stream-model-in")
    text = FS.as_text(source_frame(spark, sf, "english"))
    text.write.mode("overwrite").option("header", True).csv(src)
    sink, ckpt = shared_scratch(spark, "stream-model-out"), shared_scratch(spark, "stream-model-ckpt")
    q = start_scoring_stream(spark, src, text.columns, sink, ckpt, scorer=PipelineScorer(t.model))
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return rounded(out.select(F.col(ID).cast("long").alias(ID), "probability", "risk_level", "decision"))


# --- exact checks of the learned-model and clustering queries -------------------------------
# Each returns invariants of the full output of the query it names, with a DuckDB twin.

CUSTOMER_COUNT = O.with_(O.CUSTOMERS) + "SELECT count(*) AS rows"


def _consistent(p: str = "probability"):
    """Rows whose probability, risk level, decision or action do not fit one another."""
    prob = F.col(p)
    return F.count_if(~prob.between(0, 1) | (F.col("risk_level") != risk_level(prob)) | (F.col("decision") != decision(prob, 0.5))
                      | (F.col("action") != risk_action(F.col("risk_level")))).alias("inconsistent")


@register("s4_model_roundtrip_check", SPLIT_SQL + "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches "
          "FROM split WHERE split = 'test'")
def q_s4_check(spark, sf):
    return q_s4(spark, sf).agg(F.count("*").alias("rows"), F.count_if(~F.col("identical")).alias("mismatches"))


@register("s5_metadata_check", SPLIT_SQL + f"""
SELECT count(*) AS dataset_rows, CAST({len(CUSTOMER_COLUMNS)} AS BIGINT) AS dataset_columns,
       count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'test') AS test_rows,
       '{TARGET}' AS target, 'hist_gradient_boosting' AS classifier, '150' AS iterations,
       CAST({len(IMPORTANCE_COLUMNS)} AS BIGINT) AS importance_rows, CAST(5 AS BIGINT) AS report_rows,
       count(*) FILTER (WHERE split = 'test') AS prediction_rows FROM split""")
def q_s5_check(spark, sf):
    parts = _metadata(spark, sf)
    sizes = {name: F.lit(parts[part].count()).cast("long") for name, part in (
        ("importance_rows", "importance"), ("report_rows", "report"), ("prediction_rows", "test_predictions"))}
    return parts["training"].select("dataset_rows", "dataset_columns", "train_rows", "test_rows", "target", "classifier",
                                    F.col("parameters.maxIter").alias("iterations")).withColumns(sizes)


@register("s4_s5_bundle_check", SPLIT_SQL + f"""
SELECT 'training' AS part, CAST(1 AS BIGINT) AS rows, true AS verified UNION ALL SELECT 'metrics', 1, true
UNION ALL SELECT 'report', 5, true UNION ALL SELECT 'importance', {len(IMPORTANCE_COLUMNS)}, true
UNION ALL SELECT 'test_predictions', count(*), true FROM split WHERE split = 'test'""")
def q_bundle(spark, sf):
    """A published version's parts, and whether what is stored has the manifest's rows and checksums."""
    t = TR.train_final(spark, sf)
    folder = shared_scratch(spark, "bundle")
    version = BU.publish(spark, t, folder, IMP.permutation_importance(P.customers(spark, sf), RuleScorer()))
    verified = BU.verify(spark, folder) == version
    return (BU.versions(spark, folder).select(F.explode("parts").alias("p")).where("p.part <> 'model'")
            .select("p.part", "p.rows", F.lit(verified).alias("verified")))


@register("m2_final_model_check", SPLIT_SQL + "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches, "
          "CAST(0 AS BIGINT) AS loss_rises FROM split WHERE split = 'test'")
def q_m2_check(spark, sf):
    """Test probabilities recomputed in SQL from the exported trees; the training loss falls with every tree."""
    t = TR.train_final(spark, sf)
    booster = t.model.stages[-1]
    vectors = PipelineModel(t.model.stages[:-1]).transform(t.split.where("split = 'test'").drop("split")).select(ID, "selected")
    both = booster.scored_by_rules(vectors).join(t.test_scored.select(ID, "probability"), ID, "full")
    train = booster.history()["train"]
    rises = sum(b > a + 1e-9 for a, b in zip(train, train[1:]))
    return both.agg(F.count("*").alias("rows"), F.count_if(
        F.coalesce(F.abs(F.col("probability") - F.col("rule_probability")) > 1e-6, F.lit(True))).alias("mismatches")).withColumn(
        "loss_rises", F.lit(rises).cast("long"))


_MODELS = ["majority_baseline", *[c for c, _ in CANDIDATES]]


@register("m4_model_comparison_check", SPLIT_SQL + f"""
SELECT m.model, c.*, CAST(0 AS BIGINT) AS differing, true AS ordered FROM (VALUES {", ".join(f"('{m}')" for m in _MODELS)}) m(model)
CROSS JOIN (SELECT count(*) FILTER (WHERE churned = 0) AS negatives, count(*) FILTER (WHERE churned = 1) AS positives
            FROM split WHERE split = 'test') c""")
def q_m4_check(spark, sf):
    """The board's cells, accuracy and AUC recomputed from the stored scores by another path (AUC: mean ranks)."""
    scored = TR.fit_candidates(spark, sf).scored
    hit = F.when(F.col("probability") >= 0.5, 1).otherwise(0)
    cells = scored.groupBy("model").agg(*[F.count_if((F.col(TARGET) == t) & (hit == p)).alias(f"c_{t}{p}") for t in (0, 1) for p in (0, 1)])
    ties = scored.groupBy("model", "probability").agg(F.count_if(F.col(TARGET) == 1).alias("up"), F.count_if(F.col(TARGET) == 0).alias("down"))
    below = Window.partitionBy("model").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    auc = (ties.withColumn("under", F.coalesce(F.sum("down").over(below), F.lit(0))).groupBy("model")
           .agg((F.sum(F.col("up") * (F.col("under") + F.col("down") / 2)) / F.sum("up") / F.sum("down")).alias("auc")))
    board = TR.compare_models(spark, sf)
    order = [(-r["roc_auc"], r["model"]) for r in board.select("roc_auc", "model").collect()]
    n = F.col("c_00") + F.col("c_01") + F.col("c_10") + F.col("c_11")
    same = [F.col("tn") == F.col("c_00"), F.col("fp") == F.col("c_01"), F.col("fn") == F.col("c_10"), F.col("tp") == F.col("c_11"),
            F.abs(F.col("roc_auc") - F.col("auc")) < 1e-6, F.abs(F.col("accuracy") - (F.col("c_00") + F.col("c_11")) / n) < 1e-6]
    return board.join(cells, "model").join(auc, "model").select(
        "model", (F.col("c_00") + F.col("c_01")).alias("negatives"), (F.col("c_10") + F.col("c_11")).alias("positives"),
        sum(F.when(F.coalesce(s, F.lit(False)), 0).otherwise(1) for s in same).cast("long").alias("differing"),
        F.lit(order == sorted(order)).alias("ordered"))


def _falls(losses, per_step: float = 1e-9) -> int:
    return sum(b > a + per_step for a, b in zip(losses, losses[1:]))


def _fit_flaws(name: str, c) -> int:
    """Faults of a fit: a gradient that is not near zero, a training loss that rises, a network that learned nothing."""
    model = c.models[name]
    if name == "logistic_regression":
        return int(logistic_gradient(model, c.train) > 1e-3)
    if name == "gradient_boosting":
        return _falls(model.evaluateEachIteration(c.train))
    if name == "mlp":
        losses = model.told()["losses"]
        return int(losses[-1] >= losses[0])
    return 0


def _candidate(name: str, kind: str):
    @register(f"{name}_check", SPLIT_SQL + "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS fit_flaws "
              "FROM split WHERE split = 'test'")
    def check(spark, sf):
        """Stored probabilities against those recomputed in SQL from the exported coefficients, nodes or weights."""
        c = TR.fit_candidates(spark, sf)
        ruled = checked_by_rules(kind, c.models[kind], c.test, shared_scratch(spark, "exported-trees")).select(ID, "rule_probability")
        both = ruled.join(c.scored.where(F.col("model") == kind).select(ID, "probability"), ID, "full")
        return both.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(
            F.abs(F.col("probability") - F.col("rule_probability")) > 1e-6, F.lit(True))).alias("mismatches")).withColumn(
            "fit_flaws", F.lit(_fit_flaws(kind, c)).cast("long"))

    @register(name)
    def full(spark, sf):
        board = TR.compare_models(spark, sf).where(F.col("model") == kind)
        return rounded(board.select("model", "kind", "fit_rows", "test_rows", *METRIC_COLUMNS))


for _name, _kind in (("m3b_logistic_regression", "logistic_regression"), ("m3c_random_forest", "random_forest"),
                     ("m3d_gradient_boosting", "gradient_boosting"), ("m3e_multilayer_perceptron", "mlp")):
    _candidate(_name, _kind)


@register("m5_probabilities_check", CUSTOMER_COUNT + ", CAST(0 AS BIGINT) AS mismatches FROM customers")
def q_m5_check(spark, sf):
    """Probabilities of all customers against the exported trees' rules on the preprocessed vectors."""
    t = TR.train_final(spark, sf)
    vectors = PipelineModel(t.model.stages[:-1]).transform(P.customers(spark, sf)).select(ID, "selected")
    both = t.model.stages[-1].scored_by_rules(vectors).join(q_m5(spark, sf), ID, "full")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(
        F.abs(F.col("probability") - F.col("rule_probability")) > 2e-6, F.lit(True))).alias("mismatches"))


@register("m6_model_scoring_check", CUSTOMER_COUNT + ", CAST(0 AS BIGINT) AS inconsistent FROM customers")
def q_m6m_check(spark, sf):
    t = TR.train_final(spark, sf)
    return prediction_output(PipelineScorer(t.model), P.customers(spark, sf)).agg(F.count("*").alias("rows"), _consistent())


@register("m6_model_stream_check", CUSTOMER_COUNT + ", CAST(0 AS BIGINT) AS differences FROM customers")
def q_stream_model_check(spark, sf):
    batch = q_m6m(spark, sf).select(ID, F.col("probability").alias("batch"))
    both = q_stream_model(spark, sf).join(batch, ID, "full")
    return both.agg(F.count("*").alias("rows"), F.count_if(
        F.coalesce(F.abs(F.col("probability") - F.col("batch")) > 1e-6, F.lit(True))).alias("differences"))


@register("w4_model_what_if_check", O.with_(O.CUSTOMERS) + f"SELECT count(*) * {len(SCENARIOS)} AS rows, "
          f"CAST(0 AS BIGINT) AS inconsistent, CAST({len(SCENARIOS)} AS BIGINT) AS scenarios FROM customers")
def q_w4m_check(spark, sf):
    gap = F.abs(F.col("current_probability") - F.col("simulated_probability") - F.col("reduction")) > 2e-6
    outside = ~F.col("current_probability").between(0, 1) | ~F.col("simulated_probability").between(0, 1)
    return q_w4m(spark, sf).agg(F.count("*").alias("rows"), F.count_if(gap | outside).alias("inconsistent"),
                                F.countDistinct("scenario").alias("scenarios"))


@register("e6_model_importance_check", f"SELECT CAST({len(IMPORTANCE_COLUMNS)} AS BIGINT) AS variables, "
          "CAST(0 AS BIGINT) AS outside, count(*) > 0 AS has_customers FROM customer")
def q_e6m_check(spark, sf):
    outside = ~F.col("importance_mean").between(-1, 1) | ~F.col("importance_std").between(0, 1)
    return q_e6m(spark, sf).agg(F.count("*").alias("variables"), F.count_if(outside).alias("outside"),
                                (F.count("*") > 0).alias("has_customers"))


@register("k1_k2_segments_check", CUSTOMER_COUNT + ", CAST(2 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS not_nearest, "
          "true AS centres_are_means, true AS least_cost, true AS centred, true AS uncorrelated, true AS ordered FROM customers")
def q_k1_check(spark, sf):
    """Every row is at its nearest centre, centres are the means of their rows, the cost is the least of all starts."""
    seg, clusters, _ = _segmented(spark, sf)
    pcs, d = ["pc1", "pc2", "pc3"], clusters.centres.shape[1]
    pairs = [("pc1", "pc2"), ("pc1", "pc3"), ("pc2", "pc3")]
    x = vector_to_array(F.col("features"))
    long = seg.select("cluster", F.posexplode(x).alias("i", "v"))
    centre = F.element_at(F.lit([float(v) for c in clusters.centres for v in c]), F.col("cluster").cast("int") * d + F.col("i") + 1)
    far = (long.withColumn("c", centre).groupBy("cluster", "i").agg(F.abs(F.avg("v") - F.first("c")).alias("far"))
           .agg(F.max("far")).first()[0])
    squares = [F.aggregate(F.zip_with(x, F.lit([float(v) for v in c]), lambda a, b: F.pow(a - b, F.lit(2))), F.lit(0.0), lambda a, b: a + b)
               for c in clusters.centres]
    own = F.when(F.col("cluster") == "0", squares[0]).otherwise(squares[1])
    return seg.agg(F.count("*").alias("rows"), F.countDistinct("cluster").alias("clusters"),
                   F.count_if(own > F.least(*squares) + 1e-9).alias("not_nearest"), F.sum(own).alias("cost"),
                   F.greatest(*[F.abs(F.avg(c)) for c in pcs]).alias("m"), F.greatest(*[F.abs(F.corr(a, b)) for a, b in pairs]).alias("c"),
                   *[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(pcs)]).select(
        "rows", "clusters", "not_nearest", F.lit(far < 1e-6).alias("centres_are_means"),
        ((F.abs(F.col("cost") / clusters.cost - 1) < 1e-9) & F.lit(clusters.cost <= min(clusters.costs) * (1 + SEG.TIED))
         & F.lit(len(clusters.costs) == SEG.STARTS)).alias("least_cost"),
        (F.col("m") < 1e-6).alias("centred"), (F.col("c") < 1e-6).alias("uncorrelated"),
        ((F.col("v0") >= F.col("v1")) & (F.col("v1") >= F.col("v2"))).alias("ordered"))


@register("k3_explained_variance_check", CUSTOMER_COUNT + ", CAST(2 AS BIGINT) AS clusters, true AS shares_of_variance FROM customers")
def q_k3_check(spark, sf):
    """The explained shares are the variances of the scores over the total variance of the vectors."""
    seg, _, _ = _segmented(spark, sf)
    total = (seg.select(F.posexplode(vector_to_array(F.col("features"))).alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("v"))
             .agg(F.sum("v")).first()[0])
    seen = seg.agg(F.count("*").alias("rows"), *(F.var_samp(c).alias(c) for c in ("pc1", "pc2", "pc3")))
    told = q_k3(spark, sf).first()
    share = {n: F.abs(sum(F.col(f"pc{i}") for i in range(1, n + 1)) / total * 100 - told[f"variance_{n}d_pct"]) < 1e-4 for n in (2, 3)}
    return seen.select("rows", F.lit(told["clusters"]).cast("long").alias("clusters"), (share[2] & share[3]).alias("shares_of_variance"))


@register("a9_cluster_profile_check", CUSTOMER_COUNT + ", CAST(2 AS BIGINT) AS clusters, round(avg(churned), 6) AS churn_rate "
          "FROM customers")
def q_a9c_check(spark, sf):
    out = q_a9c(spark, sf)
    return rounded(out.agg(F.sum("customers").alias("rows"), F.count("*").alias("clusters"),
                           (F.sum(F.col("churn_rate") * F.col("customers")) / F.sum("customers")).alias("churn_rate")))
