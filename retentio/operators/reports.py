"""Report aggregates behind the dashboards.

Every function takes a DataFrame (customer table or scored portfolio) and
returns a small result DataFrame.  Single global aggregates use map-side
partial aggregation; grouped reports group on low-cardinality keys; top-k
reports end in ``orderBy(...).limit(k)`` which Spark plans as
``TakeOrderedAndProject`` (per-partition top-k, no full sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    BASE_NUMERIC, HISTOGRAM_MAX_BINS, ID, RANKED_ROWS, RISK_LEVELS, SCATTER_SAMPLE_ROWS, TARGET,
    TOP_COUNTRIES, TOP_NULL_COLUMNS,
)
from ..functions.schema import decode_target, pretty_label
from . import stats

R = 6  # decimals kept in report outputs


def round6(c, digits: int = R):
    """Half-up decimal rounding through a 10-place decimal (no -0.0, engine-independent ties)."""
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def _r(c):
    return round6(c)


def round_doubles(df: DataFrame, digits: int = R) -> DataFrame:
    """Round double columns on the JVM through a decimal."""
    from pyspark.sql import types as T
    return df.select(*[round6(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def portfolio_kpis(scored: DataFrame) -> DataFrame:
    """A1 (+P13): customers, churn %, high/medium risk counts, mean probability %."""
    return scored.agg(
        F.count(F.lit(1)).alias("customers"),
        _r(F.avg(TARGET) * 100).alias("churn_pct"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk"),
        F.count_if(F.col("risk_level") == "medium").alias("medium_risk"),
        _r(F.avg("probability") * 100).alias("mean_probability_pct"),
    )


def dataset_kpis(df: DataFrame) -> DataFrame:
    """A2: rows, columns, churn %, total null cells."""
    nulls = None
    for c in df.columns:
        term = F.sum(F.col(c).isNull().cast("long"))
        nulls = term if nulls is None else nulls + term
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        _r(F.avg(TARGET) * 100).alias("churn_pct"),
        nulls.alias("null_cells"),
    )


def target_distribution(df: DataFrame) -> DataFrame:
    """A3 (+P11): customers per decoded target, unknown codes dropped."""
    status = decode_target(F.col(TARGET))
    return (df.where(status.isNotNull()).groupBy(status.alias("status"))
            .agg(F.count(F.lit(1)).alias("customers")))


def level_counts(scored: DataFrame, column: str = "risk_level", levels=tuple(reversed(RISK_LEVELS))) -> DataFrame:
    """A4: fixed level order, zero-filled, from one aggregate (no join)."""
    counts = scored.agg(*[F.count_if(F.col(column) == lv).alias(lv) for lv in levels])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(lv).alias(column), F.col(lv).alias("customers"))
        for i, lv in enumerate(levels)
    ])).alias("s")
    return counts.select(stacked).select("s.*")


def country_risk(scored: DataFrame, top: int = TOP_COUNTRIES) -> DataFrame:
    """A5: mean probability and customers per country, null keys dropped, top ``top``."""
    return (scored.where(F.col("country").isNotNull()).groupBy("country")
            .agg(_r(F.avg("probability")).alias("mean_probability"), F.count(F.lit(1)).alias("customers"))
            .orderBy(F.desc("mean_probability"), "country").limit(top))


def null_share(df: DataFrame, top: int = TOP_NULL_COLUMNS) -> DataFrame:
    """A6 (+P9): percentage of nulls per column, top ``top``, with display label."""
    cols = [c for c in df.columns]
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("null_pct")) for c in cols
    ])).alias("s")).select("s.*")
    return (long.withColumn("null_pct", _r(F.col("null_pct")))
            .orderBy(F.desc("null_pct"), "variable").limit(top)
            .withColumn("label", pretty_label(F.col("variable"))))


def batch_balance(scored: DataFrame) -> DataFrame:
    """Totals per risk level and decision shares (0 when empty)."""
    total = F.count(F.lit(1))
    share = lambda cond: F.coalesce(_r(F.count_if(cond) * 100.0 / F.nullif(total, F.lit(0))), F.lit(0.0))
    return scored.agg(
        total.alias("total"),
        F.count_if(F.col("risk_level") == "high").alias("high"),
        F.count_if(F.col("risk_level") == "medium").alias("medium"),
        F.count_if(F.col("risk_level") == "low").alias("low"),
        share(F.col("decision") == "active").alias("active_pct"),
        share(F.col("decision") == "churn").alias("churn_pct"),
    )


def campaign_advice(scored: DataFrame) -> DataFrame:
    """Advice lines conditioned on the risk counts."""
    counts = scored.agg(F.count_if(F.col("risk_level") == "high").alias("h"),
                        F.count_if(F.col("risk_level") == "medium").alias("m"))
    lines = F.array(
        F.when(F.col("h") > 0, F.struct(F.lit(1).alias("line"), F.format_string(
            "Prioritise immediate contact with the %d high-risk customers.", F.col("h")).alias("advice"))),
        F.when(F.col("m") > 0, F.struct(F.lit(2).alias("line"), F.format_string(
            "Launch preventive campaigns for the %d medium-risk customers.", F.col("m")).alias("advice"))),
        F.struct(F.lit(3).alias("line"),
                 F.lit("Download the CSV to plan retention actions per customer.").alias("advice")),
    )
    return counts.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("a")).select("a.*")


PROFILE_MEANS = [
    ("mean_purchases", "total_purchases"),
    ("mean_lifetime_value", "lifetime_value"),
    ("mean_cart_abandonment", "cart_abandonment_rate"),
    ("mean_email_open", "email_open_rate"),
    ("mean_service_calls", "customer_service_calls"),
    ("mean_app_usage", "mobile_app_usage"),
]


def segment_profile(df: DataFrame, segment: str, with_app: bool = True) -> DataFrame:
    """Size, churn rate, behaviour means and share of customers per segment."""
    means = PROFILE_MEANS if with_app else PROFILE_MEANS[:-1]
    prof = df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"),
        _r(F.avg(TARGET)).alias("churn_rate"),
        *[_r(F.avg(src)).alias(name) for name, src in means],
    )
    # the total is a window over the (few) segment rows, not over customers
    total = F.sum("customers").over(Window.partitionBy(F.lit(1)))
    return prof.withColumn("pct_customers", _r(F.col("customers") * 100.0 / total))


def segment_count(df: DataFrame, segment: str) -> DataFrame:
    """A10: number of distinct segments."""
    return df.agg(F.countDistinct(segment).alias("segments"))


def numeric_bounds(df: DataFrame, columns=None, method: str = "exact") -> DataFrame:
    """p1, p99 and median per column; empty → (0, 1, 0); flat → high = low + 1."""
    columns = columns or [c for c in BASE_NUMERIC if c in df.columns]
    q = stats.quantiles(df, columns, [0.01, 0.5, 0.99], method=method)
    rows = []
    for c in columns:
        lo, med, hi = q[(c, 0.01)], q[(c, 0.5)], q[(c, 0.99)]
        if lo is None:
            lo, hi, med = 0.0, 1.0, 0.0
        elif lo == hi:
            hi = lo + 1.0
        rows.append((c, float(lo), float(hi), float(med)))
    return round_doubles(df.sparkSession.createDataFrame(
        rows, "variable string, low double, high double, default double"))


def quantile_values(df: DataFrame, columns, probs, method: str = "exact") -> DataFrame:
    """Arbitrary quantiles per column, 0 when a column has no values."""
    q = stats.quantiles(df, columns, probs, method=method)
    rows = [(c, float(p), float(q[(c, p)]) if q[(c, p)] is not None else 0.0) for c in columns for p in probs]
    return round_doubles(df.sparkSession.createDataFrame(rows, "variable string, q double, value double"))


def safe_modes(df: DataFrame, columns) -> DataFrame:
    """Most frequent value, ties → smallest, none → ''."""
    m = stats.modes(df, columns)
    return df.sparkSession.createDataFrame([(c, m[c] if m[c] is not None else "") for c in columns],
                                           "variable string, mode string")


def sorted_options(df: DataFrame, columns) -> DataFrame:
    """Distinct non-null options per column with their sorted position."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("option")) for c in columns
    ])).alias("p")
    opts = df.select(pairs).select("p.*").where(F.col("option").isNotNull()).distinct()
    w = Window.partitionBy("variable").orderBy("option")
    return opts.withColumn("position", F.row_number().over(w).cast("long"))


def typical_customer(df: DataFrame, method: str = "exact") -> DataFrame:
    """Medians of the numerics and modes of the categoricals as one row."""
    nums = [c for c in BASE_NUMERIC if c in df.columns]
    cats = [c for c in ["gender", "country", "signup_quarter", "payment_method_diversity", "city"]
            if c in df.columns]
    med = stats.quantiles(df, nums, [0.5], method=method)
    counts = stats.column_counts(df, nums)
    mod = stats.modes(df, cats)
    fields = []
    values = []
    for c in nums:
        v = med[(c, 0.5)]
        fields.append(f"{c} double")
        values.append(0.0 if counts[c][0] == 0 else float(v))
    for c in cats:
        fields.append(f"{c} string")
        values.append(mod[c] if mod[c] is not None else "")
    return round_doubles(df.sparkSession.createDataFrame([tuple(values)], ", ".join(fields)))


def class_histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_MAX_BINS) -> DataFrame:
    """Equal-width histogram by class over the column's [min, max]."""
    v = F.col(column)
    rng = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx")).first()
    if rng["mn"] is None:
        return df.sparkSession.createDataFrame([], "status string, bin int, bin_start double, customers long")
    mn, mx = float(rng["mn"]), float(rng["mx"])
    width = (mx - mn) / bins if mx > mn else 1.0
    b = F.least(F.floor((v - F.lit(mn)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    status = decode_target(F.col(TARGET))
    return (df.where(v.isNotNull() & status.isNotNull())
            .groupBy(status.alias("status"), b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("customers"))
            .withColumn("bin_start", _r(F.lit(mn) + F.col("bin") * F.lit(width))))


def class_box(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    """Box summary per class (quartiles, whiskers at the extreme values inside 1.5·IQR)."""
    spark = df.sparkSession
    status = decode_target(F.col(TARGET))
    wide = df.select(*[F.when(status == s, F.col(column)).alias(s) for s in ("active", "churn")])
    q = stats.quantiles(wide, ["active", "churn"], [0.25, 0.5, 0.75], method=method)
    fences = []
    for s in ("active", "churn"):
        q1, q3 = q[(s, 0.25)], q[(s, 0.75)]
        if q1 is None:
            continue
        iqr = q3 - q1
        fences.append((s, q1 - 1.5 * iqr, q3 + 1.5 * iqr))
    aggs = []
    for s, lo, hi in fences:
        x = F.col(s)
        aggs += [F.min(F.when(x >= lo, x)), F.max(F.when(x <= hi, x))]
    row = wide.agg(*aggs).first() if aggs else []
    out = []
    for i, (s, lo, hi) in enumerate(fences):
        out.append((s, q[(s, 0.25)], q[(s, 0.5)], q[(s, 0.75)], row[2 * i], row[2 * i + 1]))
    return round_doubles(spark.createDataFrame(out, "status string, q1 double, median double, q3 double, "
                                                    "lower_whisker double, upper_whisker double"))


def scatter_extract(scored: DataFrame, x: str, y: str, color: str, hover: list[str],
                    n: int | None = SCATTER_SAMPLE_ROWS) -> DataFrame:
    """Projection of the chosen chart columns, of a sample or (``n`` = None) of all rows."""
    from .sampling import sample_rows
    return (scored if n is None else sample_rows(scored, n)).select(ID, x, y, color, *hover)


PRIORITY = ["probability", "risk_level", "decision"]


def priority_columns(scored: DataFrame) -> DataFrame:
    """Priority columns first, action hidden."""
    rest = [c for c in scored.columns if c not in PRIORITY and c != "action"]
    return scored.select(*PRIORITY, *rest)


def ranked(scored: DataFrame, n: int = RANKED_ROWS) -> DataFrame:
    """Highest probabilities first, first ``n`` rows (key breaks ties)."""
    return priority_columns(scored).orderBy(F.desc("probability"), ID).limit(n)


def threshold_sweep(scored: DataFrame, thresholds: list[float], score: str = "probability") -> DataFrame:
    """M9 over a threshold list: predicted churn / active counts per threshold.

    Each row gets the exact number of thresholds ≤ its score (a guess from ``floor(p·100)`` for the
    0.01-spaced list, corrected by one comparison each way), rows are counted per that number (≤ len+1
    groups), and the per-threshold counts are suffix sums of those few counts — constant work per row.
    """
    ts = sorted(thresholds)
    arr = F.array(*[F.lit(float(t)) for t in ts])
    n = len(ts)
    p = F.col(score)
    lo = ts[0]
    step = (ts[-1] - ts[0]) / (n - 1) if n > 1 else 1.0
    g0 = F.least(F.greatest(F.floor((p - F.lit(lo)) / F.lit(step)) + 1, F.lit(0)), F.lit(n)).cast("int")
    g1 = F.when((g0 < n) & (F.element_at(arr, g0 + 1) <= p), g0 + 1).otherwise(g0)
    g2 = F.when((g1 > 0) & (F.element_at(arr, F.greatest(g1, F.lit(1))) > p), g1 - 1).otherwise(g1)
    counts = {r["g"]: r["n"] for r in scored.where(p.isNotNull()).groupBy(g2.alias("g"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}          # ≤ len(thresholds) + 1 rows
    total = sum(counts.values())
    rows, above = [], total
    for i, t in enumerate(ts):
        above -= counts.get(i, 0)              # rows with fewer than i+1 thresholds ≤ p are below t_i
        rows.append((float(t), above, total - above))
    return scored.sparkSession.createDataFrame(rows, "threshold double, predicted_churn long, predicted_active long")
