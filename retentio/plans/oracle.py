"""DuckDB twins of the Spark plans (the correctness oracle).

Each registered query gets an independent SQL formulation over the raw
views ``customer nation region orders lineitem events``.  The building blocks
below are CTE strings that are chained with ``with_(...)``.
"""

from __future__ import annotations

from ..constants import (
    AGE_RANGE, CURRENT_BINS, LEGACY_BINS, LEGACY_INCLUDE_LOWEST, NON_NEGATIVE_COLUMNS,
    RATE_COLUMNS, RISK_ACTIONS, RISK_HIGH_AT, RISK_MEDIUM_AT, SCORE_OFFSET, SCORE_WEIGHTS,
)

CUSTOMERS = """
cut AS (SELECT max(o_orderdate) - INTERVAL 180 DAY AS t FROM orders),
ob AS (SELECT o.* FROM orders o, cut WHERE o.o_orderdate <= cut.t),
oa AS (SELECT DISTINCT o_custkey AS a_custkey FROM orders o, cut WHERE o.o_orderdate > cut.t),
oagg AS (
  SELECT o_custkey AS k, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
         count(*) AS n_orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS spend_cents,
         count(DISTINCT o_orderpriority) AS n_priorities
  FROM ob GROUP BY o_custkey),
lagg AS (
  SELECT ob.o_custkey AS lk,
         avg(CAST(l.l_discount > 0.05 AS INTEGER)) AS discount_share,
         avg(CAST(l.l_returnflag = 'R' AS INTEGER)) AS return_share,
         count(*) FILTER (WHERE l.l_quantity > 45) AS big_lines
  FROM lineitem l JOIN ob ON l.l_orderkey = ob.o_orderkey GROUP BY ob.o_custkey),
eagg AS (
  SELECT user_id AS ek, count(*) AS n_events,
         avg(CASE WHEN event_type IN ('view','click') THEN value END) AS session_avg,
         count(*) FILTER (WHERE event_type = 'view') AS views,
         count(*) FILTER (WHERE event_type = 'click') AS clicks,
         count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
         count(*) FILTER (WHERE event_type = 'error') AS errors,
         max(value) AS max_value,
         count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 50) AS app_events,
         count(DISTINCT CAST(ts AS DATE)) AS active_days
  FROM events GROUP BY user_id),
customers AS (
  SELECT c.c_custkey AS customer_id,
    CAST(16 + (c.c_custkey * 37) % 90 AS DOUBLE) AS age,
    CASE WHEN c.c_custkey % 25 = 0 THEN 'Other' WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    n.n_name AS country, r.r_name AS city,
    CAST(floor(date_diff('day', CAST(oagg.first_order AS DATE), CAST(cut.t AS DATE)) / 365.0) AS DOUBLE) AS membership_years,
    CAST(eagg.n_events AS DOUBLE) AS login_frequency,
    eagg.session_avg AS session_duration_avg,
    CAST(eagg.views AS DOUBLE) / eagg.active_days AS pages_per_session,
    100.0::DOUBLE * (eagg.clicks - eagg.purchases) / nullif(eagg.clicks, 0) AS cart_abandonment_rate,
    CAST(eagg.clicks AS DOUBLE) AS wishlist_items,
    CAST(coalesce(oagg.n_orders, 0) AS DOUBLE) AS total_purchases,
    CAST(oagg.spend_cents AS DOUBLE) / oagg.n_orders / 100000.0 AS average_order_value,
    CAST(date_diff('day', CAST(oagg.last_order AS DATE), CAST(cut.t AS DATE)) AS DOUBLE) AS days_since_last_purchase,
    100.0::DOUBLE * lagg.discount_share AS discount_usage_rate,
    100.0::DOUBLE * lagg.return_share AS returns_rate,
    100.0::DOUBLE * eagg.views / eagg.n_events AS email_open_rate,
    CAST(eagg.errors AS DOUBLE) AS customer_service_calls,
    CAST(lagg.big_lines AS DOUBLE) AS product_reviews_written,
    eagg.max_value / 4 AS social_engagement_score,
    CAST(eagg.app_events AS DOUBLE) AS mobile_app_usage,
    CASE WHEN oagg.n_priorities <= 3 THEN 'Low' WHEN oagg.n_priorities = 4 THEN 'Medium'
         WHEN oagg.n_priorities >= 5 THEN 'High' END AS payment_method_diversity,
    CAST(oagg.spend_cents AS DOUBLE) / 100000.0 AS lifetime_value,
    c.c_acctbal AS credit_balance,
    'Q' || CAST(quarter(oagg.first_order) AS VARCHAR) AS signup_quarter,
    CAST(CASE WHEN oa.a_custkey IS NULL THEN 1 ELSE 0 END AS INTEGER) AS churned
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  CROSS JOIN cut
  LEFT JOIN oagg ON c.c_custkey = oagg.k
  LEFT JOIN lagg ON c.c_custkey = lagg.lk
  LEFT JOIN eagg ON c.c_custkey = eagg.ek
  LEFT JOIN oa ON c.c_custkey = oa.a_custkey)
"""


def _rule_exprs() -> list[str]:
    lo, hi = AGE_RANGE
    out = [f"CASE WHEN age >= {lo} AND age <= {hi} THEN age END AS age"]
    for c in RATE_COLUMNS:
        out.append(f"CASE WHEN {c} >= 0 AND {c} <= 100 THEN {c} END AS {c}")
    for c in NON_NEGATIVE_COLUMNS:
        out.append(f"CASE WHEN {c} >= 0 THEN {c} END AS {c}")
    return out


_RULED = ["age"] + RATE_COLUMNS + NON_NEGATIVE_COLUMNS

CLEAN = (
    "clean AS (SELECT * REPLACE ("
    + ", ".join(_rule_exprs())
    + ") FROM customers)"
)


def _bin_sql(source: str, edges, labels, include_lowest: bool) -> str:
    parts = []
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        conds = []
        if lo is not None:
            op = ">=" if (include_lowest and i == 0) else ">"
            conds.append(f"{source} {op} {lo}")
        if hi is not None:
            conds.append(f"{source} <= {hi}")
        if not conds:
            conds.append(f"{source} IS NOT NULL")
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def features_cte(name: str = "featured", source: str = "clean", legacy: bool = False) -> str:
    bins = LEGACY_BINS if legacy else CURRENT_BINS
    cols = [
        "CAST(coalesce(mobile_app_usage > 0, false) AS INTEGER) AS uses_app",
        "CAST(coalesce(credit_balance > 0, false) AS INTEGER) AS has_credit",
    ]
    for out, (src, edges, labels) in bins.items():
        lowest = legacy and out in LEGACY_INCLUDE_LOWEST
        cols.append(f"{_bin_sql(src, edges, labels, lowest)} AS {out}")
    return f"{name} AS (SELECT *, {', '.join(cols)} FROM {source})"


FEATURED = features_cte()


def rule_case(c: str) -> str:
    """The validity rule of column ``c`` as an inline expression (identity when none)."""
    lo, hi = AGE_RANGE
    if c == "age":
        return f"(CASE WHEN age >= {lo} AND age <= {hi} THEN age END)"
    if c in RATE_COLUMNS:
        return f"(CASE WHEN {c} >= 0 AND {c} <= 100 THEN {c} END)"
    if c in NON_NEGATIVE_COLUMNS:
        return f"(CASE WHEN {c} >= 0 THEN {c} END)"
    return c


def score_sql(values: dict | None = None, cleaned: bool = True) -> str:
    """F8 over columns (rule-cleaned inline when ``cleaned``); ``values`` overrides columns."""
    values = values or {}
    def val(c):
        return values.get(c, rule_case(c) if cleaned else c)
    terms = " + ".join(f"CAST({w!r} AS DOUBLE) * coalesce({val(c)}, 0)" for c, w in SCORE_WEIGHTS)
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-(({terms}) - CAST({SCORE_OFFSET} AS DOUBLE))))"


def risk_sql(p: str) -> str:
    return (f"CASE WHEN {p} >= {RISK_HIGH_AT} THEN 'high' WHEN {p} >= {RISK_MEDIUM_AT} "
            f"THEN 'medium' WHEN {p} IS NOT NULL THEN 'low' END")


def action_sql(level: str) -> str:
    whens = " ".join(f"WHEN {level} = '{k}' THEN '{v}'" for k, v in RISK_ACTIONS.items())
    return f"CASE {whens} END"


def scored_cte(threshold: float = 0.5, source: str = "customers") -> str:
    return (
        f"scored0 AS (SELECT *, {score_sql()} AS probability FROM {source}),\n"
        f"scored AS (SELECT *, {risk_sql('probability')} AS risk_level,"
        f" CASE WHEN probability >= {threshold} THEN 'churn' ELSE 'active' END AS decision,"
        f" {action_sql(risk_sql('probability'))} AS action FROM scored0)"
    )


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


BASE = (CUSTOMERS, CLEAN, FEATURED)


def label_sql(x: str) -> str:
    """P9 twin: display label of a (possibly group-prefixed) variable name."""
    from ..constants import VARIABLE_LABELS
    clean = f"(CASE WHEN instr({x}, '__') > 0 THEN substr({x}, instr({x}, '__') + 2) ELSE {x} END)"
    whens = [f"WHEN {x} IS NULL THEN ''"]
    whens += [f"WHEN {clean} = '{k}' THEN '{v}'" for k, v in VARIABLE_LABELS.items()]
    for base in sorted(VARIABLE_LABELS, key=len, reverse=True):
        whens.append(f"WHEN starts_with({clean}, '{base}_') THEN '{VARIABLE_LABELS[base]}: ' || "
                     f"replace(substr({clean}, {len(base) + 2}), '_', ' ')")
    return "CASE " + " ".join(whens) + f" ELSE replace({clean}, '_', ' ') END"


def origin_sql(x: str, categorical: list[str]) -> str:
    """P10 twin: base variable of a transformed feature name."""
    from ..constants import PREDICTION_COLUMNS
    clean = f"(CASE WHEN instr({x}, '__') > 0 THEN substr({x}, instr({x}, '__') + 2) ELSE {x} END)"
    inlist = ", ".join(f"'{c}'" for c in PREDICTION_COLUMNS)
    whens = [f"WHEN {clean} IN ({inlist}) THEN {clean}"]
    whens += [f"WHEN starts_with({clean}, '{c}_') THEN '{c}'" for c in sorted(categorical, key=len, reverse=True)]
    return "CASE " + " ".join(whens) + f" ELSE {clean} END"


def unpivot_sql(source: str, columns: list[str], value_expr: str = "{c}", name: str = "variable",
                value: str = "value", where: str | None = None) -> str:
    parts = []
    for c in columns:
        w = f" WHERE {where.format(c=c)}" if where else ""
        parts.append(f"SELECT '{c}' AS {name}, {value_expr.format(c=c)} AS {value} FROM {source}{w}")
    return "\nUNION ALL ".join(parts)


# --- split, preprocessing fit and transform (long form) ------------------------

def split_cte(source: str = "featured", name: str = "split", train_share: float = 0.8) -> str:
    return (f"{name} AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY churned ORDER BY "
            f"md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id) <= "
            f"floor({train_share} * count(*) OVER (PARTITION BY churned) + 0.5) "
            f"THEN 'train' ELSE 'test' END AS split FROM {source})")


def _long(source: str, cols: list[str], cast: str = "DOUBLE", key: bool = True) -> str:
    k = "customer_id, " if key else ""
    return "\nUNION ALL ".join(f"SELECT {k}'{c}' AS variable, CAST({c} AS {cast}) AS x FROM {source}"
                               for c in cols)


def prep_ctes(legacy: bool = False) -> list[str]:
    """Fit (on split='train') and transform (all rows) of the preprocessor, in long form.

    Produces CTEs ``fill_num`` (variable, n, mean, skew, median, fill, strategy),
    ``fences`` (variable, lo, hi), ``scaler`` (variable, center, scale), ``fill_cat``
    (variable, fill), ``levels`` (variable, position, level) and ``tx`` (customer_id, feature, value).
    """
    from ..constants import (BINARY_COLUMNS, CAP_COLUMNS, CATEGORICAL, LOG_COLUMNS, NOMINAL_COLUMNS,
                             NUMERIC, ORDINAL_COLUMNS, ORDINAL_LEVELS)
    ctes = [split_cte(), "tr AS (SELECT * FROM split WHERE split = 'train')"]
    if legacy:
        num, cat, nominal = NUMERIC, CATEGORICAL, CATEGORICAL
        ctes += [
            f"trn AS ({_long('tr', num)})",
            "fill_num AS (SELECT variable, count(x) AS n, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS skew,"
            " quantile_cont(x, 0.5) AS median, coalesce(quantile_cont(x, 0.5), 0) AS fill, 'median' AS strategy"
            " FROM trn GROUP BY variable)",
            "imp AS (SELECT t.variable, coalesce(t.x, f.fill) AS x FROM trn t JOIN fill_num f USING (variable))",
            "scaler AS (SELECT variable, coalesce(quantile_cont(x, 0.5), 0) AS center,"
            " CASE WHEN quantile_cont(x, 0.5) IS NULL THEN 1"
            " WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) = 0 THEN 1"
            " ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END AS scale FROM imp GROUP BY variable)",
            "fences AS (SELECT CAST(NULL AS VARCHAR) AS variable, CAST(NULL AS DOUBLE) AS lo,"
            " CAST(NULL AS DOUBLE) AS hi WHERE false)",
        ]
        num_groups = {c: "num" for c in num}
        cat_prefix = "cat"
    else:
        num = LOG_COLUMNS + CAP_COLUMNS
        cat, nominal = BINARY_COLUMNS + NOMINAL_COLUMNS + ORDINAL_COLUMNS, NOMINAL_COLUMNS
        logs = ", ".join(f"'{c}'" for c in LOG_COLUMNS)
        ctes += [
            f"trn AS ({_long('tr', num)})",
            "fill_num AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN skew IS NOT NULL AND NOT isnan(skew)"
            " AND abs(skew) > 0.5 THEN median ELSE mean END AS fill,"
            " CASE WHEN n = 0 THEN 'zero' WHEN skew IS NOT NULL AND NOT isnan(skew) AND abs(skew) > 0.5"
            " THEN 'median' ELSE 'mean' END AS strategy FROM ("
            " SELECT variable, count(x) AS n, avg(x) AS mean,"
            " CASE WHEN count(x) >= 3 THEN skewness(x) END AS skew, quantile_cont(x, 0.5) AS median"
            " FROM trn GROUP BY variable))",
            f"imp AS (SELECT t.variable, CASE WHEN t.variable IN ({logs}) THEN ln(1 + greatest(coalesce(t.x, f.fill), 0))"
            " ELSE coalesce(t.x, f.fill) END AS x FROM trn t JOIN fill_num f USING (variable))",
            f"fences AS (SELECT variable, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ("
            f" SELECT variable, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM imp"
            f" WHERE variable NOT IN ({logs}) GROUP BY variable))",
            "capped AS (SELECT i.variable, CASE WHEN f.variable IS NULL THEN i.x ELSE least(greatest(i.x, f.lo), f.hi)"
            " END AS x FROM imp i LEFT JOIN fences f USING (variable))",
            "scaler AS (SELECT variable, coalesce(quantile_cont(x, 0.5), 0) AS center,"
            " CASE WHEN quantile_cont(x, 0.5) IS NULL THEN 1"
            " WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) = 0 THEN 1"
            " ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END AS scale FROM capped GROUP BY variable)",
        ]
        num_groups = {**{c: "num_log" for c in LOG_COLUMNS}, **{c: "num_cap" for c in CAP_COLUMNS}}
        cat_prefix = "cat_nom"
    ctes += [
        f"trc AS ({_long('tr', cat, 'VARCHAR')})",
        "fill_cat AS (SELECT variable, (SELECT t2.x FROM trc t2 WHERE t2.variable = v.variable AND t2.x IS NOT NULL"
        " GROUP BY t2.x ORDER BY count(*) DESC, t2.x LIMIT 1) AS fill FROM (SELECT DISTINCT variable FROM trc) v)",
        "levels AS (SELECT variable, row_number() OVER (PARTITION BY variable ORDER BY x) - 1 AS position, x AS level"
        " FROM (SELECT DISTINCT variable, x FROM trc WHERE x IS NOT NULL AND variable IN ("
        + ", ".join(f"'{c}'" for c in nominal) + ")))",
    ]
    group_case = "CASE " + " ".join(f"WHEN variable = '{c}' THEN '{g}'" for c, g in num_groups.items()) + " END"
    allnum = _long("split", list(num_groups))
    tx_num = ("SELECT a.customer_id, " + group_case.replace("variable", "a.variable") + " || '__' || a.variable AS feature,"
              " (CASE WHEN a.variable IN (" + ", ".join(f"'{c}'" for c, g in num_groups.items() if g == 'num_log')
              + ") THEN ln(1 + greatest(coalesce(a.x, f.fill), 0))"
              " WHEN fe.variable IS NOT NULL THEN least(greatest(coalesce(a.x, f.fill), fe.lo), fe.hi)"
              " ELSE coalesce(a.x, f.fill) END - s.center) / s.scale AS value"
              f" FROM ({allnum}) a JOIN fill_num f USING (variable) JOIN scaler s USING (variable)"
              " LEFT JOIN fences fe USING (variable)") if "num_log" in num_groups.values() else (
              f"SELECT a.customer_id, 'num__' || a.variable AS feature, (coalesce(a.x, f.fill) - s.center) / s.scale AS value"
              f" FROM ({allnum}) a JOIN fill_num f USING (variable) JOIN scaler s USING (variable)")
    allcat = _long("split", nominal, "VARCHAR")
    tx_nom = (f"SELECT a.customer_id, '{cat_prefix}__' || a.variable || '_' || l.level AS feature,"
              " CASE WHEN coalesce(a.x, fc.fill) = l.level THEN 1.0 ELSE 0.0 END AS value"
              f" FROM ({allcat}) a JOIN levels l USING (variable) JOIN fill_cat fc USING (variable)")
    parts = [tx_num, tx_nom]
    if not legacy:
        allbin = _long("split", BINARY_COLUMNS, "VARCHAR")
        parts.append("SELECT a.customer_id, 'binary__' || a.variable AS feature,"
                     " CAST(coalesce(a.x, fc.fill) AS DOUBLE) AS value"
                     f" FROM ({allbin}) a JOIN fill_cat fc USING (variable)")
        ords = []
        for c in ORDINAL_COLUMNS:
            whens = " ".join(f"WHEN '{lv}' THEN {float(i)}" for i, lv in enumerate(ORDINAL_LEVELS[c]))
            ords.append(f"SELECT customer_id, 'cat_ord__{c}' AS feature, coalesce(CASE coalesce({c}, "
                        f"(SELECT fill FROM fill_cat WHERE variable = '{c}')) {whens} END, -1.0) AS value FROM split")
        parts += ords
    ctes.append("tx AS (" + "\nUNION ALL ".join(parts) + ")")
    return ctes


def eval_sql(t: str, model: str | None = None) -> str:
    """E1-E5 twin over a relation ``t(y, p)`` (threshold 0.5); one row."""
    name = f"'{model}' AS model, " if model else ""
    return f"""SELECT {name}tn, fp, fn, tp,
  round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
  round(coalesce(tp / nullif(tp + fn, 0), 0) * 100, 6) AS detection_rate_pct, fn AS missed,
  round(auc, 6) AS roc_auc
FROM (SELECT count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
             count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp
      FROM {t}) cm,
     (SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM (
        SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS below
        FROM (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {t} GROUP BY p))) a"""


def anova_ctes(k: int = 35) -> list[str]:
    from ..constants import CATEGORICAL
    return [
        "st AS (SELECT tx.feature, s.churned, count(*) AS n, sum(tx.value) AS s, sum(tx.value * tx.value) AS q"
        " FROM tx JOIN split s USING (customer_id) WHERE s.split = 'train' GROUP BY tx.feature, s.churned)",
        "fs AS (SELECT feature, sum(n) AS n, sum(s) AS s, sum(q) AS ss, sum(s * s / n) AS sqk, count(*) AS k"
        " FROM st GROUP BY feature)",
        "fsc AS (SELECT feature, CASE WHEN k < 2 OR n <= k THEN NULL"
        " WHEN (ss - s * s / n) - (sqk - s * s / n) <= 0 THEN"
        " CASE WHEN sqk - s * s / n > 0 THEN CAST('Infinity' AS DOUBLE) END"
        " ELSE ((sqk - s * s / n) / (k - 1)) / (((ss - s * s / n) - (sqk - s * s / n)) / (n - k)) END AS f_score"
        " FROM fs)",
        f"anova AS (SELECT feature, f_score, {origin_sql('feature', CATEGORICAL)} AS base_variable,"
        f" row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) <= {k} AS selected FROM fsc)",
    ]


def decimal_rounding(sql: str, digits: int = 6) -> str:
    """Rewrite ``round(x, 6)`` as a decimal round (half-up on a 10-place decimal, like Spark's)."""
    out, i, token = [], 0, "round("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(token)])
            i = j + len(token)
            continue
        depth, k, comma = 1, j + len(token), None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        args_end = k - 1
        if comma is None or sql[comma + 1:args_end].strip() != str(digits):
            out.append(sql[i:j + len(token)])
            i = j + len(token)
            continue
        inner = decimal_rounding(sql[j + len(token):comma], digits)
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST({inner} AS DECIMAL(38,10)), {digits}) AS DOUBLE)")
        i = args_end + 1
