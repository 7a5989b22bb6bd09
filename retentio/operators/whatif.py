"""Customer-level what-if, presets, bounds and risk signals (W1-W4), for whole tables.

The reference thresholds are quantiles of the reference table, computed once
in one batched quantile job; they enter the per-customer projections as
literals.  Scenario fan-out is an ``explode`` of a literal array inside each
row (4 scenarios → 4 rows per customer), so there is no join at all and one
scoring pass covers every customer and scenario.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BASE_NUMERIC, ID, NO_SIGNAL, PRESETS, SCENARIOS, SIGNALS
from ..functions.scoring import rule_probability
from . import stats
from .reports import round6

R = 6


def reference_quantiles(reference: DataFrame, needs: dict[str, list[float]], method: str = "exact") -> dict:
    """quantile_value: ``q`` of a reference column, 0 when it has no values."""
    q = stats.quantiles(reference, list(needs), needs, method=method)
    return {k: (0.0 if v is None else float(v)) for k, v in q.items()}


def clamp(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clamp each column into its [low, high]; NULL stays NULL."""
    return df.withColumns({
        c: F.when(F.col(c).isNull(), F.col(c)).otherwise(F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
        for c, (lo, hi) in bounds.items()
    })


def bounds_of(reference: DataFrame, columns=None, method: str = "exact") -> dict[str, tuple[float, float]]:
    """(p1, p99) per column with the empty / flat rules of A11."""
    columns = columns or [c for c in BASE_NUMERIC if c in reference.columns]
    q = stats.quantiles(reference, columns, [0.01, 0.99], method=method)
    out = {}
    for c in columns:
        lo, hi = q[(c, 0.01)], q[(c, 0.99)]
        if lo is None:
            lo, hi = 0.0, 1.0
        elif lo == hi:
            hi = lo + 1.0
        out[c] = (float(lo), float(hi))
    return out


def presets(reference: DataFrame, typical: DataFrame, method: str = "exact") -> DataFrame:
    """The typical customer with each preset's quantile overrides (one row per preset)."""
    needs: dict[str, list[float]] = {}
    for _, overrides in PRESETS:
        for c, q in overrides:
            needs.setdefault(c, []).append(q)
    qv = reference_quantiles(reference, needs, method)
    rows = F.array(*[
        F.struct(F.lit(name).alias("preset"), *[
            (F.lit(qv[(c, dict(ov)[c])]) if c in dict(ov) else F.col(c)).cast("double").alias(c)
            for c in BASE_NUMERIC
        ]) for name, ov in PRESETS
    ])
    cats = [c for c in typical.columns if c not in BASE_NUMERIC]
    return typical.select(F.explode(rows).alias("p"), *cats).select("p.*", *cats)


def risk_signals(customers: DataFrame, reference: DataFrame, method: str = "exact") -> DataFrame:
    """Fired signals per customer; one 'no strong signal' row when none fires."""
    needs: dict[str, list[float]] = {}
    for _, c, _, q, _, _ in SIGNALS:
        needs.setdefault(c, []).append(q)
    qv = reference_quantiles(reference, needs, method)
    fired = []
    for name, c, op, q, criterion, reading in SIGNALS:
        v = F.col(c)
        cond = (v >= F.lit(qv[(c, q)])) if op == ">=" else (v <= F.lit(qv[(c, q)]))
        fired.append(F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(name).alias("signal"), F.lit(c).alias("variable"), v.cast("double").alias("customer_value"),
            F.lit(criterion).alias("criterion"), F.lit(reading).alias("reading"))))
    none = F.struct(F.lit(NO_SIGNAL[0]).alias("signal"), F.lit(NO_SIGNAL[1]).alias("variable"),
                    F.lit(None).cast("double").alias("customer_value"), F.lit(NO_SIGNAL[2]).alias("criterion"),
                    F.lit(NO_SIGNAL[3]).alias("reading"))
    arr = F.filter(F.array(*fired), lambda x: x.isNotNull())
    arr = F.when(F.size(arr) > 0, arr).otherwise(F.array(none))
    return customers.select(ID, F.explode(arr).alias("s")).select(ID, "s.*")


def _probability_of(values: dict[str, Column], columns: list[str]) -> Column:
    """Rule probability after applying the validity rules to ``values`` (default: the columns)."""
    from ..constants import SCORE_WEIGHTS
    present = set(columns)
    return rule_probability({
        c: _rebind_rule(c, values.get(c, F.col(c) if c in present else F.lit(None).cast("double")))
        for c, _ in SCORE_WEIGHTS})


def _rebind_rule(c: str, v: Column) -> Column:
    from ..constants import AGE_RANGE, NON_NEGATIVE_COLUMNS, RATE_COLUMNS
    if c == "age":
        return F.when(v.between(*AGE_RANGE), v)
    if c in RATE_COLUMNS:
        return F.when(v.between(0.0, 100.0), v)
    if c in NON_NEGATIVE_COLUMNS:
        return F.when(v >= 0, v)
    return v


def what_if(customers: DataFrame, reference: DataFrame, method: str = "exact") -> DataFrame:
    """Current vs simulated probability per customer and scenario (rule scorer)."""
    needs: dict[str, list[float]] = {}
    for _, overrides in SCENARIOS:
        for c, q in overrides:
            needs.setdefault(c, []).append(q)
    qv = reference_quantiles(reference, needs, method)
    cols = customers.columns
    current = _probability_of({}, cols)
    scen = F.array(*[
        F.struct(F.lit(name).alias("scenario"),
                 _probability_of({c: F.lit(qv[(c, q)]) for c, q in ov}, cols).alias("simulated"))
        for name, ov in SCENARIOS
    ])
    out = customers.select(ID, current.alias("current"), F.explode(scen).alias("s"))
    return out.select(
        ID, "s.scenario", round6(F.col("current")).alias("current_probability"),
        round6(F.col("s.simulated")).alias("simulated_probability"),
        round6(F.col("current") - F.col("s.simulated")).alias("reduction"),
        F.when(F.col("s.simulated") < F.col("current"), "prioritise").otherwise("monitor").alias("reading"))


def what_if_scored(customers: DataFrame, reference: DataFrame, scorer, method: str = "exact") -> DataFrame:
    """W4 for any scorer (e.g. a fitted pipeline): the current row is scored first, then exploded into one
    row per scenario with the overrides applied and scored again; no shuffle."""
    needs: dict[str, list[float]] = {}
    for _, overrides in SCENARIOS:
        for c, q in overrides:
            needs.setdefault(c, []).append(q)
    qv = reference_quantiles(reference, needs, method)
    touched = sorted(needs)
    variants = [(name, {c: qv[(c, q)] for c, q in ov}) for name, ov in SCENARIOS]
    arr = F.array(*[F.struct(F.lit(name).alias("scenario"), *[
        (F.lit(ov[c]) if c in ov else F.col(c)).cast("double").alias(f"_v_{c}") for c in touched])
        for name, ov in variants])
    current = scorer.with_probability(customers, "_cur")
    rows = current.select(*customers.columns, "_cur", F.explode(arr).alias("_s"))
    rows = rows.select(*[c for c in customers.columns if c not in touched], "_cur", "_s.scenario",
                       *[F.col(f"_s._v_{c}").alias(c) for c in touched])
    out = scorer.with_probability(rows)
    return out.select(
        ID, "scenario", round6(F.col("_cur")).alias("current_probability"),
        round6(F.col("probability")).alias("simulated_probability"),
        round6(F.col("_cur") - F.col("probability")).alias("reduction"),
        F.when(F.col("probability") < F.col("_cur"), "prioritise").otherwise("monitor").alias("reading"))
