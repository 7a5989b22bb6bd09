"""Schema normalisation (P1-P6, P9-P11) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    ABSENT_DEFAULTS, ACTIVE_LABEL, BASE_NUMERIC, CATEGORICAL, CHURN_LABEL, HEADER_ALIASES,
    NULL_TOKENS, SOURCE_CATEGORICAL, TARGET, VARIABLE_LABELS,
)

ALIAS_TO_CANONICAL = {alias: canon for canon, pair in HEADER_ALIASES.items() for alias in pair}


def rename_aliases(df: DataFrame) -> DataFrame:
    """English or Spanish source headers → canonical names; others pass through."""
    mapping = {c: ALIAS_TO_CANONICAL[c] for c in df.columns if c in ALIAS_TO_CANONICAL}
    return df.withColumnsRenamed(mapping) if mapping else df


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(c: Column, dtype: T.DataType) -> Column:
    """Numeric coercion; text that is not a plain decimal or scientific number, NaN and
    infinite values (also by overflow) become NULL."""
    if isinstance(dtype, T.StringType):
        text = F.trim(c)
        v = F.when(text.rlike(NUMBER), text.try_cast("double"))
    else:
        v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def to_target(c: Column, dtype: T.DataType) -> Column:
    """Numeric target, truncated to int; missing or outside the integer range → 0 (never an error)."""
    return F.coalesce(to_double(c, dtype).try_cast("int"), F.lit(0))


def to_category(c: Column, dtype: T.DataType) -> Column:
    """Categorical text; pandas-style missing tokens become NULL."""
    s = c.cast("string")
    return F.when(~s.isin(*NULL_TOKENS), s)


def normalize(df: DataFrame) -> DataFrame:
    """P1-P4 on any frame: rename, coerce numerics/target, type categoricals."""
    df = rename_aliases(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = {}
    if TARGET in types:
        exprs[TARGET] = to_target(F.col(TARGET), types[TARGET])
    for c in BASE_NUMERIC:
        if c in types:
            exprs[c] = to_double(F.col(c), types[c])
    for c in SOURCE_CATEGORICAL:
        if c in types:
            exprs[c] = to_category(F.col(c), types[c])
    return df.withColumns(exprs)


def complete(df: DataFrame) -> DataFrame:
    """P5: add absent base columns (numerics NULL, categoricals a default); cells untouched."""
    add = {c: F.lit(None).cast("double") for c in BASE_NUMERIC if c not in df.columns}
    add.update({c: F.lit(v) for c, v in ABSENT_DEFAULTS.items() if c not in df.columns})
    return df.withColumns(add) if add else df


def model_input(df: DataFrame) -> DataFrame:
    """Normalise + complete + drop the target."""
    return complete(normalize(df)).drop(TARGET)


def require_target(df: DataFrame) -> None:
    """A training table must carry the target (English, Spanish or canonical)."""
    names = set(rename_aliases(df).columns)
    if TARGET not in names:
        raise ValueError("the training table needs the target column (churned / Churned / Fuga_Cliente)")


def decode_target(c: Column) -> Column:
    """1 → churn, 0 → active, anything else NULL."""
    return F.when(c == 1, CHURN_LABEL).when(c == 0, ACTIVE_LABEL)


def _label_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in VARIABLE_LABELS.items() for x in kv])


def _after_group(name: Column) -> Column:
    """Text after the first ``__`` (the column-group prefix), else the name itself."""
    return F.when(F.instr(name, "__") > 0,
                  F.substring(name, F.instr(name, "__") + 2, 1 << 20)).otherwise(name)


def pretty_label(name: Column) -> Column:
    """Strip ``group__``, exact label, else longest declared prefix → 'Label: suffix'."""
    clean = _after_group(name)
    chain = None
    for base in sorted(VARIABLE_LABELS, key=len, reverse=True):
        cond = clean.startswith(base + "_")
        val = F.concat(F.lit(VARIABLE_LABELS[base] + ": "),
                       F.regexp_replace(F.substring(clean, len(base) + 2, 1 << 20), "_", " "))
        chain = F.when(cond, val) if chain is None else chain.when(cond, val)
    return F.when(name.isNull(), F.lit("")).otherwise(
        F.coalesce(F.element_at(_label_map(), clean), chain, F.regexp_replace(clean, "_", " ")))


def feature_origin(name: Column, categorical: list[str] | None = None) -> Column:
    """P10: transformed feature name → base variable."""
    from ..constants import PREDICTION_COLUMNS
    categorical = categorical or CATEGORICAL
    clean = _after_group(name)
    chain = F.when(clean.isin(*PREDICTION_COLUMNS), clean)
    for c in sorted(categorical, key=len, reverse=True):
        chain = chain.when(clean.startswith(c + "_"), F.lit(c))
    return chain.otherwise(clean)
