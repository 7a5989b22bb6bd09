"""Preprocessing estimators (I1-I9, I13) on the ``pyspark.ml`` surface.

``ChurnPreprocessor.fit`` computes every statistic with a few global
aggregates over the (rule-cleaned, featured) training rows; the fitted
``ChurnPreprocessorModel`` is a pure projection: named feature columns
``group__column[_level]`` plus an assembled ``features`` vector.

Fit order follows the original column-group pipelines, each statistic taken
on the output of the previous step:

* pass 1 — count / mean / sample skewness (I1), medians, modes (I2, I3) and
  one-hot vocabularies (I7);
* pass 2 — quartiles of the imputed capped columns (I4 fences) and median /
  quartiles of ``log1p`` of the imputed log columns (I5 → I6);
* pass 3 — median / quartiles of the capped columns (I6).

Each pass is one batched quantile job over a persisted input.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BINARY_COLUMNS, CAP_COLUMNS, CATEGORICAL, GROUP_BINARY, GROUP_CAP, GROUP_LOG,
    GROUP_NOMINAL, GROUP_ORDINAL, ID, LEGACY_GROUP_CATEGORICAL, LEGACY_GROUP_NUMERIC, LOG_COLUMNS,
    NOMINAL_COLUMNS, NUMERIC, ORDINAL_COLUMNS, ORDINAL_LEVELS,
)
from ..session import keep
from . import stats

SKEW_THRESHOLD = 0.5
IQR_FACTOR = 1.5


def skew_fill(m: dict, median: float | None, threshold: float = SKEW_THRESHOLD) -> tuple[float, str]:
    """Median when |sample skew| > threshold, else mean; no values → 0."""
    if not m["n"]:
        return 0.0, "zero"
    if m["skew"] is not None and abs(m["skew"]) > threshold:
        return float(median), "median"
    return float(m["mean"]), "mean"


def robust(center: float | None, q1: float | None, q3: float | None) -> tuple[float, float]:
    """centre = median, scale = IQR with 0 → 1."""
    if center is None:
        return 0.0, 1.0
    scale = q3 - q1
    return float(center), float(scale if scale != 0 else 1.0)


class _Profile(Params):
    profile = Param(Params._dummy(), "profile", "current | legacy", typeConverter=TypeConverters.toString)
    quantileMethod = Param(Params._dummy(), "quantileMethod", "exact | approx",
                           typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "assembled vector column", typeConverter=TypeConverters.toString)


class ChurnPreprocessor(Estimator, _Profile, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, profile: str = "current", quantileMethod: str = "exact", outputCol: str = "features"):
        super().__init__()
        self._setDefault(profile="current", quantileMethod="exact", outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ChurnPreprocessorModel":
        profile = self.getOrDefault("profile")
        method = self.getOrDefault("quantileMethod")
        data = keep(df)
        try:
            fitted = _fit_legacy(data, method) if profile == "legacy" else _fit_current(data, method)
        finally:
            data.unpersist()
        fitted["profile"] = profile
        return ChurnPreprocessorModel(stats=json.dumps(fitted), outputCol=self.getOrDefault("outputCol"))


def _modes_and_levels(df: DataFrame, categorical: list[str], binary: list[str]) -> tuple[dict, dict]:
    return stats.modes_and_levels(df, categorical + binary, categorical)


def _fit_current(df: DataFrame, method: str) -> dict:
    num = LOG_COLUMNS + CAP_COLUMNS
    moments = stats.moments(df, num)
    rows = moments[num[0]]["rows"]
    known = {c: (moments[c]["n"], None, None) for c in num}
    med = stats.quantiles(df, num, [0.5], method=method, **({"counts": known} if method == "exact" else {}))
    modes, levels = _modes_and_levels(df, NOMINAL_COLUMNS, BINARY_COLUMNS + ORDINAL_COLUMNS)
    numeric = {}
    for c in num:
        fill, how = skew_fill(moments[c], med[(c, 0.5)])
        numeric[c] = {"group": GROUP_LOG if c in LOG_COLUMNS else GROUP_CAP, "fill": fill, "strategy": how,
                      "skew": moments[c]["skew"], "mean": moments[c]["mean"], "median": med[(c, 0.5)]}
    # pass 2: fences on imputed capped columns; scaler stats of log1p(imputed) log columns
    imputed = {c: F.coalesce(F.col(c), F.lit(numeric[c]["fill"])) for c in num}
    p2 = df.select(*[imputed[c].alias(c) for c in CAP_COLUMNS],
                   *[F.log1p(F.greatest(imputed[c], F.lit(0.0))).alias(c) for c in LOG_COLUMNS])
    full = {"counts": {c: (rows, None, None) for c in num}} if method == "exact" else {}   # imputed: no NULLs
    q2 = stats.quantiles(p2, num, {**{c: [0.25, 0.75] for c in CAP_COLUMNS},
                                   **{c: [0.25, 0.5, 0.75] for c in LOG_COLUMNS}}, method=method, **full)
    for c in LOG_COLUMNS:
        numeric[c]["center"], numeric[c]["scale"] = robust(q2[(c, 0.5)], q2[(c, 0.25)], q2[(c, 0.75)])
    for c in CAP_COLUMNS:
        q1, q3 = q2[(c, 0.25)], q2[(c, 0.75)]
        iqr = q3 - q1
        numeric[c]["lo"], numeric[c]["hi"] = q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr
    # pass 3: scaler stats of capped columns
    p3 = df.select(*[F.least(F.greatest(imputed[c], F.lit(numeric[c]["lo"])), F.lit(numeric[c]["hi"])).alias(c)
                     for c in CAP_COLUMNS])
    q3s = stats.quantiles(p3, CAP_COLUMNS, [0.25, 0.5, 0.75], method=method,
                          **({"counts": {c: (rows, None, None) for c in CAP_COLUMNS}} if method == "exact" else {}))
    for c in CAP_COLUMNS:
        numeric[c]["center"], numeric[c]["scale"] = robust(q3s[(c, 0.5)], q3s[(c, 0.25)], q3s[(c, 0.75)])
    out = {
        "numeric": numeric,
        "binary": {c: {"fill": float(modes[c]) if modes[c] is not None else 0.0} for c in BINARY_COLUMNS},
        "nominal": {c: {"fill": modes[c], "levels": levels.get(c, [])} for c in NOMINAL_COLUMNS},
        "ordinal": {c: {"fill": modes[c], "levels": ORDINAL_LEVELS[c]} for c in ORDINAL_COLUMNS},
    }
    out["features"] = _names_current(out)
    return out


def _fit_legacy(df: DataFrame, method: str) -> dict:
    num = list(NUMERIC)
    q = stats.quantiles(df, num, [0.5], method=method)
    numeric = {c: {"group": LEGACY_GROUP_NUMERIC, "fill": float(q[(c, 0.5)]) if q[(c, 0.5)] is not None else 0.0,
                   "strategy": "median"} for c in num}
    imputed = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(numeric[c]["fill"])).alias(c) for c in num])
    qs = stats.quantiles(imputed, num, [0.25, 0.5, 0.75], method=method)
    for c in num:
        numeric[c]["center"], numeric[c]["scale"] = robust(qs[(c, 0.5)], qs[(c, 0.25)], qs[(c, 0.75)])
    modes, levels = _modes_and_levels(df, CATEGORICAL, [])
    out = {"numeric": numeric, "binary": {}, "ordinal": {},
           "nominal": {c: {"fill": modes[c], "levels": levels.get(c, [])} for c in CATEGORICAL}}
    out["features"] = [f"{LEGACY_GROUP_NUMERIC}__{c}" for c in num] + [
        f"{LEGACY_GROUP_CATEGORICAL}__{c}_{lv}" for c in CATEGORICAL for lv in out["nominal"][c]["levels"]]
    return out


def _names_current(s: dict) -> list[str]:
    names = [f"{GROUP_LOG}__{c}" for c in LOG_COLUMNS] + [f"{GROUP_CAP}__{c}" for c in CAP_COLUMNS]
    names += [f"{GROUP_BINARY}__{c}" for c in BINARY_COLUMNS]
    names += [f"{GROUP_NOMINAL}__{c}_{lv}" for c in NOMINAL_COLUMNS for lv in s["nominal"][c]["levels"]]
    names += [f"{GROUP_ORDINAL}__{c}" for c in ORDINAL_COLUMNS]
    return names


class ChurnPreprocessorModel(Model, _Profile, DefaultParamsReadable, DefaultParamsWritable):
    stats = Param(Params._dummy(), "stats", "fitted statistics (JSON)", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, stats: str = "{}", outputCol: str = "features"):
        super().__init__()
        self._setDefault(stats="{}", outputCol="features")
        self._set(**self._input_kwargs)

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault("stats"))

    @property
    def feature_names(self) -> list[str]:
        return self.fitted["features"]

    def feature_columns(self) -> dict[str, Column]:
        """Transformed value per feature name (I4-I9) as column expressions."""
        s = self.fitted
        out: dict[str, Column] = {}
        legacy = s.get("profile") == "legacy"
        for c, p in s["numeric"].items():
            v = F.coalesce(F.col(c).cast("double"), F.lit(p["fill"]))
            if p["group"] == GROUP_LOG:
                v = F.log1p(F.greatest(v, F.lit(0.0)))
            elif p["group"] == GROUP_CAP:
                v = F.least(F.greatest(v, F.lit(p["lo"])), F.lit(p["hi"]))
            out[f"{p['group']}__{c}"] = (v - F.lit(p["center"])) / F.lit(p["scale"])
        for c, p in s["binary"].items():
            out[f"{GROUP_BINARY}__{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(p["fill"]))
        prefix = LEGACY_GROUP_CATEGORICAL if legacy else GROUP_NOMINAL
        for c, p in s["nominal"].items():
            v = F.coalesce(F.col(c).cast("string"), F.lit(p["fill"]))
            for lv in p["levels"]:
                out[f"{prefix}__{c}_{lv}"] = F.coalesce((v == F.lit(lv)).cast("double"), F.lit(0.0))
        for c, p in s["ordinal"].items():
            m = F.create_map(*[F.lit(x) for i, lv in enumerate(p["levels"]) for x in (lv, float(i))])
            v = F.coalesce(F.col(c).cast("string"), F.lit(p["fill"]))
            out[f"{GROUP_ORDINAL}__{c}"] = F.coalesce(F.element_at(m, v), F.lit(-1.0))
        return {n: out[n] for n in s["features"]}

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.feature_columns()
        named = df.withColumns(cols)
        assembler = VectorAssembler(inputCols=list(cols), outputCol=self.getOrDefault("outputCol"))
        return assembler.transform(named)

    def long_form(self, df: DataFrame, key: str = ID) -> DataFrame:
        """(key, feature, value) rows of the transformed matrix."""
        cols = self.feature_columns()
        arr = F.array(*[F.struct(F.lit(n).alias("feature"), e.alias("value")) for n, e in cols.items()])
        return df.select(F.col(key), F.explode(arr).alias("f")).select(key, "f.feature", "f.value")


# --- standalone column-group stages (the individual fit/transform classes) -------------------

class _Cols(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns transformed in place",
                      typeConverter=TypeConverters.toListString)
    fitted = Param(Params._dummy(), "fitted", "fitted values per column (JSON)", typeConverter=TypeConverters.toString)
    quantileMethod = Param(Params._dummy(), "quantileMethod", "exact | approx", typeConverter=TypeConverters.toString)

    def _values(self) -> dict:
        return json.loads(self.getOrDefault("fitted"))


class _ColsModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, fitted: str = "{}"):
        super().__init__()
        self._setDefault(fitted="{}", inputCols=[])
        self._set(**self._input_kwargs)


class SkewImputer(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """I1 as a stage: fill NULLs with the median when |sample skew| > 0.5, else the mean (0 when empty)."""

    @keyword_only
    def __init__(self, inputCols=None, quantileMethod: str = "exact"):
        super().__init__()
        self._setDefault(inputCols=[], quantileMethod="exact", fitted="{}")
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getOrDefault("inputCols")
        m = stats.moments(df, cols)
        med = stats.quantiles(df, cols, [0.5], method=self.getOrDefault("quantileMethod"))
        return SkewImputerModel(inputCols=cols, fitted=json.dumps({c: skew_fill(m[c], med[(c, 0.5)])[0] for c in cols}))


class SkewImputerModel(_ColsModel):
    def _transform(self, df):
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self._values().items()})


class IQRCapper(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """I4 as a stage: clip to [q1 - 1.5·IQR, q3 + 1.5·IQR] (linear-interpolated quartiles)."""

    @keyword_only
    def __init__(self, inputCols=None, quantileMethod: str = "exact"):
        super().__init__()
        self._setDefault(inputCols=[], quantileMethod="exact", fitted="{}")
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getOrDefault("inputCols")
        q = stats.quantiles(df, cols, [0.25, 0.75], method=self.getOrDefault("quantileMethod"))
        fences = {}
        for c in cols:
            q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
            fences[c] = None if q1 is None else [q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)]
        return IQRCapperModel(inputCols=cols, fitted=json.dumps(fences))


class IQRCapperModel(_ColsModel):
    def _transform(self, df):
        return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
                               for c, b in self._values().items() if b is not None for lo, hi in [b]})


class Log1p(Transformer, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """I5 as a stage: ``log1p(max(x, 0))``."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._setDefault(inputCols=[], fitted="{}", quantileMethod="exact")
        self._set(**self._input_kwargs)

    def _transform(self, df):
        return df.withColumns({c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
                               for c in self.getOrDefault("inputCols")})


class ExactRobustScaler(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """I6 as a stage: ``(x - median) / IQR`` with IQR 0 → 1 (centred, exact quartiles)."""

    @keyword_only
    def __init__(self, inputCols=None, quantileMethod: str = "exact"):
        super().__init__()
        self._setDefault(inputCols=[], quantileMethod="exact", fitted="{}")
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getOrDefault("inputCols")
        q = stats.quantiles(df, cols, [0.25, 0.5, 0.75], method=self.getOrDefault("quantileMethod"))
        return ExactRobustScalerModel(inputCols=cols, fitted=json.dumps(
            {c: robust(q[(c, 0.5)], q[(c, 0.25)], q[(c, 0.75)]) for c in cols}))


class ExactRobustScalerModel(_ColsModel):
    def _transform(self, df):
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self._values().items()})
