"""Batched column statistics: exact/approximate quantiles, modes, moments.

All statistics of one pass are computed together.  Results are constant-size
(one value per column × level) and are returned to the driver as plain
Python scalars, like fitted parameters of a Spark ML model.

Exact quantiles (linear interpolation, ``(n-1)·q`` positions) use a distributed
selection.  One wide pass counts every column and sketches it (KLL); the sketch
names a narrow value range for each quantile, a second wide pass counts the values
below and inside the ranges, and only the values inside leave their rows.  A
range that still holds too many values is narrowed further by counting them per
bucket of a monotone key, until its distinct values can be ranked in one task.
No step gathers a whole column into one task or the driver, and a hot value
collapses in the map-side ``groupBy(value)`` pre-aggregation.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


MAX_CATEGORIES = 10_000            # levels of a categorical column, at most
# Ranges holding at most this many values are ranked directly in one task.
FINAL_RANGE_ROWS = 2_000_000
# Bucket key resolution: floor(log1p(x·SCALE)·PER_EFOLD), x in [0, 1].
SCALE = 1e9
PER_EFOLD = 256
MAX_LEVELS = 8
# Sketch size, and the margin of rank on each side of a quantile (several times the sketch's rank error).
SKETCH_K = 1024
MARGIN = 0.01
MERGE_GROUPS = 512                 # sketches of this many groups of partitions meet in the last merge


def column_counts(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """(non-null count, min, max) per column in one aggregate."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v), F.min(v), F.max(v)]
    row = df.agg(*aggs).first()
    return {c: (row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, c in enumerate(columns)}


def _positions(n: int, q: float) -> tuple[int, int, float]:
    pos = (n - 1) * q
    lo = math.floor(pos)
    return lo, math.ceil(pos), pos - lo


def _values(c: str) -> F.Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _sketched(df: DataFrame, probs_by: dict) -> tuple[dict, dict]:
    """One wide pass: (count, min, max) per column, and per (column, quantile) the range that should hold its ranks.

    Sketches are merged in two steps, so no task receives those of all partitions of a large table.
    """
    columns = list(probs_by)
    partial = df.select(*[_values(c).alias(f"v{i}") for i, c in enumerate(columns)]).groupBy(
        F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g")).agg(*[x for i in range(len(columns)) for x in (
            F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"a{i}"), F.max(f"v{i}").alias(f"z{i}"),
            F.kll_sketch_agg_double(f"v{i}", SKETCH_K).alias(f"k{i}"))])
    merged = partial.agg(*[x for i in range(len(columns)) for x in (
        F.sum(f"n{i}").alias(f"n{i}"), F.min(f"a{i}").alias(f"a{i}"), F.max(f"z{i}").alias(f"z{i}"),
        F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"k{i}")), SKETCH_K).alias(f"k{i}"))])
    ends = [F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"k{i}", F.array(*[
        F.lit(min(max(q + side, 0.0), 1.0)) for q in probs_by[c] for side in (-MARGIN, MARGIN)]))).alias(f"e{i}")
        for i, c in enumerate(columns)]
    row = merged.select(*[f"{p}{i}" for i in range(len(columns)) for p in "naz"], *ends).first()
    counts, ranges = {}, {}
    for i, c in enumerate(columns):
        counts[c] = (row[f"n{i}"] or 0, row[f"a{i}"], row[f"z{i}"]) if row else (0, None, None)
        if counts[c][0]:
            for j, q in enumerate(probs_by[c]):
                lo, hi = row[f"e{i}"][2 * j:2 * j + 2]
                ranges[(c, q)] = (counts[c][1] if q <= MARGIN else lo, counts[c][2] if q >= 1 - MARGIN else hi)
    return counts, ranges


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float] | dict[str, list[float]],
                    counts: dict | None = None) -> dict[tuple[str, float], float | None]:
    """Exact linearly-interpolated quantiles; ``None`` for a column without values.

    ``counts`` may give known (count, min, max) per column, which saves a pass; wrong ones are noticed and measured.
    """
    probs_by = probs if isinstance(probs, dict) else {c: list(probs) for c in columns}
    if not probs_by:
        return {}
    counts = column_counts(df, list(probs_by)) if counts is None else counts
    if all(counts[c][0] <= FINAL_RANGE_ROWS for c in probs_by):       # every value is ranked at once
        try:
            return _quantiles_from(df, probs_by, counts, {})
        except KeyError:                 # supplied counts disagreed with the data
            pass
    return _quantiles_from(df, probs_by, *_sketched(df, probs_by))


def _quantiles_from(df: DataFrame, probs_by: dict, counts: dict, ranges: dict) -> dict:
    result: dict[tuple[str, float], float | None] = {}
    wanted: dict[tuple[str, float], set[int]] = {}
    for c, qs in probs_by.items():
        n = counts[c][0]
        for q in qs:
            if n:
                wanted[(c, q)] = set(_positions(n, q)[:2])
            else:
                result[(c, q)] = None
    if not wanted:
        return result
    values = _select_ranks(df, _first_cells(df, counts, ranges, wanted))
    for c, q in wanted:
        lo, hi, frac = _positions(counts[c][0], q)
        a, b = values[(c, lo)], values[(c, hi)]
        result[(c, q)] = a if lo == hi else a + (b - a) * frac
    return result


def _first_cells(df: DataFrame, counts: dict, ranges: dict, wanted: dict) -> list[tuple]:
    """Cells (column, lo, hi, offset, count, ranks) to start with: the sketch's ranges where a column is too large to be
    ranked at once, after one wide pass that counts the values below and in each; else the whole column.  A range that
    does not hold its ranks after all is not used."""
    whole: dict[str, set[int]] = defaultdict(set)
    cells, asked = [], [k for k in wanted if counts[k[0]][0] > FINAL_RANGE_ROWS and k in ranges]
    found = iter(df.agg(*[F.count_if(t) for c, q in asked for v, (lo, hi) in [(_values(c), ranges[(c, q)])]
                          for t in (v < lo, v.between(lo, hi))]).first()) if asked else iter(())
    held = {k: (next(found), next(found)) for k in asked}
    for (c, q), rs in wanted.items():
        below, inside = held.get((c, q), (0, 0))
        if min(rs) >= below and max(rs) < below + inside:
            cells.append((c, *ranges[(c, q)], below, inside, sorted(rs)))
        else:
            whole[c] |= rs
    return cells + [(c, counts[c][1], counts[c][2], 0, counts[c][0], sorted(rs)) for c, rs in whole.items()]


def _select_ranks(df: DataFrame, cells: list[tuple]) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank (ascending) per column, by range narrowing from the given cells."""
    spark = df.sparkSession
    found: dict[tuple[str, int], float] = {}
    for _ in range(MAX_LEVELS):
        final, split = [], []
        for cell in cells:
            c, lo, hi, off, n, rs = cell
            if lo is not None and lo == hi:
                for r in rs:
                    found[(c, r)] = lo
            elif n <= FINAL_RANGE_ROWS:
                final.append(cell)
            else:
                split.append(cell)
        if final:
            found.update(_rank_in_cells(spark, df, final))
        if not split:
            break
        cells = _narrow(spark, df, split)
    else:
        wide = [c[0] for c in cells if c[4] > FINAL_RANGE_ROWS and c[1] != c[2]]
        if wide:
            raise RuntimeError(f"ranges of {wide} stay above {FINAL_RANGE_ROWS} values after {MAX_LEVELS} levels")
        found.update(_rank_in_cells(spark, df, cells))
    return found


def _ranks_frame(spark, cells):
    rows = [(i, int(r)) for i, cell in enumerate(cells) for r in cell[5]]
    return spark.createDataFrame(rows, "cell long, r long")


def _in_cells(df: DataFrame, cells) -> DataFrame:
    """(cell, v) of the values inside the cells; a row gives only those of its values."""
    found = []
    for i, (c, lo, hi, _off, _n, _r) in enumerate(cells):
        v = _values(c)
        inside = v.isNotNull() if lo is None else v.between(F.lit(float(lo)), F.lit(float(hi)))
        found.append(F.when(inside, F.struct(F.lit(i).cast("long").alias("cell"), v.alias("v"))))
    return df.select(F.explode(F.array(*found)).alias("p")).where("p IS NOT NULL").select("p.*")


def _of(cells, field: int) -> F.Column:
    """A field of the row's cell."""
    return F.element_at(F.lit([cell[field] for cell in cells]), F.col("cell").cast("int") + 1)


def _narrow(spark, df: DataFrame, cells):
    cells = [(c, float(lo), float(hi), off, n, rs) for c, lo, hi, off, n, rs in cells]
    x = (F.col("v") - _of(cells, 1)) / (_of(cells, 2) - _of(cells, 1)) * F.lit(SCALE)
    keyed = _in_cells(df, cells).withColumn("k", F.floor(F.log1p(x) * F.lit(PER_EFOLD)))
    buckets = keyed.groupBy("cell", "k").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("kmin"), F.max("v").alias("kmax"))
    w = Window.partitionBy("cell").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumns({"c": _of(cells, 0), "end": _of(cells, 3) + F.sum("n").over(w)})
    hit = (buckets.join(_ranks_frame(spark, cells), "cell")
           .where((F.col("r") >= F.col("end") - F.col("n")) & (F.col("r") < F.col("end"))))
    grouped: dict = {}
    for row in hit.select("c", "kmin", "kmax", "end", "n", "r").collect():
        key = (row["c"], row["kmin"], row["kmax"], row["end"] - row["n"], row["n"])
        grouped.setdefault(key, []).append(row["r"])
    return [(c, lo, hi, off, n, sorted(rs)) for (c, lo, hi, off, n), rs in grouped.items()]


def _rank_in_cells(spark, df: DataFrame, cells) -> dict[tuple[str, int], float]:
    distinct = _in_cells(df, cells).groupBy("cell", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    distinct = distinct.withColumns({"c": _of(cells, 0), "end": _of(cells, 3) + F.sum("n").over(w)})
    hit = (distinct.join(_ranks_frame(spark, cells), "cell")
           .where((F.col("r") >= F.col("end") - F.col("n")) & (F.col("r") < F.col("end"))))
    return {(row["c"], row["r"]): row["v"] for row in hit.select("c", "r", "v").collect()}


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     accuracy: int = 10_000) -> dict[tuple[str, float], float | None]:
    """One-pass ``percentile_approx`` (bounded memory; not interpolated)."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy) for c in columns]).first()
    out = {}
    for i, c in enumerate(columns):
        vals = row[i]
        for j, q in enumerate(probs):
            out[(c, q)] = None if vals is None else vals[j]
    return out


def quantiles(df: DataFrame, columns: list[str], probs, method: str = "exact", **kw):
    if method == "approx":
        plist = sorted({q for qs in probs.values() for q in qs}) if isinstance(probs, dict) else list(probs)
        return approx_quantiles(df, columns, plist, **kw)
    return exact_quantiles(df, columns, probs, **kw)


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns
    ])).alias("p")
    return (df.select(pairs).select("p.c", "p.v").where(F.col("v").isNotNull())
            .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))


def _best(counted: DataFrame):
    key = F.struct((-F.col("n")).alias("neg"), F.col("v"))
    return F.min_by(key, key)["v"]


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, ties → smallest (as text)."""
    counted = _value_counts(df, columns)
    got = {r["c"]: r["m"] for r in counted.groupBy("c").agg(_best(counted).alias("m")).collect()}
    return {c: got.get(c) for c in columns}


def modes_and_levels(df: DataFrame, columns: list[str], with_levels: list[str]) -> tuple[dict, dict]:
    """Modes of ``columns`` and sorted vocabularies of ``with_levels`` from one grouped count.

    A vocabulary is collected per categorical column; a column with over MAX_CATEGORIES levels is refused.
    """
    counted = cut_lineage(_value_counts(df, columns))
    wanted = F.col("c").isin(*with_levels) if with_levels else F.lit(False)
    large = counted.where(wanted).groupBy("c").count().where(F.col("count") > MAX_CATEGORIES).first()
    if large:
        raise ValueError(f"{large['c']} has {large['count']} levels (at most {MAX_CATEGORIES}); it is not a category")
    rows = counted.groupBy("c").agg(
        _best(counted).alias("m"),
        F.sort_array(F.collect_list(F.when(wanted, F.col("v")))).alias("levels")).collect()
    got = {r["c"]: r for r in rows}
    m = {c: (got[c]["m"] if c in got else None) for c in columns}
    lv = {c: (list(got[c]["levels"]) if c in got else []) for c in with_levels}
    return m, lv


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """count, mean and the sample (bias-corrected) skewness per column (+ total rows), one aggregate."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v), F.avg(v), F.skewness(v)]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        n, mean, g1 = row[3 * i + 1], row[3 * i + 2], row[3 * i + 3]
        if n is None or n < 3 or g1 is None or (isinstance(g1, float) and math.isnan(g1)):
            skew = None
        else:
            skew = g1 * math.sqrt(n * (n - 1)) / (n - 2)
        out[c] = {"n": n, "mean": mean, "skew": skew, "rows": row["_rows"]}
    return out
