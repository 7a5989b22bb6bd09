"""Evaluation (E1-E5, E9, M1, M3a) from a frame of (label, probability[, group]).

The input is read once: positives and negatives are counted per distinct score
(and group), and that table is checkpointed.  The confusion cells and the exact
ROC AUC come from it.  For the AUC, negatives below each score are prefix-summed
with a two-level scheme (bucket totals, then ranks inside each bucket), for one
group or many, so no window spans all scores of a group.

For many groups of nearly distinct scores (the variants of the importance) that table would be as long as the input:
``auc_by_group`` sorts the scores of each class in the tasks that made them and ships them as arrays instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TARGET
from ..session import batches_by_rows, cut_lineage, ship
from .sampling import class_counts

AUC_BUCKETS = 1024                 # cut points of a group's scores, at most
SCORES_PER_BUCKET = 250_000        # distinct scores ranked in one window partition; fewer need no cuts
CELL_SCORES = 1_000_000            # scores of a group ranked at once, about, where groups are ranked from arrays
HELD_ROWS = 1 << 20                # rows that a task sorts at a time
CELLS = "grp int, part int, pos binary, pos_n binary, neg binary, neg_n binary"


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, label: str = TARGET, pred: str = "prediction", groups=()) -> DataFrame:
    """Tn, fp, fn, tp (per group)."""
    y, p = F.col(label), F.col(pred)
    cells = [F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
             F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp")]
    return df.groupBy(*groups).agg(*cells)


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """E2 + E5: accuracy, precision, recall, F1, balanced accuracy, detection rate, missed."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision = _safe(tp, tp + fp)
    recall = _safe(tp, tp + fn)
    specificity = _safe(tn, tn + fp)
    return cm.withColumns({
        "accuracy": _safe(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": _safe(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (recall + specificity) / 2,
        "detection_rate_pct": _safe(tp, tp + fn) * 100,
        "missed": F.col("fn"),
    })


def score_table(df: DataFrame, label: str = TARGET, score: str = "probability", groups=()) -> DataFrame:
    """Positives and negatives per (group, distinct score), checkpointed: the only pass over ``df``."""
    return cut_lineage(df.groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg")))


def _score_buckets(by_score: DataFrame, g: list[str]) -> DataFrame:
    """Monotone bucket per distinct score, from approximate quantiles of the group's distinct scores.

    A group of at most SCORES_PER_BUCKET distinct scores is one bucket; the cut points of the others are
    one array per group (at most AUC_BUCKETS numbers).
    """
    probs = [i / AUC_BUCKETS for i in range(1, AUC_BUCKETS)]
    large = by_score.groupBy(*g).count().where(F.col("count") > SCORES_PER_BUCKET).select(*g)
    cuts = (by_score.join(large, g, "left_semi").groupBy(*g)
            .agg(F.percentile_approx(F.col("score").cast("double"), probs, 10 * AUC_BUCKETS).alias("_cuts")))
    # number of cut points below the score, by bisection: a step per power of two instead of a comparison per cut
    steps = [1 << i for i in reversed(range(AUC_BUCKETS.bit_length()))]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        F.get("_cuts", at + step - 1) < F.col("score"), at + step).otherwise(at))
    return (by_score.join(cuts, g, "left").withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(below))
            .drop("_cuts"))


def _auc(by_score: DataFrame, g: list[str]) -> DataFrame:
    keyed = _score_buckets(by_score, g)
    wb = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)    # ≤ AUC_BUCKETS rows
    start = (keyed.groupBy(*g, "_b").agg(F.sum("neg").alias("_bneg"))
             .withColumn("_start", F.coalesce(F.sum("_bneg").over(wb), F.lit(0))).drop("_bneg"))
    ws = Window.partitionBy(*g, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (keyed.join(start, g + ["_b"])
              .withColumn("_below", F.col("_start") + F.coalesce(F.sum("neg").over(ws), F.lit(0))))
    agg = ranked.groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") * 0.5)).alias("_num"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(*g, (F.col("_num") / F.nullif(F.col("_p") * F.col("_n"), F.lit(0))).alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = TARGET, score: str = "probability", groups=()) -> DataFrame:
    """Exact ROC AUC (ties count one half) per group; NULL when a class is absent."""
    if groups:
        return _auc(score_table(df, label, score, groups), list(groups))
    return _auc(score_table(df.withColumn("_g", F.lit(0)), label, score, ["_g"]), ["_g"]).drop("_g")


def score_cuts(df: DataFrame, rows: int, score: str = "probability") -> list[float]:
    """Cut points that part ``rows`` scores into ranges of about CELL_SCORES; any cuts give the same AUC."""
    ranges = min(AUC_BUCKETS, -(-rows // CELL_SCORES))
    if ranges < 2:
        return []
    s = F.col(score).cast("double")
    found = df.agg(F.percentile_approx(F.when(~F.isnan(s), s), [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(found or []))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of the stretches of ``values`` between consecutive ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _stretches(values: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """Per range, the ascending distinct values and how many rows have each (no counts where all are one)."""
    values, counts = np.sort(values), np.zeros(0, np.int64)
    if (values[1:] == values[:-1]).any():
        values, counts = np.unique(values, return_counts=True)
    ends = np.concatenate([[0], np.searchsorted(values, cuts, side="right"), [len(values)]])
    return [_binary(values, ends), _binary(counts, ends if len(counts) else ends * 0)]


def _sorted_cells(cuts: list[float]):
    """Rows (group, label, score) -> CELLS: the scores of a group in a range, of each class.  Range 0 holds rows without
    a score, which rank lowest."""
    def cells(held):
        grp, label, score = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(grp, kind="stable") if (grp[1:] < grp[:-1]).any() else slice(None)
        grp, label, score = grp[order], label[order], score[order]
        ends = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
        for a, b in zip(ends, ends[1:]):
            found = [_stretches(score[a:b][label[a:b] == one], np.asarray(cuts)) for one in (1, 0)]
            n = len(cuts) + 1
            batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, grp[a], np.int32)), pa.array(np.arange(1, n + 1, dtype=np.int32)),
                                                *found[0], *found[1]], ["grp", "part", "pos", "pos_n", "neg", "neg_n"])
            yield batch.filter(pa.array([p.as_buffer().size + q.as_buffer().size > 0 for p, q in zip(found[0][0], found[1][0])]))

    def run(batches):
        held, unscored = [], {}
        for batch in batches:
            columns = [batch.column("grp").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False),
                       batch.column("score").to_numpy(zero_copy_only=False)]
            if batch.column("score").null_count:
                none = batch.column("score").is_null().to_numpy(zero_copy_only=False)
                for g, y in zip(columns[0][none].tolist(), columns[1][none].tolist()):
                    unscored.setdefault(g, [0, 0])[1 - y] += 1
                columns = [c[~none] for c in columns]
            held.append(columns)
            if sum(len(h[0]) for h in held) >= HELD_ROWS:
                yield from cells(held)
                held = []
        if any(len(h[0]) for h in held):
            yield from cells(held)
        for g, counts in unscored.items():
            found = [pa.array([np.array(x, t).tobytes()], pa.binary()) for n in counts for x, t in (([0.0] * (n > 0), np.float64), ([n] * (n > 0), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([0], pa.int32()), *found], ["grp", "part", "pos", "pos_n", "neg", "neg_n"])
    return run


def _ranked_cell(cell: pa.Table) -> pa.Table:
    """Rows of both classes of a (group, range), and its pairs in which the positive row ranks higher (ties: one half)."""
    def joined(name):
        values = [np.frombuffer(v.as_buffer()) for v in cell.column(name)]
        counts = [np.frombuffer(c.as_buffer(), np.int64) for c in cell.column(f"{name}_n")]
        if not any(map(len, counts)):
            values = np.sort(np.concatenate(values))
            return values, np.ones(len(values), np.int64)
        values, counts = np.concatenate(values), np.concatenate([c if len(c) else np.ones(len(v), np.int64) for v, c in zip(values, counts)])
        order = np.argsort(values, kind="stable")
        return values[order], counts[order]
    (pos, pos_n), (neg, neg_n) = joined("pos"), joined("neg")
    run = np.concatenate([[0], np.cumsum(neg_n)])
    below, upto = (run[np.searchsorted(neg, pos, side)] for side in ("left", "right"))
    return pa.table([cell.column("grp").slice(0, 1), cell.column("part").slice(0, 1), pa.array([int(pos_n.sum())]), pa.array([int(run[-1])]),
                     pa.array([float((pos_n * (below + upto)).sum()) / 2])], names=["grp", "part", "pos", "neg", "num"])


def auc_by_group(df: DataFrame, group: str, cuts: list[float], label: str = TARGET, score: str = "probability") -> DataFrame:
    """E3 for many groups (numbers) at once: exact ROC AUC (ties count one half); NULL when a class is absent.

    Tasks sort the scores they hold and deal them, by ``cuts``, into ranges that all groups share; each (group, range)
    is ranked by itself, and what lies below it is added from the counts.  Labels are 0, 1 or NULL (left out).
    """
    ship(df.sparkSession)
    rows = df.select(F.col(group).cast("int").alias("grp"), F.col(label).cast("int").alias("label"),
                     F.col(score).cast("double").alias("score")).where("label IS NOT NULL")
    with batches_by_rows(df.sparkSession):
        cells = cut_lineage(rows.mapInArrow(_sorted_cells(cuts), CELLS).groupBy("grp", "part").applyInArrow(
            _ranked_cell, "grp int, part int, pos long, neg long, num double"))           # a row per group and range
    lower = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0))
    return (cells.withColumn("num", F.col("num") + F.col("pos") * below).groupBy(F.col("grp").alias(group))
            .agg((F.sum("num") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc")))


def evaluate(df: DataFrame, label: str = TARGET, score: str = "probability", threshold: float = 0.5,
             groups=()) -> DataFrame:
    """E1-E5 in one row per group: confusion cells, metrics and AUC."""
    g = list(groups) or ["_g"]
    by_score = score_table(df if groups else df.withColumn("_g", F.lit(0)), label, score, g)
    hit = F.col("score") >= threshold
    cm = by_score.groupBy(*g).agg(*(F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name) for name, cond, c in (
        ("tn", ~hit, "neg"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("tp", hit, "pos"))))
    out = metrics_from_confusion(cm).join(_auc(by_score, g), g)           # one row per group on each side
    return out if groups else out.drop("_g")


def classification_report(df: DataFrame, label: str = TARGET, score: str = "probability",
                          threshold: float = 0.5) -> DataFrame:
    """Per-class precision/recall/F1/support, macro and weighted averages, accuracy."""
    cm = confusion(df.withColumn("prediction", (F.col(score) >= threshold).cast("int")), label)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    rows = F.array(
        F.struct(F.lit("0").alias("class"), _safe(tn, tn + fn).alias("precision"), _safe(tn, tn + fp).alias("recall"),
                 _safe(2 * tn, 2 * tn + fn + fp).alias("f1"), (tn + fp).alias("support")),
        F.struct(F.lit("1").alias("class"), _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
                 _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support")),
    )
    per = cm.select(F.explode(rows).alias("r")).select("r.*")
    total = F.sum("support").over(Window.partitionBy(F.lit(1)))   # two rows
    per = per.withColumn("_w", F.col("support") / total)
    summary = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("_w")).alias("wp"), F.sum(F.col("recall") * F.col("_w")).alias("wr"),
        F.sum(F.col("f1") * F.col("_w")).alias("wf"), F.sum("support").alias("n"),
        # accuracy = correct / total; class precisions carry the correct counts
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("acc"))
    extra = summary.select(F.explode(F.array(
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("accuracy").alias("class"), F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                 F.col("acc").alias("f1"), F.col("n").alias("support")),
    )).alias("r")).select("r.*")
    return per.drop("_w").unionByName(extra)


def class_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    """M1: balanced weights ``n / (classes · n_c)`` (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(1))
    return counts.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                         .alias("weight"))


def with_weights(df: DataFrame, label: str = TARGET, out: str = "weight") -> DataFrame:
    """Attach the balanced weight column ``n / (classes · n_c)``; the label must be a class label."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for c, m in counts.items():
        weight = F.when(F.col(label) == c, n / (len(counts) * m)).otherwise(weight)
    return df.withColumn(out, weight)


def majority_class(df: DataFrame, label: str = TARGET) -> int:
    """Most frequent class, ties → smallest."""
    row = (df.groupBy(label).count().orderBy(F.desc("count"), label).first())
    return int(row[0]) if row else 0


def leaderboard_top(board: DataFrame, metric: str = "roc_auc", n: int = 5) -> DataFrame:
    """Top ``n`` models by ``metric`` (name breaks ties)."""
    return board.orderBy(F.desc(metric), "model").limit(n)
