import math

from pyspark.sql import functions as F

from retentio.operators import evaluate as E
from retentio.operators import sampling as S


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "churned int, probability double")
    assert E.roc_auc(df).first()["roc_auc"] == 0.875
    flipped = df.withColumn("probability", -F.col("probability"))
    assert math.isclose(E.roc_auc(flipped).first()["roc_auc"], 1 - 0.875)
    tied = df.withColumn("probability", F.lit(0.3))
    assert E.roc_auc(tied).first()["roc_auc"] == 0.5
    one_class = df.where("churned = 1")
    assert E.roc_auc(one_class).first()["roc_auc"] is None


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2)], "churned int, probability double")
    row = E.evaluate(df).first()
    assert row["precision"] == 0.0 and row["recall"] == 0.0 and row["f1"] == 0.0
    assert row["accuracy"] == 0.5 and row["balanced_accuracy"] == 0.5


def test_report_and_weights(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.7), (1, 0.8), (1, 0.9), (1, 0.3)], "churned int, probability double")
    rep = {r["class"]: r for r in E.classification_report(df).collect()}
    assert rep["1"]["support"] == 3 and math.isclose(rep["1"]["recall"], 2 / 3)
    assert math.isclose(rep["accuracy"]["precision"], 3 / 5)
    w = {r["churned"]: r["weight"] for r in E.class_weights(df).collect()}
    assert math.isclose(w[0], 5 / 4) and math.isclose(w[1], 5 / 6)


def test_split_sizes_exact_and_partition_independent(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "customer_id long, churned int")
    a = S.stratified_split(df.repartition(1))
    b = S.stratified_split(df.repartition(8))
    counts = {(r["churned"], r["split"]): r["count"] for r in a.groupBy("churned", "split").count().collect()}
    n1 = sum(1 for _, y in rows if y == 1)
    assert counts[(1, "train")] == math.floor(0.8 * n1 + 0.5)
    assert counts[(0, "train")] == math.floor(0.8 * (2000 - n1) + 0.5)
    sa = {r["customer_id"]: r["split"] for r in a.collect()}
    sb = {r["customer_id"]: r["split"] for r in b.collect()}
    assert sa == sb


def test_downsample_keeps_shares(spark):
    rows = [(i, int(i % 4 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "customer_id long, churned int")
    small = S.stratified_downsample(df, max_rows=100)
    got = {r["churned"]: r["count"] for r in small.groupBy("churned").count().collect()}
    assert got == {0: 75, 1: 25}
    assert S.stratified_downsample(df, max_rows=5000).count() == 1000


def test_grouped_auc_equals_ungrouped_with_cut_points(spark, monkeypatch):
    monkeypatch.setattr(E, "SCORES_PER_BUCKET", 20)
    monkeypatch.setattr(E, "AUC_BUCKETS", 16)
    rows = [("a" if i % 3 else "b", int((i * 7919) % 11 > 5), ((i * 104729) % 400) / 400) for i in range(900)]
    df = spark.createDataFrame(rows, "model string, churned int, probability double")
    both = {r["model"]: r["roc_auc"] for r in E.roc_auc(df, groups=["model"]).collect()}
    for name, auc in both.items():
        pos = [p for m, y, p in rows if m == name and y == 1]
        neg = [p for m, y, p in rows if m == name and y == 0]
        exact = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert math.isclose(auc, exact) and math.isclose(E.roc_auc(df.where(F.col("model") == name)).first()[0], exact)


def test_grouped_auc_has_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.4)], "model string, churned int, probability double")
    plan = E.roc_auc(df, groups=["model"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_b#" in line for line in windows)


def test_split_with_finer_buckets_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(3000)], "customer_id long, churned int")
    plain = {r["customer_id"]: r["split"] for r in S.stratified_split(df).collect()}
    monkeypatch.setattr(S, "ROWS_PER_BUCKET", 0.1)
    assert S.bucket_digits(3000) > S.MIN_HEX_DIGITS
    assert {r["customer_id"]: r["split"] for r in S.stratified_split(df).collect()} == plain


def test_split_flags_rows_without_join_or_window(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "customer_id long, churned int")
    plan = S.stratified_split(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_a_target_with_many_values_is_refused(spark):
    import pytest
    df = spark.range(5000).selectExpr("id AS customer_id", "cast(id AS int) AS churned")
    with pytest.raises(ValueError, match="class label"):
        S.stratified_split(df)


def test_importance_uses_every_row_in_bounded_buckets(spark):
    from retentio.operators.importance import permutation_importance

    class ByAge:
        def with_probability(self, df, out="probability"):
            return df.withColumn(out, F.col("age") / 100)
    rows = [(i, int(i % 4 == 0), 60.0 + i % 7 if i % 4 == 0 else 20.0 + i % 7, float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "customer_id long, churned int, age double, returns_rate double")
    got = {r["variable"]: r["importance_mean"] for r in permutation_importance(
        df, ByAge(), ["age", "returns_rate"], repeats=2, rows_per_bucket=50).collect()}
    assert got["returns_rate"] == 0 and 0.4 < got["age"] < 0.6


def test_cut_points_are_found_by_bisection(spark, monkeypatch):
    """A bucket is the number of cuts below the score, with a few steps instead of a comparison per cut."""
    monkeypatch.setattr(E, "SCORES_PER_BUCKET", 20)
    df = spark.createDataFrame([("a", i / 977) for i in range(900)] + [("b", 0.5)], "g string, score double")
    found = E._score_buckets(df, ["g"])
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
    cuts = (df.where("g = 'a'").agg(F.percentile_approx("score", [i / E.AUC_BUCKETS for i in range(1, E.AUC_BUCKETS)], 10 * E.AUC_BUCKETS)).first()[0])
    got = {(r.g, r.score): r._b for r in found.collect()}
    assert got.pop(("b", 0.5)) == 0
    assert got == {("a", i / 977): sum(c < i / 977 for c in cuts) for i in range(900)}


def test_importance_variants_are_dealt_to_every_core(spark):
    """The grid of a few small buckets is scored by many tasks: adaptive execution would join the buckets to one."""
    from retentio.operators.importance import permutation_importance
    seen = []

    class ByAge:
        def with_probability(self, df, out="probability"):
            if "variable" in df.columns:
                seen.append(df.select(F.spark_partition_id().alias("p")).distinct().count())
            return df.withColumn(out, F.col("age") / 100)
    names = ["age", *(f"x{i}" for i in range(11))]
    rows = [(i, int(i % 4 == 0), *(float((i * (7 + j)) % 83) for j in range(12))) for i in range(400)]
    df = spark.createDataFrame(rows, f"customer_id long, churned int, {', '.join(f'{c} double' for c in names)}")
    for per_bucket in (400, 50):                                # 1 and 8 buckets
        permutation_importance(df, ByAge(), names, repeats=2, rows_per_bucket=per_bucket)
    assert seen[0] >= 10 and seen[1] >= 10, seen


def _pairs_won(rows) -> float | None:
    """AUC by comparing all pairs; a missing score ranks lowest, NaN highest."""
    rank = lambda s: (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s)
    pos, neg = ([rank(s) for y, s in rows if y == k] for k in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_of_many_groups_from_sorted_arrays(spark):
    """Interleaved groups, ties, missing, NaN and signed zero scores, null labels, one class only; any cuts."""
    import random
    dice = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.25, 0.25]
    rows = [(dice.choice([-1, 3, 70]), dice.choice([0, 0, 1, None]), dice.choice([*odd, dice.random(), dice.random()])) for _ in range(900)]
    rows += [(9, 1, 0.5), (9, 1, 0.7)]
    df = spark.createDataFrame(rows, "g int, churned int, probability double").repartition(3)
    for cuts in ([], [0.0], [0.1, 0.25, 0.8]):
        got = {r.g: r.roc_auc for r in E.auc_by_group(df, "g", cuts).collect()}
        assert got.keys() == {-1, 3, 70, 9}
        for g, found in got.items():
            exact = _pairs_won([(y, s) for h, y, s in rows if h == g])
            assert found == exact or math.isclose(found, exact), (cuts, g)


def test_a_task_ships_sorted_arrays_not_a_row_per_score(spark):
    df = spark.range(40_000, numPartitions=1).selectExpr("CAST(id % 4 AS INT) AS grp", "CAST(id % 3 = 0 AS INT) AS label", "rand(3) AS score")
    cells = df.mapInArrow(E._sorted_cells([0.3, 0.6]), E.CELLS).collect()
    assert len(cells) == 12 and {(r.grp, r.part) for r in cells} == {(g, p) for g in range(4) for p in (1, 2, 3)}
    assert sum(len(r.pos) + len(r.neg) for r in cells) == 8 * 40_000 and not any(r.pos_n or r.neg_n for r in cells)


def test_importance_counts_no_row_per_score(spark, monkeypatch):
    """A (variant, score) table is as long as the whole grid: the bundle's importance ran out of time over it."""
    from retentio.operators.importance import permutation_importance

    def tabled(*_, **__):
        raise AssertionError("a row per distinct score of a variant")

    class ByAge:
        def with_probability(self, df, out="probability"):
            return df.withColumn(out, F.col("age") / 100)
    monkeypatch.setattr(E, "score_table", tabled)
    df = spark.createDataFrame([(i, i % 2, float(i * 7 % 50)) for i in range(200)], "customer_id long, churned int, age double")
    assert permutation_importance(df, ByAge(), ["age"], repeats=2).count() == 1


def test_importance_permutes_in_hash_order_whatever_the_keys(spark):
    """Compared with the definition in plain Python: string keys, short, longer than a digest's block, not ASCII, null."""
    import hashlib
    import statistics

    from retentio.operators.importance import permutation_importance

    class ByBoth:
        def with_probability(self, df, out="probability"):
            return df.withColumn(out, F.col("a") / 10 + F.coalesce(F.length("b"), F.lit(0)))
    keys = [*(f"k{i}" for i in range(40)), *(f"{i}" * 70 for i in range(3)), "\u00e9\u4e2d", "", None]
    rows = [(k, int(i % 3 == 0), float(i * 7 % 13), None if i % 11 == 0 else "x" * (i % 4)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "customer_id string, churned int, a double, b string")
    got = {r.variable: r for r in permutation_importance(df, ByBoth(), ["a", "b"], repeats=3).collect()}

    def auc(values):
        return _pairs_won([(y, a / 10 + len(b or "")) for (_, y, *_), (a, b) in zip(rows, values)])
    base = auc([r[2:] for r in rows])
    for at, name in enumerate(["a", "b"]):
        drops = []
        for r in range(3):
            order = sorted(range(len(rows)), key=lambda i: hashlib.md5(":".join([*([] if rows[i][0] is None else [rows[i][0]]), name, str(r)]).encode()).hexdigest())
            following = dict(zip(order, order[1:] + order[:1]))
            drops.append(base - auc([tuple(rows[following[i]][2 + c] if c == at else rows[i][2 + c] for c in range(2)) for i in range(len(rows))]))
        assert math.isclose(got[name].importance_mean, statistics.fmean(drops), abs_tol=1e-12)
        assert math.isclose(got[name].importance_std, statistics.pstdev(drops), abs_tol=1e-12)


def test_digests_of_many_texts_equal_the_library():
    import hashlib

    import numpy as np
    import pyarrow as pa
    from retentio.operators.digests import Prefixes, hash_order
    texts = ["", "7:", "12:", "1234567:", "\u00e9:", "x" * 40, *(f"{i}:" for i in range(300))]
    for more in ([], ["y" * 54], ["z" * 200]):                 # one block; one block but not with the suffix; several
        for suffixes in ([b"age:0"], [b"age:0", b"a:11", b""]):
            high, low = Prefixes.of(pa.array([*texts, *more])).digests(suffixes)
            for h, l, s in zip(high, low, suffixes):
                exact = [hashlib.md5(t.encode() + s).hexdigest() for t in [*texts, *more]]
                assert [f"{int(a):016x}{int(b):016x}" for a, b in zip(h, l)] == exact
                assert hash_order(h, l).tolist() == sorted(range(len(exact)), key=exact.__getitem__)
    same = np.array([5, 5, 1, 5], np.uint64)
    assert hash_order(same, np.array([9, 2, 7, 2], np.uint64)).tolist() == [2, 1, 3, 0]


def test_the_rule_scorer_reads_what_it_names(spark, sf_small):
    from retentio.operators.scoring import RuleScorer
    from retentio.plans import portfolio as P
    df, scorer = P.customers(spark, sf_small), RuleScorer()
    few = scorer.with_probability(df.select("customer_id", *scorer.reads))
    assert few.select("customer_id", "probability").exceptAll(scorer.with_probability(df).select("customer_id", "probability")).count() == 0
