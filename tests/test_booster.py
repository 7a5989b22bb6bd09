"""The leaf-wise booster against a plain Python version, and the same trees however rows are split."""

import heapq
import json
import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from retentio.constants import ID, TARGET
from retentio.operators import booster
from retentio.operators.booster import LeafwiseBooster, LeafwiseModel


def _rows(spark, n, seed=3, missing=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = [float(rng.normal()), float(rng.integers(0, 4)), float(rng.normal()), float(rng.integers(0, 2))]
        y = int(rng.random() < 1 / (1 + math.exp(-(2 * x[0] * (x[1] - 1.5) + x[3]))))
        if missing and i % 9 == 0:
            x[0] = float("nan")
        rows.append((i, y, 1.0 + (i % 3) / 2, i % 10 == 0, x))
    df = spark.createDataFrame(rows, f"{ID} long, {TARGET} int, weight double, held boolean, x array<double>")
    return df.withColumn("selected", array_to_vector("x")), rows


def _plain(rows, bounds, first, trees, leaves, l2, rate, min_rows):
    """Best-first boosting row by row in plain Python, over the same bins and rounded gradients."""
    bins = [[booster.MISSING if math.isnan(v) else sum(v > b for b in bounds[f]) for f, v in enumerate(r[4])] for r in rows]
    score, fitted = [first] * len(rows), []
    for _ in range(trees):
        g, h = [], []
        for (_, y, w, _, _), s in zip(rows, score):
            p = 1 / (1 + math.exp(-s))
            g.append(round(w * (p - y) * booster.FIXED))
            h.append(round(w * p * (1 - p) * booster.FIXED))

        def totals(members):
            return sum(g[i] for i in members) / booster.FIXED, sum(h[i] for i in members) / booster.FIXED

        def strength(members):
            a, b = totals(members)
            return a * a / (b + l2)

        def best(members):
            found = None
            missing = any(bins[i][f] == booster.MISSING for i in members for f in range(len(bounds)))
            for side in (False, True) if missing else (False,):
                for f in range(len(bounds)):
                    for cut in range(booster.MISSING):
                        left = [i for i in members if (side if bins[i][f] == booster.MISSING else bins[i][f] <= cut)]
                        if min(len(left), len(members) - len(left)) < min_rows:
                            if len(members) - len(left) < min_rows and cut >= len(bounds[f]):
                                break
                            continue
                        rest = sorted(set(members) - set(left))
                        gain = strength(left) + strength(rest) - strength(members)
                        if gain > 0 and (found is None or gain > found[0] + 1e-9):
                            found = (gain, f, cut, side, left, rest)
            return found
        everyone = list(range(len(rows)))
        parts, heap, tick = [everyone], [], 0
        split = best(everyone)
        if split:
            heapq.heappush(heap, (-split[0], tick, split, everyone))
        while heap and len(parts) < leaves:
            _, _, (_, _, _, _, left, rest), members = heapq.heappop(heap)
            parts.remove(members)
            parts += [left, rest]
            for part in (left, rest):
                tick += 1
                if split := best(part):
                    heapq.heappush(heap, (-split[0], tick, split, part))
        for part in parts:
            a, b = totals(part)
            for i in part:
                score[i] += -rate * a / (b + l2)
        fitted.append(len(parts))
    return score, fitted


def test_trees_equal_plain_python(spark):
    df, rows = _rows(spark, 160)
    model = LeafwiseBooster(weightCol="weight", maxIter=3, maxLeaves=6, minLeafRows=8, stepSize=0.3).fit(df)
    weight = sum(r[2] for r in rows)
    ones = sum(r[2] * r[1] for r in rows)
    bounds = booster.thresholds(df.select("x"))
    score, sizes = _plain(rows, bounds, math.log(ones / (weight - ones)), 3, 6, 0.1, 0.3, 8)
    got = {r[0]: r.p for r in model.transform(df).select(ID, vector_to_array("probability")[1].alias("p")).collect()}
    assert all(abs(got[r[0]] - 1 / (1 + math.exp(-s))) < 1e-6 for r, s in zip(rows, score))
    assert [sum(left < 0 for left in t["left"]) for t in json.loads(model.getOrDefault("trees"))] == sizes


def test_same_trees_for_any_split_of_the_rows(spark):
    df, _ = _rows(spark, 1500)
    options = dict(weightCol="weight", validationIndicatorCol="held", maxIter=13, maxLeaves=20)
    one = LeafwiseBooster(**options).fit(df)
    assert len(json.loads(one.getOrDefault("trees"))) > booster.STORED
    for parts, block in ((1, 100), (7, 100), (70, 16)):
        other = LeafwiseBooster(blockRows=block, **options).fit(df.repartition(parts))
        assert other.getOrDefault("trees") == one.getOrDefault("trees")
        assert other.history() == one.history()


def test_loss_falls_and_tables_score_alike(spark, tmp_path):
    df, _ = _rows(spark, 600)
    model = LeafwiseBooster(weightCol="weight", maxIter=12, minLeafRows=10).fit(df)
    train = model.history()["train"]
    assert len(train) == 13 and all(b < a for a, b in zip(train, train[1:])) and not model.history()["held"]
    scored = model.scored_by_rules(model.transform(df).select(ID, "selected", vector_to_array("probability")[1].alias("p")))
    assert scored.filter("abs(p - rule_probability) < 1e-9").count() == 600
    model.write().overwrite().save(str(tmp_path / "m"))
    again = LeafwiseModel.load(str(tmp_path / "m")).transform(df)
    assert again.select("probability").collect() == model.transform(df).select("probability").collect()
    assert model.nodes(spark).filter("left < 0").count() == model.leaf_rules(spark).count()


def test_early_stopping_on_noise(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, int(rng.integers(0, 2)), i % 5 == 0, [float(v) for v in rng.normal(size=3)]) for i in range(800)],
                               f"{ID} long, {TARGET} int, held boolean, x array<double>").withColumn("selected", array_to_vector("x"))
    model = LeafwiseBooster(validationIndicatorCol="held", patience=4).fit(df)
    held = model.history()["held"]
    assert len(held) < 60 and min(held[-4:]) >= held[-5] - booster.TOLERANCE


def test_odd_tables(spark):
    df, _ = _rows(spark, 60)
    few = LeafwiseBooster(maxIter=2).fit(df.limit(30))                    # too few rows for any split: no trees
    assert json.loads(few.getOrDefault("trees")) == [] and few.scored_by_rules(few.transform(df)).count() == 60
    for wrong in (df.limit(0), df.filter(f"{TARGET} = 1"), df.withColumn(TARGET, F.lit(None).cast("int"))):
        try:
            LeafwiseBooster(maxIter=2).fit(wrong)
            raise AssertionError
        except ValueError as e:
            assert "both classes" in str(e)


def test_bit_sets_reach_the_leaves_of_a_walk():
    """Trees of more than 64 and 128 leaves, chains included, with missing values."""
    rng = np.random.default_rng(4)
    for leaves, chain in ((2, False), (63, False), (64, True), (65, False), (150, True), (200, False)):
        tree, open_ = booster.Tree(), [0]
        tree.add()
        while len(open_) < leaves:
            n = open_.pop(-1 if chain else int(rng.integers(len(open_))))
            tree.feature[n], tree.bin[n], tree.missing_left[n] = int(rng.integers(5)), int(rng.integers(0, 255)), bool(rng.integers(2))
            tree.left[n], tree.right[n] = tree.add(), tree.add()
            open_ += [tree.left[n], tree.right[n]]
        tree.value = rng.normal(size=len(tree.left)).tolist()
        bins = rng.integers(0, 256, (5, 700)).astype(np.uint8)
        bins[:, ::7] = booster.MISSING
        walked = []
        for column in bins.T:
            n = 0
            while tree.left[n] >= 0:
                b = column[tree.feature[n]]
                n = tree.left[n] if (tree.missing_left[n] if b == booster.MISSING else b <= tree.bin[n]) else tree.right[n]
            walked.append(n)
        assert tree.routes().leaves(bins).tolist() == walked
        assert tree.routes().added(bins).tolist() == [tree.value[n] for n in walked]


def test_rules_walk_beside_broadcast_nodes(spark):
    """The check never multiplies rows by trees: no rows are generated, grouped or joined by key."""
    df, _ = _rows(spark, 200)
    model = LeafwiseBooster(maxIter=4, minLeafRows=10).fit(df)
    ruled = model.scored_by_rules(model.transform(df).select(ID, "selected", vector_to_array("probability")[1].alias("p")))
    plan = ruled._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Join Cross" in plan
    assert ruled.filter("abs(p - rule_probability) < 1e-9").count() == 200


def test_blocks_of_few_files_have_a_task_each(spark):
    """Small files are read together; the blocks must not be."""
    df, _ = _rows(spark, 400)
    rows = df.coalesce(1).select(F.col("x"), F.col(TARGET).cast("double").alias("y"), F.col("weight").alias("w"), F.lit(0).alias("v"))
    boosting = booster.Boosting(rows, booster.thresholds(rows), 0.0, 100, 400)
    try:
        assert boosting.blocks.getNumPartitions() == 4
        assert [n > 0 for n in boosting.blocks.mapPartitions(lambda b: [sum(1 for _ in b)]).collect()] == [True] * 4
    finally:
        boosting.close()


def test_sums_added_by_tasks_give_the_same_trees(spark, monkeypatch):
    df, _ = _rows(spark, 400)
    fits = []
    for direct in (64, 1):
        monkeypatch.setattr(booster, "DIRECT_SUMS", direct)
        fits.append(LeafwiseBooster(maxIter=2, maxLeaves=5, blockRows=100).fit(df).getOrDefault("trees"))
    assert fits[0] == fits[1] and len(json.loads(fits[0])) == 2


def test_a_feature_has_as_many_sums_as_bins(spark):
    """What a wave returns grows with the bins there are: 29 cells for features of 22, 1 and 0 thresholds, not 3 x 256."""
    cells = booster.Cells([22, 1, 0])
    rng = np.random.default_rng(2)
    n = 500
    bins = np.array([rng.integers(0, 23, n), rng.integers(0, 2, n), np.zeros(n)], np.uint8)
    bins[0, ::9] = booster.MISSING
    label, tree = (rng.random(n) < 0.4).astype(float), booster.Tree()
    tree.add()
    block = [bins.tobytes(), label.tobytes(), np.ones(n).tobytes(), np.zeros(n, np.uint8).tobytes(), np.zeros(n).tobytes()]
    found = booster.histograms([block], [], tree, [0], cells)
    assert len(found) == (24 + 3 + 2) * 3 + 4
    sums = found[:-4].reshape(1, -1, 3)
    assert [int(sums[0, cells.feature == f, 2].sum()) for f in range(3)] == [n] * 3
    # the best split against every split tried by itself
    g, h = (v / booster.FIXED for v in booster.gradients(label, np.ones(n), np.zeros(n)))
    tried = []
    for missing_left in (False, True):
        for f in range(3):
            for b in range([23, 2, 1][f]):
                left = (bins[f] <= b) | ((bins[f] == booster.MISSING) & missing_left)
                if 20 <= left.sum() <= n - 20:
                    tried.append((sum(g[s].sum() ** 2 / (h[s].sum() + 0.1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 0.1),
                                  f, b, missing_left, int(left.sum())))
    top = max(tried, key=lambda t: t[0])
    [got] = booster.best_splits(sums, cells, 0.1, 20)
    assert got[1:] == top[1:] and math.isclose(got[0], top[0], rel_tol=1e-6)


def test_features_with_few_bins_share_a_byte():
    """A wave over packed blocks, with missing values, gives the sums, loss and routes of blocks with a row per feature."""
    import pickle
    sizes = [254, 21, 10, 1, 1, 0, 1, 1, 1, 1, 2]
    planes, rng, n = booster.Planes(sizes), np.random.default_rng(6), 3000
    assert planes.count == 4 and pickle.loads(pickle.dumps(planes)) == planes        # 10 x 256 codes before
    bins = np.array([rng.integers(0, s + 1, n) for s in sizes], np.uint8)
    bins[rng.random(bins.shape) < 0.1] = booster.MISSING
    packed = planes.packed(bins)
    for f, s in enumerate(sizes):
        row, digits, missing = planes.layout(f)
        assert np.where(digits[packed[row]] == missing, booster.MISSING, digits[packed[row]]).tolist() == bins[f].tolist()
    rest = [c.tobytes() for c in ((rng.random(n) < 0.3).astype(float), rng.random(n), (rng.random(n) < 0.1).astype(np.uint8), rng.normal(size=n))]
    cells = booster.Cells(sizes)
    trees = []

    def ask(block, how):
        def sums(tree, wanted):
            found = booster.histograms([block], trees, tree, wanted, cells, how)
            return found[:-4].reshape(len(wanted), -1, 3), found[-4:]
        return sums
    for _ in range(3):
        (a, ends), (b, same) = (booster.grow(ask([m.tobytes(), *rest], how), cells, 20, 0.1, 0.3, 20)
                                for m, how in ((bins, None), (packed, planes)))
        assert vars(a) == vars(b) and ends.tolist() == same.tolist() and len(a.left) > 20
        assert a.routes().leaves(bins).tolist() == b.routes(planes).leaves(packed).tolist()
        trees.append(a)
