"""Published bundles: a killed publish leaves the earlier version readable, damage is noticed."""

import pytest

from retentio.plans import bundle as B
from retentio.plans import portfolio as P
from retentio.plans import training as TR
from retentio.session import shared_scratch


@pytest.fixture(scope="module")
def fitted(spark, sf_small):
    t = TR.fit_final(P.customers(spark, sf_small), "logistic_regression")
    return t, spark.createDataFrame([("age", 0.1, 0.0)], "variable string, importance_mean double, importance_std double")


def test_publish_and_read(spark, fitted):
    folder = shared_scratch(spark, "t-bundle")
    with pytest.raises(FileNotFoundError):
        B.load_published(spark, folder)
    first = B.publish(spark, fitted[0], folder, fitted[1])
    second = B.publish(spark, fitted[0], folder, fitted[1])
    assert first < second == B.current(spark, folder) and B.versions(spark, folder).count() == 2
    model, parts = B.load_published(spark, folder)
    assert len(model.stages) == 5 and parts["importance"].count() == 1
    assert parts["test_predictions"].count() == fitted[0].test_scored.count()
    assert B.verify(spark, folder, first) == first


def test_a_killed_publish_leaves_the_earlier_bundle(spark, fitted, monkeypatch):
    folder = shared_scratch(spark, "t-bundle")
    first = B.publish(spark, fitted[0], folder, fitted[1])

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(B, "save_metadata", killed)
    with pytest.raises(RuntimeError):
        B.publish(spark, fitted[0], folder, fitted[1])
    assert B.current(spark, folder) == first
    model, parts = B.load_published(spark, folder)
    assert parts["training"].count() == 1 and model.stages


def test_damage_is_noticed(spark, fitted):
    folder = shared_scratch(spark, "t-bundle")
    version = B.publish(spark, fitted[0], folder, fitted[1])
    home = f"{folder}/versions/{version}"
    kept = spark.read.parquet(f"{home}/test_predictions").collect()
    fewer = spark.createDataFrame(kept[:-1], fitted[0].test_scored.select("customer_id", "churned", "probability").schema)
    fewer.write.mode("overwrite").parquet(f"{home}/test_predictions")
    with pytest.raises(B.DamagedBundle, match="test_predictions"):
        B.load_published(spark, folder)


def test_checksums_ignore_order_and_see_repeats(spark):
    rows = spark.range(100).selectExpr("id", "if(id % 7 = 0, null, id) AS v")
    assert B.checksum(rows) == B.checksum(rows.orderBy(rows.id.desc()).repartition(7))
    assert B.checksum(rows) != B.checksum(rows.union(rows.limit(1)))
    assert B.checksum(rows.limit(0)) == (0, "0")
