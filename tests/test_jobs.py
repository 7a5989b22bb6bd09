"""The command-line jobs: train on derived customers, then score a Spanish-header upload."""

from retentio.plans import jobs
from retentio.plans import portfolio as P
from retentio.session import shared_scratch
from retentio.sources import files as FS
from retentio.sources.customers import source_frame


def test_train_then_score(spark, sf_small):
    out = shared_scratch(spark, "t-job")
    metrics = jobs.train(spark, P.customers(spark, sf_small), out, classifier_name="logistic_regression")
    assert 0.0 <= metrics["roc_auc"] <= 1.0 and metrics["tp"] + metrics["fn"] + metrics["tn"] + metrics["fp"] > 0
    upload = shared_scratch(spark, "t-upload")
    text = FS.as_text(source_frame(spark, sf_small, "spanish"))
    text.write.mode("overwrite").option("header", True).csv(upload)
    res = jobs.score(spark, out, upload, shared_scratch(spark, "t-scored"))
    bal = res["balance"]
    assert bal["total"] == 150 and bal["high"] + bal["medium"] + bal["low"] == 150
    assert res["rejected"] == 0 and res["advice"][-1].startswith("Download")
    out = f"{out}/versions/{metrics['version']}"
    assert spark.read.json(f"{out}/metrics").count() == 1
    assert spark.read.json(f"{out}/importance").count() == 23
    record = spark.read.json(f"{out}/training").first()
    assert record["dataset_rows"] == 150 and record["train_rows"] + record["test_rows"] == 150
    assert record["target"] == "churned" and record["trained_at"] and record["parameters"]["maxIter"] == "600"


def test_missing_model_and_metadata(spark):
    import pytest
    from retentio.plans.training import load_model, read_metadata
    missing = shared_scratch(spark, "t-missing")
    with pytest.raises(FileNotFoundError):
        load_model(f"{missing}/model")
    parts = read_metadata(spark, missing)
    assert set(parts) == {"training", "metrics", "report", "importance", "test_predictions"}
    assert all(df.count() == 0 for df in parts.values())
