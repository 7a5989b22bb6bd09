"""Command-line jobs: offline training and batch scoring.

    python -m retentio.plans.jobs train --sf-dir /data/tables --out /shared/churn
    python -m retentio.plans.jobs train --input customers.csv --out /shared/churn
    python -m retentio.plans.jobs score --model /shared/churn --input upload.csv --out /shared/scored

Training: split → fit pipeline → held-out metrics → permutation importance → publish model + metadata as a new version.
Scoring: CSV upload (bad lines kept apart) → probabilities, risk, decision, action → sorted CSV, plus
risk counts and advice lines.  Paths must be shared storage on a cluster.
"""

from __future__ import annotations

import argparse
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..constants import DEFAULT_THRESHOLD
from ..operators import reports
from ..operators.scoring import PipelineScorer, prediction_output
from ..session import get_session, written
from ..sources import files as FS
from . import portfolio as P
from .bundle import current, load_published, publish
from .training import FINAL, fit_final, load_model


def train(spark: SparkSession, data: DataFrame, out: str, classifier_name: str = FINAL,
          early_stopping: bool | None = None) -> dict:
    t = fit_final(data, classifier_name, early_stopping)
    version = publish(spark, t, out)
    _, parts = load_published(spark, out, version, checked=False)
    return {"version": version, **parts["metrics"].first().asDict()}


def model_at(spark: SparkSession, path: str) -> PipelineModel:
    """The newest published model in a bundle folder, or the model saved at ``path`` itself."""
    return load_published(spark, path)[0] if current(spark, path) else load_model(path)


def score(spark: SparkSession, model_path: str, upload: str, out: str,
          threshold: float = DEFAULT_THRESHOLD) -> dict:
    good, rejects, error = FS.try_read_batch(spark, upload)
    if error:
        return {"error": error}
    scored = written(prediction_output(PipelineScorer(model_at(spark, model_path)), good, threshold, normalized=True), "scored")
    FS.write_scored_csv(scored, f"{out}/predictions")
    rejects.write.mode("overwrite").text(f"{out}/rejected_lines")
    balance = reports.batch_balance(scored).first().asDict()
    advice = [r["advice"] for r in reports.campaign_advice(scored).orderBy("line").collect()]  # ≤ 3 lines
    return {"balance": balance, "advice": advice, "rejected": rejects.count()}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="retentio")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--input", help="customer CSV/Parquet (English or Spanish headers)")
    t.add_argument("--format", default="csv", choices=["csv", "parquet"])
    t.add_argument("--sf-dir", help="folder with the star-schema tables to derive customers from")
    t.add_argument("--out", required=True)
    t.add_argument("--classifier", default=FINAL)
    t.add_argument("--early-stopping", action=argparse.BooleanOptionalAction, default=None)
    s = sub.add_parser("score")
    s.add_argument("--model", required=True)
    s.add_argument("--input", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--threshold", type=float, default=DEFAULT_THRESHOLD)
    args = ap.parse_args(argv)
    spark = get_session()
    if args.cmd == "train":
        data = FS.read_customers(spark, args.input, args.format) if args.input else P.customers(spark, args.sf_dir)
        print(json.dumps(train(spark, data, args.out, args.classifier, args.early_stopping), default=str))
    else:
        print(json.dumps(score(spark, args.model, args.input, args.out, args.threshold), default=str))


if __name__ == "__main__":
    main()
