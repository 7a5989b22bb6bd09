"""Streaming portfolio scoring.

Scoring (M6) is stateless given a fitted scorer, so the same projection runs
on a file stream: new customer CSV files arriving in a folder are normalised,
scored and appended to a Parquet sink.  The checkpoint folder (in the shared
checkpoint area) makes the query restartable with exactly-once file output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..constants import DEFAULT_THRESHOLD
from ..functions.schema import complete, normalize
from ..operators.scoring import RuleScorer, prediction_output
from ..sources.files import NoHeader, read_customers, text_schema


def start_scoring_stream(spark: SparkSession, source_dir: str, columns: list[str], sink_dir: str,
                         checkpoint_dir: str, scorer=None, threshold: float = DEFAULT_THRESHOLD,
                         available_now: bool = True, max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Stream CSV uploads (header, text columns) → scored rows appended to Parquet.

    A stream has one schema: a file whose header differs from ``columns`` stops the query instead of filling wrong columns.
    """
    scorer = scorer or RuleScorer()
    stream = (spark.readStream.schema(text_schema(columns)).option("header", True).option("enforceSchema", False)
              .option("escape", '"').option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir))
    scored = prediction_output(scorer, complete(normalize(stream)), threshold)
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def start_upload_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, scorer=None,
                        threshold: float = DEFAULT_THRESHOLD, available_now: bool = True,
                        max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Stream CSV uploads of any header, language and column order → scored rows in Parquet, one folder per batch.

    The stream carries file names only; every batch reads its files by their own headers.  A batch overwrites the
    folder ``batch=<number>``, so one that is repeated after a failure leaves each row once.  At most
    ``max_files_per_trigger`` names reach the driver.  Files without a header line give no rows.
    """
    scorer = scorer or RuleScorer()
    names = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir).where("length > 0").select("path"))

    def score(batch: DataFrame, number: int) -> None:
        files = [row["path"] for row in batch.collect()]
        try:
            rows = read_customers(batch.sparkSession, files) if files else None
        except NoHeader:
            rows = None
        if rows is not None:
            rows = prediction_output(scorer, rows, threshold, normalized=True)
            rows.write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

    writer = names.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
