"""Corpus pipeline: toxicity, quality rules, SimHash near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet to the shared folder and read again as the next stage's ``docs``.  The first
three return the columns of ``documents``, the last one the pieces of the packed sequences.

Edge cases are those of the operators: null texts count as empty (they fail the quality rules),
repeated rows are judged one by one and all but one go as near-duplicates, empty tables pass
through, and extra columns of ``documents`` are carried unchanged to the last stage.

No single SQL statement expresses the stages (a learned classifier, 64-bit text hashes and a
tokenizer); tests compare each of them with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retentio.llm.common import documents, written
from retentio.llm.hilbert_pack import pack
from retentio.llm.line_quality import drop_poor
from retentio.llm.queries import shipped
from retentio.llm.simhash import keep_first
from retentio.llm.token_ids import public_path
from retentio.llm.toxicity import drop_toxic


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all remaining documents."""
    return pack(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near-duplicates", keep_first),
    ("packing", packing),
]
STAGES = [(name, shipped(stage)) for name, stage in STAGES]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
