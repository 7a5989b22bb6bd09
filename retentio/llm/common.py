"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_scratch, shared_scratch, ship  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lean(run):
    """A batch function that leaves little behind in its Python worker, which later stages reuse: what a task no longer
    needs goes back to the system at its end.  Its data hold no cycles, so the search for them is off meanwhile."""
    @wraps(run)
    def task(batches):
        import pyarrow as pa
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)        # glibc
            if trim is not None:
                trim(0)
    return task


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    df.write.parquet(path, **options)
    again = spark.read.schema(df.schema).parquet(path)
    again.scratch = path
    return again


def dropped(df: DataFrame) -> None:
    """Remove the folder of a frame that :func:`written` returned, after its last reader."""
    remove_scratch(df.sparkSession, df.scratch)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value's decimal text, modulo ``n``."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written with a row number, and that column's name (one that ``docs`` does not have)."""
    taken, row = {c.lower() for c in docs.columns}, "_row"
    while row in taken:
        row += "_"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row
