"""File sources and sinks.

CSV is read with every column as text and typed afterwards by the schema
normaliser (P1-P4), so unparsable cells become NULL instead of failing the
job, and headers may be English or Spanish.  Columns are found by name per
file: files are grouped by their header line, each group is read with its own
columns, and the normalised groups are united by name.  Quotes inside quoted
cells are doubled; ``multi_line`` allows line breaks in quoted cells.  Rows
with too few cells are kept with NULLs; rows with too many are rejected.
"""

from __future__ import annotations

import csv
import io
import re
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ID, TARGET
from ..functions.schema import complete, normalize
from ..session import ship

CORRUPT, EXTRA = "_corrupt_record", "_one_cell_too_many"


class NoHeader(ValueError):
    """No file of an upload has a header line."""


RECORD_BYTES = 1 << 20             # a header record is at most this long
BLOCK_BYTES = 1 << 13
LOCAL = re.compile(r"^file:/+")


def file_system(path: str):
    """(Arrow file system, path in it) as a task opens it, or None for a store that only Spark reaches."""
    if LOCAL.match(path):
        return fs.LocalFileSystem(), LOCAL.sub("/", path)
    try:
        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    except (OSError, ValueError):
        return None


def first_record(stream, limit: int = RECORD_BYTES) -> str:
    """The first record of a CSV stream that is not blank; reading stops behind the block that ends it.

    A line break inside quotes belongs to the record.  An empty stream gives the empty text.
    """
    data, start, at = b"", 0, 0
    while True:
        block = stream.read(BLOCK_BYTES)
        data += block
        while True:
            end = data.find(b"\n", at)
            if end < 0 and not block:
                end = len(data)
            if end < 0:
                at = len(data)
                break
            if block and data.count(b'"', start, end) % 2:          # inside quotes
                at = end + 1
                continue
            record = data[start:end].decode("utf-8-sig", "replace").rstrip("\r")
            if record.strip() or end == len(data):
                return record
            start = at = end + 1
        if len(data) - start > limit:
            raise ValueError(f"the header record is longer than {limit} bytes")


def _first_records(batches):
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            store, inner = file_system(path)
            with store.open_input_stream(inner, compression="detect", buffer_size=BLOCK_BYTES) as stream:
                found.append(first_record(stream))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["file", "header"])


def header_catalogue(spark: SparkSession, path) -> DataFrame:
    """(file, header) of every file under ``path``, a path or a list of paths.

    Tasks open each file and stop after its first record.  In a store that Arrow cannot open, Spark scans the lines
    instead (and a header ends at its first line break).
    """
    files = spark.read.format("binaryFile").load(path).select("path")          # lists, reads no content
    one = files.first()
    if one is not None and file_system(one["path"]) is None:
        return (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
                .where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
                .withColumn("at", F.monotonically_increasing_id())
                .groupBy("file").agg(F.min_by(F.ltrim(F.lit("\ufeff"), "value"), "at").alias("header")))
    ship(spark)
    return files.mapInArrow(_first_records, "file string, header string").where(F.trim("header") != "")


def headers(spark: SparkSession, path) -> dict[tuple[str, ...], list[str] | str]:
    """Column names of each different header, and the files that have it.

    One row per different header is collected, with its file names (which Spark's own file index lists as well); when
    all files share one header their folder stands for them.
    """
    groups = (header_catalogue(spark, path).groupBy("header")
              .agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect())
    found: dict[tuple[str, ...], list[str]] = {}
    for group in groups:
        found.setdefault(tuple(next(csv.reader(io.StringIO(group["header"], newline="")), [])), []).extend(group["files"])
    if not found:
        raise NoHeader(f"no header line in {path}")
    return {names: path for names in found} if len(found) == 1 else found


def text_schema(columns, *extra: str) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, *extra])


def _csv(spark: SparkSession, files, columns, header: bool, multi_line: bool, *extra: str) -> DataFrame:
    return (spark.read.schema(text_schema(columns, *extra)).option("header", header).option("mode", "PERMISSIVE")
            .option("escape", '"').option("multiLine", multi_line or any("\n" in c for c in columns)).option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", not extra)          # a row's cells are counted against all columns
            .csv(files))


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def read_customers(spark: SparkSession, path, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Customer table from CSV (all text, then typed) or Parquet, normalised and completed.

    ``path`` is a path or, for CSV, also a list of files.
    """
    if fmt == "parquet":
        return complete(normalize(spark.read.parquet(path)))
    return complete(_united([normalize(_csv(spark, files, names, True, multi_line))
                             for names, files in headers(spark, path).items()]))


def read_batch(spark: SparkSession, path: str, columns: list[str] | None = None,
               multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows normalised, rejected raw lines) from an uploaded CSV.

    Header lines name the columns per file; headerless files take ``columns``.  A row is rejected only if it has
    more cells than its header: it fills the extra column that is read behind the named ones.
    """
    groups = {tuple(columns): path} if columns else headers(spark, path)
    good, rejects = [], []
    for names, files in groups.items():
        raw = _csv(spark, files, names, columns is None, multi_line, EXTRA, CORRUPT)
        good.append(normalize(raw.where(F.col(EXTRA).isNull()).drop(EXTRA, CORRUPT)))
        # a row with exactly one cell too many fits the schema and is put together again
        cells = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (*names, EXTRA)])
        rejects.append(raw.where(F.col(EXTRA).isNotNull()).select(F.coalesce(F.col(CORRUPT), cells).alias("line")))
    return _united(good), _united(rejects)


def write_scored_csv(scored: DataFrame, path: str) -> None:
    """S3: header CSV, highest probability first (range-partitioned sort, one file per range)."""
    (scored.orderBy(F.desc("probability"), ID).write.mode("overwrite")
     .option("header", True).option("encoding", "UTF-8").csv(path))


def template_preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Expected upload layout: the table without its target, first rows by key."""
    return df.drop(TARGET).orderBy(ID).limit(n)


def as_text(df: DataFrame) -> DataFrame:
    """Every column cast to text (the shape of a CSV export)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def is_missing(exc: AnalysisException) -> bool:
    return exc.getCondition() == "PATH_NOT_FOUND"


def try_read_batch(spark: SparkSession, path: str, columns: list[str] | None = None):
    """S2 as the upload page uses it: ``(good, rejects, None)``, or ``(None, None, message)`` when there is no such
    file or no header line; other errors are raised."""
    try:
        return *read_batch(spark, path, columns), None
    except AnalysisException as exc:
        if not is_missing(exc):
            raise
        return None, None, f"could not read {path}: no such file"
    except ValueError as exc:
        return None, None, f"could not read {path}: {exc}"
