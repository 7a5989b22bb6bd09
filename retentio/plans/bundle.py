"""Versioned model bundle (S4, S5): the fitted pipeline and its metadata as one published unit.

A publish writes every part to a folder of its own, ``versions/<version>``, and commits last a manifest of one row:
the version and the row count and checksum of each part.  Readers follow the newest manifest, so a job that is killed
between the parts leaves the earlier bundle readable, and two publishing jobs never write to the same folder.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import is_missing
from .training import PARTS, Trained, read_metadata, save_metadata, save_model

MANIFEST = ("version string, published_at string, parts array<struct<part: string, rows: long, checksum: string>>")


class DamagedBundle(ValueError):
    """A part of a published bundle does not have the rows of its manifest."""


def _content(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """The stored rows or lines of a part; a model's are the texts and node tables below its folder."""
    if part == "model":
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/model"))
        below = F.regexp_extract("path", r"/versions/[^/]+/(.*)$", 1)
        return files.select(below.alias("file"), F.sha2("content", 256).alias("content"))
    return getattr(spark.read, PARTS[part])(f"{folder}/{part}")


def checksum(rows: DataFrame) -> tuple[int, str]:
    """(row count, checksum) in one aggregate: a sum of row hashes, so neither order nor files matter."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(text).cast("decimal(38,0)"))).first()
    return n, str(total or 0)


def publish(spark: SparkSession, t: Trained, folder: str, importance: DataFrame | None = None) -> str:
    """Write the model and all metadata of ``t`` as a new version below ``folder`` and commit it; returns the version."""
    now = datetime.now(timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    home = f"{folder}/versions/{version}"
    save_model(t, f"{home}/model")
    save_metadata(spark, t, home, importance)
    parts = [(part, *checksum(_content(spark, home, part))) for part in ("model", *PARTS)]
    row = spark.createDataFrame([(version, now.isoformat(), parts)], MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifests/{version}")
    return version


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The manifests of all committed versions; a folder without any gives no rows."""
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/manifests/*")
    except AnalysisException as exc:
        if not is_missing(exc):
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, folder: str) -> str | None:
    """The newest committed version."""
    return versions(spark, folder).agg(F.max("version")).first()[0]


def _version(spark: SparkSession, folder: str, version: str | None) -> str:
    version = version or current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no published model in {folder}; run the training job first")
    return version


def verify(spark: SparkSession, folder: str, version: str | None = None) -> str:
    """Compare every part with its manifest; returns the version or raises :class:`DamagedBundle`."""
    version = _version(spark, folder, version)
    manifest = versions(spark, folder).where(F.col("version") == version).first()
    if manifest is None:
        raise FileNotFoundError(f"no published version {version} in {folder}")
    for part in manifest["parts"]:
        try:
            found = checksum(_content(spark, f"{folder}/versions/{version}", part["part"]))
        except AnalysisException as exc:
            if not is_missing(exc):
                raise
            found = (0, "missing")
        if found != (part["rows"], part["checksum"]):
            raise DamagedBundle(f"{part['part']} of version {version}: {found} instead of {(part['rows'], part['checksum'])}")
    return version


def load_published(spark: SparkSession, folder: str, version: str | None = None,
                   checked: bool = True) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """The model and metadata of a version (None: the newest), compared with the manifest first unless told not to."""
    version = verify(spark, folder, version) if checked else _version(spark, folder, version)
    home = f"{folder}/versions/{version}"
    return PipelineModel.load(f"{home}/model"), read_metadata(spark, home)
