"""Session and lineage helpers.

Cluster runs get their settings from the cluster (spark-defaults / submit
flags); the builder below only fills what is unset so local tests behave.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# HotSpot never compiles a method above this size of bytecode, so code generated for a whole stage that is longer runs
# interpreted, many times slower; below the limit Spark evaluates the same expressions operator by operator instead.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
HOTSPOT_LIMIT = "8000"

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "retentio", **conf: str) -> SparkSession:
    """Return the active session or build a local one with sane small-data defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(LOCAL_DEFAULTS)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package where they cannot import it anyway: the driver serves it as a zip file
    (``addPyFile``), once per application.  A cluster that has the package on PYTHONPATH needs nothing."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if spark.sparkContext.applicationId in _SHIPPED or home in [os.path.abspath(p) for p in known if p]:
        return
    package = __name__.split(".")[0]
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package}", "zip", home, package))
    _SHIPPED.add(spark.sparkContext.applicationId)


def compiled(spark: SparkSession) -> None:
    """Let the wide projections of the preprocessing stages be compiled: the limit that Spark's documentation names for
    HotSpot, for this session, unless the session or its cluster sets one.  Results do not depend on it."""
    if spark.conf.get(HUGE_METHOD, None) in (None, "65535") and spark.sparkContext.getConf().get(HUGE_METHOD) is None:
        spark.conf.set(HUGE_METHOD, HOTSPOT_LIMIT)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_by_rows(spark: SparkSession):
    """For jobs run inside, bound the batches that go to Python workers by their rows alone (``maxRecordsPerBatch``).  To
    bound them by bytes too, Spark adds up all buffers of a batch again after every row, which takes longer than the rest
    of the transfer of a short row.  For rows of a bounded size only."""
    before = spark.conf.get(BATCH_BYTES, None)
    if before is not None:             # older versions know no such bound
        spark.conf.set(BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(BATCH_BYTES, before)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; invent one only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif _is_local(spark):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="retentio-ckpt-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return sc.getCheckpointDir()


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint area for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    token = os.urandom(6).hex()
    return f"{base.rstrip('/')}/retentio-{name}-{token}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_scratch`, on whatever file system it lies."""
    if "/retentio-" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, truncates the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch area and read back."""
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that several passes read; recomputed from lineage if lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


MAX_SHUFFLE_PARTITIONS = 100_000


def scale_settings(input_bytes: int, executors: int, cores_per_executor: int,
                   target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Suggested settings for a cluster run over ``input_bytes`` of Parquet.

    Shuffle partitions ≈ input / 128 MB (at least 2 waves of the available cores) so each shuffle block
    stays well inside executor memory (spill-free aggregation and sort); scan splits of 128-256 MB; AQE
    on to coalesce small partitions and split skewed ones at run time.
    """
    slots = max(executors * cores_per_executor, 1)
    # input size bounds the shuffle size from above (aggregates shrink it); AQE coalesces the rest, and the
    # cap keeps map-output bookkeeping on the driver bounded
    partitions = min(max(-(-input_bytes // target_partition_bytes), 2 * slots), MAX_SHUFFLE_PARTITIONS)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(min(max(target_partition_bytes, 128 << 20), 256 << 20)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        HUGE_METHOD: HOTSPOT_LIMIT,
    }
