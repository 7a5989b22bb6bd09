"""Permutation importance (E6) and its top-k report.

All test rows take part unless ``sample_size`` is given.  Rows are dealt once, by a hash of their key, into
buckets of about ``ROWS_PER_BUCKET`` rows that are kept as arrays.  Every (variable, repeat) variant is formed inside
the bucket by index: in a hash order of the bucket's rows, each takes the variable's value of the next one (the last
one of the first), a random cyclic permutation.  The orders are worked out on arrays of keys, many hashes at a time.
So the rows are shuffled once, whatever the number of variants, and what follows shuffles sorted scores only.  One
scoring pass covers the whole grid; the exact AUC is computed per variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ID, IMPORTANCE_COLUMNS, IMPORTANCE_REPEATS, SEED, TARGET
from ..functions.schema import pretty_label
from ..session import cut_lineage, ship
from . import evaluate as E
from .digests import Prefixes, hash_order
from .sampling import hash_key, sample_rows

ROWS_PER_BUCKET = 4096
TASKS_PER_CORE = 4                 # pieces of the grid a core, at least, as long as there are variables to deal out
LANES = 1 << 15                    # hashes worked out at a time


def _next_rows(prefixes: Prefixes, suffixes: list[bytes]) -> np.ndarray:
    """For each suffix in turn, and each place of a bucket, the place of the row that follows it in hash order."""
    found, step = [], max(1, LANES // max(1, len(prefixes.lengths)))
    for at in range(0, len(suffixes), step):
        for high, low in zip(*prefixes.digests(suffixes[at:at + step])):
            order = hash_order(high, low)
            following = np.empty_like(order)
            following[order] = np.roll(order, -1)
            found.append(following)
    return np.concatenate(found)


def _permuted(fields: list[str], columns: list[str], repeats: int):
    """Buckets (rows, the text of each row's key, numbers of variables) -> the rows of each variant of these variables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, keys, grid in zip(*(batch.column(c) for c in ("rows", "keys", "grid"))):
                own = dict(zip(fields, rows.values.flatten()))
                whole = {c: pa.concat_arrays([v] * repeats) for c, v in own.items()}
                prefixes = Prefixes.of(keys.values)
                for at in grid.values.to_pylist():
                    c = columns[at]
                    changed = {}
                    if c in own:
                        changed[c] = own[c].take(pa.array(_next_rows(prefixes, [f"{c}:{r}".encode() for r in range(repeats)])))
                    variant = np.repeat(np.arange(at * repeats, (at + 1) * repeats, dtype=np.int32), len(keys.values))
                    yield pa.RecordBatch.from_arrays([pa.array(variant), *(whole | changed).values()], ["variant", *fields])
    return run


def permutation_importance(test: DataFrame, scorer, columns=IMPORTANCE_COLUMNS, repeats: int = IMPORTANCE_REPEATS,
                           sample_size: int | None = None, seed: int = SEED,
                           rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Mean and population std of the AUC drop per variable.

    ``scorer.with_probability(df)`` adds ``probability`` (rule scorer or fitted pipeline); a scorer may name in ``reads``
    the columns that it depends on.
    """
    rows = test if sample_size is None else sample_rows(test, sample_size, seed)
    rows = cut_lineage(rows)                  # read by the count, the baseline and the grid
    ship(rows.sparkSession)
    n_rows = rows.count()
    n_buckets = max(1, -(-n_rows // rows_per_bucket))
    dealt = F.conv(F.substring(hash_key(seed), 1, 8), 16, 10).cast("long") % n_buckets
    # columns that the scores cannot depend on need no copies; every variant is scored and ranked all the same
    reads = getattr(scorer, "reads", None)
    fields = [c for c in rows.columns if reads is None or c in reads or c == TARGET]
    key = F.coalesce(F.concat(F.col(ID).cast("string"), F.lit(":")), F.lit(""))
    buckets = rows.groupBy(dealt.alias("bucket")).agg(F.collect_list(F.struct(F.struct(*fields).alias("row"), key.alias("key"))).alias("rows"))
    wanted = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(len(columns), -(-wanted // n_buckets)))        # that share the variants of a bucket
    grid = [list(range(i, len(columns), tasks)) for i in range(tasks)]
    shared = buckets.select("rows", F.explode(F.array(*(F.array(*map(F.lit, g)) for g in grid))).alias("grid"))
    # a bucket is small, its variants are not: a task each, whatever the size of the shuffled buckets
    shared = shared.repartition(n_buckets * tasks).select(F.col("rows.row").alias("rows"), F.col("rows.key").alias("keys"), "grid")
    schema = T.StructType([T.StructField("variant", T.IntegerType()), *(rows.schema[c] for c in fields)])
    permuted = shared.mapInArrow(_permuted(fields, list(columns), repeats), schema)
    # variant: its variable's place times the repeats, plus the repeat
    variable = F.element_at(F.lit(list(columns)), F.floor(F.col("variant") / repeats).cast("int") + 1)
    permuted = permuted.select("variant", variable.alias("variable"), *fields)
    own = cut_lineage(scorer.with_probability(rows).select(F.lit(-1).alias("variant"), TARGET, "probability"))
    scored = scorer.with_probability(permuted).select("variant", TARGET, "probability").unionByName(own)
    auc = E.auc_by_group(scored, "variant", E.score_cuts(own, n_rows))
    base = auc.where("variant < 0").first()
    drops = auc.where("variant >= 0").select(variable.alias("variable"), (F.lit(base and base["roc_auc"]).cast("double") - F.col("roc_auc")).alias("drop"))
    return (drops.groupBy("variable").agg(F.avg("drop").alias("importance_mean"),
                                          F.stddev_pop("drop").alias("importance_std")))


def top_importance(table: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most important variables with display labels (first row is the leader)."""
    return (table.orderBy(F.desc("importance_mean"), "variable").limit(n)
            .withColumn("label", pretty_label(F.col("variable"))))
