"""Deterministic stratified sampling and splitting (L1-L4).

Rows are ordered by ``md5(id:seed)`` inside each class.  "The first k rows of a
class" are those up to one cut key, found from counts per hash bucket and a
ranking of the one bucket that holds rank k, so flagging rows needs no window,
join or shuffle of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COMPARISON_MAX_ROWS, ID, SEED, TARGET, TEST_FRACTION

MIN_HEX_DIGITS, MAX_HEX_DIGITS = 3, 6      # 4,096 … 16.7 M hash buckets per class
ROWS_PER_BUCKET = 1_000_000               # target size of the one bucket ranked row by row


def bucket_digits(rows: int) -> int:
    """Hex digits of the hash bucket so a class's straddling bucket holds about ROWS_PER_BUCKET rows."""
    d = MIN_HEX_DIGITS
    while d < MAX_HEX_DIGITS and rows / 16 ** d > ROWS_PER_BUCKET:
        d += 1
    return d


def hash_key(seed: int = SEED, key: str = ID) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


MAX_CLASSES = 1000


def class_counts(df: DataFrame, label: str = TARGET) -> dict:
    """Rows per class; a label with over MAX_CLASSES values is refused."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has over {MAX_CLASSES} values; it is not a class label")
    return {r[0]: r[1] for r in rows}


def cut_keys(df: DataFrame, k_by_class: dict, label: str = TARGET, seed: int = SEED, key: str = ID) -> dict:
    """(hash, key) of the ``k``-th row of each class in hash order; classes with ``k`` = 0 are left out.

    Rows are counted per (class, hash bucket), the bucket that holds rank ``k`` is found by a prefix sum, and only
    that bucket's rows (about ROWS_PER_BUCKET at most) are ranked.  Both results have one row per class.
    """
    wanted = {c: k for c, k in k_by_class.items() if k > 0}
    if not wanted:
        return {}
    digits = bucket_digits(max(wanted.values()) * 2)
    keyed = df.select(F.col(label).alias("_c"), F.col(key).alias("_key"), hash_key(seed, key).alias("_h"))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("_c"))
    counts = keyed.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)   # bucket counts of a class
    at = (counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_k", rank)
          .where("_to >= _k AND _to - _n < _k").selectExpr("_c", "_b", "_k - (_to - _n) AS _r").collect())
    inside = F.lit(False)
    place = F.lit(None).cast("long")
    for r in at:
        here = (F.col("_c") == r["_c"]) & (F.col("_b") == r["_b"])
        inside, place = inside | here, F.when(here, r["_r"]).otherwise(place)
    order = Window.partitionBy("_c").orderBy("_h", "_key")
    rows = (keyed.where(inside).withColumn("_place", F.row_number().over(order)).where(F.col("_place") == place)
            .select("_c", "_h", "_key").collect())
    return {r["_c"]: (r["_h"], r["_key"]) for r in rows}


def first_k_per_class(df: DataFrame, k_by_class: dict, label: str = TARGET, seed: int = SEED,
                      key: str = ID, out: str = "selected") -> DataFrame:
    """Flag the ``k_by_class[c]`` rows with the smallest hash in each class: one projection, no join."""
    h = hash_key(seed, key)
    chosen = F.lit(False)
    for c, (cut_h, cut_key) in cut_keys(df, k_by_class, label, seed, key).items():
        first = (h < cut_h) | ((h == cut_h) & (F.col(key) <= F.lit(cut_key)))
        chosen = F.when(F.col(label) == c, first).otherwise(chosen)
    return df.withColumn(out, chosen)


def stratified_split(df: DataFrame, test_fraction: float = TEST_FRACTION, label: str = TARGET,
                     seed: int = SEED, key: str = ID) -> DataFrame:
    """L1: ``split`` = train/test; per class ``floor((1-f)·n_c + 0.5)`` training rows."""
    train_share = round(1.0 - test_fraction, 12)
    k = {c: int(math.floor(train_share * n + 0.5)) for c, n in class_counts(df, label).items()}
    flagged = first_k_per_class(df, k, label, seed, key, out="_train")
    return flagged.withColumn("split", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def stratified_downsample(df: DataFrame, max_rows: int = COMPARISON_MAX_ROWS, label: str = TARGET,
                          seed: int = SEED, key: str = ID) -> DataFrame:
    """L2: at most ``max_rows`` rows keeping class shares; unchanged when already small."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    if n <= max_rows:
        return df
    k = {c: int(math.floor(max_rows * m / n + 0.5)) for c, m in counts.items()}
    return first_k_per_class(df, k, label, seed, key, out="_keep").where("_keep").drop("_keep")


def sample_rows(df: DataFrame, n: int, seed: int = SEED, key: str = ID) -> DataFrame:
    """L3/L4: ``min(n, rows)`` rows with the smallest hash (a top-k, not a sort)."""
    return df.orderBy(hash_key(seed, key), key).limit(n)
