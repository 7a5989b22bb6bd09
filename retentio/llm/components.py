"""Connected components of a link table by alternating star contractions.

Large star: every neighbour above a node is linked to the smallest of the node and its
neighbours; small star: the same for the neighbours below it.  Each round is two aggregations
(combined map-side) and two joins against one row per node, which adaptive execution can split
where a hub is hot.  Rounds end when the links no longer change; every round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 100


def _least(links: DataFrame) -> DataFrame:
    """Smallest of each node ``a`` and its neighbours ``b``."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b"), F.col("a")))
    return (both.join(_least(both), "a").filter("b > a AND b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    return (down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.filter("a <> m").select("a", F.col("m").alias("b"))))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` (longs, in any order, repeated or not) to ``(node, component)``, where component is
    the smallest node reachable; nodes that are the smallest of their component, or without links, are left out."""
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "links")
    mark = _mark(links)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        links = written(_small_star(_large_star(links).distinct()).distinct(), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
