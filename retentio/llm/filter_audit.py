r"""Filter interaction audit by a recursive CTE over the orders of the filters.

1. One pass over whole texts gives each document the bit mask of the filters it fails and a SHA-256
   digest of its text; texts do not leave that pass.
2. Exact copies: rows are counted per (text, part, label, doc_id), then per (text, part, label) with the
   smallest doc_id and its count, so a text shared by a third of all rows is combined before it is
   shuffled and never joined back to its rows.
3. Mask cells: documents, good and toxic ones per (part, mask), at most ``2 ** filters`` a part.
4. ``WITH RECURSIVE``: a prefix of filters is extended by each unused letter and joined with the cells of
   its part; it carries the bits applied so far, and each level emits the metrics of the step it adds.
5. Full orders look up the step of each of their prefixes; a prefix of s of k filters stands in (k - s)!
   orders, which gives the sums over all orders without listing them.

Defined edge cases: null text is empty, null part the empty string; rows of one doc_id are documents of
their own, and of equal texts those with the smallest doc_id are no copies; a null doc_id is neither a
copy nor copied from, and has no labels; a label holds if any label row of the document has it; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import UPPER, documents, written
from .token_ids import slices

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SIGNS = 100, 80, 10, b"#$%&*|"
COPY = LETTERS.index("E")          # the filter that compares documents with one another
LIMIT = "spark.sql.cteRecursionRowLimit"


def _mask(raw: bytes, points: int) -> int:
    """Bits of the failed filters that look at one text: A words, B distinct words, C capitals, D signs."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, UPPER.encode()))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
              100 * capitals > MAX_CAPITALS_PERCENT * points, len(raw.translate(None, SIGNS)) < len(raw))
    return sum(f << i for i, f in enumerate(failed))


def _facts(batches):
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            text = pc.fill_null(part.column("text"), "")
            raw = text.cast(pa.binary()).to_pylist()
            masks = list(map(_mask, raw, pc.utf8_length(text).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array(masks, pa.int32()),
                 pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary())], ["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask of failed filters (all but copies), digest of the text of ``docs(doc_id, text, part)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")).mapInArrow(
        _facts, f"doc_id {kind}, part string, mask int, digest binary")


def cells(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents per mask cell, copies (:data:`COPY`) among the bits."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = facts.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").select(
        *facts.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    nameless = facts.filter("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    same = ["digest", "mask", "part", "good", "toxic"]
    rows = named.unionByName(nameless).groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    groups = rows.groupBy(*same).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    text = Window.partitionBy("digest")            # a row per part and label of the text
    groups = groups.withColumn("smallest", F.min("first").over(text)).withColumn(
        "own", F.col("nameless") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0))
    both = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << COPY)).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    counted = groups.select("part", "good", "toxic", both.alias("cell")).select("part", "good", "toxic", "cell.*")
    return counted.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


# Each level: the cells that a step touches are told by their mask, the bits applied before and the step's bit.
ENUMERATION = """
WITH RECURSIVE steps (part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {parts}
  UNION ALL
  SELECT s.part, concat(s.prefix, f.letter), s.applied | f.bit, s.step + 1,
         aggregate(c.cells, 0L, (x, m) -> x + if(m.mask & (s.applied | f.bit) = 0, m.n, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + if(m.mask & s.applied = 0 AND m.mask & f.bit != 0, m.n, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + if(m.mask & s.applied != 0 AND m.mask & f.bit != 0, m.n, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + if(m.mask = f.bit, m.n, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + if(m.mask & s.applied = 0 AND m.mask & f.bit != 0, m.good, 0L)),
         aggregate(c.cells, 0L, (x, m) -> x + if(m.mask & s.applied = 0 AND m.mask & f.bit != 0, m.toxic, 0L))
  FROM steps s JOIN {parts} c ON s.part = c.part
  LATERAL VIEW inline({filters}) f AS letter, bit
  WHERE s.applied & f.bit = 0
)
SELECT * FROM steps WHERE step > 0
"""
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def orders(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, metrics and shapley sum for every order of the filters whose cells are ``counted``."""
    spark, k = counted.sparkSession, len(letters)
    parts = written(counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")),
                    "audit-cells")
    rows = parts.count() * sum(factorial(k) // factorial(k - s) for s in range(k + 1))
    filters = "array(" + ", ".join(f"struct('{c}', {1 << i})" for i, c in enumerate(letters)) + ")"
    before = spark.conf.get(LIMIT)
    try:
        if 0 <= int(before) <= rows:               # a guard against endless recursions; this one's size is known
            spark.conf.set(LIMIT, str(rows + 1))
        steps = written(spark.sql(ENUMERATION.replace("{filters}", filters), parts=parts), "audit-steps")
    finally:
        spark.conf.set(LIMIT, before)
    letter = F.substring("prefix", -1, 1).alias("letter")
    times = reduce(lambda c, s: c.when(F.col("step") == s, factorial(k - s)), range(1, k + 1), F).cast("long")
    shapley = steps.groupBy("part", letter).agg(F.sum(F.col("removed") * times).alias("shapley"))
    full = steps.filter(F.col("step") == k).select("part", F.col("prefix").alias("filter_order"),
                                                   F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    full = full.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    return (full.join(steps.drop("step"), ["part", "prefix"]).withColumn("letter", letter)
            .join(shapley, ["part", "letter"]).select("part", "filter_order", "step", *METRICS, "shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """All orders of the five filters on ``docs(doc_id, text, part)`` with ``labels(doc_id, quality, toxic)``."""
    return orders(cells(failures(docs, part), labels))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Every order of the five filters over whole documents, per language."""
    return audit(documents(spark, sf_dir, "doc_id", "text", "lang"),
                 table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH RECURSIVE
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
marks AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM split LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
prefixes AS (
  SELECT '' AS prefix, 0 AS applied, 0 AS before, '' AS letter, 0 AS bit
  UNION ALL
  SELECT prefix || f.letter, applied | f.bit, applied, f.letter, f.bit FROM prefixes p JOIN filters f ON p.applied & f.bit = 0),
steps AS (
  SELECT part, prefix, letter,
    sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM prefixes, cells WHERE prefix <> '' GROUP BY ALL),
full_orders AS (SELECT prefix AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM prefixes WHERE length(prefix) = 5)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM full_orders JOIN steps ON steps.prefix = filter_order[1:step]
"""
