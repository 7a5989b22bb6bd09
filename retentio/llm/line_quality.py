r"""Quality rules with cross-document line frequency.

Per document (words are runs without ASCII white space): n_words, word_chars, n_symbols,
n_dup_lines, n_repeat_words and the two base rules.  Across documents: lines are normalised
(lower case, digits to 0, white space to one space) and hashed, and the distinct documents of each
line are counted per host (``source``; documents with the same text count once).  A line is above
the limit if over ``LIMIT_DOCS`` documents, and over the square root of the host's documents, have it: the
limit of a host 100 times as large is 10 times as high, so boilerplate of a large host is told apart from
short lines that many documents share by chance.  Such lines are removed; a document is rejected as depleted
if over ``DEPLETED`` of its words go or fewer than ``MIN_WORDS`` remain.  :func:`quality` judges (the query),
:func:`filtered` gives the texts of the documents kept without those lines (the pipeline stage).
Equal hashes (64 bits) of lines and windows count as equal lines and windows.

Only SQL functions are used.  One pass over the texts writes a narrow table (counts and one
``(hash, words)`` entry a line); counting and matching shuffle hashes only, combined map-side, and
a hot host or line is one group key among its lines, never one task's whole data.  Repeated 8-word
windows are found inside the row from window hashes, and only in rows that have any.

Defined edge cases: null text has no words, so base_failed is true; null source is a host of its
own; repeated rows and ids are judged row by row; a row is depleted only by lines above the limit;
an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, numbered, written

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
LIMIT_DOCS = 20
DEPLETED = 0.7
_HASH = (r"xxhash64(trim(regexp_replace(translate(lower(l), '123456789', '000000000'), '[\\x20\\x09-\\x0D]+', ' ')))")


def _split(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def _with_counts(df: DataFrame) -> DataFrame:
    """Adds the base columns to rows with a non-null ``text``; intermediate arrays are columns of their own,
    so that no lambda evaluates one again for each element."""
    kept = df.columns
    near = ", ".join(f"h[i + {j}]" if j else "h[i]" for j in range(WINDOW))
    steps = [
        {"pieces": _split(F.col("text"), r"[\x20\x09-\x0D]"),
         "n_symbols": (F.size(_split(F.col("text"), r"[#*$%&|<>]")) - 1).cast("long"),
         "lines": F.expr(r"filter(split(text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')")},
        {"words": F.array_remove("pieces", ""),
         "word_chars": (F.char_length("text") - F.size("pieces") + 1).cast("long"),
         "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
         "marks": F.expr("transform(lines, l -> struct("
                         rf"{_HASH} AS h, "
                         r"size(array_remove(split(l, '[\\x20\\x09-\\x0D]+', -1), '')) AS n))")},
        {"n_words": F.size("words").cast("long"), "h": F.expr("transform(words, w -> xxhash64(w))")},
        {"n": F.size("h")},
        {"windows": F.expr(f"CASE WHEN n >= {WINDOW} THEN transform(sequence(0, n - {WINDOW}), i -> xxhash64({near})) "
                           "ELSE cast(array() AS array<bigint>) END")},
        {"sorted": F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) "
                          "THEN array_sort(transform(windows, (x, i) -> struct(x, i))) "
                          "ELSE cast(array() AS array<struct<x: bigint, i: int>>) END")},
        {"places": F.expr("array_sort(transform(filter(sorted, (e, j) -> coalesce(get(sorted, j - 1).x = e.x, false) "
                          "OR coalesce(get(sorted, j + 1).x = e.x, false)), e -> e.i))")},
        {"n_repeat_words": F.expr("aggregate(transform(places, (p, k) -> "
                                  f"least({WINDOW}, coalesce(get(places, k + 1) - p, {WINDOW}))), 0L, (a, b) -> a + b)")},
    ]
    for step in steps:
        df = df.withColumns(step)
        if "n_words" in step:
            df = df.drop("pieces", "lines", "text", "words")
    return df.select(*[c for c in kept if c != "text"], "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     "n_repeat_words", "marks")


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: row, doc_id, the base columns, base_failed,
    n_removed_words and kept."""
    return _judged(docs).drop("gone")


def _judged(docs: DataFrame) -> DataFrame:
    """:func:`quality` and ``gone``, the hashes of the row's removed lines, null where there are none."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source",
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    base = written(_with_counts(rows), "quality")
    host = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("host")      # null is a host of its own
    listed = base.select("row", host, "text_hash", F.explode("marks").alias("m")).select(
        "row", "host", "text_hash", F.col("m.h").alias("h"), F.col("m.n").alias("n"))
    totals = base.select(host, "text_hash").distinct().groupBy("host").agg(F.count("*").alias("all"))
    above = (listed.select("host", "h", "text_hash").distinct().groupBy("host", "h").agg(F.count("*").alias("docs"))
             .filter(F.col("docs") > LIMIT_DOCS).join(totals, "host").filter("docs * docs > all").select("host", "h"))
    removed = (listed.join(above, ["host", "h"], "left_semi").groupBy("row")
               .agg(F.sum("n").cast("long").alias("n_removed_words"), F.collect_set("h").alias("gone")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = (base.drop("marks").join(removed, "row", "left").na.fill(0, ["n_removed_words"])
              .withColumn("base_failed", failed))
    depleted = ((F.col("n_removed_words") > DEPLETED * F.col("n_words"))
                | (F.col("n_words") - F.col("n_removed_words") < MIN_WORDS))
    return judged.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "n_removed_words", "gone")


def op8_line_quality(spark, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    return quality(documents(spark, sf_dir, "doc_id", "text", "source")).drop("row")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that remain, with its columns; ``text`` without the lines above the limit."""
    rows, row = numbered(docs, "quality-docs")
    verdict = _judged(rows.select(F.col(row).alias("doc_id"), "text", "source"))
    left = verdict.filter("kept").select(F.col("doc_id").alias(row), F.struct("gone").alias(f"{row}gone"))
    lines = rf"filter(split(text, '\n', -1), l -> NOT array_contains(`{row}gone`.gone, {_HASH}))"
    text = F.when(F.col(f"{row}gone")["gone"].isNull(), F.col("text")).otherwise(F.array_join(F.expr(lines), "\n"))
    return rows.join(left, row).withColumn("text", text).select(*docs.columns)


def drop_poor(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the quality rules reject go, and so do the lines above the limit."""
    return filtered(docs)


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT doc_id, text, host, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS k
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, host, md5(text) AS t,
             trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
             len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
      FROM (SELECT doc_id, host, text, unnest(lines) AS line FROM w)),
tot AS (SELECT host, count(DISTINCT md5(text)) AS docs FROM d GROUP BY host),
above AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT t) AS c FROM l GROUP BY host, h) JOIN tot USING (host)
          WHERE c > {LIMIT_DOCS} AND c * c > docs),
rem AS (SELECT doc_id, sum(n)::BIGINT AS n FROM l JOIN above USING (host, h) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN rem ON w.doc_id = rem.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT n_removed_words > {DEPLETED} * n_words AND n_words - n_removed_words >= {MIN_WORDS} AS kept,
       n_removed_words FROM f
"""
