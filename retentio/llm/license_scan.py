r"""License scan by diagonal voting.

Every rolling word pair of a text is hashed and joined to the pairs of the templates; each hit
votes for its diagonal (place in the text less place in the template).  Votes are aggregated by
(row, template, diagonal), neighbouring diagonals (at most ``GAP`` apart: inserted or lost words)
are merged, and a span stands if it covers ``COVERED`` of its template.  The words of every hit are
compared themselves, so hashes only find candidates.  Short phrases must be complete on one
diagonal.  Templates are a constant of a few hundred pairs, so their side of the join is broadcast.
Only SQL functions are used.

One pass over the texts; rows without hits leave one marker row each, so nothing is joined back to
the texts.  All later aggregations are by row and combined map-side.

Defined edge cases: null or word-less text gives zero counts, null places, empty labels and score
0; repeated rows and ids are scanned row by row; an empty table gives no rows; other input columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, lower_ascii, written

GAP = 2
COVERED = 0.6

# The phrases of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of common notices (at most 63 pairs each).
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation": "gpl-notice",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
    "with the license": "apache-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met": "bsd-text",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-notice",
    "all rights reserved": "all-rights-reserved",
}
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"       # A-Z still belong to words here


def template_pairs() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, is phrase, pairs, place, first word, second word)."""
    out = []
    named = [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for t, label in NOTICES.items()]
    for number, (text, label, phrase) in enumerate(named):
        words = re.findall("[a-z0-9]+", text)
        out += [(number, label, phrase, len(words) - 1, i, *words[i:i + 2]) for i in range(len(words) - 1)]
    return out


def _hits(docs: DataFrame) -> DataFrame:
    """One row per matched pair, and one marker row (``template`` null) per document."""
    spark = docs.sparkSession
    schema = "template int, label string, phrase boolean, pairs int, place int, t1 string, t2 string"
    pairs = spark.createDataFrame(template_pairs(), schema).withColumn("key", F.xxhash64("t1", "t2"))
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                        F.array_remove(F.split(F.coalesce("text", F.lit("")), _NOT_WORD, -1), "").alias("words"))
    # the pair at place i is (word i, word i + 1); the last word pairs with null and is the row's marker,
    # a document without words has a marker of its own
    rows = words.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.posexplode_outer(F.arrays_zip("words", F.expr("slice(words, 2, greatest(size(words) - 1, 0))").alias("after"))))
    rows = rows.select("row", "doc_id", "n_words", F.col("pos").cast("long").alias("pos"),
                       F.lower("col.words").alias("w1"), F.lower("col.after").alias("w2"))
    met = rows.withColumn("key", F.when(F.col("w2").isNotNull(), F.xxhash64("w1", "w2"))).join(F.broadcast(pairs), "key", "left")
    same = (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    return met.filter(F.col("w2").isNull() | same).select(
        "row", "doc_id", "n_words", "pos", "template", "label", "phrase", "pairs", "place")


def spans(hits: DataFrame) -> DataFrame:
    """Verified spans: row, label, phrase, first (word), covered (share of the template)."""
    voted = (hits.filter("template IS NOT NULL").groupBy("row", "template", "label", "phrase", "pairs",
                                                         (F.col("pos") - F.col("place")).alias("diagonal"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("seen")))
    phrases = (voted.filter("phrase AND bit_count(seen) = pairs")
               .select("row", "label", "phrase", F.col("diagonal").alias("first"), F.lit(1.0).alias("covered")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("long"), F.lit(1).cast("long"))
    merged = (voted.filter("NOT phrase").withColumn("opens", opens).withColumn("span", F.sum("opens").over(order))
              .groupBy("row", "template", "label", "phrase", "pairs", "span")
              .agg(F.min("diagonal").alias("first"), F.bit_or("seen").alias("seen"))
              .withColumn("covered", F.bit_count("seen") / F.col("pairs")))
    return phrases.union(merged.filter(F.col("covered") >= COVERED).select("row", "label", "phrase", "first", "covered"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: row, doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score."""
    hits = written(_hits(docs), "license-hits")
    found = spans(hits).groupBy("row").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("covered").alias("score"))
    every = hits.filter("template IS NULL").select("row", "doc_id", "n_words")
    return every.join(found, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in every document."""
    return scan(documents(spark, sf_dir, "doc_id", "text")).drop("row")


_PAIRS = ", ".join(f"({n}, '{label}', {str(phrase).lower()}, {pairs}, {place}, '{a}', '{b}')"
                   for n, label, phrase, pairs, place, a, b in template_pairs())

OP10_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {_PAIRS}) AS v(template, label, phrase, pairs, place, t1, t2)),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, words[i] AS w1, words[i + 1] AS w2
      FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w)),
v AS (SELECT doc_id, template, label, phrase, pairs, pos - place AS diagonal, bit_or(1::BIGINT << place) AS seen
      FROM g JOIN t ON w1 = t1 AND w2 = t2 GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {GAP}
                     THEN 0 ELSE 1 END AS opens FROM v WHERE NOT phrase),
m AS (SELECT doc_id, label, phrase, min(diagonal) AS diagonal, bit_count(bit_or(seen))::DOUBLE / any_value(pairs) AS covered
      FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM o)
      GROUP BY doc_id, template, label, phrase, span),
s AS (SELECT doc_id, label, phrase, diagonal, 1.0::DOUBLE AS covered FROM v WHERE phrase AND bit_count(seen) = pairs
      UNION ALL SELECT doc_id, label, phrase, diagonal, covered FROM m WHERE covered >= {COVERED}),
f AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(diagonal) FILTER (phrase) AS first_word,
             max(diagonal) FILTER (phrase) AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score
      FROM s GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN f ON w.doc_id = f.doc_id
"""
