"""Fixtures of the training-data operator tests."""

import random

from pyspark.sql import DataFrame

CLASHING = ["row", "key", "fp", "fold", "host", "words", "part", "_row", "order", "label", "n_words", "kept", "size"]


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "an", "er", "tion", "Ing", "ou", "ré", "ß", "st", "wh", "le"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", ",", "."]) for _ in range(words)]
    return "".join(w + rng.choice([" ", " ", " ", " ", "\n"]) for w in out)


def edge_texts() -> list:
    rng = random.Random(4)
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    return [None, "", " \t\n", "one", "two words", same, same, prose(rng, 300), prose(rng, 40), long,
            "é ü <|endoftext|> ß x\x85y   z", "a" * 5000, "# | $ % " * 10, "same line here ok\n" * 30,
            "Licensed under the Apache License, Version 2.0. MIT License. cc-by"]


def edge_docs(spark, texts=None) -> DataFrame:
    """Odd texts, a repeated row, a null id and extra columns whose names clash with internal ones."""
    texts = edge_texts() if texts is None else texts
    rows = [(i + 1, t, "en", None if i % 5 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    if rows:
        rows += [rows[len(rows) // 2], (None, "a row without an id and some words", "en", "src0", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(CLASHING):
        docs = docs.selectExpr("*", f"{i} AS `{name}`")
    return docs
