"""Toxicity, language-model scores, and queries with a DuckDB twin on odd rows."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from retentio.llm import context_mixing, license_scan, line_quality, queries, toxicity, url_filter
from tools.oracle_check import digest

from .helpers import edge_docs, edge_texts


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op7_learns_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.op7_toxicity(spark, sf_dir).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    wins = [(a > b) + 0.5 * (a == b) for a, x in held if x == 1 for b, y in held if y == 0]
    assert np.mean(wins) > 0.8


def test_op7_without_labels_of_both_classes_keeps_everything(spark):
    docs = edge_docs(spark)
    for known in ([], [(1, None)], [(1, 1), (2, 1), (3, 1), (4, 1)], [(i, 0) for i in range(9)]):
        labels = spark.createDataFrame(known, "doc_id long, toxic int")
        assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect()} == {(0.0, 0)}
        assert toxicity.below(docs, toxicity.fit(docs, labels)).count() == docs.count()


def test_op7_one_id_with_several_texts(spark):
    rows = [(i % 40, f"{'bad vile' if i % 2 else 'good kind'} text {i % 7} {'x' * (i // 40)}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, toxicity.toxicity(docs.repartition(n), labels).collect())) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2]


def test_op7_odd_rows_and_labels(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, None), (2, 3), (3, 0), (3, 1), (6, 1), (8, 0), (9, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and not [r for r in rows if r.doc_id is None and r.held_out]
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}          # 0.5 for all would reject every document
    assert toxicity.toxicity(edge_docs(spark, []), labels).count() == 0


def base_scores(rows):
    learned = Counter()
    for r in rows:
        if r.doc_id is None or fold(r.doc_id, 7) != 2:
            learned.update((r.text or "").encode().lower().split())
            learned["end"] += 1
    total, distinct = sum(learned.values()), len(learned)
    for r in rows:
        tokens = (r.text or "").encode().lower().split() + ["end"]
        yield (r.doc_id, r.doc_id is not None and fold(r.doc_id, 7) == 2, len(tokens), sum(learned[t] > 0 for t in tokens), total,
               round(sum(math.log10((learned[t] + 1) / (total + distinct + 1)) for t in tokens), 5))


def test_op2_base_and_odd_rows(spark):
    docs = edge_docs(spark)
    rows = context_mixing.score(docs).collect()
    got = [(*r[:5], round(r.base_score, 5)) for r in rows]
    assert sorted(got, key=str) == sorted(base_scores(docs.collect()), key=str)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in rows)
    assert context_mixing.score(edge_docs(spark, [])).count() == 0


def test_op2_bits_are_a_distribution():
    tables = np.full((context_mixing.ORDERS, 1 << context_mixing.SLOT_BITS), context_mixing.NEUTRAL, np.uint16)
    rng = np.random.default_rng(1)
    tables[:, :] = rng.integers(0, 1 << 16, tables.shape[1], dtype=np.uint16)
    mixer = context_mixing.Mixer(tables, refined=rng.random(context_mixing.MAP_CONTEXTS * context_mixing.MAP_STEPS + 1))
    key = np.frombuffer(b"abc d" * 256, np.uint8).reshape(256, 5)
    window = np.zeros(256, np.uint64)
    for j in range(5):
        window = window << np.uint64(8) | key[:, j].astype(np.uint64)
    window = window << np.uint64(8) | np.arange(256, dtype=np.uint64)
    assert abs((10 ** -mixer.cost(window)).sum() - 1) < 1e-6


def test_op2_scores_do_not_depend_on_how_rows_are_split(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    found = [{r.doc_id: (r.score, r.base_score) for r in context_mixing.score(docs.repartition(n)).collect()} for n in (1, 3, 8)]
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(np.allclose(other[i], found[0][i], rtol=1e-9, atol=0) for i in other)


def test_op2_places_are_read_back():
    rng = np.random.default_rng(5)
    sizes = np.array([0, 3, 0, 500, 1, 0])
    places = rng.integers(0, 1 << rng.integers(1, 31, sizes.sum()))
    packed = context_mixing._varints(places, sizes)
    ends = np.cumsum(sizes)
    assert all((context_mixing._places(p) == places[e - n:e]).all() for p, n, e in zip(packed, sizes, ends))


def test_op2_learns(spark):
    rows = context_mixing.op2_context_mixing(spark, "/root/testdata/sf0.01").collect()
    held = [r.bits_per_byte for r in rows if r.held_out and r.n_tokens > 50]
    assert np.mean(held) < 2.6


def twin(con, sql, df):
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert digest([tuple(r) for r in df.collect()], df.columns, 6) == digest(rel.fetchall(), rel.columns, 6)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twins_on_the_tables(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    twin(con, queries.ORACLE[name], queries.QUERIES[name](spark, sf_small))


def test_twins_on_odd_documents(spark):
    docs = edge_docs(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    con.register("documents", documents)
    twin(con, line_quality.OP8_SQL, line_quality.quality(docs).drop("row"))
    twin(con, license_scan.OP10_SQL, license_scan.scan(docs).drop("row"))
    every = edge_docs(spark)
    assert line_quality.quality(every).count() == license_scan.scan(every).count() == every.count()
    none = edge_docs(spark, [])
    assert line_quality.quality(none).count() == license_scan.scan(none).count() == 0


def test_op8_lines_above_the_limit_deplete(spark):
    common = "this boiler plate line is on every page of the whole host today"
    own = [" ".join("abcdefgh"[i % 8] * (i // 8 + 1) + "xyz"[j % 3] * j for j in range(30)) for i in range(60)]
    rows = [(i, f"{common}\n{own[i]}", "a") for i in range(60)]
    rows += [(100 + i, f"{common} \n{common.upper()}\nfew {'abc'[i]} more words", "a") for i in range(3)]
    rows += [(200, f"{common}\n" + " ".join(f"q{j}" for j in range(12)), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: (r.kept, r.n_removed_words) for r in line_quality.quality(docs).collect()}
    assert all(kept[i] == (True, 13) for i in range(60))
    assert all(kept[100 + i] == (False, 26) for i in range(3))
    assert kept[200] == (True, 0)


def test_op8_lines_above_the_limit_are_removed(spark):
    common = "this boiler plate line 12 is on every page of the whole host today"
    own = [" ".join("abcdefgh"[i % 8] * (i // 8 + 1) + "xyz"[j % 3] * j for j in range(30)) for i in range(60)]
    rows = [(i, f"{own[i]}\n\n {common.upper()} \nend {own[i][:9]}", "a") for i in range(60)]
    rows += [(100, f"{common}\n" + " ".join("v" * j for j in range(1, 11)), "a"), (101, f"{common}\n{own[1]}", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS row", "2 AS gone")
    left = line_quality.drop_poor(spark, docs, "")
    assert left.columns == docs.columns
    expected = {i: f"{own[i]}\n\nend {own[i][:9]}" for i in range(60)} | {101: rows[-1][1]}
    assert {r.doc_id: r.text for r in left.collect()} == expected
    assert {r.doc_id for r in line_quality.quality(docs).filter("kept").collect()} == set(expected)


def test_op8_limit_of_a_large_host(spark):
    """A line of 300 documents is boilerplate in a host of 5,000 as in one of 500; chance repeats are not."""
    words = spark.range(5500).selectExpr(
        "id AS doc_id", "if(id < 5000, 'large', 'small') AS source",
        "concat('this notice stands on many of the pages of its host and adds nothing to them at all ever\n', "
        "if(id % 120 = 0, 'chance line\n', ''), array_join(transform(sequence(1, if(id % 50 = 7, 4, 25)), "
        "i -> translate(concat('w', id, 'x', i), '0123456789', 'abcdefghij')), ' ')) AS text")
    docs = words.filter("doc_id < 300 OR doc_id >= 5000").unionByName(words.filter("doc_id BETWEEN 300 AND 4999").selectExpr(
        "doc_id", "source", "substring(text, instr(text, '\n') + 1) AS text"))
    rows = {r.doc_id: r for r in line_quality.quality(docs).collect()}
    assert all(rows[i].n_removed_words == (19 if i < 300 or i >= 5000 else 0) for i in rows)
    assert all(rows[i].kept == (i % 50 != 7) for i in rows if i < 300 or i >= 5000)


def test_op10_merges_neighbouring_diagonals(spark):
    text = ("Redistribution and use in source and binary forms, with or without any modification are permitted "
            "provided that following conditions are met")
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "bsd-text" and row.n_base == 0 and 0.6 <= row.score < 1 and row.first_word is None


def test_op5_odd_urls_and_empty_list(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.A.Example.NET/en/x?y#z", "ftp://a.org/fr/", "x://b.org/fr",
            "https://m.shop.com/a.html", "https://shop.com/a/", "https://shop.com/b", "a://b://c/d", "http://é.com/É?",
            "http://x.example.com/de/" + "y" * 50_000, "http://xnet/", "http://net"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, "")], "page_id long, url string").selectExpr(
        "*", "1 AS html", "2 AS block", "3 AS host", "4 AS listed")
    listed = spark.createDataFrame([("shop.com/a",), ("shop.com/a",), (None,), ("",)], "canonical_url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, listed).collect()}
    assert url_filter.filter_urls(pages, listed).count() == len(urls) + 1
    assert [(got[i].host, got[i].path) for i in range(4)] == [("", "")] * 4
    assert (got[4].host, got[4].rule, got[4].verdict) == ("www.a.example.net", "example.net/en/", "allow")
    assert (got[5].rule, got[6].rule) == ("org/fr/", None)
    assert [got[i].verdict for i in (7, 8, 9)] == ["block", "block", "allow"]
    assert (got[10].host, got[11].host, got[12].rule) == ("b:", "é.com", "example.com/de/")
    assert (got[13].rule, got[14].rule) == (None, None)
    assert not url_filter.filter_urls(pages, listed.limit(0)).filter("listed").count()
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_op5_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F
    listed = spark.range(3000).select(F.concat(F.lit("host/"), F.col("id").cast("string")).alias("k"))
    bloom, blocks = url_filter.bloom_filter(listed, "k")
    words = {r.block: r.word for r in bloom.collect()}
    probe = spark.range(20_000).select(F.concat(F.lit("host/"), F.col("id").cast("string")).alias("k")).select(
        "k", url_filter._block(F.col("k"), blocks).alias("b"), url_filter._mask(F.col("k")).alias("m"))
    hits = {r.k for r in probe.collect() if words.get(r.b, 0) & r.m == r.m}
    assert all(f"host/{i}" in hits for i in range(3000)) and len(hits) < 3000 + 0.03 * 17_000


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf_small):
    docs = edge_docs(spark).unionByName(spark.read.parquet(f"{sf_small}/documents.parquet"), allowMissingColumns=True)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_small).cache()
        assert kept.columns == docs.columns and kept.count() < before, name
        assert kept.exceptAll(docs).count() == 0
        docs, before = kept, kept.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_small).count() == 0


def test_pipeline_is_registered():
    assert "pipeline" in entry.queries() and sum(k.startswith("op") for k in queries.QUERIES) == 13
    assert edge_texts()[0] is None
