"""All filter orders against a plain Python version."""

import itertools
import re

from retentio.llm import filter_audit

from .helpers import edge_docs, edge_texts

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Rows by listing every order and applying it document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    judged = []
    for doc_id, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in docs)}
        judged.append((part or "", {f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    rows, shapley = [], {}
    for part in {j[0] for j in judged}:
        mine = [j[1:] for j in judged if j[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                removed = [j for j in mine if f in j[0] and not j[0] & before]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                rows.append((part, "".join(order), step, sum(not j[0] & (before | {f}) for j in mine), len(removed),
                             sum(f in j[0] and bool(j[0] & before) for j in mine), sum(j[0] == {f} for j in mine),
                             sum(j[1] for j in removed), sum(j[2] for j in removed)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_odd_rows(spark):
    texts = edge_texts() + ["COPY of capitals", "COPY of capitals", None, ""]
    docs = edge_docs(spark, texts)
    docs = docs.selectExpr("*", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'x' ELSE '' END AS tongue")
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (6, 1, 1), (7, 1, 1), (None, 1, 1), (999, 1, 1)]
    found = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), part="tongue")
    expected = brute([(r.doc_id, r.text, r.tongue) for r in docs.collect()], labels)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) == 2 * 600
    again = filter_audit.audit(docs.repartition(7), spark.createDataFrame(labels, LABELS).repartition(3), part="tongue")
    assert sorted(map(tuple, again.collect())) == expected


def test_more_prefixes_than_the_recursion_guard(spark):
    docs = spark.createDataFrame([(i, "Same Words " * (i % 4), f"part{i % 40}") for i in range(120)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    before = spark.conf.get(filter_audit.LIMIT)
    spark.conf.set(filter_audit.LIMIT, "500")
    try:
        found = filter_audit.audit(docs, labels).collect()
        assert spark.conf.get(filter_audit.LIMIT) == "500"
    finally:
        spark.conf.set(filter_audit.LIMIT, before)
    assert sorted(map(tuple, found)) == brute([tuple(r) for r in docs.collect()], [])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).count() == 0


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 0, 1), ("p", 3, 4, 2, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in filter_audit.orders(cells, "XY").collect()}
    assert rows["XY", 1].removed == 6 and rows["XY", 2].redundant == 4 and rows["YX", 2].kept == 5
    assert rows["YX", 1].shapley == 4 and rows["XY", 1].shapley == 8
