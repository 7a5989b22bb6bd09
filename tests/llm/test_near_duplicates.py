"""SimHash, NN-descent and components against brute force."""

import math
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from retentio.llm import nn_descent, simhash
from retentio.llm.components import components

from .helpers import edge_docs, prose


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 300), (7, 3)]
    pairs += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    top = roots(500, pairs)
    assert got == {i: top[i] for i in range(500) if top[i] != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op6_odd_rows(spark):
    rng = random.Random(3)
    text = prose(rng, 200)
    docs = edge_docs(spark).unionByName(edge_docs(spark, [text, text + " end", text.replace("the", "The")]).filter("doc_id < 4")
                                        .withColumn("doc_id", F.col("doc_id") + 100))
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3]
    top = roots(len(rows), near)
    least = {}
    for r, t in zip(rows, top):
        if r.doc_id is not None:
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    expected = sorted(((r.doc_id, f"{p:016x}", least.get(t)) for r, p, t in zip(rows, prints, top)), key=str)
    assert sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str) == expected
    kept = simhash.keep_first(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(set(top))
    assert simhash.simhash_components(edge_docs(spark, [])).count() == 0


def test_simhash_lists_of_every_size(spark, monkeypatch):
    rng = random.Random(5)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 500:
        x = base
        for b in rng.sample(range(64), rng.randrange(9)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(200)})
    near = [(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3]
    parts = {}
    for x, t in zip(fps, roots(len(fps), near)):
        parts.setdefault(t, []).append(signed(x))
    expected = {x: min(p) for p in parts.values() for x in p if x != min(p)}
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for paired, grouped in ((48, 4096), (4, 16)):          # joins and forests; lists that are split again
        monkeypatch.setattr(simhash, "PAIRED", paired)
        monkeypatch.setattr(simhash, "GROUPED", grouped)
        assert {r.node: r.component for r in components(simhash.links(frame)).collect()} == expected


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS row", "2 AS unit", "3 AS node", "4 AS least")


def test_op1_groups_odd_vectors_and_labels(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.standard_normal((6, 16))
    for i in range(260):
        centre = base[0] if i < 120 else base[i % 6] if i < 180 else rng.standard_normal(16)
        rows.append((i, (centre + 0.05 * rng.standard_normal(16)).astype("f4").tolist(), i % 2 if i > 120 else 0))
    rows += [(300 + i, rows[3][1], 0) for i in range(20)] + [rows[5]]
    odd = [(400, None, 0), (401, [0.0] * 16, 0), (402, [math.nan] + [1.0] * 15, 0), (403, [None] + [1.0] * 15, 0),
           (404, rows[3][1], None), (None, rows[3][1], 0), (405, [1.0, 2.0], 0), (406, [], 0), (407, [math.inf] * 16, 0)]
    got = nn_descent.near_duplicates(vectors(spark, rows + odd)).collect()
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    labels = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in rows])
    part = ids.copy()
    for _ in range(len(rows)):
        new = np.array([min(part[i], part[near[i]].min(initial=part[i])) for i in range(len(rows))])
        if (new == part).all():
            break
        part = new
    expected = [(int(i), int(n), int(p), bool(i == p)) for i, n, p in zip(ids, near.sum(1), part)]
    expected += [(v, 0, v, None if v is None else True) for v, _, _ in odd]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert nn_descent.near_duplicates(vectors(spark, [])).count() == 0


def test_op1_recall_on_the_table(spark, sf_small):
    got = nn_descent.op1_nn_descent(spark, sf_small)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    expected = sorted(r for label in {r[2] for r in rows} for r in brute_links([x for x in rows if x[2] == label]))
    assert sorted(map(tuple, got.collect())) == expected


def brute_links(rows):
    """(vec_id, n_links, component_id, kept) of rows with distinct ids and usable vectors, sorted."""
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    labels = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    top = roots(len(rows), np.argwhere(np.triu(near)).tolist())
    return sorted((r[0], int(n), rows[t][0], t == i) for i, (r, n, t) in enumerate(zip(rows, near.sum(1), top)))


def two_groups(rng, size, dim=64):
    """Two groups of near copies: cosine about 0.99 inside, 0.94 between them."""
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    b = 0.95 * a + math.sqrt(1 - 0.95 ** 2) * b
    return [(c + 0.0125 * rng.standard_normal(dim)).astype("f4").tolist() for c in (a, b) for _ in range(size)]


def test_op1_links_between_dense_groups(spark):
    rng = np.random.default_rng(8)
    some = two_groups(rng, 60) + two_groups(rng, 14) + [rng.standard_normal(64).astype("f4").tolist() for _ in range(200)]
    rows = [(i, v, 0) for i, v in enumerate(some)]
    expected = brute_links(rows)
    assert len({r[2] for r in expected[:120]}) == len({r[2] for r in expected[120:148]}) == 1
    assert sorted(map(tuple, nn_descent.near_duplicates(vectors(spark, rows)).collect())) == expected


def test_op1_pairs_in_small_labels_beside_a_large_one(spark):
    """Isolated pairs just above the threshold are found however large another label is."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(64).astype("f4").tolist(), 0) for i in range(6000)]
    for i in range(6000, 6400, 2):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        pair = (a, 0.935 * a + math.sqrt(1 - 0.935 ** 2) * b)
        rows += [(i + j, v.astype("f4").tolist(), 1 + i % 10) for j, v in enumerate(pair)]
    expected = brute_links(rows[6000:])
    got = [tuple(r) for r in nn_descent.near_duplicates(vectors(spark, rows)).collect() if r.vec_id >= 6000]
    assert sorted(got) == expected and sum(r[1] for r in expected) == 400


def test_op1_low_recall_is_never_returned(spark, monkeypatch):
    """A first graph that misses most pairs, beside a dense group that outweighs them, or with few pairs to sample."""
    rng = np.random.default_rng(10)
    rows = [(i, v, 0) for i, v in enumerate(two_groups(rng, 40))]
    for label, pairs, lone in ((0, 150, 0), (1, 3, 1200)):
        for _ in range(pairs):
            a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
            rows += [(len(rows) + j, v.astype("f4").tolist(), label) for j, v in enumerate((a, 0.94 * a + math.sqrt(1 - 0.94 ** 2) * b))]
        rows += [(len(rows) + i, rng.standard_normal(64).astype("f4").tolist(), label) for i in range(lone)]
    for name, value in (("RUN", 8), ("ROUNDS", 1), ("RETRIES", 0), ("SETTLED", 1.0)):
        monkeypatch.setattr(nn_descent, name, value)
    assert sorted(map(tuple, nn_descent.near_duplicates(vectors(spark, rows)).collect())) == brute_links(rows)


def test_op1_links_come_from_the_graph(spark, caplog):
    """Labels of several sizes, about one linked vector in a hundred, one dense group: under 5 % compared exactly."""
    rng = np.random.default_rng(12)
    rows = []
    for label, lone, pairs in ((0, 9000, 60), (1, 3000, 25), (2, 700, 5), (3, 90, 2), (4, 1, 1)):
        for _ in range(pairs):
            a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
            rows += [(v, label) for v in (a, 0.95 * a + math.sqrt(1 - 0.95 ** 2) * b)]
        rows += [(v, label) for v in rng.standard_normal((lone, 32))]
    rows += [(c + 0.01 * rng.standard_normal(32), 0) for c in np.eye(32)[:3] for n in range((12, 30, 100)[int(c[1] + 2 * c[2])])]
    rows = [(i, v.astype("f4").tolist(), label) for i, (v, label) in enumerate(rows)]
    expected = {r[0]: r for label in range(5) for r in brute_links([x for x in rows if x[2] == label])}
    with caplog.at_level("INFO", logger="retentio.llm.nn_descent"):
        got = {r.vec_id: tuple(r) for r in nn_descent.near_duplicates(vectors(spark, rows)).collect()}
    linked = [i for i, r in expected.items() if r[1]]
    right = [i for i in linked if got[i] == expected[i]]
    assert len(linked) > 300 and len(right) >= 0.97 * len(linked) and all(got[i] == expected[i] for i in expected if not expected[i][1])
    compared = [int(r.message.split()[0]) for r in caplog.records if "compared with their whole label" in r.message]
    assert 100 <= compared[0] < 0.05 * len(rows)
