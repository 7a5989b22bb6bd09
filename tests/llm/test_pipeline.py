"""The whole pipeline on a small table against a brute-force version of every stage."""

import math
import struct
import zlib

import duckdb
import xxhash

import corpus_pipeline
from retentio.llm import line_quality, toxicity

from .test_near_duplicates import brute_fingerprint, roots
from .test_tokens import check_pieces


def brute_toxic_scores(docs: dict, labels: dict) -> dict:
    """Per-coordinate FTRL in plain Python over the same features and order."""
    hasher = toxicity.Hasher()
    features = {i: sorted(set(hasher.buckets([t])[0].tolist())) for i, t in docs.items()}
    order = {i: xxhash.xxh64_intdigest(struct.pack("<q", i), 42) for i in docs}
    known = sorted((i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 5),
                   key=lambda i: ((order[i] - (order[i] >> 63 << 64)) % (1 << 40)))
    z, n, bias = {}, {}, -1

    def weight(f):
        l1 = 0 if f == bias else toxicity.L1
        a = z.get(f, 0.0)
        if abs(a) <= l1:
            return 0.0
        return -(a - math.copysign(l1, a)) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for i in known:
            w = {f: weight(f) for f in [*features[i], bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[i]
            for f, v in w.items():
                m = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(m + g * g) - math.sqrt(m)) / toxicity.ALPHA * v
                n[f] = m + g * g
    return {i: 1 / (1 + math.exp(-sum(map(weight, [*fs, bias])))) for i, fs in features.items()}


def test_every_stage_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)

    scores = brute_toxic_scores(texts, labels)
    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}

    con = duckdb.connect()
    con.register("documents", clean.select("doc_id", "text", "source").toArrow())
    expected = {r[0] for r in con.sql(f"SELECT doc_id FROM ({line_quality.OP8_SQL}) WHERE kept").fetchall()}
    good = stages["quality"](spark, clean, sf_dir).cache()
    assert {r.doc_id for r in good.collect()} == expected and 0 < len(expected) < clean.count()

    ids = sorted(expected)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    near = [(i, j) for j in range(len(ids)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3]
    unique = stages["near-duplicates"](spark, good, sf_dir).cache()
    assert {r.doc_id for r in unique.collect()} == {i for i, t in zip(ids, roots(len(ids), near)) if i == ids[t]}

    check_pieces(stages["packing"](spark, unique, sf_dir).collect(), unique)
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == unique.count()


def test_boilerplate_goes_on_the_way(spark, tmp_path):
    """One table through all four stages: toxic, poor, boilerplate, near copies that differ in removed lines only."""
    notice = "this notice stands on every page of the host and says nothing about the page itself"
    spelt = str.maketrans("0123456789", "abcdefghij")                 # lines are compared without regard to digits
    own = [" ".join(f"w{i}x{j}" for j in range(40)).translate(spelt) for i in range(60)]
    rows = [(i, f"{notice}\n{own[i]}", "en", "a") for i in range(60)]
    rows += [(100 + i, own[i], "en", "a") for i in range(10)]                            # copies once the notice is gone
    rows += [(200, f"{notice}\nonly four words left", "en", "a"), (201, None, "en", None), (202, "too short", "en", "a")]
    rows += [(300 + i, f"vile scum {own[i]} vile scum", "en", "b") for i in range(40)]
    clean = {400 + i: " ".join(f"c{i}x{j}" for j in range(40)).translate(spelt) for i in range(80)}
    rows += [(i, text, "en", "c") for i, text in clean.items()]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(r[0], 1, int(300 <= r[0] < 400)) for r in rows]
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, folder).cache()
        seen[name] = left.collect()
    assert {r.doc_id for r in seen["toxicity"]} == {r[0] for r in rows} - set(range(300, 340))
    assert {r.doc_id: r.text for r in seen["quality"]} == {i: own[i] for i in range(60)} | {100 + i: own[i] for i in range(10)} | clean
    assert {r.doc_id for r in seen["near-duplicates"]} == {*range(60), *clean}
    assert {r.doc_id for r in seen["packing"]} == {*range(60), *clean}
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, seen["packing"]))
