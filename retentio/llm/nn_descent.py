"""Embedding near-duplicates by NN-descent.

1. Vectors that can link are normalised in double precision; equal vectors of a label collapse
   to one node that carries its number of copies.
2. The first neighbour graph comes from sign codes of random planes: rows are range-sorted by
   (round, label, code) and compared inside runs of at most ``RUN`` rows, which cross the borders of
   codes but not those of labels, so each label is cut as finely as its own size needs, and a hot code
   is spread over tasks.
3. Descent: each node's neighbours and reverse neighbours (the nearest, twice its list's length) are
   compared with one another, improvements enter the lists, until the lists settle.
4. A list whose last entry still is a link is saturated and tells nothing of the links beyond it: it
   doubles in length (8, 16, ... ``LONGEST``), its entries count as new, and descent goes on.  Only nodes that
   saturate the longest list, members of groups of over ``LONGEST`` near copies, are compared with every
   node of their label in pairs of blocks of about ``SIDE`` vectors; a pair of blocks emits a count per
   vector and the trees of its links, never its pairs.
5. The lists are audited against brute force, for a bounded sample of nodes in each size class of labels:
   the recall of a class is the mean over its sampled nodes that have a true link.  A class of which all
   nodes were sampled needs no more proof; other classes with under ``PROVEN`` such nodes are judged by
   their pooled sample, and its interval is logged.  Below ``RECALL`` another round of planes and descent
   with lists of twice the length is added, ``RETRIES`` times; what is still below is compared as in 4.
6. Entries with cosine >= ``threshold`` are the links; :mod:`.components` joins them.

Defined edge cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows with a null label, link with nothing; vectors of different lengths do not link; rows
with null vec_id link with nothing and have a null component; repeated rows are vectors of their
own and link with one another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .common import dropped, lean, written

THRESHOLD = 0.93
NEAREST = 8              # length of a list at first
LONGEST = 64             # and at most
RUN = 128
ROUNDS = 5               # codings of the first graph
PLANES = 40
SETTLED = 0.002          # share of changed list entries at which descent ends
SIDE = 2048              # vectors of a block
BLOCK = 512              # vectors of it multiplied at a time
PRODUCTS = 1 << 20       # pairs of members compared at a time
AUDITED = 200
PROVEN = 50              # sampled nodes with links that a recall needs
RECALL = 0.97
RETRIES = 2

_log = logging.getLogger(__name__)


def _unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors (rows) of packed doubles of one length."""
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return v


def _prepare(batches):
    """Packed unit vector, null where the row cannot link."""
    for batch in batches:
        out = []
        for x in batch.column("embedding").to_pylist():
            v = None
            if x and None not in x:
                v = np.array(x, np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top
                    v = (v / np.sqrt(v @ v)).astype("<f8").tobytes()
                else:
                    v = None
            out.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], ["row", "unit"])


def _coded(seed: int, rounds: int):
    def run(batches):
        for batch in batches:
            raw, nodes, labels = (batch.column(c).to_pylist() for c in ("unit", "node", "label"))
            for size in sorted({len(r) for r in raw}):
                at = [i for i, r in enumerate(raw) if len(r) == size]
                u = _unit([raw[i] for i in at])
                for k in range(rounds):
                    planes = np.random.default_rng([seed, k, size]).standard_normal((size // 8, PLANES))
                    code = ((u @ planes > 0) << np.arange(PLANES)[::-1]).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), k, np.int64)), pa.array(np.full(len(at), size, np.int64)),
                         pa.array([labels[i] for i in at], pa.string()), pa.array(code),
                         pa.array([nodes[i] for i in at], pa.int64()), pa.array([raw[i] for i in at], pa.binary())],
                        ["round", "size", "label", "code", "node", "unit"])
    return run


def _best(nodes: np.ndarray, sims: np.ndarray, k: int):
    """(a, b, sim) of the k best other nodes of each row."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(nodes) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(nodes, k), nodes[top].ravel(), np.take_along_axis(sims, top, 1).ravel()


def _runs(k: int):
    """Neighbours inside runs of about equal length of each label of a sorted partition."""
    def run(batches):
        for batch in batches:
            if batch.num_rows < 2:
                continue
            raw = batch.column("unit").to_pylist()
            label = batch.column("label").dictionary_encode().indices.to_numpy()
            key = np.stack([batch.column("round").to_numpy(), batch.column("size").to_numpy(), label])
            node = batch.column("node").to_numpy()
            starts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            a, b, s = [], [], []
            for lo, hi in zip([0, *starts.tolist()], [*starts.tolist(), len(node)]):
                cuts = np.linspace(lo, hi, -(-(hi - lo) // RUN) + 1).astype(int).tolist()
                for at, to in zip(cuts, cuts[1:]):
                    if to - at > 1:
                        u = _unit(raw[at:to])
                        x, y, z = _best(node[at:to], u @ u.T, k)
                        a.append(x)
                        b.append(y)
                        s.append(z)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], ["a", "b", "sim"])
    return run


def _centres(members) -> list[tuple[int, int]]:
    """Ranges of centres whose members, all as many as the most in a range, make at most ``PRODUCTS`` pairs."""
    size = np.diff(members.offsets.to_numpy())
    cuts, at, most = [], 0, 0
    for i, n in enumerate(size.tolist()):
        most = max(most, n)
        if i > at and (i + 1 - at) * most * most > PRODUCTS:
            cuts.append((at, i))
            at, most = i, n
    return [*cuts, (at, len(size))] if len(size) else []


def _local_joins(batches):
    """Improvements among the members of each centre."""
    for batch in batches:
        for at, to in _centres(batch.column("members")):
            lists = batch.column("members").slice(at, to - at)
            flat = lists.flatten()
            size = np.diff(lists.offsets.to_numpy())
            node, floor = flat.field("node").to_numpy(), flat.field("floor").to_numpy()
            fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
            if not len(node):
                continue
            u = _unit(flat.field("unit").to_pylist())
            width = int(size.max())
            inside = np.arange(width)[None, :] < size[:, None]
            place = np.zeros((len(size), width), np.int64)
            place[inside] = np.arange(len(node))
            got = u[place]
            sims = got @ got.transpose(0, 2, 1)
            x, y = place[:, :, None], place[:, None, :]
            good = inside[:, :, None] & inside[:, None, :] & (node[x] != node[y]) & (sims > floor[x]) & (fresh[x] | fresh[y])
            c, i, j = np.nonzero(good)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[place[c, i]]), pa.array(node[place[c, j]]), pa.array(sims[c, i, j])], ["a", "b", "sim"])


def _lists(edges: DataFrame, wants: DataFrame) -> DataFrame:
    """Best entries per node, as many as ``wants(a, k)`` says (``NEAREST`` for nodes it does not have)."""
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b", "fresh")), asc=False).alias("near"))
    k = F.coalesce("k", F.lit(NEAREST))
    return ranked.join(wants, "a", "left").select("a", F.slice("near", F.lit(1), k).alias("near"), k.alias("k"))


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("a", F.inline("near")).select("a", "b", "sim", "fresh")


def _descend(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Neighbours-of-neighbours joins until the lists settle; ``fresh`` marks entries not yet joined.  A saturated list
    takes no nearer entries: it holds links alone and is made longer in any case."""
    while True:              # ends: lists only improve
        one = _edges(graph)
        both = (one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "fresh"))
                .groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh")))
        order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        member = (both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * LONGEST)
                  .join(graph.select("a", "k"), "a", "left").filter(F.col("place") <= 2 * F.coalesce("k", F.lit(NEAREST)))
                  .select(F.col("a").alias("centre"), F.col("b").alias("node"), "fresh"))
        busy = member.groupBy("centre").agg(F.max("fresh").alias("any")).filter("any").select("centre")
        floor = graph.select(F.col("a").alias("node"),
                             F.when(F.size("near") < F.col("k"), -1.0).when(F.element_at("near", -1)["sim"] >= threshold, 2.0)
                             .otherwise(F.element_at("near", -1)["sim"]).alias("floor"))
        found = (member.join(busy, "centre", "left_semi")
                 .join(nodes.select("node", "unit").join(floor, "node", "left").na.fill(-1.0, ["floor"]), "node")
                 .groupBy("centre").agg(F.collect_list(F.struct("node", "unit", "floor", "fresh")).alias("members"))
                 .select("members").mapInArrow(lean(_local_joins), "a long, b long, sim double"))
        joined = one.withColumn("fresh", F.lit(False)).union(found.withColumn("fresh", F.lit(True)))
        old, graph = graph, written(_lists(joined, graph.select("a", "k")), "descent")
        dropped(old)
        total, changed = _edges(graph).agg(F.count("*"), F.count_if("fresh")).first()
        if changed <= SETTLED * total:
            return graph


def _grown(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """The settled graph with every saturated list doubled, and settled again, up to ``LONGEST`` entries."""
    while True:
        graph = _descend(nodes, graph, threshold)
        full = (F.size("near") >= F.col("k")) & (F.element_at("near", -1)["sim"] >= threshold) & (F.col("k") < LONGEST)
        if graph.filter(full).isEmpty():
            return graph
        again = F.when(full, F.transform("near", lambda x: x.withField("fresh", F.lit(True)))).otherwise(F.col("near"))
        old, graph = graph, written(graph.select("a", again.alias("near"), F.when(full, 2 * F.col("k")).otherwise(F.col("k")).alias("k")),
                                    "longer")
        dropped(old)


def _block_links(threshold: float):
    """Of one pair of blocks (chosen nodes, nodes): each node's weighted links, counted at chosen nodes in full and at
    the others to chosen ones, and the least node it is joined to inside the pair."""
    none = np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        chosen, left = (table.column(c).to_numpy() for c in ("chosen", "left"))
        u = _unit(table.column("unit").to_pylist())
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        near = np.concatenate([u[x[at:at + BLOCK]] @ u[y].T >= threshold for at in range(0, max(1, len(x)), BLOCK)])
        near &= node[x][:, None] != node[y][None, :]
        low, high = node[x], node[y]
        while True:
            new = np.minimum(low, np.where(near, high[None, :], none).min(1, initial=none))
            newer = np.minimum(high, np.where(near, new[:, None], none).min(0, initial=none))
            if (new == low).all() and (newer == high).all():
                break
            low, high = new, newer
        links = np.concatenate([near @ copies[y], np.where(chosen[y], 0, near.T @ copies[x])])
        return pa.table({"node": np.concatenate([node[x], node[y]]), "links": links, "root": np.concatenate([low, high])})
    return run


def _exact_links(nodes: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) of all pairs of blocks between the ``chosen(node)`` and every node of their label: the sum of
    ``links`` is the degree of a chosen node and the links to chosen nodes of another; (node, root) join what is linked."""
    key = ["label", "size"]
    named = (nodes.join(chosen.select("node", F.lit(True).alias("chosen")), "node", "left")
             .select("node", "label", F.length("unit").alias("size"), "unit", "copies",
                     F.coalesce("chosen", F.lit(False)).alias("chosen")))
    groups = (named.groupBy(*key).agg(F.count_if("chosen").alias("picked"), F.count("*").alias("m")).filter("picked > 0")
              .select(*key, *(F.ceil(F.col(c) / SIDE).cast("long").alias(n) for c, n in (("picked", "lefts"), ("m", "rights")))))
    rows = named.join(groups, key)
    columns = [*key, "node", "unit", "copies", "chosen"]
    lefts = rows.filter("chosen").select(*columns, F.lit(True).alias("left"), F.pmod(F.xxhash64("node"), "lefts").alias("i"),
                                         F.explode(F.expr("sequence(0L, rights - 1)")).alias("j"))
    rights = rows.select(*columns, F.lit(False).alias("left"), F.explode(F.expr("sequence(0L, lefts - 1)")).alias("i"),
                         F.pmod(F.xxhash64("node"), "rights").alias("j"))
    return (lefts.union(rights.select(*lefts.columns)).groupBy(*key, "i", "j")
            .applyInArrow(_block_links(threshold), "node long, links long, root long"))


def _audit(nodes: DataFrame, listed: DataFrame, degrees: DataFrame, threshold: float) -> dict:
    """Recall of each class of ``listed(node, label, unit, class)``: over a bounded sample of its nodes that have true
    links, the mean share of them that ``degrees(node, links)`` has."""
    sizes = {r["class"]: r["count"] for r in listed.groupBy("class").count().collect()}      # powers of two
    recall, open_ = {}, dict(sizes)
    for wanted in (AUDITED, 16 * AUDITED):
        shares = {c: min(1.0, wanted / n) for c, n in open_.items()}
        if not shares:
            break
        cut = F.create_map(*[F.lit(x) for c, share in shares.items() for x in (c, int(share * (1 << 30)))])
        part = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30))
        chosen = written(listed.filter(part < cut[F.col("class")]), "audited")
        found = _recall(nodes, chosen, degrees, threshold)
        dropped(chosen)
        for c, share in shares.items():
            shared, proofs = found.get(c, (0.0, 0))
            if proofs >= PROVEN or share == 1.0:
                recall[c] = shared / proofs if proofs else 1.0
                del open_[c]
    if open_:
        shared, proofs = map(sum, zip(*(found.get(c, (0.0, 0)) for c in open_)))
        pooled = shared / proofs if proofs else 1.0
        z = 1.96 ** 2 / max(proofs, 1)
        middle, half = (pooled + z / 2) / (1 + z), np.sqrt(z * pooled * (1 - pooled) + z * z / 4) / (1 + z)
        _log.info("classes %s: pooled recall %.3f (%.3f to %.3f) of %d proofs", sorted(open_), pooled, middle - half, middle + half, proofs)
        recall |= dict.fromkeys(open_, pooled)
    return recall


def _recall(nodes: DataFrame, chosen: DataFrame, degrees: DataFrame, threshold: float) -> dict:
    """(sum of the shares found, number) of the ``chosen`` nodes with true links, by class."""
    by: dict = {}
    for q in chosen.select("node", "label", "unit").collect():
        by.setdefault((q.label, len(q.unit)), []).append(q)
    sent = nodes.sparkSession.sparkContext.broadcast(
        {key: (np.array([q.node for q in some]), _unit([bytes(q.unit) for q in some])) for key, some in by.items()})

    def count(batches):
        for batch in batches:
            raw, labels = batch.column("unit").to_pylist(), batch.column("label").to_pylist()
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            where: dict = {}
            for i, key in enumerate(zip(labels, map(len, raw))):
                where.setdefault(key, []).append(i)
            for key, rows in where.items():
                if key in sent.value:
                    ids, u = sent.value[key]
                    near = (u @ _unit([raw[i] for i in rows]).T >= threshold) & (ids[:, None] != node[rows][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ copies[rows])], ["node", "links"])

    true = nodes.mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("truth"))
    found = (true.filter("truth > 0").join(chosen.select("node", "class"), "node").join(degrees, "node", "left")
             .na.fill(0, ["links"]).groupBy("class").agg(F.sum(F.least("truth", "links") / F.col("truth")).alias("shared"),
                                                       F.count("*").alias("proofs")).collect())
    sent.destroy()
    return {r["class"]: (r.shared, r.proofs) for r in found}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    rows = written(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding"), "vectors")
    units = rows.select("row", "embedding").mapInArrow(_prepare, "row long, unit binary")
    able = (rows.select("row", "vec_id", F.col("label").cast("string").alias("label")).join(units, "row")
            .filter("unit IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL"))
    able = written(able, "units")
    nodes = written(able.groupBy("label", "unit").agg(F.min("row").alias("node"), F.count("*").alias("copies"),
                                                      F.min("vec_id").alias("least")), "nodes")
    key = ["label", F.length("unit").alias("size")]
    groups = nodes.groupBy(*key).agg(F.count("*").alias("m")).withColumn("class", F.floor(F.log2("m")).cast("int"))
    sized = nodes.select("node", "unit", *key).join(groups, ["label", "size"])
    able_to = written(sized.select("node", "label", "unit", "class"), "sized")
    graph, wants = None, nodes.select(F.col("node").alias("a"), F.lit(NEAREST).alias("k"))
    for attempt in range(RETRIES + 1):
        coded = able_to.mapInArrow(_coded(seed + attempt, ROUNDS),
                                   "round long, size long, label string, code long, node long, unit binary")
        order = ["round", "size", "label", "code", "node"]
        first = (coded.repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInArrow(_runs(NEAREST << attempt), "a long, b long, sim double").withColumn("fresh", F.lit(True)))
        old = graph
        if graph is not None:
            first = first.union(_edges(graph).withColumn("fresh", F.lit(False)))
            wants = graph.select("a", F.least(2 * F.col("k"), F.lit(LONGEST)).alias("k"))
        graph = written(_lists(first, wants), "first-graph")
        if old is not None:
            dropped(old)
        graph = _grown(nodes, graph, threshold)
        full = written(graph.filter((F.size("near") >= F.col("k")) & (F.element_at("near", -1)["sim"] >= threshold))
                       .select(F.col("a").alias("node")), "saturated")
        links = written(_edges(graph).filter(F.col("sim") >= threshold).select("a", "b"), "near-links")
        both = written(links.union(links.select("b", "a")).distinct()
                       .join(nodes.select(F.col("node").alias("b"), "copies"), "b").select("a", "b", "copies"), "both-links")
        degrees = both.groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("links"))
        recall = _audit(nodes, able_to.join(full, "node", "left_anti"), degrees, threshold)
        _log.info("round %d: recall %s", attempt, recall)
        short = [c for c, r in recall.items() if r < RECALL]
        if not short:
            break
    missed = able_to.filter(F.col("class").isin(short)).select("node") if short else full.limit(0)
    chosen = written(full.union(missed).distinct(), "compared")
    _log.info("%d nodes compared with their whole label, %d of them for classes %s below the recall",
              chosen.count(), missed.count() if short else 0, short)
    exact = written(_exact_links(nodes, chosen, threshold), "block-links")
    parts = written(components(links.union(exact.filter("node <> root").select("node", "root"))), "near-parts")
    listed = (both.join(chosen.withColumnRenamed("node", "a"), "a", "left_anti")
              .join(chosen.withColumnRenamed("node", "b"), "b", "left_anti").select(F.col("a").alias("node"), "copies"))
    degrees = listed.union(exact.select("node", "links")).groupBy("node").agg(F.sum("copies").alias("links"))
    named = (nodes.join(parts, "node", "left").select("node", "label", "unit", "copies", "least",
                                                     F.coalesce("component", "node").alias("part")))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    per_node = (named.join(least, "part").join(degrees, "node", "left")
                .select("label", "unit", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked = able.join(per_node, ["label", "unit"]).select("row", "n_links", "component_id")
    return rows.select("row", "vec_id").join(linked, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))


def op1_nn_descent(spark, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicates(vectors)
