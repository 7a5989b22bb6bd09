r"""Prefix trie of conversations by fixed-length block hashing.

1. Turns become a 128-bit digest of (role, text) and the text's code points; texts go no further.  A range sort
   numbers the turns of a conversation, whatever its length, task by task; one offset per task puts the numbers
   of a conversation that spans tasks together.
2. Conversations are rebuilt (:func:`rebuilt`) and cut into blocks of ``BLOCK`` turns.  Digests of successive
   blocks are chained by doubling: after round r a block's digest covers the 2^r blocks up to it, so a
   conversation of m blocks needs log2(m) joins on its unique (conversation, block) and no long window.
3. Conversations with equal chained digests share all turns so far.  They are counted per digest, which leaves one
   row per distinct block; blocks after the same chain are siblings.
4. A block without siblings yields its turns as a chain of nodes.  Only where siblings diverge are turn
   boundaries refined: the prefixes of those blocks are hashed and grouped.
5. Sums over subtrees: each group of siblings adds up its nodes, groups hand their sums up by doubling along the
   chain of groups (pre-aggregated per receiver), and inside a block a node adds to at most ``BLOCK`` ancestors.
6. The members that end at a node are digested in order by :mod:`.pieces`.

Hot groups: counts and sums are combined before each shuffle; no list of members or siblings is ever built in one
row or window.  The one join on a key that may be hot, of nodes with their parent's row, is split by AQE.

Defined edge cases: null role and text are empty; turns are ordered by turn (null first), then role, then digest;
repeated rows are turns of their own; rows with a null conv_id belong to no conversation; a table without
conversations gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import crc_mod, written
from .pieces import LAYOUT, cut_into_runs, read_pieces, runs

BLOCK = 4                          # turns of a block
SHARED, FOLDS = 100, 6             # conversations of a hundred share opening turns; how many: crc32 modulo 6
SPAN = 4096                        # turns of a conversation that are looked up together
ROOT = b"\0"                       # key of the root; digests have 16 bytes


def _digest(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


# ---------------------------------------------------------------- turns and rebuilt conversations

def _positions(batches):
    """Place of each row in the run of its conversation inside this task."""
    from pyspark import TaskContext
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        starts = np.array(runs(ids))
        sizes = np.diff(np.append(starts, batch.num_rows))
        goes_on = count if last is not None and ids[0].as_py() == last else 0
        pos = np.arange(batch.num_rows) - np.repeat(starts, sizes)
        pos[:sizes[0]] += goes_on
        last, count = ids[batch.num_rows - 1].as_py(), int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("digest"), batch.column("chars"), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(pos)],
            ["conv_id", "digest", "chars", "part", "pos"])


def turns_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 0, digest, chars) of every turn, and (conv_id, n) of every conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.length(text).alias("chars"))
    order = ["conv_id", "turn", "role", "digest"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars")
    numbered = written(ordered.mapInArrow(_positions, "conv_id long, digest binary, chars int, part int, pos long"), "trie-turns")
    parts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("ahead", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n"))
    before = before.filter("ahead > 0").select("conv_id", "part", "ahead")          # at most one row per task
    turns = numbered.join(F.broadcast(before), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("ahead", F.lit(0))).alias("pos"), "digest", "chars")
    return turns, parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, at, total, digest, chars) and conversations (c, total) after sharing: conversation c starts with the
    first h turns of conversation c - c % 100 (those there are) and goes on with its own turns after its first h."""
    base = sizes.filter(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select(F.col("conv_id").alias("c"), "n", crc_mod(F.col("conv_id"), FOLDS).alias("h"),
                         (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    convs = convs.join(base, "base", "left").select(
        "c", "n", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    convs = written(convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    spans = convs.filter("n > h").select("c", "h", "taken", "total", F.explode(
        F.sequence(F.lit(0), F.expr(f"(n - 1) div {SPAN}"))).alias("span"))
    own = (turns.withColumn("span", F.expr(f"pos div {SPAN}")).join(spans.withColumnRenamed("c", "conv_id"), ["conv_id", "span"])
           .filter("pos >= h").select(F.col("conv_id").alias("c"), F.expr("taken + pos - h").alias("at"), "total", "digest", "chars"))
    opening = turns.filter((F.col("conv_id") % SHARED == 0) & (F.col("pos") < FOLDS - 1))
    shared = (opening.withColumnRenamed("conv_id", "base").join(convs.filter("taken > 0").select("c", "base", "taken", "total"), "base")
              .filter("pos < taken").select("c", F.col("pos").alias("at"), "total", "digest", "chars"))
    return own.unionByName(shared), convs.select("c", "total")


# ---------------------------------------------------------------- chained block digests

def chained(turns: DataFrame) -> DataFrame:
    """c, k, blocks of c, turns of block k, chained digest ``d`` up to it, and ``g``, the digest before it."""
    blocks = turns.groupBy("c", F.expr(f"at div {BLOCK}").alias("k"), "total").agg(
        F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("turns"))
    joined = F.aggregate("turns", F.unhex(F.lit("")), lambda x, t: F.concat(x, t["digest"]))
    blocks = written(blocks.select("c", "k", F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("blocks"), "turns",
                                   _digest(joined).alias("d")), "trie-blocks")
    longest = blocks.agg(F.max("blocks")).first()[0] or 0
    left, step, ready = blocks.drop("turns"), 1, []
    while step < longest:
        ready.append(left.filter(F.col("blocks") <= step))
        left = left.filter(F.col("blocks") > step)
        earlier = left.filter(F.col("k") + step < F.col("blocks")).select("c", (F.col("k") + step).alias("k"), F.col("d").alias("e"))
        moved = left.filter(F.col("k") >= step).join(earlier, ["c", "k"]).withColumn("d", _digest(F.concat("e", "d"))).drop("e")
        left = written(left.filter(F.col("k") < step).unionByName(moved), "trie-chain")
        step *= 2
    for more in ready:
        left = left.unionByName(more)
    before = left.filter(F.col("k") + 1 < F.col("blocks")).select("c", (F.col("k") + 1).alias("k"), F.col("d").alias("g"))
    left = left.join(before, ["c", "k"], "left").withColumn("g", F.coalesce("g", F.lit(ROOT)))
    return left.join(blocks.select("c", "k", "turns"), ["c", "k"])


# ---------------------------------------------------------------- nodes

def distinct_blocks(chain: DataFrame) -> DataFrame:
    """One row per chained digest: d, g, k, turns, n conversations, conv the smallest, alone (no siblings)."""
    found = chain.groupBy("d", "k").agg(F.count("*").alias("n"), F.min("c").alias("conv"))
    one = chain.select(F.col("c").alias("conv"), "k", "g", "turns")
    blocks = written(found.join(one, ["conv", "k"]), "trie-distinct")
    single = (blocks.groupBy("g").agg(F.count("*").alias("m"), F.min("conv").alias("conv"), F.min("k").alias("k"))
              .filter("m = 1").select("conv", "k", F.lit(True).alias("alone")))
    return blocks.join(single, ["conv", "k"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))


def _keys(blocks: DataFrame) -> DataFrame:
    """Adds ``keys``, the node key of each turn of a block; a full block's last node has the block's digest."""
    places = F.sequence(F.lit(1), F.size("turns"))
    whole = F.lit(BLOCK)
    alone = F.transform(places, lambda j: F.when(j == whole, F.col("d")).otherwise(
        _digest(F.concat("d", F.lit("/").cast("binary"), j.cast("string").cast("binary")))))
    among = F.transform(places, lambda j: F.when(j == whole, F.col("d")).otherwise(
        _digest(F.concat(F.col("g"), F.aggregate(F.slice("turns", 1, j), F.unhex(F.lit("")), lambda x, t: F.concat(x, t["digest"]))))))
    return blocks.withColumn("keys", F.when(F.col("alone"), alone).otherwise(among))


def nodes_of(blocks: DataFrame) -> DataFrame:
    """key, parent, path (keys from the block's first turn), g, k, depth, chars, n, conv of every node but the root,
    from ``blocks`` with keys."""
    turn = blocks.select("g", "k", "n", "conv", "alone", "keys", F.posexplode("turns").alias("j", "turn"))
    turn = turn.select(
        F.col("keys")[F.col("j")].alias("key"), F.when(F.col("j") == 0, F.col("g")).otherwise(F.get("keys", F.col("j") - 1)).alias("parent"),
        F.slice("keys", F.lit(1), F.col("j") + 1).alias("path"), "g", "k", (F.col("k") * BLOCK + F.col("j") + 1).alias("depth"),
        F.col("turn.chars").cast("long").alias("chars"), "n", "conv", "alone")
    among = turn.filter(~F.col("alone"))
    merged = among.groupBy("key").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"))
    return turn.filter("alone").drop("alone").unionByName(merged.join(among.drop("n", "alone"), ["key", "conv"]))


def handed_up(groups: DataFrame, levels: int, values: list[str]) -> DataFrame:
    """Sums of ``values`` over all groups below a group, itself included, by doubling: after the round of ``step``
    a group holds the sums of those less than ``2 * step`` below it, and ``up`` is its ancestor that far away."""
    left, step, ready = groups, 1, []
    while step <= levels:
        low = left.filter(F.col("level") >= step)
        given = low.groupBy("up").agg(*(F.sum(v).alias(f"more_{v}") for v in values)).withColumnRenamed("up", "g")
        over = left.filter(F.col("level") >= step).select(F.col("g").alias("up"), F.col("up").alias("next"))
        moved = left.filter(F.col("level") >= 2 * step).join(over, "up").select(
            "g", F.col("next").alias("up"), "level", *values)
        left = (left.filter(F.col("level") < 2 * step).withColumn("up", F.lit(None).cast("binary")).unionByName(moved)
                .join(given, "g", "left"))
        left = written(left.select("g", "up", "level", F.col(f"more_{values[0]}").isNull().alias("settled"), *(
            (F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values)), "trie-sums")
        done = F.col("settled") & (F.col("level") < 2 * step)         # nothing that deep below, nothing to give
        ready.append(left.filter(done).drop("settled"))
        left, step = left.filter(~done).drop("settled"), 2 * step
    for more in ready:
        left = left.unionByName(more)
    return left.select("g", *values)


class _Ends:
    """Digest of comma-joined ids."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, ids: str) -> None:
        self.hash.update((("," if self.any else "") + ids).encode())
        self.any = True

    def result(self) -> tuple:
        return (self.hash.hexdigest(),)


def _id_lists(batches):
    from pyspark import TaskContext
    seq = TaskContext.get().partitionId() << 32
    for rows, starts, cut in cut_into_runs(batches, "d", 1 << 20, lambda b: [(b, 8 * b.num_rows)]):
        ids = list(map(str, rows.column("c").to_pylist()))
        lists = [",".join(ids[b:e]) for b, e in zip(starts, [*starts[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays(
            [rows.column("d").combine_chunks().take(pa.array(starts)), pa.array(np.arange(seq, seq + len(starts))),
             pa.array(cut, pa.bool_()), pa.array(lists, pa.string())], ["d", "seq", "cut", "ids"])
        seq += len(starts)


def ends_of(last: DataFrame) -> DataFrame:
    """d, ends_sha256 of the conversations ``last(d, c)`` in ascending order per d."""
    ordered = last.select("d", "c").repartitionByRange("d", "c").sortWithinPartitions("d", "c")
    pieces = ordered.mapInArrow(_id_lists, LAYOUT.format(key="d", kind="binary") + "ids string")
    return read_pieces(pieces, _Ends, "ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt ``conversations(conv_id, turn, role, text)``."""
    turns, convs = rebuilt(*turns_of(conversations))
    chain = written(chained(turns), "trie-chained")
    blocks = written(_keys(distinct_blocks(chain)), "trie-keys")
    below = nodes_of(blocks)
    counts = convs.agg(F.count("*").alias("n"), F.min("c").alias("conv"))
    root = counts.filter("n > 0").select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.array(F.lit(ROOT)).alias("path"),
                                         F.lit(None).cast("binary").alias("g"), F.lit(None).cast("long").alias("k"),
                                         F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n", "conv")
    nodes = written(below.unionByName(root), "trie-nodes")

    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                    .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
                    .withColumn("saved", (F.col("n") - 1) * F.col("chars")), "trie-children")
    values = ["leaves", "saved"]
    groups = nodes.filter("g IS NOT NULL").groupBy("g").agg(F.min("k").alias("level"), *(F.sum(v).alias(v) for v in values))
    groups = groups.join(blocks.select(F.col("d").alias("g"), F.col("g").alias("up")), "g", "left").select("g", "up", "level", *values)
    groups = written(groups, "trie-groups")
    levels = groups.agg(F.max("level")).first()[0] or 0
    totals = handed_up(groups, levels, values).withColumnsRenamed({"g": "key"} | {v: f"under_{v}" for v in values})
    given = nodes.join(totals, "key", "left").select(F.explode("path").alias("key"), *(
        (F.col(v) + F.coalesce(f"under_{v}", F.lit(0))).alias(v) for v in values))
    sums = given.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    turnless = convs.filter("total = 0").select(F.lit(ROOT).alias("d"), "c")
    ends = ends_of(chain.filter("k = blocks - 1").select("d", "c").unionByName(turnless))
    at = blocks.select("d", F.element_at("keys", -1).alias("key"))
    ends = ends.join(at, "d", "left").select(F.coalesce("key", "d").alias("key"), "ends_sha256")

    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.drop(*values).join(sums, "key").join(ends, "key", "left").join(parents, "parent", "left")
            .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


# crc32 bit by bit; a node is known by the digest of its turns, subtrees are told by the ancestors of each node.
OP13_SQL = r"""
WITH RECURSIVE
rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))),
    4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM rows)),
joined AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth, role, text FROM (
    SELECT c, 0 AS own, pos, role, text FROM convs JOIN rows ON rows.conv_id = base AND pos < h
    UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN rows ON rows.conv_id = c AND pos >= h)),
chains AS (
  SELECT c, 0::BIGINT AS depth, sha256('') AS node, NULL::VARCHAR AS parent, 0::BIGINT AS chars FROM convs
  UNION ALL
  SELECT j.c, j.depth, sha256(x.node || length(j.role) || ':' || j.role || j.text), x.node, length(j.text)
  FROM chains x JOIN joined j ON j.c = x.c AND j.depth = x.depth + 1),
ends AS (SELECT node, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(node, depth) AS node FROM chains GROUP BY c) GROUP BY node),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(c) AS conv_id,
  count(*) AS n_convs FROM chains GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (
  SELECT node, node AS top FROM nodes
  UNION ALL SELECT above.node, nodes.parent FROM above JOIN nodes ON nodes.node = top WHERE nodes.parent IS NOT NULL),
sums AS (
  SELECT top AS node, sum((n_children IS NULL)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM above JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
