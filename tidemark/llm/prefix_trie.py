"""Shared beginnings of conversations: a prefix trie by adaptive radix trees.

A turn is told by 16 bytes of a digest of its role and text, so a conversation is
a byte string of fixed-width big-endian ids, and beginnings of turns are byte
depths that are multiples of 16. Texts themselves are never moved.

1. Turns get their place in a conversation by a range sort over all turns, so a
   very long conversation spreads over tasks. Conversations are rebuilt with the
   head of another one.
2. From the first turn that no other conversation has at that depth, a
   conversation is alone. Its further nodes follow row by row and it enters the
   trees only up to that turn, so what a task holds of a conversation is what it
   shares with another one.
3. Conversations with the same sequence become one row, in one stream over their
   sorted ids, which also makes the digest of the ids: that is one task for each
   sequence, as a digest needs its bytes in order, but in constant memory.
4. Sequences are range-partitioned by their bytes. Each task builds an adaptive
   radix tree of its range (radix_tree.py) and emits the nodes at turn-aligned
   depths. Only beginnings of a task's first and last sequence can be in other
   tasks, too. These nodes, two paths for each task, are added up across tasks by
   the digest of their beginning; sums over their subtrees come from running sums
   along the paths, in which every node is counted on one path only.

Defined results: null turns come first; turns with the same number are ordered by
their digest; null role or text is empty. Rows without conv_id belong to no
conversation. A conversation that has turns before, but none after rebuilding is a
member of the root only. An empty table has no members and so not even a root.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.radix_tree import TURN, TurnNodes
from tidemark.llm.tables import partitions_for, table
from tidemark.operators.ranking import block_offsets, place_in_order
from tidemark.session import materialize

#: conversations take heads of fewer turns than this, from the first one of so many ids
HEADS, FAMILY = 6, 100
#: sequences in a tree, about
PER_TREE = 50_000

SEQUENCES = "key binary, points array<int>, goes_on boolean, n long, conv long, ends string"
NODES = (
    "path binary, depth long, node binary, parent binary, conv long, parent_conv long, n long, "
    "children long, leaves long, saved long, point long, goes_on boolean, ends string"
)
NOTHING = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (16 bytes) and point (code points of the text) of each turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    # the role's length ahead tells ("a", "bc") from ("ab", "c")
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * TURN))
    return conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("id"), F.length(text).alias("point"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, id, point) of rebuilt conversations, depths from 1; and (conv, length) of all."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("point")]
    # turns alike in all of these are alike altogether, so which comes first does not matter
    placed = place_in_order(turn_ids(conversations), order, "turns", unique=True)
    offsets = block_offsets(placed, _before=F.count("*"))
    # one row per shuffle partition
    numbered = placed.join(F.broadcast(offsets), "block").select("conv_id", "id", "point", (F.col("_before") + F.col("place")).alias("at"))
    own = numbered.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    own = own.select("*", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("lead"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("head"))
    leads = own.select(F.col("conv_id").alias("lead"), F.col("size").alias("lead_size"))
    own = own.join(leads, "lead", "left").withColumn("taken", F.least("head", F.coalesce("lead_size", F.lit(0))))
    own = materialize(own, "conversations")
    turns = materialize(
        numbered.join(own.select("conv_id", "first", "head", "taken"), "conv_id")
        .select("conv_id", "id", "point", (F.col("at") - F.col("first")).alias("place"), "head", "taken")
        .where(F.col("place") >= F.col("head"))
        .select(F.col("conv_id").alias("conv"), (F.col("taken") + F.col("place") - F.col("head") + 1).alias("depth"), "id", "point")
        .unionByName(_heads(numbered, own)),
        "rebuilt",
    )
    lengths = own.select(F.col("conv_id").alias("conv"), (F.col("taken") + F.greatest(F.col("size") - F.col("head"), F.lit(0))).alias("length"))
    return turns, lengths


def _heads(numbered: DataFrame, own: DataFrame) -> DataFrame:
    """The turns that conversations take from another one; at most five, to at most 199 conversations each."""
    leads = own.where(F.col("conv_id") == F.col("lead")).select("conv_id", "first")
    close = numbered.join(leads, "conv_id").where(F.col("at") - F.col("first") < HEADS - 1)
    close = close.select(F.col("conv_id").alias("lead"), "id", "point", (F.col("at") - F.col("first")).alias("place"))
    takers = own.where("taken > 0").select("conv_id", "lead", "taken")
    return (
        close.join(takers, "lead")
        .where(F.col("place") < F.col("taken"))
        .select(F.col("conv_id").alias("conv"), (F.col("place") + 1).alias("depth"), "id", "point")
    )


def merge_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence of rows that are sorted by key, goes_on and conv."""
    rows: list[tuple] = []
    now, digest = None, None

    def close():
        rows.append((*now, NOTHING if now[2] else digest.hexdigest()))

    def batch():
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.binary(), pa.list_(pa.int32()), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        names = ["key", "points", "goes_on", "n", "conv", "ends"]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        rows.clear()
        return out

    for part in batches:
        for key, goes_on, conv, points in zip(*(part.column(c) for c in ("key", "goes_on", "conv", "points")), strict=True):
            key, goes_on, conv = key.as_py(), goes_on.as_py(), conv.as_py()
            if now is not None and now[0] == key and now[2] == goes_on:
                now[3] += 1
                digest.update(b",%d" % conv)
                continue
            if now is not None:
                close()
            now, digest = [key, points.as_py(), goes_on, 1, conv], hashlib.sha256(b"%d" % conv)
        yield batch()
    if now is not None:
        close()
    yield batch()


def prefix_digests(key: bytes) -> list[bytes]:
    """A digest of each turn-aligned beginning of a key, the empty one first."""
    state = hashlib.sha256()
    found = [state.digest()]
    for at in range(0, len(key), TURN):
        state.update(key[at : at + TURN])
        found.append(state.digest())
    return found


def tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task's tree.

    Nodes that no other task has are finished and have no path. The others stand
    on the path of the task's first or last sequence; one on both has its counts
    on the first.
    """
    rows = [row for part in batches for row in part.to_pylist()]
    if not rows:
        return
    keys, goes_on, ends = ([r[c] for r in rows] for c in ("key", "goes_on", "ends"))
    t = TurnNodes(keys, [r["n"] for r in rows], [r["conv"] for r in rows], [r["points"] for r in rows], goes_on)
    first, last = prefix_digests(keys[t.first]), prefix_digests(keys[t.last])
    out = []
    for at in range(len(t.depth)):
        depth, parent, end = t.depth[at], t.parent[at], t.end[at]
        told = ends[end] if end >= 0 else NOTHING
        if not t.holds[at]:
            up = first if t.holds[parent] & 1 else last
            open_parent = up[depth - 1] if t.holds[parent] else None
            out.append((None, depth, None, open_parent, t.conv[at], None if open_parent else t.conv[parent], t.n[at], t.children[at], t.leaves[at], t.saved[at], 0, False, told))
            continue
        up = first if t.holds[at] & 1 else last
        on = end >= 0 and goes_on[end]
        above = up[depth - 1] if depth else None
        out.append((up[-1], depth, up[depth], above, t.conv[at], None, t.n[at], t.children[at], t.leaves[at], t.saved[at], t.point[at], on, told if end >= 0 else None))
        if t.holds[at] == 3 and t.first != t.last:
            out.append((last[-1], depth, up[depth], above, None, None, 0, 0, 0, 0, 0, False, None))
    schema = {"path": pa.binary(), "depth": pa.int64(), "node": pa.binary(), "parent": pa.binary()}
    schema |= dict.fromkeys(("conv", "parent_conv", "n", "children", "leaves", "saved", "point"), pa.int64())
    schema |= {"goes_on": pa.bool_(), "ends": pa.string()}
    for low in range(0, len(out), 20_000):
        columns = zip(*out[low : low + 20_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, schema.values(), strict=True)], list(schema))


def _finish(conv, depth, parent_conv, n, children, leaves, saved, ends) -> list[Column]:
    values = [conv, depth, parent_conv, n, children, leaves, saved]
    named = [(F.col(v) if isinstance(v, str) else v).cast("long").alias(name) for v, name in zip(values, RESULT, strict=False)]
    return [*named, (F.col(ends) if isinstance(ends, str) else ends).alias("ends_sha256")]


def merge_paths(spine: DataFrame) -> DataFrame:
    """The nodes on the tasks' paths, added up over tasks; ``spine`` has one row per path and depth."""
    met = spine.groupBy("node").agg(
        F.max("depth").alias("depth"),
        F.max("parent").alias("parent"),
        F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        F.max("point").alias("point"),
        F.max("goes_on").alias("goes_on"),
        F.max("ends").alias("ends"),
        F.min("path").alias("owner"),
    )
    below = met.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open_children"))
    on = F.col("goes_on").cast("int")
    met = met.join(below, "node", "left").withColumn("children", F.col("children") + F.coalesce("open_children", F.lit(0)) + on)
    own_leaf = ((F.col("children") == 0) | F.col("goes_on")).cast("int")
    met = met.withColumn("leaves", F.col("leaves") + own_leaf).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("point"))
    met = materialize(met.drop("open_children", "goes_on", "point"), "shared-nodes")
    mine = F.col("path") == F.col("owner")
    deeper = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = (
        spine.select("path", "depth", "node")
        .join(met.select("node", "owner", "leaves", "saved"), "node")
        .select("node", *[F.sum(F.when(mine, F.col(c)).otherwise(0)).over(deeper).alias(c) for c in ("leaves", "saved")])
        .groupBy("node")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    parents = met.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    return met.drop("leaves", "saved").join(sums, "node").join(parents, "parent", "left")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations (conv_id, turn, role, text); columns as in RESULT."""
    spark = conversations.sparkSession
    turns, lengths = rebuilt_turns(conversations)
    single = turns.groupBy("depth", "id").agg(F.count("*").alias("k"), F.min("conv").alias("conv")).where("k = 1")
    # from this depth on a conversation shares nothing
    alone = materialize(lengths.join(single.groupBy("conv").agg(F.min("depth").alias("alone")), "conv", "left"), "lengths")
    turns = turns.join(alone, "conv")
    held = turns.where("alone is null or depth <= alone").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "id", "point"))).alias("t"))
    whole = alone.join(held, "conv", "left").select(
        "conv",
        F.coalesce(F.concat_ws("", F.transform("t", lambda x: F.hex(x["id"]))), F.lit("")).alias("key"),
        F.coalesce(F.transform("t", lambda x: x["point"]), F.array().cast("array<int>")).alias("points"),
        F.coalesce(F.col("alone") < F.col("length"), F.lit(False)).alias("goes_on"),
    )
    whole = whole.withColumn("key", F.unhex("key"))
    alike = whole.repartition("key").sortWithinPartitions("key", "goes_on", "conv").mapInArrow(merge_alike, SEQUENCES)
    alike = materialize(alike, "sequences")
    trees = partitions_for(spark, alike.count(), PER_TREE)
    nodes = materialize(alike.repartitionByRange(trees, "key").mapInArrow(tree_rows, NODES), "nodes")
    shared = materialize(merge_paths(nodes.where("path is not null")), "shared-nodes")
    ends = F.coalesce("ends", F.lit(NOTHING))
    top = shared.select(*_finish("conv", "depth", "parent_conv", "n", "children", "leaves", "saved", ends))
    parents = shared.select(F.col("node").alias("parent"), F.col("conv").alias("open_conv"))
    inner = nodes.where("path is null").join(parents, "parent", "left")
    inner = inner.select(*_finish("conv", "depth", F.coalesce("parent_conv", "open_conv"), "n", "children", "leaves", "saved", "ends"))
    last = F.col("depth") == F.col("length")
    zero, one = F.lit(0), F.lit(1)
    rest = turns.where("depth > alone").select(
        *_finish("conv", "depth", "conv", one, F.when(last, 0).otherwise(1), one, zero, F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(NOTHING))
    )
    return top.unionByName(inner).unionByName(rest)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared beginnings of all conversations, rebuilt with the heads of others."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
