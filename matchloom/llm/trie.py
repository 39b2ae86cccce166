"""Prefix trie of conversations: which beginnings are shared, by how many, and what encoding them once would save."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import discard, written

#: Turns of another conversation's beginning that a rebuilt conversation can have at most, and how many share one.
MOST_HEAD, FAMILY = 3, 20
#: Levels of the trie within which nodes are exploded to all their ancestors.
LEVELS = 32
#: Ids that are joined to one text before they are hashed.
RUN_IDS = 4096
ROOT = hashlib.sha256(b"").digest()[:16]
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, turn_key, words): the turns of each conversation, numbered from 1 in the order of `turn`, null first.

    `turn_key` is the first half of the SHA-256 of role and text (with the role's length, so that no two pairs agree),
    `words` counts the text's words. Null role or text counts as empty. Turns that tie are ordered by `turn_key`; equal
    turns are interchangeable and each counts. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.left(key, F.lit(32))).alias("turn_key"), words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_key")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "turn_key", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations whose first turns are taken from the first of their family, as (conv_id, seq, turn_key, words).

    Conversation c starts with the first h turns of conversation c - c % FAMILY (all, if it has fewer; none, if there is no
    such one), h = crc32(decimal c) % (MOST_HEAD + 1), and goes on with its own turns after its first h. Every conversation has a
    row with seq 0 and no turn besides, so that turnless ones aren't lost. A family's head is at most MOST_HEAD rows, so a
    join multiplies it by at most FAMILY (twice that around 0, where ids are negative).
    """
    turns = written(turns, "numbered-turns")
    heads = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (MOST_HEAD + 1)
    convs = turns.select("conv_id").distinct().withColumn("h", heads)
    own = turns.withColumn("h", heads).where("seq > h").drop("h")
    lead = turns.where(F.col("seq") <= MOST_HEAD).where(F.col("conv_id") % FAMILY == 0).withColumnRenamed("conv_id", "first_id")
    family = convs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % FAMILY)
    taken = family.join(lead, "first_id").where("seq <= h").select(*turns.columns)
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("words"))
    return marks.unionAll(taken).unionAll(own)


PREFIXES = "conv_id long, depth long, node binary, parent binary, words long, is_end boolean, above array<array<binary>>"


def _chain(levels: int):
    """Turns of whole conversations, in order, to one row for each prefix.

    `above` has for each scale s with depth % levels**s == 0 the nodes above this one, levels**s turns apart: back to the
    start of its block of `levels`, or for the first node of a block the whole block before. A conversation is read
    turn by turn; what is held are `levels` digests for each scale.
    """
    fields = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("is_end", pa.bool_()), ("above", pa.list_(pa.list_(pa.binary())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, waiting = None, None
        for batch in batches:
            out = []
            for c, key, words in zip(batch.column("conv_id").to_pylist(), batch.column("turn_key").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if waiting:
                    waiting[5] = c != conv
                    out.append(waiting)
                if c != conv:
                    conv, depth, parent, node, above = c, 0, None, ROOT, [[]]
                    stacks = [deque([ROOT], maxlen=levels)]
                else:
                    depth, parent, above = depth + 1, node, []
                    node = hashlib.sha256(parent + key).digest()[:16]
                    e, scale = depth, 0
                    while True:
                        if scale == len(stacks):
                            stacks.append(deque([ROOT], maxlen=levels))
                        n = e % levels or levels
                        above.append(list(stacks[scale])[-n:])
                        stacks[scale].append(node)
                        if e % levels:
                            break
                        e, scale = e // levels, scale + 1
                waiting = [conv, depth, node, parent, words, False, above]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
        if waiting:
            waiting[5] = True
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(waiting, fields, strict=True)], schema=fields)

    return run


def prefixes(turns: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every prefix of every conversation with the chained digest that names its node.

    A node's digest is the first half of SHA-256 over its parent's digest and the turn's, so equal digests mean equal
    sequences of turns. A conversation is the work of one task, as the chain is sequential, but no row of it is held.
    """
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "turn_key", "words").mapInArrow(_chain(levels), PREFIXES)


def _runs(run_ids: int):
    """Joins the ids of a node that come one after another to texts of up to `run_ids` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        at = first = None
        for batch in batches:
            out = []
            for node, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (node != at or len(held) == run_ids):
                    out.append((at, first, ",".join(held)))
                    held = []
                if not held:
                    at, first = node, c
                held.append(str(c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["node", "first", "ids"])

    return run


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = digest = None
    for batch in batches:
        out = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == at:
                digest.update(b",")
            else:
                if at is not None:
                    out.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame, run_ids: int = RUN_IDS) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 over a node's ids, ascending and joined by commas.

    Ranges of (node, id) are sorted and joined to runs of up to `run_ids` ids, so the ids of a node that holds a third of all
    conversations are spread over tasks. SHA-256 itself is sequential: one task reads a node's runs in order, one at a time.
    """
    runs = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_runs(run_ids), "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed_runs, "node binary, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, levels: int, deepest: int) -> DataFrame:
    """(node, n_leaves, saved_tokens) summed over each node's subtree, of nodes (node, depth, above, leaf, saved).

    Within a block of `levels` depths each node is exploded to itself and all its ancestors. The first nodes of blocks then
    form a tree of their own, `levels` times as flat, which is solved the same way with the sums of their blocks; their
    totals are exploded to the block before them. So a node gives rise to `levels` rows at most for each scale, not to as many as
    it is deep; tries of up to `levels` turns need one scale. Sums combine on the map side, so the root isn't hot.
    """
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]

    def solved(values: DataFrame, scale: int) -> DataFrame:
        """values: node, place (depth in steps of the scale), above, leaves, saved; gives node, leaves, saved."""
        own = F.array("node")
        inside = F.when(F.col("place") % levels == 0, own).otherwise(F.concat(F.col("above")[scale], own))
        blocks = values.select(F.explode(inside).alias("node"), "leaves", "saved").groupBy("node").agg(*sums)
        if levels ** (scale + 1) > deepest:
            return blocks
        blocks = written(blocks, "trie-blocks")
        firsts = values.where(F.col("place") % levels == 0).select("node", (F.col("place") / levels).cast("long").alias("place"), "above")
        totals = written(solved(firsts.join(blocks, "node"), scale + 1), "trie-totals")
        below = firsts.where("place > 0").join(totals, "node").select(F.explode(F.col("above")[scale]).alias("node"), "leaves", "saved")
        return blocks.unionAll(below).groupBy("node").agg(*sums)

    return solved(nodes.select("node", F.col("depth").alias("place"), "above", F.col("leaf").alias("leaves"), "saved"), 0)


def prefix_trie(turns: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes of the trie of all conversations (conv_id, seq, turn_key, words; a row with seq 0 for each conversation).

    Per node: conv_id (its smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs (members:
    conversations that start with it), n_children, n_leaves (childless nodes in its subtree, itself included),
    saved_tokens (over its subtree, (n_convs - 1) times the words of the node's last turn) and ends_sha256 (over the ids of
    the members that end there; see end_digests()).

    Prefixes are named by chained digests and grouped by (depth, digest) with map-side sums, so a beginning that all
    share isn't hot. Nodes are then exploded to their ancestors (see _subtree_sums()). An empty table has no node.
    """
    chained = written(prefixes(turns, levels), "trie-prefixes")
    grouped = chained.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.first("above").alias("above"))
    nodes = written(grouped, "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    full = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-counts")
    deepest = full.agg(F.max("depth")).first()[0] or 0
    worth = full.select("node", "depth", "above", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = _subtree_sums(worth, levels, deepest).toDF("node", "n_leaves", "saved_tokens")
    ends = end_digests(chained.where("is_end").select("node", "conv_id"))
    above = full.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = full.drop("above", "words").join(sums, "node").join(ends, "node", "left").join(above, "parent", "left")
    none = F.sha2(F.lit(""), 256)
    result = written(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")), "trie")
    discard(chained, nodes, full)
    return result
