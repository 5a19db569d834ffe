"""Trie of shared conversation beginnings, by fixed-length block hashing.

A conversation is its turns in order, here after its beginning was replaced (`rebuild`). Every distinct
sequence of first turns is a node.

1. A turn's digest, keyed by its place, gives two 64-bit lanes. The lanes of a beginning are the exclusive
   or of its turns' lanes, so they are made block by block and then along the blocks: no task walks the
   turns of a long conversation.
2. Turns stand in blocks of `BLOCK_TURNS`. Conversations are grouped by the digests of successive blocks.
   If all conversations of a group go on with the same block, the nodes in it have the group's members,
   and one conversation stands for all of them.
3. Turn boundaries are compared only inside the blocks in which siblings diverge.
4. A node is carried by its smallest member. The nodes a conversation carries are the end of its path, a
   chain. Sums over a subtree are those along the node's own chain, plus the whole of every chain that
   hangs below it; those are added up by the beginnings they pass, so nothing runs level by level.

Counts and minima combine before they are shuffled, so a beginning that a third of all conversations
share reaches its reducer as one row per task. Texts are never shuffled, only digests and lengths. The ids
of conversations that end in one node are written out in blocks of `ID_BLOCK` ids and hashed in order, as a
stream: memory is bounded whatever their number, but one node's hash is made by one task.

Nulls and ties: a null role or text counts as empty; null turns come first; equal turns of a conversation
go by role and digest, and rows that repeat each other stand next to each other. Rows without conv_id
belong to no conversation and are left out. A conversation left without turns is a member of the root
alone. An empty table gives no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, running

BLOCK_TURNS = 4
#: Most turns taken from another conversation, and conversations that share one beginning.
HEAD_TURNS, FAMILY = 8, 5
#: Width of the ranges of ids that are written out together.
ID_BLOCK = 10_000
#: Turn numbers that are put in order at once.
TURN_BLOCK = 4096

NODE = ["depth", "pa", "pb"]
EMPTY = hashlib.sha256(b"").hexdigest()


def head_turns(conv: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with."""
    return (F.crc32(conv.cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("long")


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv, place, sha, bytes): turns by place from 1, without their texts."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("_role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("sha"),
        F.octet_length(text).cast("long").alias("bytes"))
    block = F.coalesce(F.floor(F.col("turn") / TURN_BLOCK).cast("long"), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("_role"), F.col("sha")]
    placed = running(rows, ["conv"], block, order, F.lit(1).cast("long"))
    return placed.select("conv", (F.col("before") + 1).alias("place"), "sha", "bytes")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, n_turns) of all rebuilt conversations and (conv, depth, sha, bytes) of their turns.

    The first turns, `head_turns` of them, come from the first conversation of the family.
    """
    own = cut(_ordered(turns))
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("own_turns"))
    convs = sizes.withColumn("head", head_turns(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("own_turns").alias("_there")), "base", "left")
    taken = F.least("head", F.coalesce("_there", F.lit(0)))
    convs = cut(convs.select("conv", "base", "head", taken.alias("taken"),
                             (taken + F.greatest(F.col("own_turns") - F.col("head"), F.lit(0))).alias("n_turns")))
    heads = own.filter(F.col("place") <= HEAD_TURNS).withColumnRenamed("conv", "base").join(
        convs.select("base", "conv", "taken"), "base").filter("place <= taken")
    rest = own.join(convs.select("conv", "head", "taken"), "conv").filter("place > head")
    out = heads.select("conv", F.col("place").alias("depth"), "sha", "bytes").unionAll(
        rest.select("conv", F.col("taken") + F.col("place") - F.col("head"), "sha", "bytes"))
    return convs.select("conv", "n_turns"), out


def _beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with the lanes of the beginning they end (pa, pb) and of the one before (qa, qb), and the blocks."""
    block = F.floor((F.col("depth") - 1) / BLOCK_TURNS).cast("long")
    turns = turns.select(
        "conv", "depth", "bytes", block.alias("block"),
        F.xxhash64(F.col("depth"), "sha").alias("a"), F.xxhash64(-F.col("depth"), "sha").alias("b"))
    blocks = turns.groupBy("conv", "block").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max("depth").alias("depth"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"s{x}": F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)) for x in "ab"})
    blocks = cut(blocks.select("conv", "block", "depth", "sa", "sb", *(F.col(f"s{x}").bitwiseXOR(F.col(x)).alias(f"p{x}") for x in "ab")))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumns({f"i{x}": F.bit_xor(x).over(inside) for x in "ab"})
    turns = turns.join(blocks.select("conv", "block", "sa", "sb"), ["conv", "block"])
    ends = {f"p{x}": F.col(f"s{x}").bitwiseXOR(F.col(f"i{x}")) for x in "ab"}
    turns = turns.withColumns(ends).withColumns({f"q{x}": F.col(f"p{x}").bitwiseXOR(F.col(x)) for x in "ab"})
    return turns.select("conv", "block", "depth", "bytes", "pa", "pb", "qa", "qb"), blocks


def _nodes(turns: DataFrame, blocks: DataFrame, convs: int) -> DataFrame:
    """(depth, pa, pb, qa, qb, bytes, n_convs, conv_id) for all nodes but the root."""
    groups = blocks.groupBy("block", "sa", "sb", *NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"))
    groups = cut(groups)
    above = groups.filter(F.col("depth") == (F.col("block") + 1) * BLOCK_TURNS).select(
        (F.col("block") + 1).alias("block"), F.col("pa").alias("sa"), F.col("pb").alias("sb"), F.col("n").alias("_above"))
    # The first block hangs below the root, whose members need no join.
    first = groups.filter("block = 0").withColumn("_above", F.lit(convs).cast("long"))
    later = groups.filter("block > 0").join(above, ["block", "sa", "sb"])
    alike = first.select(*later.columns).unionAll(later).select(*NODE, "n", "least", (F.col("n") == F.col("_above")).alias("alike"))
    marked = blocks.join(alike, NODE)
    stand = marked.filter("NOT alike OR conv = least").select("conv", "block", F.when(F.col("alike"), F.col("n")).otherwise(1).alias("members"))
    rows = turns.join(stand, ["conv", "block"])
    return rows.groupBy(*NODE).agg(
        F.first("qa").alias("qa"), F.first("qb").alias("qb"), F.first("bytes").alias("bytes"),
        F.sum("members").alias("n_convs"), F.min("conv").alias("conv_id"))


def _digester(batches):
    """SHA-256 of the ids of each node, from its runs of ids in ascending order."""
    node, state = None, None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if row[:3] != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = row[:3], hashlib.sha256()
            else:
                state.update(b",")
            state.update(row[3].encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*NODE, "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=[*NODE, "ends_sha256"])


def _ends(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(depth, pa, pb, ends_sha256) of the nodes in which conversations end."""
    last = blocks.join(convs, "conv").filter(F.col("depth") == F.col("n_turns")).select("conv", *NODE)
    none = convs.filter("n_turns = 0").select("conv", *(F.lit(0).cast("long").alias(n) for n in NODE))
    runs = last.unionAll(none).groupBy(*NODE, F.floor(F.col("conv") / ID_BLOCK).alias("_range")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string"))).alias("ids"))
    runs = runs.repartition(*NODE).sortWithinPartitions(*NODE, "_range")
    return runs.select(*NODE, "ids").mapInArrow(_digester, "depth long, pa long, pb long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations in (conv_id, turn, role, text): `conv_id`, `depth`,
    `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`."""
    convs, rebuilt = rebuild(turns)
    all_convs = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least")).first()
    steps, blocks = _beginnings(rebuilt)
    steps = cut(steps)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        *(zero.alias(n) for n in (*NODE, "qa", "qb", "bytes")), "n_convs", "conv_id")
    nodes = cut(_nodes(steps, blocks, all_convs.n).unionByName(root))
    below = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumns({
        "saves": (F.col("n_convs") - 1) * F.col("bytes"), "leaf": (F.col("n_children") == 0).cast("long")})
    # Sums along the chain of a conversation, from its end up.
    nodes = running(nodes, ["conv_id"], -F.floor(F.col("depth") / TURN_BLOCK), [F.col("depth").desc()], F.col("saves"))
    nodes = cut(nodes.withColumn("saved", F.col("before") + F.col("saves")).drop("before", "whole", "saves"))
    chains = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.max("saved").alias("chain_saved"), F.sum("leaf").alias("chain_leaves"))
    chains = cut(chains)
    passed = steps.select(F.col("conv").alias("conv_id"), *NODE).join(chains, "conv_id").filter("depth < top")
    sums = [F.sum("chain_saved").alias("more_saved"), F.sum("chain_leaves").alias("more_leaves")]
    hanging = passed.groupBy(*NODE).agg(*sums).unionAll(
        chains.filter("top > 0").select(*(zero.alias(n) for n in NODE), "chain_saved", "chain_leaves").groupBy(*NODE).agg(*sums))
    parents = nodes.select(F.col("depth").alias("_up"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv_id").alias("_parent"))
    nodes = nodes.join(chains.select("conv_id", "top", "chain_leaves"), "conv_id")
    # The node above is of the same chain, or the root, or is looked up for the heads of chains.
    heads = nodes.filter("depth > 1 AND depth = top").select(*NODE, (F.col("depth") - 1).alias("_up"), "qa", "qb")
    looked = heads.join(parents, ["_up", "qa", "qb"]).select(*NODE, "_parent")
    nodes = nodes.join(hanging, NODE, "left").join(looked, NODE, "left").join(_ends(convs, blocks), NODE, "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") > F.col("top"), F.col("conv_id")).when(
        F.col("depth") == 1, F.lit(all_convs.least)).otherwise(F.col("_parent"))
    return nodes.select(
        "conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("chain_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
