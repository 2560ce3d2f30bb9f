"""Trie of conversation prefixes by partition refinement.

All conversations start in one class, the root. Turn by turn the classes that are still active are split by
the turn that follows; a class of one conversation is retired, since what follows is a chain of nodes that are
its own. Sizes of subtrees are then folded back, depth by depth. A node is named by its depth and its smallest
member, which no other node of that depth has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import mixing, storage

#: Conversation ids in a piece of the list that a node's digest is made of.
PIECE = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def order_turns(conversations: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """(conv_id, at, role, text): turns numbered from 1 by turn (null first), then by role and text.

    conv_id is taken as a long; rows without one are left out. A null role or text becomes empty. Rows are dealt by
    ranges of their order, so that a conversation of any length is numbered by many tasks.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = ["conv_id", "turn", "role", "text", "tie"]
    rows = rows.where("conv_id is not null").withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    rows = scratch.write(rows, "ordered")
    parts = rows.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("at"), "role", "text")


def share_openings(turns: DataFrame, *, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that open alike: (conv_id, depth, role, text) and (conv_id, length), one row for each conversation.

    Conversation c gets the first h turns of conversation c - c % every (as many as it has), then its own turns after its
    first h, h being crc32(c) % most. turns: conv_id, at, role, text.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    convs = sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    opening = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", opening.alias("opening"), (opening + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    first = turns.where(F.col("at") < most).select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "role", "text")
    shared = convs.join(first, "base").where("depth <= opening").select("conv_id", "depth", "role", "text")
    own = turns.join(convs, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("opening")).alias("depth"), "role", "text")
    return shared.unionByName(own), convs.select("conv_id", "length")


def digest_lists(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): the digest of the ids of each (node, depth) in ascending order, joined by commas.

    Ids are sorted by ranges and joined in pieces of thousands by many tasks; only the pieces of a list meet in one task,
    which reads them in order and holds one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, last = [], None
            for node, depth, conv in zip(*(x.to_pylist() for x in batch.columns)):
                if last == (node, depth) and len(found[-1][3]) < PIECE:
                    found[-1][3].append(str(conv))
                else:
                    found.append((node, depth, conv, [str(conv)]))
                last = (node, depth)
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([",".join(x[3]) for x in found], pa.string())], names=["node", "depth", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        kind = ["node", "depth", "ends_sha256"]
        for batch in batches:
            found = []
            for node, depth, ids in zip(*(batch.column(x).to_pylist() for x in ("node", "depth", "ids"))):
                if last == (node, depth):
                    digest.update(f",{ids}".encode())
                    continue
                if last is not None:
                    found.append((*last, digest.hexdigest()))
                last, digest = (node, depth), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=kind)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last, digest.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], names=kind)

    order = ["node", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "node long, depth long, first long, ids string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digested, "node long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    turns: conv_id, depth (1, 2, ... without holes), role, text; convs: each conv_id and its length, 0 for one without
    turns, which is a member of the root only. conv_id of a node is its smallest member, n_convs counts members,
    n_leaves the childless nodes of its subtree, saved_tokens sums (n_convs - 1) times the words of a node's text over
    its subtree, and ends_sha256 is of the members that end there. Turns are compared by 256-bit digests of role and
    text. Without conversations there is no node. The rounds are as many as the longest prefix that two conversations
    share has turns, and each reads the turns of its depth only.
    """
    spark = turns.sparkSession
    with storage.Scratch(spark, "trie") as scratch:
        own = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
        turns = turns.select("conv_id", "depth", own.alias("own"), mixing.count_tokens(F.col("text")).cast("long").alias("words"))
        # in the order of depth, so that a round skips the other depths
        turns = scratch.write(turns.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "turns")
        convs = scratch.write(convs.select("conv_id", F.col("length").cast("long").alias("length")), "convs")
        n, root = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
        kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, words long, length long"
        levels = [scratch.write(spark.createDataFrame([(root, 0, None, n, 0, convs.first().length if n == 1 else 0)] if n else [], kinds), "nodes")]
        members = [convs.select("conv_id", F.lit(root).cast("long").alias("node"), F.lit(n).cast("long").alias("n"), "length", F.lit(0).cast("long").alias("depth"))]
        while members[-1].where("n > 1").limit(1).count():
            depth = len(levels)
            step = members[-1].where("n > 1").join(turns.where(F.col("depth") == depth).drop("depth"), "conv_id")
            step = scratch.write(step.select("conv_id", "node", "own", "words", "length"), "step")
            groups = step.groupBy("node", "own").agg(F.min("conv_id").alias("child"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.max("length").alias("longest"))
            groups = scratch.write(groups, "groups")
            at = F.lit(depth).cast("long").alias("depth")
            levels.append(groups.select(F.col("child").alias("conv_id"), at, F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), "words", F.col("longest").alias("length")))
            members.append(scratch.write(step.join(groups.select("node", "own", "child", "n"), ["node", "own"]).select("conv_id", F.col("child").alias("node"), "n", "length", at), "members"))

        # folded back: what a node's children have in all
        done, below = [], None
        for level in reversed(levels):
            if below is not None:
                level = level.join(below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "conv_id", "left")
            else:
                level = level.select("*", *(F.lit(None).cast("long").alias(x) for x in ("n_children", "n_leaves", "saved_tokens")))
            chain = (F.col("n_convs") == 1) & (F.col("length") > F.col("depth"))
            saved = F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")
            children = F.when(chain, 1).otherwise(F.coalesce("n_children", F.lit(0))).cast("long")
            below = scratch.write(level.select("conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens")), "folded")
            done.append(below)

        alone = [x.where("n = 1 and length > depth").select("conv_id", "length", F.col("depth").alias("retired")) for x in members]
        ends = [x.where("depth = length").select("node", "depth", "conv_id") for x in members]
        for x in alone:
            one = F.lit(1).cast("long")
            tail = turns.join(x, "conv_id").where("depth > retired")
            done.append(tail.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
            ends.append(x.select(F.col("conv_id").alias("node"), F.col("length").alias("depth"), "conv_id"))
        digests = digest_lists(_union(ends)).withColumnRenamed("node", "conv_id")
        found = _union(done).join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
        return scratch.keep(found, "prefix-trie")


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return found


def rebuilt_trie(conversations: DataFrame, *, every: int = 20, most: int = 4) -> DataFrame:
    """prefix_trie() of the conversations (conv_id, turn, role, text) with shared openings. What odd rows give is said in
    order_turns(): null turns come first, nulls are empty texts, repeated rows are turns of their own, extra columns are not read."""
    with storage.Scratch(conversations.sparkSession, "openings") as scratch:
        turns = scratch.write(order_turns(conversations, scratch), "turns")
        return prefix_trie(*share_openings(turns, every=every, most=most))
