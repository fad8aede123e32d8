"""The trie of conversation prefixes, level by level.

A conversation's turns are ordered, conversations are rebuilt upon the first turns of the one that opens their block (op13), and each distinct
sequence of first d turns is a node. Construction takes one depth at a time: live conversations, each with the node it stands on, are grouped by
(node, next turn); a group is a node of the next depth, and its smallest conv_id names it. A conversation alone on its node is done: the rest of
its way is a chain with closed forms. So live rows shrink from depth to depth, and depths are as many as the longest prefix that two conversations
share. Then, from the deepest level back, children, leaves and savings are summed by parent and joined to the level above.

Skew: a conversation may hold a third of all rows, so turns are numbered within ranges of (conversation, turn) and offset by the ranges before.
A node may hold a third of all conversations: groups are pre-aggregated, and their names come back by skew_join, the hot ones broadcast. The digest
of the conversations that end at a node is one pass over their ids by nature; ids are packed by ranges in parallel, and the pass streams the
packed rows.

Defined results: rows without conv_id belong to no conversation; null role or text is empty; turns go by number (null first), then by the MD5 of role and
text; repeated rows are turns of their own; turns are equal by the MD5 of (length of role, role, text); of a negative id the block opens at
conv_id - conv_id % 100 with the sign rule of SQL; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import skew_join, stored

#: Conversations of a block share turns of its first one; the longest shared beginning is SHARED - 1 turns.
BLOCK, SHARED = 100, 6
#: Turns of a conversation that travel with it; later ones are fetched when it is still live there.
AHEAD = 16
TURN = "array<struct<m:binary,k:bigint>>"


def numbered(turns: DataFrame) -> DataFrame:
    """(c, pos from 1, m: the turn's digest, k: code points of its text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), digest.alias("m"), F.char_length(text).cast("long").alias("k"))
    # the last key only parts equal rows, which are interchangeable
    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("m"), F.col("u")]
    dealt = rows.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            c = batch["c"].to_numpy()
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            at = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)])) + 1
            if c[0] == last:
                at[: first[1] if len(first) > 1 else len(c)] += count
            last, count = c[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([batch["c"], pa.array(np.full(len(c), part, np.int32)), pa.array(at.astype(np.int64)), batch["m"], batch["k"]], ["c", "part", "pos", "m", "k"])

    found = stored(dealt.select("c", "m", "k").mapInArrow(number, "c long, part int, pos long, m binary, k long"), "turns")
    ends = found.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "pos")).alias("last")).orderBy("part").collect()  # a line a partition
    before, offsets = (None, 0), []
    for r in ends:
        if before[0] == r["first"]:
            offsets.append((r["part"], r["first"], before[1]))
        before = (r["last"]["c"], r["last"]["pos"] + (before[1] if before[0] == r["last"]["c"] else 0))
    if not offsets:
        return found.drop("part")
    lines = F.broadcast(turns.sparkSession.createDataFrame(offsets, "o_part int, o_c long, off long"))
    return found.join(lines, (F.col("part") == F.col("o_part")) & (F.col("c") == F.col("o_c")), "left").select("c", (F.col("pos") + F.coalesce("off", F.lit(0))).alias("pos"), "m", "k")


def _first(rows: DataFrame, key: Column | str, most: int) -> Column:
    """An aggregate: the turns at positions 1 .. most, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", "m", "k")))), lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k")))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Numbered turns -> a line a conversation: c, len (of the rebuilt one), behind (own position less depth, once the shared turns are over), rest (its first turns)."""
    own = rows.groupBy("c").agg(F.max("pos").alias("n"), _first(rows, "c", AHEAD).alias("own"))
    own = own.withColumn("h", (F.crc32(F.col("c").cast("string").cast("binary")) % SHARED).cast("int")).withColumn("b", F.col("c") - F.col("c") % BLOCK)
    bases = rows.filter((F.col("c") % BLOCK == 0) & (F.col("pos") < SHARED)).groupBy(F.col("c").alias("base_c")).agg(_first(rows, "c", SHARED - 1).alias("base"))
    both = own.join(bases, F.col("b") == F.col("base_c"), "left").withColumn("base", F.slice(F.coalesce("base", F.array().cast(TURN)), F.lit(1), F.col("h")))
    rest = F.concat("base", F.slice("own", F.col("h") + 1, F.lit(AHEAD)))
    return both.select("c", (F.size("base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len"), (F.col("h") - F.size("base")).cast("long").alias("behind"), rest.alias("rest"))


def _refilled(live: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """live, at depth, with the next AHEAD turns where those at hand are used up."""
    later = rows.groupBy("c", F.floor((F.col("pos") - 1) / AHEAD).alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "k"))), lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"))).alias("more"))
    due = live.filter("size(rest) = 0").withColumn("q", F.floor((F.lit(depth) + F.col("behind")) / AHEAD)).drop("rest")
    return live.filter("size(rest) > 0").unionByName(due.join(later, ["c", "q"]).select("c", "parent", "len", "behind", F.col("more").alias("rest")))


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, node, c) -> depth, node, ends_sha256: SHA-256 of the ids in order, joined by commas."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            depth, node, c = (batch[x].to_numpy() for x in ("depth", "node", "c"))
            first = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])])
            ids = list(map(str, c.tolist()))
            text = [",".join(ids[a:b]) for a, b in zip(first, [*first[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(depth[first]), pa.array(node[first]), pa.array(c[first]), pa.array(text)], ["depth", "node", "c", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for depth, node, ids in zip(*(batch[x].to_pylist() for x in ("depth", "node", "ids"))):
                if (depth, node) == now:
                    sha.update(b",")
                else:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (depth, node), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "node", "ends_sha256"])
                out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], ["depth", "node", "ends_sha256"])

    packed = ends.repartitionByRange("depth", "node", "c").sortWithinPartitions("depth", "node", "c").mapInArrow(pack, "depth long, node long, c long, ids string")
    dealt = packed.repartition("depth", "node").sortWithinPartitions("depth", "node", "c")
    return dealt.select("depth", "node", "ids").mapInArrow(digest, "depth long, node long, ends_sha256 string")


def levels(live: DataFrame, rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes of each depth from 1 (parent, conv_id, n_convs, k, len), and by depth the rows (depth, node, c) that end on nodes with several members.
    live: c, parent, len, behind, rest."""
    nodes, ends, depth, total = [], [], 0, live.count()
    while total:
        depth += 1
        turn = F.col("rest")[0]
        ahead = live.withColumn("g", F.struct("parent", turn["m"].alias("m")))
        groups = ahead.groupBy("g").agg(
            F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max(turn["k"]).alias("k"), F.max("len").alias("len"),
            F.sum((F.col("len") > depth).cast("long")).alias("going"), F.sum(((F.col("len") > depth) & (F.size("rest") == 1)).cast("long")).alias("due"),
        )
        found = stored(groups, f"level-{depth}")
        nodes.append(found.select("g.parent", "conv_id", "n_convs", "k", "len"))
        shared = found.filter("n_convs > 1")
        going, due = shared.agg(F.sum("going"), F.sum("due")).first()
        named = skew_join(ahead, shared.select("g", F.col("conv_id").alias("node"), F.col("n_convs").alias("w")), "g", "w", total, "inner")
        moved = stored(named.select("c", F.col("node").alias("parent"), "len", "behind", F.slice("rest", F.lit(2), F.lit(AHEAD + SHARED)).alias("rest")), f"live-{depth}")
        ends.append(moved.filter(F.col("len") == depth).select(F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("node"), "c"))
        live, total = moved.filter(F.col("len") > depth), going or 0
        if due:
            live = stored(_refilled(live, rows, depth), f"refilled-{depth}")
    return nodes, ends


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = numbered(turns)
    convs = stored(rebuilt(rows), "rebuilt")
    root, n = convs.agg(F.min("c"), F.count("*")).first()
    live = convs.filter("len > 0").select("c", F.lit(root).cast("long").alias("parent"), "len", "behind", "rest")
    nodes, ends = levels(live, rows)
    top = convs.sparkSession.createDataFrame([(None, root, n, 0, 0)] if n else [], "parent long, conv_id long, n_convs long, k long, len long")
    ends.append(convs.filter("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"), "c"))

    done, kids = [], None
    for depth in range(len(nodes), -1, -1):
        level = (nodes[depth - 1] if depth else top).withColumn("depth", F.lit(depth).cast("long"))
        # a node of one member is the head of a chain; others have their children among the nodes below
        chained = (F.col("n_convs") == 1) & (F.col("len") > depth)
        own = (F.col("n_convs") - 1) * F.col("k")
        if kids is not None:
            level = level.join(kids, F.col("conv_id") == F.col("up"), "left")
            level = level.withColumns({"n_children": F.coalesce("n_children", chained.cast("long")), "n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": own + F.coalesce("saved_tokens", F.lit(0))}).drop("up")
        else:
            level = level.withColumns({"n_children": chained.cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": own})
        level = stored(level, f"summed-{depth}")
        done.append(level)
        kids = level.groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    all_nodes, all_ends = done[0], ends[0]
    for level in done[1:]:
        all_nodes = all_nodes.unionByName(level)
    for part in ends[1:]:
        all_ends = all_ends.unionByName(part)
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    nothing = hashlib.sha256(b"").hexdigest()
    digests = _digests(all_ends).withColumnsRenamed({"depth": "e_depth", "node": "e_node"})
    several = all_nodes.join(digests, (F.col("depth") == F.col("e_depth")) & (F.col("conv_id") == F.col("e_node")), "left")
    alone = (F.col("n_convs") == 1) & (F.col("len") == F.col("depth")) & (F.col("depth") > 0)
    several = several.withColumn("ends_sha256", F.coalesce("ends_sha256", F.when(alone, sha(F.col("conv_id"))).otherwise(F.lit(nothing))))
    columns = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    chains = all_nodes.filter((F.col("n_convs") == 1) & (F.col("len") > F.col("depth")) & (F.col("depth") > 0)).select("conv_id", "len", F.explode(F.sequence(F.col("depth") + 1, F.col("len"))).alias("depth"))
    one, last = F.lit(1).cast("long"), F.col("depth") == F.col("len")
    below = chains.select(
        "conv_id", "depth", F.col("conv_id").alias("parent"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, sha(F.col("conv_id"))).otherwise(F.lit(nothing)).alias("ends_sha256"),
    )
    return several.select(*columns).unionByName(below.select(*columns))
