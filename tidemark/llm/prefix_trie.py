"""The trie of conversations' prefixes, level by level.

A conversation is a row of turns, and a node is the sequence of its first turns. At each depth the live
conversations are grouped by (parent node, next turn); the least conversation of a group names the node. A
node of few conversations is finished, level by level too, within one task, and one that has a single conversation is
nothing but that one's rest; only nodes of many go on to the next level of the cluster. In reverse, each level's
joins roll up the leaves and the savings of the level below.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, partitions_for, shared_dir, staged
from .ranks import numbered

#: A node of at most so many conversations and turns below it is finished in one task.
SUBTREE_CONVERSATIONS, SUBTREE_TURNS = 64, 1 << 16
#: Bytes that a turn takes while such a task works, about.
TURN_BYTES = 256
#: A key with more than this share of the rows is broadcast: there are no more such keys than its inverse.
HOT_SHARE = 1e-3

WORDS = r"[^\x20\x09-\x0D]+"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: Column, total: int) -> DataFrame:
    """rows joined with keyed, which has each key once and about how many rows it has: the hot keys' rows stay where
    they are and meet a broadcast table of at most 1 / HOT_SHARE keys, the others are shuffled."""
    hot = weight > HOT_SHARE * total
    few = F.broadcast(keyed.where(hot))
    rest = rows.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti").join(keyed.where(~hot), on)
    return rows.join(few, on).unionByName(rest)


def as_turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, turn, n_words): each conversation's turns from 0, told apart by 128 bits of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), digest.alias("turn"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_words"))
    order = [F.col("conv"), F.col("at").asc_nulls_first(), F.col("turn")]
    return staged(numbered(staged(rows), order, key="conv").select("conv", F.col("place"), "turn", "n_words"))


def shared_heads(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of c - c % family, then c's own after its first h, where h is the
    checksum of c modulo most. Returns (conv, size), and (conv, depth, turn, n_words) with depths from 1."""
    n = turns.count()
    own = turns.groupBy("conv").agg(F.count("*").alias("n_own"))
    own = staged(own.select("conv", "n_own", (F.col("conv") - F.col("conv") % family).alias("head"), F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most)).alias("h")))
    heads = own.select(F.col("conv").alias("head"), F.col("n_own").alias("n_head"))
    convs = own.join(heads, "head", "left").withColumn("given", F.least("h", F.coalesce("n_head", F.lit(0))))
    convs = staged(convs.select("conv", "head", "h", "given", "n_own", (F.col("given") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("size")))
    kept = spread_join(turns, convs.select("conv", "h", "given", "n_own"), ["conv"], F.col("n_own"), n).where("place >= h")
    kept = kept.select("conv", (F.col("given") + F.col("place") - F.col("h") + 1).alias("depth"), "turn", "n_words")
    firsts = turns.where(F.col("place") < most).withColumnRenamed("conv", "head")
    given = firsts.join(convs.select("conv", "head", "given"), "head").where("place < given").select("conv", (F.col("place") + 1).alias("depth"), "turn", "n_words")
    return convs.select("conv", "size"), kept.unionByName(given)


def in_bands(turns: DataFrame) -> DataFrame:
    """The turns as a table in folders by the power of two below their depth, so that a level doesn't read them all."""
    path = shared_dir(turns.sparkSession)
    out = turns.withColumn("band", F.floor(F.log2(F.col("depth").cast("double"))).cast("int"))
    out.write.partitionBy("band").parquet(path)
    return turns.sparkSession.read.schema(out.schema).parquet(path)


def grown(convs: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Level by level from the root, the nodes of many conversations: for each depth those nodes, (conv, node, size) of
    their conversations, and (conv, size, node, parent, depth, n) of those whose next node needs no further level."""
    root = convs.agg(F.min("conv").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n"), F.lit(0).cast("long").alias("words"))
    nodes = [staged(root)]
    live = convs.withColumn("node", F.lit(nodes[0].first()["conv_id"]).cast("long"))
    lives, finished = [], []
    large = (F.col("n") > SUBTREE_CONVERSATIONS) | ((F.col("n") > 1) & (F.col("turns") > SUBTREE_TURNS))
    while True:
        depth = len(nodes)
        lives.append(live)
        next_turns = turns.where((F.col("band") == depth.bit_length() - 1) & (F.col("depth") == depth)).select("conv", "turn", "n_words")
        steps = staged(live.where(F.col("size") >= depth).withColumnRenamed("node", "parent").join(next_turns, "conv"))
        groups = steps.groupBy("parent", "turn").agg(F.min("conv").alias("node"), F.count("*").alias("n"), F.max("n_words").alias("words"), F.sum(F.col("size") - depth + 1).alias("turns"))
        groups = staged(groups)
        total, n_large = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(large)).first()
        if not total:
            return nodes, lives, finished
        kids = spread_join(steps.select("conv", "size", "parent", "turn"), groups.select("parent", "turn", "node", "n", "turns"), ["parent", "turn"], F.col("n"), total)
        kids = staged(kids.select("conv", "size", "node", "parent", F.lit(depth).cast("long").alias("depth"), "n", large.alias("large")))
        finished.append(kids.where("not large"))
        if not n_large:
            return nodes, lives, finished
        nodes.append(groups.where(large).select(F.col("node").alias("conv_id"), "parent", "n", "words"))
        live = kids.where("large").select("conv", "node", "size")


def id_lists(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The distinct keys, ascending, and each one's ids, ascending and joined by commas."""
    by = np.lexsort((ids, keys))
    keys, ids = keys[by], ids[by].tolist()
    starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1] if len(keys) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(ids)]
    return keys[starts], [",".join(map(str, ids[i:j])) for i, j in zip(starts.tolist(), ends.tolist())]


def subtrees(table: pa.Table) -> dict[str, np.ndarray]:
    """All nodes of whole subtrees, given the turns (node, parent, top, conv, size, depth, turn, n_words) of their
    conversations from the subtree's top node on. Each depth's turns are grouped at once by (parent, turn)."""
    column = lambda c: table[c].combine_chunks().to_numpy()
    depth, conv, size, words = map(column, ("depth", "conv", "size", "n_words"))
    by = np.lexsort((conv, depth))
    depth, conv, size, words = depth[by], conv[by], size[by], words[by]
    turn = table["turn"].combine_chunks().dictionary_encode().indices.to_numpy()[by].astype(np.int64)
    who = np.unique(conv, return_inverse=True)[1]
    tops, own_top = np.unique(column("node")[by], return_inverse=True)
    at_top = depth == column("top")[by]
    parents_of_tops = np.zeros(len(tops), np.int64)
    parents_of_tops[own_top] = column("parent")[by]
    # A conversation's node so far; before the first one, its subtree's number below zero.
    now = np.zeros(int(who.max(initial=-1)) + 1, np.int64)
    now[who] = -1 - own_top
    parts, n_nodes, ends_at = [], 0, np.zeros(len(conv), np.int64)
    edges = np.r_[0, np.flatnonzero(depth[1:] != depth[:-1]) + 1, len(depth)]
    for i, j in zip(edges.tolist(), edges[1:].tolist()):
        mine = who[i:j]
        order = np.lexsort((turn[i:j], now[mine]))
        parent, next_turn = now[mine][order], turn[i:j][order]
        first = np.r_[True, (parent[1:] != parent[:-1]) | (next_turn[1:] != next_turn[:-1])]
        starts = np.flatnonzero(first)
        ids = n_nodes + np.cumsum(first) - 1
        now[mine[order]] = ids
        ends_at[i:j][order] = ids
        n = np.diff(np.r_[starts, j - i])
        parts.append((np.minimum.reduceat(conv[i:j][order], starts), np.full(len(starts), depth[i]), parent[starts], n, (n - 1) * words[i:j][order][starts]))
        n_nodes += len(starts)
    conv_id, level, parent, n, saved = (np.concatenate(x) for x in zip(*parts))
    inner = parent >= 0
    n_children = np.bincount(parent[inner], minlength=n_nodes)
    leaves = (n_children == 0).astype(np.int64)
    at = np.searchsorted(level, np.unique(level))
    for i, j in list(zip(at.tolist(), [*at[1:].tolist(), n_nodes]))[::-1]:
        below = np.flatnonzero(inner[i:j]) + i
        np.add.at(leaves, parent[below], leaves[below])
        np.add.at(saved, parent[below], saved[below])
    hashes = np.full(n_nodes, EMPTY_HASH, object)
    last = depth == size
    ended, lists = id_lists(ends_at[last], conv[last])
    hashes[ended] = [hashlib.sha256(x.encode()).hexdigest() for x in lists]
    above = np.where(inner, conv_id[np.maximum(parent, 0)], parents_of_tops[np.maximum(-1 - parent, 0)])
    return {"conv_id": conv_id, "depth": level, "parent_conv_id": above, "n_convs": n, "n_children": n_children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": hashes, "is_top": ~inner}


def finished_in_tasks(small: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of all subtrees of few conversations. A task takes as many of them as fit into it."""
    n_turns = small.agg(F.sum(F.col("size") - F.col("depth") + 1)).first()[0] or 0
    rows = turns.join(small.select("conv", "size", "node", "parent", F.col("depth").alias("top")), "conv").where("depth >= top")
    rows = rows.select("node", "parent", "top", "conv", "size", "depth", "turn", "n_words").repartition(partitions_for(small.sparkSession, n_turns * TURN_BYTES), "node")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_pydict(subtrees(pa.Table.from_batches(held)))

    return staged(rows.mapInArrow(run, NODE + ", is_top boolean"))


def tails(single: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations that are alone, from the depth on at which they are."""
    n_turns = single.agg(F.sum("size")).first()[0] or 0
    rows = spread_join(turns, single.select("conv", "size", "parent", F.col("depth").alias("top")), ["conv"], F.col("size"), n_turns).where("depth >= top")
    one, last = F.lit(1).cast("long"), F.col("depth") == F.col("size")
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"),
        (~last).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )


def list_hashes(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of (node, depth, conv): the SHA-256 of each node's conversations, ascending, joined by
    commas. Sorted partitions by range join them in pieces; a node's pieces, and no ids, go to one task in
    order, which holds one batch of them."""
    n = partitions_for(ends.sparkSession, ends.count() * TURN_BYTES)
    order = ["depth", "node", "conv"]

    def join(batches):
        for b in batches:
            depth, node, conv = (b.column(c).to_numpy() for c in order)
            starts = np.r_[0, np.flatnonzero((depth[1:] != depth[:-1]) | (node[1:] != node[:-1])) + 1] if len(conv) else np.zeros(0, int)
            pieces = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(starts, [*starts[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (depth[starts], node[starts], conv[starts])] + [pa.array(pieces, pa.string())], [*order, "piece"])

    def digest(batches):
        held, last = None, None
        for b in batches:
            out = []
            for depth, node, _, piece in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, node) == last:
                    held.update(b"," + piece.encode())
                    continue
                if last:
                    out.append((*last, held.hexdigest()))
                held, last = hashlib.sha256(piece.encode()), (depth, node)
            if out:
                yield batch(out)
        if last:
            yield batch([(*last, held.hexdigest())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["depth", "node", "ends_sha256"])

    pieces = staged(ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(join, "depth long, node long, conv long, piece string"))
    sorted_pieces = by_bytes(pieces).repartition(n, "depth", "node").sortWithinPartitions(*order)
    return staged(sorted_pieces.mapInArrow(digest, "depth long, node long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (shared_heads tells how), with the columns of NODE.

    Turns go by their number, null first, and equal numbers by a digest of role and text; null roles and texts are
    empty. Rows without a conv_id belong to no conversation. A conversation that is rebuilt without turns ends in the
    root; without conversations there is no root and no row. Repeated rows are turns of their own. Other columns are
    not read, and no text is shuffled: turns go by 128 bits. The cluster's levels are as many as the depth at which some
    node still has more than SUBTREE_CONVERSATIONS conversations, some jobs each; each ends in staged tables.
    """
    convs, rows = shared_heads(as_turns(conversations), family, most)
    turns = in_bands(rows)
    if convs.isEmpty():
        return convs.sparkSession.createDataFrame([], NODE)
    nodes, lives, finished = grown(convs, turns)
    done = convs.sparkSession.createDataFrame([], "conv long, size long, node long, parent long, depth long, n long")
    for kids in finished:
        done = done.unionByName(kids.select("conv", "size", "node", "parent", "depth", "n"))
    alone = done.where("n = 1")
    small = finished_in_tasks(done.where("n > 1"), turns)
    tops = small.where("is_top").select("depth", F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens")
    tops = tops.unionByName(alone.select("depth", "parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
    tops = staged(tops.groupBy("depth", "parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    rolled: list[DataFrame] = []
    for depth in range(len(nodes) - 1, -1, -1):
        below = tops.where(F.col("depth") == depth + 1).drop("depth")
        if rolled:
            below = below.unionByName(rolled[-1].select(F.col("parent_conv_id").alias("parent"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")).groupBy("parent").agg(*sums)
        level = nodes[depth].join(below.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        level = level.select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), zero("n_children").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("words") + zero("saved_tokens")).alias("saved_tokens"))
        rolled.append(staged(level))
    ends, upper = None, None
    for depth, live in enumerate(lives):
        here = live.where(F.col("size") == depth).select("node", F.lit(depth).cast("long").alias("depth"), "conv")
        ends = here if ends is None else ends.unionByName(here)
    for level in rolled:
        upper = level if upper is None else upper.unionByName(level)
    hashes = list_hashes(ends).withColumnRenamed("node", "conv_id")
    upper = upper.join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)))
    return upper.unionByName(small.drop("is_top")).unionByName(tails(alone, turns))
