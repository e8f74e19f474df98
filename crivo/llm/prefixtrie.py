"""Prefix trie of conversations: which beginnings they share, and what is to be saved by storing each beginning once.

A node is a distinct sequence of first turns (role, text). Two conversations are at the same node if their prefix keys
agree: the xor of a 128-bit hash of (place, SHA-256 of role and text) over the turns so far.

Subtree totals roll up in depth bands. Depths are cut into bands of `height`; a node is exploded to its ancestors in its
own band only, which completes every node whose subtree ends in the band. The nodes that start a band form a trie that is
`height` times flatter, whose totals are found in the same way, and each hands its completed total to the band above it.
So a path of D turns takes log(D) / log(height) rounds and no node is copied more than 2 * `height` times a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from crivo.operators.relational import join_groups
from crivo.session import materialise, ship

HEIGHT = 16
SEGMENT = 4096  # turns of one conversation that meet in one join key
CHUNK = 256  # identifiers joined to one string before the strings of a node meet
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ("depth", "k1", "k2")


def _div(c: Column, by: int) -> Column:
    return F.floor(c / by).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, d1, d2, words) of the rows of `turns` (conv_id, turn, role, text): places count from 1.

    Turns are ordered by number, null first; equal numbers by the digest of role and text. Rows without a conv_id belong to
    no conversation and have no place. A null role or text is empty. One conversation may hold most of the rows: the order
    is a range sort over all rows, and a row's place is its place in its range plus the sizes of the ranges before.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")
    )
    rows = rows.select("conv_id", "turn", *[F.conv(F.substring("digest", 15 * i + 1, 15), 16, 10).cast("long").alias(f"d{i + 1}") for i in (0, 1)], "words")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("range", F.shiftright("row", 33)), "trie-turns")
    ranges = rows.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.join(ranges, ["conv_id", "range"]).withColumn("place", F.expr("row - first + before + 1"))
    return materialise(rows.select("conv_id", "place", "d1", "d2", "words"), "trie-places")


def regrafted(turns: DataFrame, family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another: (turns, conversations (conv_id)).

    `turns` is what `numbered` returns. With h = crc32 of the decimal conv_id modulo `most` + 1, conversation c takes the first h
    turns of c - c % `family` (as many as there are) and goes on with its own turns after its first h. The remainder has the
    sign of c. A conversation may be left without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("place") <= most))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "d1", "d2", "words"))).alias("head"))
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    known = sizes.join(heads, "base", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, cast(h AS int))"))
    known = materialise(known.select("conv_id", "n", "h", "head"), "trie-heads")
    segments = known.select("conv_id", "h", F.size("head").alias("taken"), F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("n") - 1, SEGMENT))).alias("segment"))
    own = turns.withColumn("segment", _div(F.col("place") - 1, SEGMENT)).join(segments, ["conv_id", "segment"]).where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "d1", "d2", "words")
    grafted = known.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    return own.unionByName(grafted), known.select("conv_id")


def _running_xor(rows: DataFrame, height: int) -> DataFrame:
    """Add k1, k2 to rows (conv_id, depth, x1, x2, ...): the xor of x1 and of x2 over the conversation's depths so far."""
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    band = Window.partitionBy("conv_id", "band").orderBy("depth")
    rows = rows.withColumn("band", _div(F.col("depth"), height))
    out = rows.withColumns({f"k{i}": F.bit_xor(f"x{i}").over(band) for i in (1, 2)})
    if deepest >= height:
        totals = rows.groupBy("conv_id", F.col("band").alias("depth")).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
        above = _running_xor(materialise(totals, "trie-bands"), height)
        above = above.select("conv_id", (F.col("depth") + 1).alias("band"), F.col("k1").alias("o1"), F.col("k2").alias("o2"))
        out = out.join(above, ["conv_id", "band"], "left")
        out = out.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))) for i in (1, 2)}).drop("o1", "o2")
    return out.drop("band")


def _paths(turns: DataFrame, conversations: DataFrame, height: int) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): the nodes each conversation passes, the root included; p is the parent's key."""
    x = [F.xxhash64(F.lit(i), "place", "d1", "d2").alias(f"x{i}") for i in (1, 2)]
    root = conversations.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "words", "x1", "x2")])
    rows = root.unionByName(turns.select("conv_id", F.col("place").alias("depth"), "words", *x))
    rows = _running_xor(rows, height)
    parent = [F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return materialise(rows.select("conv_id", "depth", "k1", "k2", *parent, "words"), "trie-paths")


def _subtree_sums(nodes: DataFrame, paths: DataFrame, sums: list[str], height: int) -> DataFrame:
    """(depth, k1, k2, *sums): the sums over each node's subtree, the node included.

    `nodes` (conv_id, depth, k1, k2, *sums) names a conversation that passes the node; `paths` (conv_id, depth, k1, k2).
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    added = [F.sum(c).alias(c) for c in sums]
    bands = paths.groupBy("conv_id", _div(F.col("depth"), height).alias("band")).agg(F.array_sort(F.collect_list(F.struct(*NODE))).alias("path"))  # `height` at most
    placed = nodes.withColumn("band", _div(F.col("depth"), height)).join(bands, ["conv_id", "band"])
    ancestors = F.slice("path", F.lit(1), (F.col("depth") % height + 1).cast("int"))
    inside = placed.select(F.explode(ancestors).alias("top"), *sums).groupBy("top").agg(*added).select("top.*", *sums)
    if deepest < height:
        return inside
    inside = materialise(inside, "trie-inside")
    roots = nodes.where(F.col("depth") % height == 0).select("conv_id", *NODE).join(inside, list(NODE))
    roots = materialise(roots.withColumn("depth", _div(F.col("depth"), height)), "trie-roots")
    flat = paths.where(F.col("depth") % height == 0).withColumn("depth", _div(F.col("depth"), height)).select("conv_id", *NODE)
    whole = _subtree_sums(roots, flat, sums, height)
    below = roots.where("depth > 0").select("conv_id", *NODE).join(whole, list(NODE)).withColumn("band", F.col("depth") - 1)
    handed = below.join(bands, ["conv_id", "band"]).select(F.explode("path").alias("top"), *sums).select("top.*", *sums)
    return materialise(inside.unionByName(handed).groupBy(*NODE).agg(*added), "trie-sums")


def _join_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join the identifiers of a node's rows, which come in order, to strings of at most CHUNK of them."""
    for rows in batches:
        new = (rows[list(NODE)] != rows[list(NODE)].shift()).any(axis=1)
        at = rows.groupby(new.cumsum()).cumcount()
        part = (new | (at % CHUNK == 0)).cumsum()
        out = rows.groupby(part).agg({"depth": "first", "k1": "first", "k2": "first", "conv_id": "first"})
        out["ids"] = rows["conv_id"].astype(str).groupby(part).agg(",".join)
        yield out


def _hash_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the strings of each node, which come in order; one digest is open at a time."""
    node, digest = None, None
    for rows in batches:
        done = []
        for depth, k1, k2, ids in zip(rows["depth"], rows["k1"], rows["k2"], rows["ids"]):
            if (depth, k1, k2) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*NODE, "ends_sha256"])


def _end_digests(paths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where a conversation ends.

    A digest is one sequence, so a node's identifiers pass through one task; they come as strings of many, and none is held.
    """
    key = "depth long, k1 long, k2 long"
    ends = paths.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("end.*", "conv_id")
    order = [*NODE, "conv_id"]
    strings = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_join_ids, f"{key}, conv_id long, ids string")
    return strings.repartition(*NODE).sortWithinPartitions(*order).mapInPandas(_hash_ids, f"{key}, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the prefix trie of `turns` (conv_id, place, d1, d2, words), one row each.

    `turns` is what `numbered` or `regrafted` returns; `conversations` (conv_id) lists all, also those without turns. A
    node is named by its smallest member and its depth. Columns: conv_id, depth, parent_conv_id (the parent's name; null for
    the root), n_convs (members), n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree,
    members but one times words of the last turn), ends_sha256 (of the ascending identifiers of the conversations that end
    here, joined by commas). An empty table has no node.
    """
    ship(turns.sparkSession)
    paths = _paths(turns, conversations, height)
    nodes = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("words", "p1", "p2")])
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    weights = nodes.select("conv_id", *NODE, (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.expr("(n_convs - 1) * words AS saved_tokens"))
    sums = _subtree_sums(weights, paths, ["n_leaves", "saved_tokens"], height)
    nodes = nodes.join(sums, list(NODE)).join(_end_digests(paths), list(NODE), "left")
    nodes = materialise(nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))), "trie-whole")

    name = F.concat_ws("/", *NODE)  # a node may have most of all nodes as children
    parents = nodes.where("n_children > 0").select(name.alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    rest = nodes.where("depth > 0").withColumn("parent", F.concat_ws("/", F.col("depth") - 1, "p1", "p2"))
    rest = join_groups(rest, parents, "parent", "size", "conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return root.select(columns).unionByName(rest.select(columns))
