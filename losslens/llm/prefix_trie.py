"""A prefix trie over conversations, from mergeable partial node tables.

A node is named by a hash of its path: the sum of hashes of (depth, turn) along
it, so names come from running sums and a long conversation is many tasks.
Partitions combine their own rows by name and the partial tables are merged by
hash: members are counted, lists of conversations that end at a node are kept as
sorted pieces.  The rollup goes up from the ends: a node's saving is handed to
its least member, a member's savings from a depth on are a running sum from its
last turn up, and a node's subtree has what its members bring from its depth on,
so any depth takes one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import hot_join, save
from losslens.llm.ranges import MODULUS, running_sums

#: Ids of an end list that travel in a row.
PIECE_IDS = 8192
ROOT = (0, 0)
WORD = r"[^\x20\x09-\x0D]+"


def told_apart(rows: DataFrame, conv: str = "conv_id", at: str = "turn") -> DataFrame:
    """conv (long), turn, digest of role and text, words: a row for each turn, without its text; null roles and texts are empty, rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = rows.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{at}`").alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    digest = F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"))
    return own.select("conv", "turn", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("id"))


def in_order(told: DataFrame) -> DataFrame:
    """conv, place (from 0 in its conversation), digest, words; turns go by number (null first), equal numbers by digest."""
    one = told.withColumn("place", F.lit(1).cast("long"))
    return running_sums(one, "conv", [F.col("turn").asc_nulls_first(), "digest", "id"], ["place"], "trie-turns").select("conv", (F.col("place") - 1).alias("place"), "digest", "words")


def shared_openings(turns: DataFrame, group: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, place, digest, words) of rebuilt conversations, and (conv) of all of them.

    Conversation c begins with the first h turns of c - c % group (all, if it has
    fewer; none, if it isn't there) and goes on with its own turns after its
    first h; h is crc32(c) % longest.  A group's first conversation gives at most
    longest - 1 turns to group - 1 others.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % longest).alias("h")
    sizes = save(turns.groupBy("conv").agg(F.count("*").alias("n")), "trie-sizes")
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = save(sizes.select("conv", "n", h, (F.col("conv") - F.col("conv") % group).alias("base")).join(bases, "base", "left").select("conv", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent")), "trie-convs")
    heads = turns.where(F.col("place") < longest - 1).select(F.col("conv").alias("base"), "place", "digest", "words")
    opening = convs.where("h > 0").select("conv", "h", "base").join(heads, "base").where("place < h").select("conv", "place", "digest", "words")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = hot_join(turns, convs.select("conv", "n", "h", "lent"), "conv", "n", total).where("place >= h")
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "digest", "words")
    return opening.unionByName(own), sizes.select("conv")


def paths(turns: DataFrame) -> DataFrame:
    """conv, depth, node, parent, words of each turn (depth from 1); node and parent are structs of two longs, the root is (0, 0)."""
    depth = (F.col("place") + 1).cast("long")
    keep = F.lit(MODULUS - 1)
    hashes = [F.xxhash64(F.lit(seed), "digest", depth).bitwiseAND(keep) for seed in (1, 2)]
    rows = turns.select("conv", depth.alias("depth"), "words", hashes[0].alias("x"), hashes[1].alias("y"), hashes[0].alias("own_x"), hashes[1].alias("own_y"))
    summed = running_sums(rows, "conv", ["depth"], ["x", "y"], "trie-paths")
    parent = F.struct((F.col("x") - F.col("own_x")).bitwiseAND(keep).alias("x"), (F.col("y") - F.col("own_y")).bitwiseAND(keep).alias("y"))
    return summed.select("conv", "depth", "words", F.struct("x", "y").alias("node"), parent.alias("parent"))


def root() -> Column:
    return F.struct(F.lit(ROOT[0]).cast("long").alias("x"), F.lit(ROOT[1]).cast("long").alias("y"))


def node_table(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """node, parent, depth, words, n_convs, conv (least member), n_children; the root too, if there are conversations.

    Each partition combines its rows to a table of its own before the tables meet.
    """
    merged = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.max("words").alias("words"), F.count("*").alias("n_convs"), F.min("conv").alias("conv"))
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    top = top.select(root().alias("node"), F.lit(None).cast("struct<x:long,y:long>").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n_convs", "conv")
    nodes = save(merged.unionByName(top), "trie-nodes")
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return save(nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")


def end_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, ends_sha256): of the ids, ascending and comma-joined, of the conversations that end at the node.

    Ids are sorted by range and travel as pieces of at most PIECE_IDS; a node's
    pieces come in their order to one task, which feeds them to the digest one
    by one, so a list of any length is never held.
    """
    last = rows.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))
    ends = convs.join(last, "conv", "left").select(F.coalesce("node", root()).alias("node"), "conv").select("node.x", "node.y", "conv")
    order = ["x", "y", "conv"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, now, ids, out = TaskContext.get().partitionId(), 0, None, [], []

        def close() -> None:
            out.append((*now, part, piece, ",".join(map(str, ids))))
            ids.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()])], ["x", "y", "part", "piece", "ids"])

        for batch in batches:
            for x, y, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and ((x, y) != now or len(ids) == PIECE_IDS):
                    close()
                    piece += 1
                now = x, y
                ids.append(conv)
            yield made()
        if ids:
            close()
        yield made()

    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "x long, y long, part long, piece long, ids string")
    pieces = pieces.repartition("x", "y").sortWithinPartitions("x", "y", "part", "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string()])], ["x", "y", "ends_sha256"])

        for batch in batches:
            done = []
            for x, y, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4))):
                if (x, y) != now:
                    if sha:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (x, y), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield made(done)
        yield made([(*now, sha.hexdigest())] if sha else [])

    return pieces.mapInArrow(digest, "x long, y long, ends_sha256 string").select(F.struct("x", "y").alias("node"), "ends_sha256")


def rollup(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) of each node but the root, over its subtree."""
    stats = nodes.where("depth > 0").select("node", "n_convs", F.col("conv").alias("least"), "n_children", F.col("words").alias("node_words"))
    total = stats.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    # n_convs is both what a node saves and how many rows meet it
    met = hot_join(rows.select("conv", "depth", "node"), stats.withColumn("n", F.col("n_convs")), "node", "n", total)
    own = F.col("conv") == F.col("least")
    saved = F.when(own, (F.col("n_convs") - 1) * F.col("node_words")).otherwise(F.lit(0).cast("long"))
    leaf = F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long")
    # from each conversation's last turn up: what it brings from this depth on
    brought = running_sums(met.select("conv", "depth", "node", saved.alias("saved"), leaf.alias("leaf")), "conv", [F.desc("depth")], ["saved", "leaf"], "trie-rollup")
    return brought.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has conv, place (from 0, without gaps), digest and words of each turn;
    convs has each conversation once, those without turns too.  Conversations
    with equal turns share all their nodes.  Without conversations there are no
    nodes.
    """
    rows = save(paths(turns), "trie-rows")
    nodes = node_table(rows, convs)
    sums = rollup(rows, nodes)
    ends = end_digests(rows, convs)
    full = save(nodes.join(sums, "node", "left").join(ends, "node", "left"), "trie-full")
    leaves, saved = full.where("depth = 1").agg(F.coalesce(F.sum("n_leaves"), F.lit(1)), F.coalesce(F.sum("saved_tokens"), F.lit(0))).first()
    is_root = F.col("depth") == 0
    at_root = {"n_leaves": leaves, "saved_tokens": saved}
    full = full.withColumns({c: F.when(is_root, F.lit(v).cast("long")).otherwise(F.col(c)) for c, v in at_root.items()})
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
    below = full.where(~is_root)
    met = hot_join(below, parents.withColumnRenamed("n_children", "weight"), "parent", "weight", nodes.count())
    whole = met.unionByName(full.where(is_root).withColumn("parent_conv_id", F.lit(None).cast("long")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations given as rows (conv_id, turn, role, text) after they got shared openings; rows without a conv_id are left out, other columns are ignored."""
    turns = save(in_order(save(told_apart(rows), "trie-told")), "trie-order")
    rebuilt, convs = shared_openings(turns)
    return prefix_trie(rebuilt, convs)
