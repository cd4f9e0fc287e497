"""Chat formatting over reply trees.

Messages point to the message they answer.  Iterative self-joins double the
length of the way known for each message (its pointer, the distance and the
score along it) until every pointer has reached a root, so a tree of depth d
takes about log2 d rounds.  A leaf and its way up are a branch; branches of a
tree are ranked by score, the chosen leaves spread along the stored pointers to
all messages above them, and each chosen path is formatted as one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from losslens.llm.common import save

# The template's own control strings, and those of other common
# templates, which are escaped too.
TURN, TEXT, END_TURN = "<|turn|>", "<|text|>", "<|end|>\n"
#: A control string's first character, the backslashes of earlier escapes, and its rest.
CONTROL = re.compile(r"(<|\[)(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)")
ESCAPED = re.compile(r"(<|\[)(\\*)\\(\||/?s>|/?INST\]|<SYS>>|</SYS>>)")
PIECES = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END_TURN), re.S)
LEARNED = "assistant"


def escape(text: str) -> str:
    """The text with one backslash more inside each control string."""
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    """Undoes escape: one backslash less inside each control string that has some."""
    return ESCAPED.sub(r"\1\2\3", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans (first and last + 1 character) under the loss mask: assistant texts only."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = TURN + escape(role or "") + TEXT, escape(text or "")
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END_TURN)
        at += len(out[-1])
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in PIECES.findall(formatted)]


def link_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Plain conversations as reply trees: conv, node, parent, role, text, score; each row answers the one before it.

    Rows go by turn (null first), equal turns by role and text; repeated rows
    stay.  The score of a message is 0.  Nodes are numbered range by range over
    all conversations, so a conversation with a third of all rows is many ranges;
    the driver gets one row of each range.
    """
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("__turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "__turn", "role", "text")]
    kind = named.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's range, its place there, and whether the row before has the same conversation (unknown for a range's first)."""
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            convs = batch.column(0).to_pylist()
            before = [last, *convs[:-1]]
            goes_on = [None if at + i == 0 else a == b for i, (a, b) in enumerate(zip(before, convs))]
            places = np.arange(at, at + len(convs))
            at, last = at + len(convs), convs[-1] if convs else last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(convs), pa.int64()), pa.array(places, pa.int64()), pa.array(goes_on, pa.bool_())], ["conv", "role", "text", "range", "place", "goes_on"])

    sorted_rows = named.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")
    cut = save(sorted_rows.mapInArrow(run, f"conv {kind}, role string, text string, range long, place long, goes_on boolean"), "reply-rows")
    ends = cut.groupBy("range").agg(F.count("*").alias("n"), F.min_by(F.struct("conv"), "place").alias("first"), F.max_by(F.struct("conv"), "place").alias("last"))
    starts, total, before = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r["range"]):  # a row for each range
        starts.append((r["range"], total, before is not None and before.conv == r.first.conv))
        total, before = total + r.n, r.last
    starts = rows.sparkSession.createDataFrame(starts, "range long, start long, joins boolean")
    numbered = cut.join(F.broadcast(starts), "range").withColumn("node", F.col("start") + F.col("place"))
    return numbered.select("conv", "node", F.when(F.coalesce("goes_on", "joins"), F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def same(conv: str, node: str, other: str, at: str) -> Column:
    return F.col(conv).eqNullSafe(F.col(other)) & (F.col(node) == F.col(at))


def cut_circles(nodes: DataFrame, lost: DataFrame, n: int) -> DataFrame:
    """nodes, with the parent of each circle's least message made null; ``lost`` are the n messages that reach no root.

    Each lost message's way is doubled until it is longer than any circle; where
    it then stands is on one, and a message there that is the least on its own
    way is the circle's least.
    """
    walk = save(lost.join(nodes.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "parent"), same("conv", "node", "c2", "n2")).select("conv", "node", F.col("parent").alias("up"), F.col("node").alias("least")), "reply-circle")
    steps = 1
    while steps < n:
        above = walk.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), F.col("up").alias("u2"), F.col("least").alias("l2"))
        walk = save(walk.join(above, same("conv", "up", "c2", "n2")).select("conv", "node", F.col("u2").alias("up"), F.least("least", "l2").alias("least")), "reply-circle")
        steps *= 2
    stands = walk.select(F.col("conv").alias("c2"), F.col("up").alias("n2")).distinct()
    heads = walk.where("node = least").join(stands, same("conv", "node", "c2", "n2"), "left_semi").select(F.col("conv").alias("c2"), F.col("node").alias("n2"))
    return nodes.join(heads, same("conv", "node", "c2", "n2"), "left").withColumn("parent", F.when(F.col("n2").isNull(), F.col("parent"))).drop("c2", "n2")


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, node, root, depth, total) for each message, and the pointer tables of each round: (conv, node, up), 2**round steps up.

    A message whose parent is missing is a root; so is the least message of a
    circle of replies.
    """
    there = nodes.select(F.col("conv").alias("c2"), F.col("node").alias("n2"))
    known = nodes.join(there, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("parent") == F.col("n2")), "left").withColumn("up", F.col("n2"))
    way = known.select("conv", "node", "up", F.coalesce("up", "node").alias("root"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total"))
    way = save(way, "reply-way")
    pointers, done, still = [], way.where("up is null"), way.where("up is not null")
    n, before = still.count(), -1
    while n and n != before:  # depths have no gaps, so a round that finishes none leaves only circles
        pointers.append(still.select("conv", "node", "up"))
        # only messages whose pointer hasn't reached a root take part, but any may stand above them
        above = done.unionByName(still).select(F.col("conv").alias("c2"), F.col("node").alias("n2"), F.col("up").alias("u2"), F.col("root").alias("r2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        moved = still.join(above, same("conv", "up", "c2", "n2")).select(
            "conv", "node", F.col("u2").alias("up"), F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total")
        )
        moved = save(moved, "reply-way")
        done, still = done.unionByName(moved.where("up is null")), moved.where("up is not null")
        n, before = still.count(), n
    if n:
        return climb(save(cut_circles(nodes, still.select("conv", "node"), n), "reply-nodes"))
    return done.drop("up"), pointers


def choose_paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(conv, root, leaf, rank, node, depth): the messages of the chosen root-to-leaf paths of each tree.

    Branches are ranked by mean score, then length, then the leaf's number;
    ``best`` of each tree are taken (None: all).
    """
    ways, pointers = climb(nodes)
    ways = save(ways, "reply-ways")
    leaves = ways
    for pointer in pointers[:1]:  # one step up: who is answered is no leaf
        asked = pointer.select(F.col("conv").alias("c2"), F.col("up").alias("n2")).distinct()
        leaves = ways.join(asked, same("conv", "node", "c2", "n2"), "left_anti")
    order = Window.partitionBy("conv", "root").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    path = save(ranked.select("conv", "root", F.col("node").alias("leaf"), "rank", "node"), "reply-path")
    for pointer in pointers:  # after round r the path holds the nearest 2**(r + 1) messages
        up = pointer.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "up")
        more = path.join(up, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2"))).select("conv", "root", "leaf", "rank", F.col("up").alias("node"))
        path = save(path.unionByName(more), "reply-path")
    depth = ways.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "depth")
    return path.join(depth, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2"))).select("conv", "root", "leaf", "rank", "node", "depth")


def conversations(nodes: DataFrame, best: int | None = 1, unique: bool = False) -> DataFrame:
    """(conv, root, leaf, rank, formatted, loss array<struct<start, end>>) for each chosen path.

    nodes needs conv, node, parent, role, text and score; other columns, of any
    name, are left out.  A message (conv, node) that is there more than once
    counts once, its least row (``unique`` says that there is none, and that
    nodes is a saved table or cheap to read again).  Null roles and texts count as empty, a null
    score as 0, a null conv is a conversation of its own; messages without a
    node are left out.  A circle of replies begins at its least message.  Rows
    of a path come sorted to one task, one conversation held at a time.
    """
    if not unique:
        own = nodes.where("node is not null").select("conv", "node", F.struct(F.col("parent"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).alias("m"))
        nodes = save(own.groupBy("conv", "node").agg(F.min("m").alias("m")).select("conv", "node", "m.*"), "reply-nodes")
    said = nodes.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "role", "text")
    rows = choose_paths(nodes, best).join(said, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")))
    by = ["conv", "root", "leaf"]
    rows = rows.select(*by, "rank", "depth", "role", "text").repartition(*by).sortWithinPartitions(*by, "depth")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, done, schema = None, [], [], None

        def close() -> None:
            text, spans = format_turns(turns)
            done.append((*now, text, [{"start": a, "end": b} for a, b in spans]))
            turns.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            done.clear()
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [*(schema.field(i).type for i in range(4)), pa.string(), spans]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [*by, "rank", "formatted", "loss"])

        for batch in batches:
            schema = batch.schema
            for *key, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(key) != now:
                    if turns:
                        close()
                    now = tuple(key)
                turns.append((role, text))
            if done:
                yield out()
        if turns:
            close()
            yield out()

    return rows.mapInArrow(run, f"conv {kinds['conv']}, root long, leaf long, rank {kinds['rank']}, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the stored text and its mask.

    The output is written to the shared folder first: formatting and reading
    then take turns, so a task has one Python worker and not two.
    """
    formatted = save(formatted, "reply-conversations")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv"].dataType.simpleString()
    return formatted.select("conv", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
