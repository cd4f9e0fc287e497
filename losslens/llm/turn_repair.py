"""Conversation structure repair by a min-plus matrix scan.

Role initials of a repaired conversation form ``(s?(ua)+)?``, an automaton of
four states.  A turn is a 4x4 matrix: entry (i, j) is the cheapest way to edit
it so that the automaton goes from i to j, as (cost, audit), with the closure of
inserted turns on both sides.  Products take the least cost, then the least
audit; two ways of one cost over the same turns are never prefixes of each
other, as a longer one has more inserts, so the product is associative and
exact.  Ranges of the sorted turns are multiplied on their own and the partial
products of conversations that span several ranges or pieces meet in rounds of a
tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import WHITE, hot_join, save

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 1, 2, 5, 5
#: Turns multiplied into one partial product, and partial products merged at a time.
PIECE, FAN = 4096, 32
#: State 0: nothing yet; 1: after system; 2: after user; 3: after assistant.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
OK, BLANK, DUPLICATE, TRUNCATED = range(4)

Matrix = tuple  # 16 entries, row by row: (cost, audit) or None


def times(a: Matrix, b: Matrix) -> Matrix:
    """The least (cost, audit) over the state between."""
    out: list = []
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x and y:
                    cost = x[0] + y[0]
                    if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                        best = cost, x[1] + y[1]
            out.append(best)
    return tuple(out)


def closure() -> Matrix:
    """Any number of inserted turns: the nearest way by inserts from each state to each other."""
    step = {(i, STEP[i, x]) for i in range(4) for x in "ua" if (i, x) in STEP}
    own = tuple((0, "") if i == j else (INSERT, "I") if (i, j) in step else None for i in range(4) for j in range(4))
    return times(times(own, own), own)


@lru_cache
def turn(code: str) -> Matrix:
    """A turn by its code: a role's initial (x: any other), in upper case if the turn is truncated; d: must go."""
    ways: dict = {(i, i): (DELETE, "D") for i in range(4)}
    if code != "d":
        more = TRUNCATED_STAYS if code.isupper() else 0
        for (i, x), j in STEP.items():
            for way in [(more, "K")] * (x == code.lower()) + [(more + REROLE, "R")] * (x in "ua"):
                ways[i, j] = min(way, ways.get((i, j), way))
    own = tuple(ways.get((i, j)) for i in range(4) for j in range(4))
    return times(times(closure(), own), closure())


def product(codes: str) -> Matrix:
    """The product of the turns, as a balanced tree; short runs are remembered."""
    return _short(codes) if len(codes) <= 16 else times(product(codes[: len(codes) // 2]), product(codes[len(codes) // 2 :]))


@lru_cache(4096)
def _short(codes: str) -> Matrix:
    return turn(codes) if len(codes) == 1 else times(_short(codes[: len(codes) // 2]), _short(codes[len(codes) // 2 :]))


def verdict(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    return min(matrix[j] for j in ENDS if matrix[j])


def told_apart(rows: DataFrame, conv: str, at: str) -> DataFrame:
    """conv, turn (long), role, text and a digest of both; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    named = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{at}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return named.withColumn("digest", F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")))


def turn_faults(rows: DataFrame, conv: str = "conv_id", at: str = "turn") -> DataFrame:
    """(conv, turn, digest, id, initial, fault): a row for each turn, its first fault, without its text.

    A duplicate has the role and text of an earlier turn of its conversation.
    Rows of one digest are counted before they meet, and digests of many rows
    are broadcast (HOT_KEYS at most), so copies never fill a task.
    """
    told = told_apart(rows, conv, at)
    body, initial = F.btrim("text", F.lit(WHITE)), F.substring("role", 1, 1)
    fault = F.when(body == "", BLANK).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    same = F.md5(F.concat_ws(":", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("n")), "digest"))
    own = save(told.select("conv", "turn", "digest", same.alias("same"), F.monotonically_increasing_id().alias("id"), known.alias("initial"), fault.alias("fault")), "turn-faults")
    place = F.struct(F.col("turn").isNotNull(), "turn", "id")
    seen = save(own.groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("n")), "turn-firsts")
    met = hot_join(own, seen, "same", "n", own.count())
    again = (F.col("id") != F.col("first.id")) & (F.col("fault") != BLANK)
    return met.select("conv", "turn", "digest", "id", "initial", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


SUMS = ["blank", "duplicate", "truncated", "illegal", "turns"]
#: Of a run of turns: where it stands, whether it is a whole conversation, counts, what its ends are like, its product.
PART = "range long, piece long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, head string, tail string, first_turn long, last_turn long, least long, most long, costs array<long>, audits array<string>"
PART_NAMES = [x.split()[0] for x in PART.split(", ")]
PART_TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in PART.split(", ")]


def summary(turns: list[int | None], initials: str, faults: list[int]) -> dict:
    """Of a run of turns in their order."""
    there = [t for t in turns if t is not None]
    codes = "".join("d" if f in (BLANK, DUPLICATE) else x.upper() if f == TRUNCATED else x for x, f in zip(initials, faults))
    matrix = product(codes)
    counts = [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), len(set(there))]
    return dict(zip(SUMS, counts)) | {
        "head": initials[0], "tail": initials[-1], "first_turn": turns[0], "last_turn": turns[-1], "least": there[0] if there else None, "most": there[-1] if there else None,
        "costs": [x and x[0] for x in matrix], "audits": [x and x[1] for x in matrix],
    }


def joined(a: dict, b: dict) -> dict:
    """The summary of two neighbouring runs."""
    out = {k: a[k] + b[k] for k in SUMS}
    out["illegal"] += a["tail"] + b["head"] not in ("su", "ua", "au")
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    matrix = times(*[tuple(None if c is None else (c, t) for c, t in zip(x["costs"], x["audits"])) for x in (a, b)])
    return out | {
        "head": a["head"], "tail": b["tail"], "first_turn": a["first_turn"], "last_turn": b["last_turn"], "least": b["least"] if a["least"] is None else a["least"], "most": a["most"] if b["most"] is None else b["most"],
        "costs": [x and x[0] for x in matrix], "audits": [x and x[1] for x in matrix],
    }


def _batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    """rows: (conv, summary with its place)."""
    columns = [pa.array([c for c, _ in rows], conv_type), *(pa.array([p[k] for _, p in rows], t) for k, t in zip(PART_NAMES, PART_TYPES))]
    return pa.RecordBatch.from_arrays(columns, ["conv", *PART_NAMES])


def partial_products(faults: DataFrame) -> DataFrame:
    """A row for each conversation of each sorted range, or for each PIECE turns of it."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest", "id"]
    kind = faults.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, made = TaskContext.get().partitionId(), [], 0
        now, held, piece, first = None, ([], [], []), 0, True  # first: the run that began the range may go on from the range before

        def close(last: bool) -> None:
            turns, initials, faults = held
            done.append((now, {"range": part, "piece": piece, "whole": last and not piece and not first} | summary(turns, "".join(initials), faults)))
            for x in held:
                x.clear()

        for batch in batches:
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if made and conv != now:
                    if held[0]:
                        close(True)
                    piece, first = 0, False
                elif len(held[0]) == PIECE:
                    close(False)
                    piece += 1
                now, made = conv, made + 1
                for x, y in zip(held, turn):
                    x.append(y)
            if len(done) > 256:
                yield _batch(done, batch.schema.field(0).type)
                done.clear()
            kind = batch.schema.field(0).type
        if held[0]:
            close(False)  # the range's last run may go on in the next
        if done:
            yield _batch(done, kind)

    return faults.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "initial", "fault").mapInArrow(run, f"conv {kind}, {PART}")


def merged(parts: DataFrame, groups: list[Column]) -> DataFrame:
    """Neighbouring parts of a conversation and group as one part, in one round."""
    kind = parts.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, place, conv_type = None, None, None, None
        for batch in batches:
            conv_type, done = batch.schema.field(0).type, []
            for row in batch.to_pylist():
                key = row["conv"], row["g0"], row["g1"]
                if held is not None and key == now:
                    held = joined(held, row)
                    continue
                if held is not None:
                    done.append((now[0], held | place))
                now, held, place = key, row, {"range": row["g0"], "piece": row["g1"], "whole": False}
            if done:
                yield _batch(done, conv_type)
        if held is not None:
            yield _batch([(now[0], held | place)], conv_type)

    cut = parts.withColumns({f"g{i}": g for i, g in enumerate(groups)})
    return cut.repartition("conv", "g0", "g1").sortWithinPartitions("conv", "g0", "g1", "range", "piece").mapInArrow(run, f"conv {kind}, {PART}")


def conversation_report(faults: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has turns (of ``turn_faults``).

    Only conversations that touch a range's ends or have over PIECE turns take
    part in the rounds of the tree.  An audit is one value, so its conversation's
    turns are bounded by what a string holds (2**31).
    """
    parts = save(partial_products(faults), "turn-parts")
    whole, open_ = parts.where("whole"), parts.where(~F.col("whole"))
    pieces, ranges = open_.agg(F.max("piece"), F.max("range")).first()
    while pieces or ranges:  # first the pieces of each range, then the ranges
        groups = [F.col("range"), F.floor(F.col("piece") / FAN)] if pieces else [F.floor(F.col("range") / FAN), F.lit(0).cast("long")]
        open_ = save(merged(open_, groups), "turn-tree")
        pieces, ranges = (pieces // FAN, ranges) if pieces else (0, ranges // FAN)
    best = F.array_min(F.array(*[F.when(F.col("costs")[j].isNotNull(), F.struct(F.col("costs")[j].alias("cost"), F.col("audits")[j].alias("audit"))) for j in ENDS]))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return whole.unionByName(open_).select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.alias("b")).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "b.cost", "b.audit")


def repaired_turns(rows: DataFrame, report: DataFrame, conv: str = "conv_id", at: str = "turn") -> DataFrame:
    """(conv, place, edit, role, text): the turns of each repaired conversation, together and in their order, K kept, R with a new role, I inserted.

    A conversation's turns come sorted to one task behind its audit; they are
    passed on one by one, so only the audit is held.
    """
    told = told_apart(rows, conv, at).select("conv", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    audits = report.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"))
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "digest"]
    both = told.unionByName(audits).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, i, place, system, now = "", 0, 0, False, None

        def role_of(edit: str, own: str) -> str:
            return own if edit == "K" else ("user", "assistant")[(place - system) % 2]

        for batch in batches:
            out: list[tuple] = []
            for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    now, audit, i, place, system = conv, text, 0, 0, False
                    while i < len(audit) and audit[i] == "I":  # what stands before the first turn
                        out.append((conv, place, "I", role_of("I", ""), ""))
                        i, place = i + 1, place + 1
                    continue
                edit, i = audit[i], i + 1
                if edit != "D":
                    system |= place == 0 and edit == "K" and role[:1] == "s"
                    out.append((conv, place, edit, role_of(edit, role), text))
                    place += 1
                while i < len(audit) and audit[i] == "I":
                    out.append((now, place, "I", role_of("I", ""), ""))
                    i, place = i + 1, place + 1
            columns = list(zip(*out)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv", "place", "edit", "role", "text"])

    kind = both.schema["conv"].dataType.simpleString()
    return both.mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired_turns' rows as they come: role:text, joined by newlines, fed to the digest turn by turn."""
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done, conv_type = [], batch.schema.field(0).type
            for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if place == 0:
                    if digest:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], conv_type), pa.array([d for _, d in done], pa.string())], ["conv", "repaired_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], conv_type), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, conv: str = "conv_id", at: str = "turn") -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of conversations given as rows with conv, turn, role and text.

    Turns go by number (cast to long, null first), equal numbers by a digest of
    role and text; a null role or text is one space; repeated rows are turns of
    their own (all but the first are duplicates); a null conv is a conversation.
    Blank and duplicate turns go, truncated ones cost more if they stay.  Texts
    of any length pass as they are.  An empty table has an empty report.  Other
    columns, of any name, are left out.
    """
    report = save(conversation_report(turn_faults(rows, conv, at)), "turn-report")
    return report, repaired_turns(rows, report, conv, at)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of ``conv_id:turn``: some rows dropped, emptied, without end marks, repeated, or said by the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_digests(rows: DataFrame) -> DataFrame:
    """The report of damaged conversations with a digest of each repaired one; a conversation that lost all its rows has zeros."""
    hurt = damaged(rows)
    report, turns = repair_conversations(hurt)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = lambda names: [F.lit(None).cast("string" if c in ("audit", "repaired_sha256") else "long").alias(c) for c in names]
    ids = rows.select(F.col("conv_id").alias("conv")).distinct().select("conv", *empty([*counts, "audit", "repaired_sha256"]))
    both = ids.unionByName(report.select("*", *empty(["repaired_sha256"]))).unionByName(text_digests(turns).select("conv", *empty([*counts, "audit"]), "repaired_sha256"))
    zero, none = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    whole = both.groupBy("conv").agg(*[F.coalesce(F.max(c), zero).alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), none).alias("repaired_sha256"))
    return whole.withColumnRenamed("conv", "conv_id")
