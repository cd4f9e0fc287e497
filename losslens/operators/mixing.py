"""Several sources as one stream, by round robin or by probabilities, and a stream shuffled through a buffer.

Both are told in closed form: where a row of a source, or of the buffer, goes is
found by counting draws, never by walking through the stream.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from losslens.sources.saved import numbered, saved

#: Draws are whole numbers below 2**DRAW_BITS, from the first hex digits of a digest.
DRAW_BITS = 52
#: Slots whose draws are counted together, and uses of a row that are made in one go.
BLOCK, USES = 1 << 16, 1 << 16


def draw(seed: int, at: str | Column) -> Column:
    """A number from 0 to 2**52 - 1 for each place of a stream, the same wherever and whenever it is made."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), (F.col(at) if isinstance(at, str) else at).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def bounds(probabilities: list[float]) -> list[int]:
    """Upper bounds of each source's draws."""
    return [round(p * (1 << DRAW_BITS)) for p in accumulate(probabilities)]


def drawn_slots(spark: SparkSession, n: int, limits: list[int], seed: int) -> DataFrame:
    """slot, source: the first n slots of the stream with the source that each one draws."""
    d = draw(seed, "slot")
    source = F.lit(len(limits) - 1)
    for i in reversed(range(len(limits) - 1)):
        source = F.when(F.col("d") < limits[i], i).otherwise(source)
    return spark.range(n).select(F.col("id").alias("slot")).withColumn("d", d).select("slot", source.alias("source"))


def block_counts(slots: DataFrame) -> DataFrame:
    """source, block, start, n: draws of each source in each block, and in all blocks before; a row for each BLOCK slots and source."""
    counts = slots.groupBy("source", F.expr(f"slot div {BLOCK}").alias("block")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"), "n")


def ranked(slots: DataFrame, counts: DataFrame) -> DataFrame:
    """slot, source, cursor: how many slots before this one draw its source; a window sees one block."""
    inside = F.row_number().over(Window.partitionBy("source", "block").orderBy("slot"))
    placed = slots.withColumn("block", F.expr(f"slot div {BLOCK}")).withColumn("inside", inside)
    return placed.join(counts.drop("n"), ["source", "block"]).select("slot", "source", (F.col("start") + F.col("inside") - 1).alias("cursor"))


def last_draws(slots: DataFrame, counts: DataFrame, sizes: list[int]) -> dict[int, int]:
    """For each source that is drawn as often as it has rows: the slot of the draw that exhausts it (one row for each source comes to the driver)."""
    spark = slots.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(sizes)), "source int, size long"))
    here = counts.join(wanted, "source").where("start < size and start + n >= size").select("source", "block", "start", "size")
    found = here.collect()
    ends = {}
    for r in found:  # one block of each source
        block = drawn_slots_between(slots, r.block)
        ends[r.source] = block.where(F.col("source") == r.source).orderBy("slot").offset(int(r.size - r.start - 1)).limit(1).first().slot
    return ends


def drawn_slots_between(slots: DataFrame, block: int) -> DataFrame:
    return slots.where((F.col("slot") >= block * BLOCK) & (F.col("slot") < (block + 1) * BLOCK))


def uses(rows: DataFrame, draws: dict[int, int], sizes: list[int]) -> DataFrame:
    """rows (source, rn and more) once for each time that the stream comes round to them, with ``cursor``.

    Many uses of one row are first cut into runs of USES, which are dealt out.
    """
    spark = rows.sparkSession
    about = F.broadcast(spark.createDataFrame([(i, draws.get(i, 0), n) for i, n in enumerate(sizes)], "source int, draws long, size long"))
    known = rows.join(about, "source").where("rn < draws").withColumn("times", F.ceil((F.col("draws") - F.col("rn")) / F.col("size")))
    if max((draws.get(i, 0) / n for i, n in enumerate(sizes) if n), default=0) > USES:
        known = known.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / USES)))).repartition("source", "rn", "run")
    else:
        known = known.withColumn("run", F.lit(0).cast("long"))
    first = F.col("run") * USES
    again = F.explode(F.sequence(first, F.least(first + USES, F.col("times")) - 1))
    return known.withColumn("use", again).withColumn("cursor", F.col("rn") + F.col("use") * F.col("size")).drop("draws", "size", "times", "run", "use", "rn")


def interleave(sources: list[DataFrame], order: str, probabilities: list[float] | None = None, seed: int = 42, over: bool = False) -> DataFrame:
    """The sources' rows (same columns) as one stream: ``source``, ``slot`` (its order, from 0) and the columns.

    Each slot takes the next row, in ``order``, of the source that it draws, or of
    the next source in turn without probabilities; a source that ends begins
    anew.  The stream ends with the slot (round robin: the round) that exhausts the
    first source, or with ``over`` the last one.  Sources are numbered range by
    range and draws counted by blocks, so no task sees the stream and the driver
    gets a few numbers; a small source that is used many times is multiplied
    before it meets its slots, so it is no hot key.  A source without rows ends the
    stream before it begins; with ``over`` it is left out, and so are its draws.
    """
    spark = sources[0].sparkSession
    if probabilities is not None and (len(probabilities) != len(sources) or min(probabilities) <= 0 or not math.isclose(sum(probabilities), 1)):
        raise ValueError("each source needs a probability over 0, and all of them a sum of 1")
    parts = [saved(numbered(s, order, name="rn"), "source") for s in sources]
    sizes = [p.count() for p in parts]
    if over and 0 in sizes and max(sizes):
        there = [i for i, n in enumerate(sizes) if n]
        some = [probabilities[i] for i in there] if probabilities else None
        left = interleave([sources[i] for i in there], order, some and [p / sum(some) for p in some], seed, over)
        return left.withColumn("source", F.element_at(F.array(*map(F.lit, there)), F.col("source") + 1))
    rows = None
    for i, part in enumerate(parts):
        one = part.withColumn("source", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    if 0 in sizes:
        return rows.where("false").select("source", F.col("rn").alias("slot"), *sources[0].columns)
    if probabilities is None:
        rounds = max(sizes) if over else min(sizes)
        made = uses(rows, {i: rounds for i in range(len(sizes))}, sizes)
        return made.select("source", (F.col("cursor") * len(sizes) + F.col("source")).alias("slot"), *sources[0].columns)
    limits, pick = bounds(probabilities), max if over else min
    guess = pick((n + 8 * math.sqrt(n) + 64) / p for n, p in zip(sizes, probabilities))
    while True:
        slots = drawn_slots(spark, math.ceil(guess), limits, seed)
        counts = saved(block_counts(slots), "draws")
        ends = last_draws(slots, counts, sizes)
        if len(ends) == len(sizes) if over else ends:
            break
        guess *= 2
    last = pick(ends.values())
    taken = slots.where(F.col("slot") <= last)
    draws = {r.source: r.n for r in taken.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row for each source
    return ranked(taken, counts).join(uses(rows, draws, sizes), ["source", "cursor"]).select("source", "slot", *sources[0].columns)


def shuffled(rows: DataFrame, order: str, size: int, seed: int = 42, name: str = "place") -> DataFrame:
    """Rows with their ``place`` (from 0) in the stream that comes out of a shuffle buffer of ``size`` rows.

    The buffer is filled with the first rows in ``order``; each later row takes the
    slot that it draws, and the row that was there comes out; at the end the rest
    comes out by its draws.  So a row leaves when its slot is drawn next: one look
    ahead over the rows of a slot, whatever the stream's length and partitions.
    A buffer of one slot changes nothing.
    """
    if size < 1:
        raise ValueError("a buffer has at least one slot")
    at = numbered(rows, order, name="_at")
    slotted = at.withColumn("_slot", F.when(F.col("_at") < size, F.col("_at")).otherwise(draw(seed, "_at") % size))
    leaves = F.lead("_at").over(Window.partitionBy("_slot").orderBy("_at"))
    known = saved(slotted.withColumn("_leaves", leaves).drop("_slot"), "shuffled")
    rest, n = known.where("_leaves is null"), known.count()
    last = F.row_number().over(Window.orderBy(draw(seed, -F.col("_at") - 1), "_at")) - 1  # the buffer: at most size rows
    ended = rest.withColumn(name, F.lit(max(0, n - size)) + last)
    return known.where("_leaves is not null").withColumn(name, F.col("_leaves") - size).unionByName(ended.withColumn(name, F.col(name).cast("long"))).drop("_at", "_leaves")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42, name: str = "sample") -> DataFrame:
    """n rows in a random order with their number in it (``sample``): all rows at most once, and if there are fewer than n, more of them drawn with replacement behind.

    ``key`` tells rows apart.  Rows are numbered range by range in the order of
    their draws; draws with replacement are numbers that meet the rows' own.
    """
    if n < 0:
        raise ValueError("a sample has no rows less than none")
    placed = saved(numbered(rows.withColumn("_d", draw(seed, key)), "_d", key, name=name).drop("_d"), "sampled")
    have = placed.count()
    once = placed.where(F.col(name) < n)
    if n <= have or not have:
        return once
    more = rows.sparkSession.range(have, n).select(F.col("id").alias("_more"), (draw(seed + 1, "id") % have).alias("_at"))
    again = more.join(placed, F.col("_at") == F.col(name)).withColumn(name, F.col("_more")).drop("_more", "_at")
    return once.unionByName(again)
