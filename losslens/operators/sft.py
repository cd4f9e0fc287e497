"""Fine-tuning data: knapsack packing, metrics on text pairs, smoothing, sampling."""

from __future__ import annotations

import bisect
import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from losslens.sources.saved import numbered, ranged, saved


def knapsack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths: each takes the largest that still fits, until none is left; a length over the capacity raises."""
    left, bins = sorted(lengths), []
    if left and left[-1] > capacity:
        raise ValueError("a length is over the capacity")
    while left:
        room, now = capacity, []
        while left and (i := bisect.bisect_right(left, room)):
            now.append(left.pop(i - 1))
            room -= now[-1]
        bins.append(now)
    return bins


def knapsack_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """``knapsack`` told by counts of lengths: (first bin, how many bins, [(length, how often in each)]) of equal bins in a row.

    Bins stay equal until one of their lengths runs short, which can happen about
    twice for each length, so there are no more runs than about twice the
    capacity, however many rows there are.
    """
    if counts and max(counts) > capacity:
        raise ValueError("a length is over the capacity")
    left = {n: c for n, c in counts.items() if c > 0}
    there, runs, first = sorted(left), [], 0
    while there:
        room, taken, at = capacity, [], len(there)
        while at and (at := bisect.bisect_right(there, room, 0, at)):
            n = there[at - 1]
            often = min(left[n], room // n) if n else left[n]
            taken.append((n, often))
            room -= n * often
            at -= 1
        times = min(left[n] // often for n, often in taken)
        runs.append((first, times, taken))
        first += times
        for n, often in taken:
            left[n] -= times * often
            if not left[n]:
                there.remove(n)
    return runs


def pack_lengths(rows: DataFrame, id_col: str, length: str, capacity: int) -> DataFrame:
    """(bin, place, id, length): knapsack packing of all rows; ``place`` orders a bin's rows, the longest first.

    The greedy rule is run on the histogram of lengths, which has at most
    ``capacity`` + 1 entries, and a row finds its bin by its rank among those of its
    length (the largest id first).  So bins are those of the rule over all rows in
    any partitioning, and a length with a third of all rows is many ranges.  Rows
    over the capacity and those without a length are dropped, as the operator does.
    """
    spark = rows.sparkSession
    kept = saved(rows.where(F.col(length) <= capacity).select(F.col(id_col).alias("id"), F.col(length).cast("long").alias("length")), "lengths")
    counts = {r.length: r["count"] for r in kept.groupBy("length").count().collect()}  # at most capacity + 1 rows
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = dict.fromkeys(counts, 0)
    for first, times, taken in knapsack_runs(counts, capacity):
        for n, often in taken:
            runs.setdefault(n, []).append((used[n], often, first))
            used[n] += times * often
    longer, known = 0, []
    for n in sorted(counts, reverse=True):
        known.append((n, longer, runs[n]))
        longer += counts[n]
    known = F.broadcast(spark.createDataFrame(known, "length long, longer long, runs array<struct<start:long,often:long,bin:long>>"))  # bounded by the capacity
    placed = numbered(kept, F.desc("length"), F.desc("id"), name="n").join(known, "length").withColumn("rank", F.col("n") - F.col("longer"))
    run = F.element_at(F.filter("runs", lambda r: r["start"] <= F.col("rank")), -1)
    found = placed.withColumn("run", run).select((F.col("run.bin") + F.expr("(rank - run.start) div run.often")).alias("bin"), "n", "id", "length")
    return found.select("bin", F.col("n").alias("place"), "id", "length")


def blocks(rows: DataFrame, id_col: str, length: str, size: int) -> DataFrame:
    """(block, id, offset, start, length): all rows end to end in the order of their ids, cut into blocks of ``size``; the last, shorter one is dropped.

    Offsets are summed range by range: the driver gets one length of each range.
    """
    cut = ranged(rows.select(id_col, F.col(length).cast("long").alias("_n")).where("_n > 0"), id_col)
    lengths = sorted(tuple(r) for r in cut.groupBy("_range").agg(F.sum("_n")).collect())
    starts, total = [], 0
    for place, n in lengths:
        starts.append((place, total))
        total += n
    begins = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range long, _start long"))
    before = F.sum("_n").over(Window.partitionBy("_range").orderBy("_within")) - F.col("_n")  # a window over one range
    placed = cut.join(begins, "_range").withColumn("_off", F.col("_start") + before)
    last = F.floor((F.col("_off") + F.col("_n") - 1) / size)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("_off") / size), last))).where(F.col("block") < total // size)
    begin, end = F.greatest("_off", F.col("block") * size), F.least(F.col("_off") + F.col("_n"), (F.col("block") + 1) * size)
    return pieces.select("block", id_col, (begin - F.col("block") * size).alias("offset"), (begin - F.col("_off")).alias("start"), (end - begin).alias("length"))


def smoothed(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value, smoothed) of each series; null values are left out.

    Series are cut where the ranges of the sorted rows end, so a hot series is
    many pieces.  A piece is smoothed from 0; what the pieces before it leave
    over (one number of each piece) is then added, faded by the weight.
    """
    cut = ranged(rows.select(key, order, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()), key, order)
    sizes = cut.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    weighed = cut.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn("_w", 1.8 * (1 / (1 + F.exp(-0.05 * F.col("_n"))) - 0.5)).drop("_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_within", kind="stable")
        w, last, out = pdf["_w"].iloc[0], 0.0, []
        for x in pdf[value]:
            last = last * w + (1 - w) * x
            out.append(last)
        return pdf.assign(_local=out, _place=range(1, len(out) + 1))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in weighed.schema)
    local = saved(weighed.groupBy("_range", key).applyInPandas(run, f"{kinds}, _local double, _place long"), "smoothed")
    ends = local.groupBy(key, "_range").agg(F.max_by("_local", "_place").alias("end"), F.max("_place").alias("n"), F.min_by(value, "_place").alias("first"), F.first("_w").alias("w"))
    pieces = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_range", "end", "n", "first", "w"))).alias("p"))
    start = F.array(F.col("p")[0]["first"])
    carries = F.aggregate("p", start, lambda have, p: F.concat(have, F.array(p["end"] + F.pow(p["w"], p["n"]) * F.element_at(have, -1))))
    carried = pieces.select(F.col(key).alias("_key"), F.explode(F.arrays_zip(F.col("p._range").alias("r"), F.slice(carries, 1, F.size("p")).alias("c"))).alias("z")).select("_key", F.col("z.r").alias("_r"), F.col("z.c").alias("_carry"))
    joined = local.join(carried, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(key, order, value, (F.col("_local") + F.pow("_w", "_place") * F.col("_carry")).alias("smoothed"))


def rouge(prediction: list[str], reference: list[str]) -> tuple[float, float, float]:
    """F-scores of common words, common word pairs and the longest common subsequence."""
    def f(hit: int, a: int, b: int) -> float:
        return 2 * hit / (a + b) if hit else 0.0

    grams = lambda x, n: Counter(zip(*(x[i:] for i in range(n))))
    both = [sum((grams(prediction, n) & grams(reference, n)).values()) for n in (1, 2)]
    row = [0] * (len(reference) + 1)
    for p in prediction:
        old, row = row, [0]
        for j, r in enumerate(reference):
            row.append(old[j] + 1 if p == r else max(old[j + 1], row[j]))
    n, m = len(prediction), len(reference)
    return f(both[0], n, m), f(both[1], n - 1, m - 1), f(row[-1], n, m)


def bleu4(prediction: list[str], reference: list[str]) -> float:
    """Geometric mean of 1- to 4-gram precisions with the brevity penalty; a zero count is 1 over a power of two."""
    if not prediction:
        return 0.0
    logs, halved = 0.0, 1
    for n in range(1, 5):
        a, b = Counter(zip(*(prediction[i:] for i in range(n)))), Counter(zip(*(reference[i:] for i in range(n))))
        hit, total = sum((a & b).values()), max(1, len(prediction) - n + 1)
        if hit == 0:
            if n == 1:
                return 0.0
            halved *= 2
            hit = 1 / halved
        logs += math.log(hit / total) / 4
    return math.exp(min(0.0, 1 - len(reference) / len(prediction)) + logs)
