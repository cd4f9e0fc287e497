"""BLEU-4 and ROUGE of two word arrays as Columns: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a machine word that stand for words of the reference; the rest of a long is for the carry.
LIMB = 60
MASK = (1 << LIMB) - 1


def grams(words: Column, n: int) -> Column:
    """Rolling n-grams as texts; none if there are fewer words."""
    if n == 1:
        return words
    starts = F.sequence(F.lit(0), F.size(words) - n)
    rolled = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, rolled).otherwise(F.array().cast("array<string>"))


def occurrences(items: Column) -> Column:
    """Each item with the number of its occurrence: equal items become different ones."""
    empty = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        n = F.when(state["last"] == x, state["n"] + 1).otherwise(0)
        return F.struct(x.alias("last"), n.alias("n"), F.concat(state["out"], F.array(F.concat(n.cast("string"), F.lit(" "), x))).alias("out"))

    return F.aggregate(F.array_sort(items), empty, step, lambda state: state["out"])


def common(a: Column, b: Column) -> Column:
    """How many items two arrays share, each as often as it is in both."""
    return F.size(F.array_intersect(occurrences(a), occurrences(b)))


def positions(words: Column) -> Column:
    """map of word to limbs: a bit is set where the word stands."""
    limbs = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / LIMB).cast("int"))
    bit = lambda at, limb: F.when(F.floor(at / LIMB) == limb, F.call_function("shiftleft", F.lit(1).cast("long"), (at % LIMB).cast("int"))).otherwise(F.lit(0).cast("long"))
    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def step(have: Column, x: Column) -> Column:
        last = F.try_element_at(have, F.lit(-1))
        fresh = F.array(F.struct(x["w"].alias("w"), F.transform(limbs, lambda j: bit(x["i"], j)).alias("bits")))
        more = F.array(F.struct(x["w"].alias("w"), F.transform(last["bits"], lambda v, j: v.bitwiseOR(bit(x["i"], j))).alias("bits")))
        return F.when(F.coalesce(last["w"] == x["w"], F.lit(False)), F.concat(F.slice(have, F.lit(1), F.size(have) - 1), more)).otherwise(F.concat(have, fresh))

    none = F.array().cast("array<struct<w:string,bits:array<bigint>>>")
    return F.map_from_entries(F.aggregate(pairs, none, step))


def lcs_length(said: Column, wanted: Column) -> Column:
    """Length of the longest common subsequence, LIMB words of ``wanted`` at a time.

    A bit of V stays set while its word adds nothing to the subsequence; each word
    of ``said`` that is in ``wanted`` at the bits M takes V to (V + (V & M)) | (V & ~M),
    with the carry from limb to limb.
    """
    where = F.when(F.size(wanted) > 0, positions(wanted)).otherwise(F.create_map().cast("map<string,array<bigint>>"))
    limbs = F.floor((F.size(wanted) + LIMB - 1) / LIMB).cast("int")
    full = F.array_repeat(F.lit(MASK), limbs)

    def walk(known: Column) -> Column:
        def step(state: Column, bits: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("v"))

            def limb(have: Column, z: Column) -> Column:
                total = z["v"] + z["v"].bitwiseAND(z["m"]) + have["carry"]
                kept = z["v"].bitwiseAND(F.bitwise_not(z["m"]))
                return F.struct(F.shiftright(total, LIMB).alias("carry"), F.concat(have["v"], F.array(total.bitwiseAND(F.lit(MASK)).bitwiseOR(kept))).alias("v"))

            zipped = F.zip_with(state, bits, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
            return F.aggregate(zipped, start, limb, lambda have: have["v"])

        hits = F.filter(F.transform(said, lambda w: known[w]), lambda m: m.isNotNull())
        return F.aggregate(hits, full, step)

    left = F.aggregate(F.transform(F.array(where), lambda known: walk(known)), F.lit(0), lambda n, v: n + F.aggregate(v, F.lit(0), lambda k, x: k + F.bit_count(x)))
    return limbs * LIMB - left


def f_score(hit: Column, a: Column, b: Column) -> Column:
    return F.when(hit > 0, 2 * hit / (a + b)).otherwise(F.lit(0.0))


def rouge(said: Column, wanted: Column) -> dict[str, Column]:
    """F-scores of common words, common word pairs and the longest common subsequence."""
    n, m = F.size(said), F.size(wanted)
    return {"rouge1": f_score(common(said, wanted), n, m), "rouge2": f_score(common(grams(said, 2), grams(wanted, 2)), n - 1, m - 1), "rouge_l": f_score(lcs_length(said, wanted), n, m)}


def bleu4(said: Column, wanted: Column) -> Column:
    """Geometric mean of 1- to 4-gram precisions with the brevity penalty; a zero count is 1 over a power of two."""
    n = F.size(said)
    hits = F.array(*[common(grams(said, k), grams(wanted, k)) for k in range(1, 5)])

    def mean(h: Column) -> Column:
        logs, zeros = F.lit(0.0), F.lit(0)
        for k in range(4):
            none = F.get(h, F.lit(k)) == 0
            zeros = zeros + none.cast("int")
            hit = F.when(none, F.pow(F.lit(2.0), -zeros)).otherwise(F.get(h, F.lit(k)))
            logs = logs + F.log(hit / F.greatest(n - k, F.lit(1))) / 4
        return F.when((n == 0) | (F.get(h, F.lit(0)) == 0), 0.0).otherwise(F.exp(F.least(F.lit(0.0), 1 - F.size(wanted) / F.nullif(n, F.lit(0))) + logs))

    return F.get(F.transform(F.array(hits), mean), F.lit(0))  # hits are counted once
