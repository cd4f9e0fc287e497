import hashlib
import random

import pytest

from losslens.operators import mixing, sft


def drawn(seed, at):
    return int(hashlib.md5(f"{seed}:{at}".encode()).hexdigest()[:13], 16)


def slow_interleave(sources, probabilities, seed, over):
    """One slot after another."""
    out, at, ended = [], [0] * len(sources), [False] * len(sources)
    slot = 0
    while not (all if over else any)(ended):
        if probabilities is None:
            source = slot % len(sources)
        else:
            source = next(i for i, b in enumerate([*mixing.bounds(probabilities)[:-1], 1 << 60]) if drawn(seed, slot) < b)
        out.append((source, slot, sources[source][at[source]]))
        at[source] = (at[source] + 1) % len(sources[source])
        ended[source] |= at[source] == 0
        slot += 1
    if probabilities is None:  # rounds are whole
        rounds = (max if over else min)(map(len, sources))
        out = [(i, r * len(sources) + i, s[r % len(s)]) for r in range(rounds) for i, s in enumerate(sources)]
    return sorted(out)


@pytest.mark.parametrize("sizes, probabilities, over", [
    ([40, 7, 90], [0.2, 0.1, 0.7], False), ([40, 7, 90], [0.2, 0.1, 0.7], True), ([3, 50], [0.9, 0.1], True), ([5, 5], [0.5, 0.5], False), ([20, 3, 1], None, True), ([20, 3, 4], None, False), ([1, 600], [0.3, 0.7], True),
])
def test_interleaving_equals_a_walk_through_the_slots(spark, monkeypatch, sizes, probabilities, over):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "USES", 8)
    rows = [[100 * i + k for k in range(n)] for i, n in enumerate(sizes)]
    frames = [spark.createDataFrame([(x,) for x in r], "id long") for r in rows]
    got = mixing.interleave(frames, "id", probabilities, 7, over).collect()
    assert sorted((r.source, r.slot, r.id) for r in got) == slow_interleave(rows, probabilities, 7, over)


def test_sources_without_rows_and_wrong_shares(spark):
    some, none = spark.range(4), spark.range(0)
    assert mixing.interleave([some, none], "id", [0.5, 0.5]).count() == 0
    assert mixing.interleave([none, none], "id", over=True).count() == 0
    left = mixing.interleave([none, some], "id", [0.5, 0.5], over=True).collect()
    assert sorted((r.source, r.slot, r.id) for r in left) == [(1, i, i) for i in range(4)]
    for shares in ([0.5, 0.4], [1.0, 0.0], [1.0]):
        with pytest.raises(ValueError):
            mixing.interleave([some, some], "id", shares)


def slow_buffer(rows, size, seed):
    held, out = rows[:size], []
    held = [(i, x) for i, x in enumerate(held)]
    for t in range(size, len(rows)):
        slot = drawn(seed, t) % size
        out.append(held[slot][1])
        held[slot] = (t, rows[t])
    return out + [x for t, x in sorted(held, key=lambda h: (drawn(seed, -h[0] - 1), h[0]))]


@pytest.mark.parametrize("n, size", [(300, 16), (10, 64), (50, 1), (0, 5), (64, 64)])
def test_shuffling_equals_a_buffer(spark, n, size):
    rows = [i * 3 for i in range(n)]
    df = spark.createDataFrame([(x,) for x in rows], "id long").repartition(3)
    got = {r.place: r.id for r in mixing.shuffled(df, "id", size, 5).collect()}
    assert [got[i] for i in range(n)] == slow_buffer(rows, size, 5) and len(got) == n
    if size == 1:
        assert [got[i] for i in range(n)] == rows
    if n > size > 1:
        other = {r.place: r.id for r in mixing.shuffled(df, "id", size, 6).collect()}
        assert other != got and sorted(other.values()) == rows


def test_runs_of_equal_bins_are_the_greedy_rule():
    draw = random.Random(4)
    for _ in range(300):
        capacity = draw.randrange(1, 60)
        lengths = [draw.randrange(0, capacity + 1) for _ in range(draw.randrange(0, 200))]
        counts = {n: lengths.count(n) for n in lengths}
        runs = sft.knapsack_runs(counts, capacity)
        bins = [[n for n, often in taken for _ in range(often)] for _, times, taken in runs for _ in range(times)]
        assert bins == sft.knapsack(lengths, capacity)
        assert len(runs) <= 2 * len(counts) + 1
    with pytest.raises(ValueError):
        sft.knapsack_runs({9: 1}, 8)


def test_a_length_with_most_rows_and_rows_without_one(spark):
    rows = [(i, 5) for i in range(500)] + [(1000, 11), (1001, None), (1002, 3), (1003, 0)]
    df = spark.createDataFrame(rows, "id long, n long").repartition(5)
    got = sft.pack_lengths(df, "id", "n", 10).collect()
    assert sorted(r.id for r in got) == [*range(500), 1002, 1003]
    bins = {}
    for r in sorted(got, key=lambda r: r.place):
        bins.setdefault(r.bin, []).append((r.length, r.id))
    assert bins[0] == [(5, 499), (5, 498), (0, 1003)] and [sum(n for n, _ in b) for b in bins.values()] == [10] * 250 + [3]
    assert sft.pack_lengths(df.limit(0), "id", "n", 10).count() == 0
