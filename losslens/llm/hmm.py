"""A hidden Markov language model trained by Baum-Welch over the whole corpus.

Words are counted exactly over all training texts.  The most frequent ones and
the end of a text are symbols of the chain; every other word is, for the chain,
one of CLASSES word classes (by its last two bytes), and inside its class has
the probability (c + 1) / (N + V + 1), with the class's own counts.  The chance
of a word given its class doesn't depend on the state, so the text's
probability is that of its symbols times these.  Each round of Baum-Welch sums
expected counts of transitions and emissions over the partitions; the scaled
forward recursion then gives the exact likelihood of each whole text.

What the driver and the executors hold is bounded: STATES x (HEAD + CLASSES)
numbers, and KNOWN_WORDS words with counts.  Counts of rarer words reach their
texts by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import bytes_of, remainder, save, slices

#: States, words with a symbol of their own, classes of other words, words whose counts go to every task.
STATES, HEAD, CLASSES, KNOWN_WORDS = 8, 16_384, 64, 200_000
#: Most rounds of Baum-Welch; they end when a round gains less than this of log10 likelihood a token.
ROUNDS, LEAST_GAIN = 6, 0.002
#: Training cuts symbol sequences into runs of this length; scoring into runs of LONG, joined exactly.
RUN, LONG = 128, 4096
#: Cells of the matrix in which runs of like length are worked out side by side.
CELLS = 1 << 20
#: Weight of the unigram in re-estimated emissions, and of the uniform in transitions.
PRIOR, FLOOR = 2.0, 1.0
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 400_000
END = 0


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over all texts (one binary-castable column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in bytes_of(part, 0):
                    held.update(text.lower().split())
                if len(held) > HELD_WORDS:
                    yield from out(held)
                    held.clear()
        yield from out(held)

    def out(held: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(held), list(held.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], ["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Exact corpus figures, the known words' counts and symbols, and the classes' counts."""

    tokens: int  # N, ends included
    types: int  # V, the end included
    ends: int
    known: dict[bytes, tuple[int, int]]  # word -> (count, symbol or -1)
    level: int  # known are the words of this level of count or above
    class_tokens: np.ndarray
    class_types: np.ndarray
    symbol_counts: np.ndarray  # of the end, the head words, the classes

    @property
    def symbols(self) -> int:
        return len(self.symbol_counts)


def level_of(c):
    """A count's level: 256 to each power of two, so that a few thousand numbers show how many words have which count."""
    return F.floor(F.log2(c) * 256).cast("int")


def lexicon(counts: DataFrame, ends: int) -> Lexicon:
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    levels = counts.groupBy(level_of(F.col("c")).alias("level")).count().collect()  # at most 64 * 256 rows
    level, room = 0, KNOWN_WORDS
    for r in sorted(levels, reverse=True):
        room -= r["count"]
        if room < 0:
            level = r.level + 1
            break
    found = counts.where(level_of(F.col("c")) >= level).toArrow().to_pydict()  # at most KNOWN_WORDS
    top = sorted(zip(found["c"], found["word"]), key=lambda x: (-x[0], x[1]))
    known = {w: (c, 1 + i if i < HEAD else -1) for i, (c, w) in enumerate(top)}
    head = min(HEAD, len(top))
    by_class = counts.groupBy((F.crc32(F.substring("word", -2, 2)) % CLASSES).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        n[r.k], v[r.k] = r.n, r.v
    for c, w in top[:head]:  # head words stand alone
        n[class_of(w)] -= c
        v[class_of(w)] -= 1
    return Lexicon(tokens + ends, types + (ends > 0), ends, known, level, n, v, np.concatenate(([ends], [c for c, _ in top[:head]], n)).astype(np.float64))


def encode(docs: DataFrame, lex: Lexicon, held: int, folds: int) -> DataFrame:
    """One row per text: its symbols, what known words give its scores, and its other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        classes = lex.symbols - CLASSES
        symbol_of = {w: s if s >= 0 else classes + class_of(w) for w, (_, s) in lex.known.items()}
        logs = {w: np.log10(c + 1) for w, (c, _) in lex.known.items()}
        within = -np.log10(lex.class_tokens + lex.class_types + 1)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for text in bytes_of(part, 2):
                    words = text.lower().split()
                    ids = list(map(symbol_of.get, words))
                    own = list(map(logs.get, words))
                    rest: Counter = Counter()
                    if None in ids:
                        for i, s in enumerate(ids):
                            if s is None:
                                ids[i], own[i] = classes + class_of(words[i]), 0.0
                                rest[words[i]] += 1
                    ids.append(END)
                    a = np.array(ids, np.uint16)
                    numerators = np.array(own)
                    inner = a[:-1] >= classes
                    in_class = float(numerators[inner].sum() + within[a[:-1][inner] - classes].sum())
                    rows.append((a.tobytes(), len(a), len(words) - rest.total() + (lex.ends > 0), float(numerators.sum() + np.log10(lex.ends + 1)), in_class, list(rest), list(rest.values())))
                numbers, row = np.arange(row, row + len(rows)), row + len(rows)
                symbols, n, known, numerator, in_class, words, times = zip(*rows)
                arrays = [pa.array(numbers), part.column(0), part.column(1), pa.array(symbols, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(numerator, pa.float64()), pa.array(in_class, pa.float64()), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "held_out", "symbols", "n_tokens", "n_known", "numerator", "in_class", "words", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, symbols binary, n_tokens long, n_known long, numerator double, in_class double, words array<binary>, times array<long>")


@dataclass
class Chain:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (symbols, K): chance of the symbol in the state


def unigram(counts: np.ndarray) -> np.ndarray:
    return (counts + 1) / (counts + 1).sum()


def first_chain(counts: np.ndarray, states: int = STATES) -> Chain:
    """Sticky states whose emissions are the unigram, unevenly shared out by fixed random numbers."""
    rng = np.random.default_rng(7)
    emit = unigram(counts)[:, None] * (0.05 + rng.gamma(0.7, size=(len(counts), states)))
    emit[END] = unigram(counts)[END]
    move = np.full((states, states), 0.15 / states) + 0.85 * np.eye(states)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def lockstep(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs as a (time, run) matrix, longest first, with how many are alive at each time; and their order."""
    order = np.argsort([-len(r) for r in runs], kind="stable")
    length = np.array([len(runs[i]) for i in order])
    table = np.zeros((length[0], len(runs)), np.uint16)
    for column, i in enumerate(order):
        table[: len(runs[i]), column] = runs[i]
    alive = len(runs) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
    return table, alive, order


def of_like_length(runs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The runs' numbers, longest first, in groups whose (time, run) matrix has at most CELLS cells (a single run may have more)."""
    order = np.argsort([-len(r) for r in runs], kind="stable")
    at = 0
    while at < len(order):
        n = max(1, CELLS // len(runs[order[at]]))
        yield order[at : at + n]
        at += n


def expected_counts(chain: Chain, runs: list[np.ndarray], first: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of runs, and their log likelihood; ``first`` marks those that begin a text, others begin with ``enter``."""
    table, alive, order = lockstep(runs)
    steps, k = len(table), len(chain.start)
    move, emit = chain.move.astype(np.float32), chain.emit.astype(np.float32)
    alpha, scale = [], []
    for t in range(steps):
        n = alive[t]
        e = emit[table[t, :n]]
        a = np.where(first[order][:, None], chain.start, enter).astype(np.float32) * e if t == 0 else (alpha[-1][:n] @ move) * e
        c = a.sum(axis=1, keepdims=True)
        alpha.append(a / c)
        scale.append(c)
    moved, gammas, ids = np.zeros((k, k)), [], []
    beta = np.ones((alive[-1], k), np.float32)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        if len(beta) < n:
            beta = np.concatenate([beta, np.ones((n - len(beta), k), np.float32)])
        gammas.append(alpha[t] * beta)
        ids.append(table[t, :n])
        if t:
            back = emit[table[t, :n]] * beta / scale[t]
            moved += alpha[t - 1][:n].T @ back
            beta = back @ move.T
    moved *= chain.move
    started = gammas[-1][first[order]].sum(axis=0)
    gamma, ids = np.concatenate(gammas), np.concatenate(ids)
    emitted = np.stack([np.bincount(ids, gamma[:, j], len(emit)) for j in range(k)], axis=1)
    return started, moved, emitted, float(sum(np.log(c, dtype=np.float64).sum() for c in scale))


def baum_welch(encoded: DataFrame, chain: Chain, counts: np.ndarray) -> tuple[Chain, float]:
    """One round over all training texts: counts per partition, summed by symbol, then new probabilities; and the log10 likelihood a token before it."""
    spark, k = encoded.sparkSession, len(chain.start)
    shared = spark.sparkContext.broadcast(chain)
    names = [f"s{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        enter = np.linalg.matrix_power(chain.move, 64)[0]  # the chain's long-run shares
        started, moved, emitted, likely = np.zeros(k), np.zeros((k, k)), np.zeros_like(chain.emit), 0.0

        def add(runs: list[np.ndarray], first: list[bool]) -> None:
            nonlocal started, moved, emitted, likely
            s, m, e, log = expected_counts(chain, runs, np.array(first), enter)
            started, moved, emitted, likely = started + s, moved + m, emitted + e, likely + log

        runs, first = [], []
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                ids = np.frombuffer(packed, np.uint16)
                for at in range(0, len(ids), RUN):
                    runs.append(ids[at : at + RUN])
                    first.append(at == 0)
                    if len(runs) == 2048:
                        add(runs, first)
                        runs, first = [], []
        if runs:
            add(runs, first)
        at = np.flatnonzero(emitted.sum(axis=1))
        # symbols, then -1 for starts, -2 - j for the transitions from state j, and the likelihood
        keys = np.concatenate([at, [-1], -2 - np.arange(k), [-2 - k]])
        values = np.concatenate([emitted[at], started[None], moved, np.full((1, k), likely)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(values[:, j]) for j in range(k))], ["key", *names])

    parts = encoded.where(~F.col("held_out")).select("symbols").mapInArrow(run, "key int, " + ", ".join(f"{n} double" for n in names))
    summed = parts.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # symbols + states + 2 rows
    key, values = summed["key"].to_numpy(), summed[names].to_numpy()
    emitted = np.zeros_like(chain.emit)
    emitted[key[key >= 0]] = values[key >= 0]
    started = values[key == -1].sum(axis=0)
    moved = np.stack([values[key == -2 - j].sum(axis=0) for j in range(k)])
    likely = values[key == -2 - k, 0].sum() / max(1.0, emitted.sum()) / np.log(10)
    shared.destroy()
    emit = emitted + PRIOR * len(counts) * unigram(counts)[:, None] * (emitted.sum(axis=0) / max(1.0, emitted.sum()))
    emit += 1e-9 * unigram(counts)[:, None]
    move, start = moved + FLOOR, started + FLOOR
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), likely


def log_likelihoods(chain: Chain, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence, exactly, by the scaled forward recursion.

    A sequence longer than LONG is cut; its later runs are worked out from each
    state as a start, and the pieces then joined, which is the same sum.
    """
    k = len(chain.start)
    runs, begins = [], []
    for ids in texts:
        for at in range(0, len(ids), LONG):
            runs += [ids[at : at + LONG]] * (1 if at == 0 else k)
            begins.append(chain.start[None] if at == 0 else chain.move)
    begin = np.concatenate(begins)
    state, total = np.zeros((len(runs), k)), np.zeros(len(runs))
    for group in of_like_length(runs):
        table, alive, order = lockstep([runs[i] for i in group])
        own = group[order]
        for t in range(len(table)):
            rows = own[: alive[t]]
            a = (begin[rows] if t == 0 else state[rows] @ chain.move) * chain.emit[table[t, : len(rows)]]
            c = a.sum(axis=1)
            state[rows] = a / c[:, None]
            total[rows] += np.log(c)
    out, at = np.zeros(len(texts)), 0
    for i, ids in enumerate(texts):
        now, log, at = state[at], total[at], at + 1
        for _ in range(LONG, len(ids), LONG):
            peak = total[at : at + k].max()
            mixed = (now * np.exp(total[at : at + k] - peak)) @ state[at : at + k]
            now, log, at = mixed / mixed.sum(), log + peak + np.log(mixed.sum()), at + k
        out[i] = log
    return out / np.log(10)


def train(docs: DataFrame, folds: int = 7, held: int = 2, rounds: int = ROUNDS) -> tuple[Lexicon, Chain, DataFrame, DataFrame]:
    """The lexicon, the chain, the saved word counts and all texts encoded (saved too)."""
    training = docs.where(remainder(F.col("doc_id"), folds) != held)
    counts = save(word_counts(training.select(F.col("text").cast("string").alias("text"))), "word-counts")
    lex = lexicon(counts, training.count())
    encoded = save(encode(docs, lex, held, folds), "encoded")
    chain = first_chain(lex.symbol_counts)
    before = -np.inf
    for _ in range(rounds):
        chain, likely = baum_welch(encoded, chain, lex.symbol_counts)
        if likely - before < LEAST_GAIN:
            break
        before = likely
    return lex, chain, counts, encoded


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    A null text counts as empty: one token, its end.  Rows are kept one for one,
    repeated rows and null ids too; other columns are dropped.  With nothing to
    learn from, every word has probability one in the base and the chain is as
    it began.
    """
    spark = docs.sparkSession
    lex, chain, counts, encoded = train(docs, folds, held, rounds)
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [np.frombuffer(x, np.uint16) for x in part.column(1).to_pylist()]
                score = log_likelihoods(shared.value, texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), *part.columns[2:]], ["row", "chain", *names])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "numerator", "in_class"]
    kinds = ", ".join(f"{n} {encoded.schema[n].dataType.simpleString()}" for n in names)
    scored = encoded.select("row", "symbols", *names).mapInArrow(run, f"row long, chain double, {kinds}")
    # words beyond the known ones: their counts come by a join, summed per text
    rare = encoded.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("times"))
    found = rare.join(counts.where(level_of(F.col("c")) < lex.level), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    extra = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"),
    )
    joined = scored.join(extra, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0.0)), "seen": F.coalesce("seen", F.lit(0))})
    whole = float(np.log10(lex.tokens + lex.types + 1))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("seen")).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("numerator") + F.col("more") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("chain") + F.col("in_class") + F.col("more")).alias("score"),
    )
