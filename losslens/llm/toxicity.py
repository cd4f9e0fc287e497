"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel counts common subsequences of four characters of two strings, gaps
allowed, each occurrence weighted by DECAY to the power of its span.  It is the
inner product of explicit weights for these subsequences, so the machine, linear
in the kernel values with the landmarks, folds into one table with a weight for
each, and a string is scored by looking its subsequences up.  Strings are the
words of a sentence (and letters written apart, put together); a text scores as
its worst string.

The machine is trained on labelled texts, each an example: the largest margin
among the strings of its sentences is asked to be positive for a toxic text and
negative for a clean one.  Landmarks are strings of these texts, half of them
spread over the toxic side, half the commonest of the clean side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import bytes_of, drop_saved, remainder, save, slices, without_dots

#: Kernel: weight per character of span, longest span, characters of a string looked at in one window (with its two ends).
DECAY, SPAN, WINDOW = 0.7, 7, 24
#: Bounds of the training sample: labelled texts of each class, and their length.
MOST_TEXTS, MOST_CHARS = {1: 1500, 0: 3000}, 20_000
#: Landmarks; strings they are chosen from; clean strings of the first round (later rounds add all that lie inside the margin).
LANDMARKS, POOL, FIRST_NEGATIVES = 240, 3000, 8000
#: A landmark stands in so many toxic texts, more than expected by so many deviations; strings are alike from this cosine on.
LEAST_TEXTS, LEAST_GAIN, ALIKE = 2, 1.5, 0.65
#: Weight of a mistake; a string's grows with the root of the texts it stands for.
COST = 20.0
#: Codes of characters: letters, digits (one code), signs (one), the ends of a string, and 32 for what follows a lead byte.
EDGE, LEADS = 30, bytes(range(192, 256))
CODES = np.zeros(256, np.int32)
CODES[:128] = 28
CODES[128:] = 32 + np.arange(128) % 32
CODES[ord("0") : ord("9") + 1] = 27
CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
#: Cells of the table; four codes are hashed into one by these odd numbers.
CELLS, MIX = 1 << 20, (np.int32(0x3F31), np.int32(0xA9B5), np.int32(0x1C6E7), np.int32(0x6B43))
PUNCTUATION = bytes(b for b in range(33, 128) if not chr(b).isalnum())
APART = re.compile(rb"(?:(?<=\s)|^)[^\s](?:[ \t][^\s]){2,}(?=\s|$)")
INNER = re.compile(rb"[^a-z\x80-\xff]")


def strings_of(text: bytes) -> set[bytes]:
    """Lower-cased words without outer punctuation, and single characters written apart put together."""
    text = text.lower()
    found = set(text.split())
    found.update(re.sub(rb"[ \t]", b"", x) for x in APART.findall(text))
    return found


def windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code matrix (one window a row) and the string each window belongs to; also a letters-only form of strings with other characters."""
    forms, owner = [], []
    for n, s in enumerate(strings):
        s = s.strip(PUNCTUATION).translate(None, LEADS)
        for form in (s,) if s.isalpha() else (s, INNER.sub(b"", s)):
            if len(form) <= WINDOW - 2:
                forms.append(form)
                owner.append(n)
            else:
                step = (WINDOW - 2) // 2
                cuts = range(0, len(form) - step, step)
                forms.extend(form[at : at + WINDOW - 2] for at in cuts)
                owner.extend([n] * len(cuts))
    length = np.fromiter(map(len, forms), np.int64, len(forms))
    codes = np.zeros((len(forms), WINDOW), np.int32)
    place = np.arange(WINDOW)[None, :]
    codes[(place >= 1) & (place <= length[:, None])] = CODES[np.frombuffer(b"".join(forms), np.uint8)]
    codes[:, 0] = EDGE
    codes[np.arange(len(forms)), length + 1] = EDGE
    return codes, np.array(owner, np.int64)


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.float32]]:
    """Cell numbers of the subsequences that begin at each place, for each way to choose their gaps, and their weight.

    A subsequence that runs over the end of its string has a zero among its codes.
    """
    for a, b, last in ((a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)):
        n = WINDOW - last
        cells = codes[:, :n] * MIX[0] + codes[:, a : a + n] * MIX[1] + codes[:, b : b + n] * MIX[2] + codes[:, last:] * MIX[3]
        yield np.where(codes[:, last:] > 0, cells & (CELLS - 1), 0), np.float32(DECAY ** (last + 1))


def look_up(codes: np.ndarray, table: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Weighted sum of the table's entries (numbers or rows) over a window's subsequences; ``at`` maps cells to entries; cell 0 counts nothing."""
    out = np.zeros((len(codes), *table.shape[1:]), np.float32)
    for cells, weight in subsequences(codes):
        out += weight * table[cells if at is None else at[cells]].sum(axis=1)
    return out


def explicit(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Explicit weights of a few windows (rows by used cells), and the map from cells to these columns (column 0: all others)."""
    used = np.unique(np.concatenate([c.ravel() for c, _ in subsequences(codes)]))
    used = used[used > 0]
    at = np.zeros(CELLS, np.int32)
    at[used] = np.arange(1, len(used) + 1)
    out = np.zeros((len(codes), len(used) + 1), np.float32)
    for cells, weight in subsequences(codes):
        np.add.at(out, (np.broadcast_to(np.arange(len(codes))[:, None], cells.shape), at[cells]), weight)
    out[:, 0] = 0
    return out, at


@dataclass
class Machine:
    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, strings: list[bytes]) -> np.ndarray:
        out = np.full(len(strings), -np.inf, np.float32)
        for at in range(0, len(strings), 20_000):
            codes, owner = windows(strings[at : at + 20_000])
            np.maximum.at(out, owner + at, look_up(codes, self.table) + np.float32(self.bias))
        return out

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """The largest margin among each text's strings; -inf for a text without one."""
        bags = [strings_of(t) for t in texts]
        every = list(set().union(*bags))
        margin = dict(zip(every, self.margins(every).tolist()))
        return np.array([max(map(margin.__getitem__, bag), default=-np.inf) for bag in bags])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(margin, -20) + self.shift, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (last one the bias) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(50):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xs, cs = x[on], cost[on, None]
        grad = ridge * w - 2 * xs.T @ (cost[on] * y[on] * slack[on])
        step = np.linalg.solve(np.diag(ridge) + 2 * xs.T @ (cs * xs), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def altered(word: bytes) -> list[bytes]:
    """The word with characters inserted, doubled, or written with signs between."""
    half = len(word) // 2
    return [b".".join(bytes([c]) for c in word), word[:half] + b"*" + word[half:], word[:half] + word[half : half + 1] + word[half:], word[:half] + b"x" + word[half:]]


class Space:
    """Nyström features of strings: kernel values with the landmarks, whitened by the landmarks' own kernel matrix."""

    def __init__(self, landmarks: list[bytes]):
        weights, self.at = explicit(windows([m[: WINDOW - 2] for m in landmarks])[0])
        values, vectors = np.linalg.eigh((weights @ weights.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
        self.folded = np.ascontiguousarray((weights.T @ root).astype(np.float32))

    def features(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One row for each window, and the string it belongs to."""
        codes, owner = windows(strings)
        rows = [look_up(codes[i : i + 1000], self.folded, self.at) for i in range(0, len(codes), 1000)]
        return np.concatenate([np.zeros((0, self.folded.shape[1]), np.float32), *rows]), owner

    def machine(self, w: np.ndarray) -> Machine:
        """Weights of the features (and a bias) folded into one table over the subsequences."""
        made = Machine((self.folded @ w[:-1]).astype(np.float32)[self.at], float(w[-1]))
        made.table[0] = 0
        return made


def spread(bags: list[np.ndarray], strings: list[bytes], positive: np.ndarray, negative: np.ndarray, total: int) -> list[int]:
    """Landmarks for the toxic side: strings that stand in more toxic texts than clean ones make likely.

    ``positive`` and ``negative`` are the texts each string stands in, by class;
    ``bags`` are the toxic texts and ``total`` the number of clean ones.  Each
    choice lessens the weight of the toxic texts that hold a string like it, so
    that the landmarks spread over the ways to be toxic and over groups of copies.
    """
    share = (negative + 0.5) / (total + 1)
    first = (positive - share * len(bags)) / np.sqrt(share * len(bags) + 1)
    pool = np.flatnonzero(positive >= LEAST_TEXTS)
    pool = pool[np.lexsort((pool, -first[pool]))][:POOL]
    if not len(pool):
        return []
    place = np.full(len(strings), -1)
    place[pool] = np.arange(len(pool))
    stands = np.zeros((len(pool), len(bags)), np.float32)
    for text, bag in enumerate(bags):
        found = place[bag]
        stands[found[found >= 0], text] = 1
    cut = [strings[i][: WINDOW - 2] for i in pool]
    codes, owner = windows(cut)
    own = np.array([float((explicit(codes[k : k + 1])[0] ** 2).sum()) for k in range(len(codes))])
    weight, chosen = np.ones(len(bags)), []
    while len(chosen) < LANDMARKS // 2:
        expected = share[pool] * weight.sum()
        gain = (stands @ weight - expected) / np.sqrt(expected + 1)
        gain[chosen] = -1
        best = int(gain.argmax())
        if gain[best] < LEAST_GAIN:
            break
        chosen.append(best)
        mine = owner == best
        weights, at = explicit(codes[mine][:1])
        like = look_up(codes, np.ascontiguousarray(weights.T), at)[:, 0] / np.sqrt(own * own[mine][0] + 1e-9)
        near = np.zeros(len(pool), bool)
        near[owner[like > ALIKE]] = True
        near[best] = True
        weight = np.where(stands[near].any(axis=0), weight * 0.3, weight)
    return [int(pool[i]) for i in chosen]


def fit(texts: list[bytes], toxic: list[bool], rounds: int = 6) -> Machine | None:
    """A machine trained on labelled texts, each a bag of the strings in its sentences.

    A toxic text asks that its worst string lies beyond the margin, a clean one
    that all of its strings lie on the other side.  Rounds of the machine and of
    the choice of each toxic text's worst string take turns until no choice
    changes and no clean string is left inside the margin.  The first round
    looks at the landmarks instead.  None without texts of both classes.
    """
    numbers: dict[bytes, int] = {}
    bags = [np.array(sorted(numbers.setdefault(s, len(numbers)) for s in strings_of(t) if s.strip(PUNCTUATION)), np.int64) for t in texts]
    strings = list(numbers)
    worse = [b for b, kind in zip(bags, toxic) if kind and len(b)]
    clean = [b for b, kind in zip(bags, toxic) if not kind and len(b)]
    if not worse or not clean:
        return None
    positive, negative = (np.bincount(np.concatenate(x), minlength=len(strings)) for x in (worse, clean))
    marks = spread(worse, strings, positive, negative, len(clean))
    if not marks:
        return None
    common = np.flatnonzero(negative)
    common = common[np.lexsort((common, -negative[common]))]
    space = Space([strings[i] for i in marks] + [strings[i] for i in common[: LANDMARKS // 2]])
    mixed = sorted(common.tolist(), key=lambda i: zlib.crc32(strings[i]))
    against = np.array(list(dict.fromkeys(common[:FIRST_NEGATIVES // 4].tolist() + mixed[:FIRST_NEGATIVES])))
    against = against[positive[against] * len(clean) <= 4 * negative[against] * len(worse)]
    nx, at = space.features([strings[i] for i in against])
    owner = against[at]
    asked, times = np.array(marks), positive[marks]
    machine = None
    for _ in range(rounds):
        px, at = space.features([strings[i] for i in asked])
        often = times[at] / np.bincount(at)[at]
        more, _ = space.features([x for i in asked[times >= LEAST_TEXTS] for x in altered(strings[i])])
        x = np.concatenate([px, more, nx])
        y = np.r_[np.ones(len(px) + len(more)), -np.ones(len(nx))]
        cost = np.r_[COST * np.sqrt(often), np.full(len(more), COST / 10), COST * np.sqrt(negative[owner])]
        machine = space.machine(squared_hinge(x, y, cost))
        margin = machine.margins(strings)
        before = set(asked.tolist())
        asked, times = np.unique([b[margin[b].argmax()] for b in worse], return_counts=True)
        fresh = np.setdiff1d(np.flatnonzero((margin > -0.8) & (negative > 0)), against)
        if before == set(asked.tolist()) and not len(fresh):
            break
        if len(fresh):
            against = np.concatenate([against, fresh])
            rows, at = space.features([strings[i] for i in fresh])
            nx, owner = np.concatenate([nx, rows]), np.concatenate([owner, fresh[at]])
    worst = np.array([margin[b].max() if len(b) else -np.inf for b in bags])
    return calibrate(machine, worst, np.array(toxic, bool))


def calibrate(machine: Machine, margin: np.ndarray, toxic: np.ndarray) -> Machine:
    """A logistic curve through the texts' margins, by damped Newton steps on smoothed labels."""
    x = np.c_[np.clip(margin, -3, 3), np.ones(len(margin))]
    up, down = toxic.sum(), (~toxic).sum()
    y = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
    weight = np.where(toxic, len(toxic) / (2 * up), len(toxic) / (2 * down))
    w = np.array([2.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - y)) + 1e-3 * w)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    machine.slope, machine.shift = float(w[0]), float(w[1])
    return machine


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, most_texts: dict[int, int] = MOST_TEXTS, most_chars: int = MOST_CHARS) -> Machine | None:
    """Fit on labelled rows outside the held-out fold; None where they aren't of both classes.

    Of each class at most ``most_texts`` ids take part, those of least xxhash64
    whose texts have at most ``most_chars`` code points; one text (the least)
    for a repeated id, and equal texts of a class once.  Nothing but the text
    and its label is used.  Only ids meet the labels; the texts of the sample
    are then picked by a broadcast of its ids, which that bound limits, and come
    to the driver: most_texts times most_chars at most.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    marked = marked.where(remainder(F.col("doc_id"), folds) != held)
    short = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= most_chars)
    there = marked.join(short.select("doc_id"), "doc_id", "left_semi")
    some = [there.where(F.col("__toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in most_texts.items()]
    chosen = save(some[0].unionByName(some[1]), "toxic-ids")
    picked = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__toxic").agg(F.min("text").alias("text"))
    sample = picked.select("__toxic", F.col("text").cast("binary").alias("text")).distinct().toArrow()
    drop_saved(chosen)
    rows = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist()))
    return fit([t for _, t in rows], [k == 1 for k, _ in rows])


def toxicity_scores(docs: DataFrame, machine: Machine | None, threshold: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts get the score of a text without strings; without a
    machine (no labelled rows of both classes) all scores are 0.  Rows are kept
    one for one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                p = score_texts(machine, bytes_of(part, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def score_texts(machine: Machine | None, texts: list[bytes]) -> np.ndarray:
    return np.zeros(len(texts)) if machine is None else machine.probability(machine.worst(texts))


def drop_toxic(docs: DataFrame, machine: Machine | None, threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores below ``threshold``, all their columns as they were; null and empty texts score as texts without strings and stay, repeated rows stay or go together."""
    names, docs = docs.columns, without_dots(docs)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(score_texts(machine, bytes_of(part, at)) < threshold))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
