"""Line dedup with two Bloom filters.

A first pass hashes the keys of each document's distinct lines (128 bits each,
with how often a task met it) into a saved table, bucketed by the run of lines
it came from.  A filter is owned in parts, by the first bits of the hashes.
What travels to a part is not the hashes but the filter positions that a run of
lines sets in it, sorted and packed, about two bytes a line; a position that a
second run sets goes from the once-seen filter to the twice-seen one, so a
repeated line is never missed.  Each run gets back one bit for each position
that it sent, and only lines all of whose bits are in the twice-seen filter, the
suspected repeats, are shuffled on as hashes, for their number of documents.
The saved hashes meet the answers where they lie, bucket by bucket.  Lines whose
hash then may be in enough documents are counted by their own text, which is
exact, and the first occurrence is chosen among them.  Lines seen once never
travel, neither as text nor as a hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import bucketed, bytes_of, drop_saved, hot_join, save, slices, without_dots

WHITE_BYTES = b" \t\n\x0b\x0c\r"
#: Lines of a part of the filters on average, and bits of each filter for a line.
PART_LINES, BITS_A_LINE = 1 << 18, 16
#: Most parts; beyond, their filters grow.
MOST_PARTS = 10_000
#: Positions set for each hash in the twice-seen filters, and in the filter of candidates.
TRAVELLING, PROBES = 2, 3
#: Distinct lines a task counts before it passes them on, and hashes handled at a time.
HELD_LINES, STEP = 200_000, 1 << 16
#: The filter of candidates, at most 2**MOST_BITS bits, goes to every task; with too many candidates it lets more lines through to be counted, and loses none.
LEAST_BITS, MOST_BITS = 16, 28
#: Tasks that fill parts of it, and the bytes of a filter that travel in a row.
FILTER_TASKS, BLOCK = 16, 1 << 20
#: Repeated lines are broadcast up to this many and so many bytes; beyond, they are joined.
BROADCAST_LINES, BROADCAST_BYTES = 1_000_000, 64 << 20


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(WHITE_BYTES).lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(n, PROBES) bit positions of 16-byte hashes given as an (n, 2) array of unsigned 64-bit halves."""
    step = np.arange(PROBES, dtype=np.uint64)
    return (hashes[:, :1] + step * (hashes[:, 1:] | np.uint64(1))) & np.uint64((1 << bits) - 1)


def halves(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<u8").reshape(-1, 2)


class FilterPair:
    """Once-seen and twice-seen filters of 2**bits bits each."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(1 << (bits - 3), np.uint8)
        self.twice = np.zeros(1 << (bits - 3), np.uint8)

    def add(self, positions: np.ndarray) -> None:
        """Set the different positions of a run of lines; those that an earlier run has set go to the second filter."""
        at, mask = (positions >> np.uint64(3)).astype(np.int64), (1 << (positions & np.uint64(7))).astype(np.uint8)
        again = (self.once[at] & mask) > 0
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def add_hashes(self, hashes: np.ndarray) -> None:
        self.add(np.unique(probes(hashes, self.bits)))

    def known_twice(self, positions: np.ndarray) -> np.ndarray:
        return (self.twice[(positions >> np.uint64(3)).astype(np.int64)] >> (positions & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def suspected(twice: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    positions = probes(hashes, bits)
    hit = twice[(positions >> np.uint64(3)).astype(np.int64)] & (1 << (positions & np.uint64(7))).astype(np.uint8)
    return (hit > 0).all(axis=1)


def line_hashes(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """(run, hashes, times): packed hashes of the distinct line keys of at least ``least`` code points, HELD_LINES at a time, and in how many documents of the run each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        number = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal number
            times = np.fromiter(held.values(), "<u4", len(held)).tobytes()
            made = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([times], pa.binary())], ["run", "hashes", "times"])
            number += 1
            held.clear()
            return made

        for batch in batches:
            for part in slices(batch, 0):
                for text in bytes_of(part, 0):
                    held.update(map(key_hash, keys_of(text, least)))
                    if len(held) > HELD_LINES:
                        yield out()
        yield out()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "run long, hashes binary, times binary")


def keys_of(text: bytes, least: int) -> set[bytes]:
    """Distinct line keys, without the empty one and those of fewer code points."""
    keys = set(map(line_key, text.split(b"\n")))
    keys.discard(b"")
    return keys if least <= 1 else {k for k in keys if len(k.decode()) >= least}


def packed(positions: np.ndarray) -> bytes:
    """Sorted different positions as their steps, byte planes apart, compressed."""
    steps = np.diff(positions.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return len(steps).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.view("u1").reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True), "u1")
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel(), dtype=np.uint64)


def by_part(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its hashes), part by part."""
    part = ((hashes[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        yield int(part[some[0]]), some


def travelling(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(n, TRAVELLING) positions in a part's filters."""
    step = np.arange(TRAVELLING, dtype=np.uint64)
    return (hashes[:, 1:] + step * (hashes[:, :1] | np.uint64(1))) & np.uint64((1 << bits) - 1)


def suspects(hashed: DataFrame, lines: int) -> DataFrame:
    """(hash binary, times long): the hashes that the twice-seen filters take for repeats, and those that one run has in several documents.

    hashed has run, hashes and times, a row for each run; ``lines`` is about how
    many hashes it has.  A part's positions of all runs lie in one task's memory,
    packed: PART_LINES lines, or one in MOST_PARTS of all.
    """
    parts = min(MOST_PARTS, max(1, lines // PART_LINES))
    bits = bits_for(-(-lines // parts), 32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, data in zip(batch.column(0).to_pylist(), bytes_of(batch, 1)):
                hashes = halves([data])
                rows = [(p, packed(np.unique(travelling(hashes[some], bits)))) for p, some in by_part(hashes, parts)]
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(rows), pa.int64()), pa.array([p for p, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["run", "part", "positions"])

    def answer(part: int | None, runs: list[int], sent: list[bytes]) -> pa.RecordBatch:
        pair = FilterPair(bits) if runs else None
        for data in sent:
            pair.add(unpacked(data))
        masks = [np.packbits(pair.known_twice(unpacked(data))).tobytes() for data in sent]
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array([part] * len(runs), pa.int64()), pa.array(masks, pa.binary())], ["run", "part", "mask"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs, sent = None, [], []
        for batch in batches:
            for run, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch, 2)):
                if part != now:
                    yield answer(now, runs, sent)
                    now, runs, sent = part, [], []
                runs.append(run)
                sent.append(data)
        yield answer(now, runs, sent)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, times, masks = halves([row["hashes"]]), np.frombuffer(row["times"], "<u4"), {m["part"]: m["mask"] for m in row["masks"]}
                keep = times > 1
                for part, some in by_part(hashes, parts):
                    positions = travelling(hashes[some], bits)
                    different = np.unique(positions)
                    twice = np.unpackbits(np.frombuffer(masks[part], np.uint8), count=len(different)).astype(bool)
                    keep[some] |= twice[np.searchsorted(different, positions)].all(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() for h in hashes[keep]], pa.binary()), pa.array(times[keep].astype(np.int64))], ["hash", "times"])

    sent = hashed.select("run", "hashes").mapInArrow(send, "run long, part long, positions binary")
    answers = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(own, "run long, part long, mask binary")
    masks = answers.groupBy("run").agg(F.collect_list(F.struct("part", "mask")).alias("masks"))  # a bit for each position of the run
    return hashed.join(masks, "run").select("hashes", "times", "masks").mapInArrow(pick, "hash binary, times long")


def bits_for(n: int, most: int = 63) -> int:
    return min(most, max(LEAST_BITS, int(np.ceil(np.log2(max(1, n) * BITS_A_LINE)))))


def candidate_filter(candidates: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the candidates' hashes, and its bits: the union of FILTER_TASKS parts, each of that size."""
    bits = bits_for(n, MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = FilterPair(bits)
        for batch in batches:
            for part in slices(batch, 0):
                pair.add_hashes(halves(bytes_of(part, 0)))
        for at in range(0, len(pair.once), BLOCK):
            if pair.once[at : at + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([pair.once[at : at + BLOCK].tobytes()], pa.binary())], ["at", "bits"])

    known = np.zeros(1 << (bits - 3), np.uint8)
    for row in candidates.select("hash").coalesce(FILTER_TASKS).mapInArrow(run, "at long, bits binary").toLocalIterator():
        known[row.at : row.at + len(row.bits)] |= np.frombuffer(row.bits, np.uint8)
    return known, bits


def lines_passing(keys: list[bytes], known: np.ndarray, bits: int) -> np.ndarray:
    """Which of the line keys the filter lets through."""
    if not keys:
        return np.zeros(0, bool)
    return suspected(known, halves(list(map(key_hash, keys))), bits)


def repeated_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, least: int = 1) -> tuple[DataFrame, tuple[np.ndarray, int]]:
    """(key binary, docs long) of the line keys found in at least ``min_docs`` documents, in a saved table, and a filter that lets all of them through."""
    if min_docs < 2:
        raise ValueError("a line of one document isn't repeated")
    spark = docs.sparkSession
    with bucketed(line_hashes(docs, text_col, least), "line-hashes", "run") as hashed:
        n = hashed.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0)) / 16).first()[0]
        counted = suspects(hashed, int(n)).groupBy("hash").agg(F.sum("times").alias("docs")).where(F.col("docs") >= min_docs)
        candidates = save(counted, "line-candidates")
    known, bits = candidate_filter(candidates, candidates.count())
    drop_saved(candidates)
    shared = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0
        for batch in batches:
            for part in slices(batch, 0):
                for text in bytes_of(part, 0):
                    keys = list(keys_of(text, least))
                    found = [k for k, ok in zip(keys, lines_passing(keys, shared.value, bits).tolist()) if ok]
                    size += sum(len(k) for k in found if k not in held)
                    held.update(found)
                    if size > BROADCAST_BYTES // 4:
                        yield out(held)
                        size = 0
        yield out(held)

    def out(held: Counter) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["key", "docs"])
        held.clear()
        return made

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = save(texts.mapInArrow(count, "key binary, docs long").groupBy("key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs), "repeated-lines")
    shared.destroy()
    return found, (known, bits)


def drop_repeated_lines(
    docs: DataFrame, text_col: str = "text", min_docs: int = 10, least: int = 1, keep_first: bool = False, report: bool = False, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """Remove every line whose key is found in at least ``min_docs`` documents.

    Keys are stripped and lower-cased (A-Z) lines of at least ``least`` code
    points; empty lines stay.  A null text has one empty line.  Without
    ``report`` all columns of docs are returned, the text with its other lines
    joined by a newline (a null text stays null) and, where docs has ``n_chars``,
    that count renewed.  With ``report`` the result is doc_id, n_lines,
    n_dropped, kept_sha256.  ``keep_first`` lets one line of each repeated key
    stay: the first in the first document by doc_id (null last).  Repeated rows
    are documents of their own; columns may have any names.
    """
    spark, names = docs.sparkSession, docs.columns
    docs = without_dots(docs)
    text_col = docs.columns[names.index(text_col)]
    found, passing = repeated_lines(docs, text_col, min_docs, least)
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    if keep_first or n > broadcast_lines or size > BROADCAST_BYTES:
        joined = _drop_by_join(docs, found, passing, text_col, least, keep_first, report)
        return joined if report else joined.toDF(*names)
    known = spark.sparkContext.broadcast(frozenset(found.select("key").toArrow().column(0).to_pylist()))  # at most broadcast_lines, BROADCAST_BYTES
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = known.value
        for batch in batches:
            for part in slices(batch, text_at if not report else 1):
                texts = bytes_of(part, 1 if report else text_at)
                kept = [without(t, [i for i, x in enumerate(t.split(b"\n")) if line_key(x) in bad]) for t in texts]
                yield reported(part.column(0), texts, kept) if report else renewed(part, text_at, kept)

    if report:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {REPORT}")
    return docs.mapInArrow(run, docs.schema).toDF(*names)


REPORT = "n_lines long, n_dropped long, kept_sha256 string"


def without(text: bytes, places: list[int]) -> tuple[bytes, int]:
    """The text without the lines at these places, and how many these are."""
    gone = set(places)
    return (b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in gone]) if gone else text), len(gone)


def reported(ids: pa.Array, texts: list[bytes], kept: list[tuple[bytes, int]]) -> pa.RecordBatch:
    n = [t.count(b"\n") + 1 for t in texts]
    sha = [hashlib.sha256(k).hexdigest() for k, _ in kept]
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array([g for _, g in kept], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def renewed(part: pa.RecordBatch, text_at: int, kept: list[tuple[bytes, int]]) -> pa.RecordBatch:
    """The rows with their new texts, and a new n_chars where lines went."""
    old = part.column(text_at)
    texts = pa.array([k if there else None for (k, _), there in zip(kept, old.is_valid().to_pylist())], pa.binary()).cast(pa.string())
    arrays, names = list(part.columns), part.schema.names
    arrays[text_at] = texts
    if "n_chars" in names:
        at = names.index("n_chars")
        arrays[at] = pa.compute.if_else(pa.array([not g for _, g in kept]), arrays[at], pa.compute.utf8_length(texts).cast(arrays[at].type))
    return pa.RecordBatch.from_arrays(arrays, names)


def _drop_by_join(docs: DataFrame, found: DataFrame, passing: tuple[np.ndarray, int], text_col: str, least: int, keep_first: bool, report: bool) -> DataFrame:
    """The same by joins, for any number of repeated lines: only lines that pass the filter meet them."""
    shared = docs.sparkSession.sparkContext.broadcast(passing[0])
    rows = save(docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("d"), F.monotonically_increasing_id().alias("row")), "lines")
    columns, text_at = docs.columns, docs.columns.index(text_col)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                own, places, keys = [], [], []
                for row, text in zip(part.column(0).to_pylist(), bytes_of(part, 1)):
                    for at, line in enumerate(text.split(b"\n")):
                        key = line_key(line)
                        if key and (least <= 1 or len(key.decode()) >= least):
                            own.append(row)
                            places.append(at)
                            keys.append(key)
                keep = pa.array(lines_passing(keys, shared.value, passing[1]))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(places, pa.int32()), pa.array(keys, pa.binary())], ["row", "at", "key"]).filter(keep)

    seen = save(rows.select("row", F.col(f"d.c{text_at}").cast("string").alias("text")).mapInArrow(lines, "row long, at int, key binary"), "line-places")
    bad = hot_join(seen, found, "key", "docs", seen.count())
    if keep_first:
        ids = rows.select("row", F.col(f"d.c{columns.index('doc_id')}").alias("id"))
        first = bad.join(ids, "row").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row", "at")).alias("f")).select(F.col("f.row").alias("row"), F.col("f.at").alias("at"))
        bad = bad.join(first, ["row", "at"], "left_anti")
    by_row = bad.groupBy("row").agg(F.collect_list("at").alias("places"))  # bounded by the row's own lines
    joined = rows.join(by_row, "row", "left").select(*[F.col(f"d.c{i}") for i in range(len(columns))], "places")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                texts = bytes_of(part, text_at)
                kept = [without(t, p or []) for t, p in zip(texts, part.column(len(columns)).to_pylist())]
                plain = pa.RecordBatch.from_arrays(part.columns[: len(columns)], columns)
                yield reported(plain.column(columns.index("doc_id")), texts, kept) if report else renewed(plain, text_at, kept)

    if report:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return joined.mapInArrow(drop, f"doc_id {kind}, {REPORT}")
    return joined.mapInArrow(drop, docs.schema)
