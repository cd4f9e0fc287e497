"""Sum-of-squares online packing of tokenized documents into windows.

Each task packs its own documents as they come; nothing is shuffled.  A
document longer than a window fills whole windows and leaves a rest.  A rest of
length s goes to the fill level h that makes the sum over levels of (number of
open windows at that level)^2 least: a level array holds these numbers.  At
most MOST_OPEN windows are open.  When that many are and none has room, the
rest is cut by the same rule: it fills a window of level h and what is left of
it enters level h + s - size, for the h that makes the sum least.  At the end of
a task the emptiest window is taken apart and its pieces placed again, with one
open window less allowed, until one is left: a task pads one window at most, and
places at most MOST_OPEN windows a second time.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import slices, texts_of


#: Windows that a task holds open.
MOST_OPEN = 128
NEVER = np.iinfo(np.int64).max


class LevelPacker:
    """Places pieces into windows of ``size``; ``count[h]`` is the number of open windows filled up to h.

    ``split(piece, n)`` gives the first n of a piece, and the rest.
    """

    def __init__(self, size: int, split: Callable, most_open: int = MOST_OPEN):
        self.size, self.split, self.most_open = size, split, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # windows by level; a window lists its pieces
        self.held = 0

    def level_for(self, length: int) -> int | None:
        """The level that holds a piece whole at the least sum of squares; 0 is a new window, None that there is no room."""
        count, after = self.count, self.size - length
        # change of the sum for level h: a window leaves h and enters h + length
        change = 2 * (count[length:] - count[: after + 1]) + 2
        change[0] = 2 * count[length] + 1 if self.held < self.most_open else NEVER  # a new window leaves no level
        if after:
            change[after] = 1 - 2 * count[after]  # a full window enters no level
        change[1:][count[1 : after + 1] == 0] = NEVER
        h = int(change.argmin())
        return None if change[h] == NEVER else h

    def level_to_fill(self, length: int) -> int:
        """The level whose window a part of the piece fills at the least sum of squares, the rest entering a level of its own."""
        count, first = self.count, self.size - length + 1
        change = 2 * (count[1:length] - count[first : self.size])
        change[count[first : self.size] == 0] = NEVER
        return first + int(change.argmin())

    def place(self, length: int, piece) -> list[list]:
        """Put a piece (length < size) into windows; returns those that it fills."""
        full = []
        while (h := self.level_for(length)) is None:
            h = self.level_to_fill(length)
            head, piece = self.split(piece, self.size - h)
            full.append([*self.take(h), head])
            length -= self.size - h
        window = [*(self.take(h) if h else ()), piece]
        if h + length == self.size:
            return [*full, window]
        self.count[h + length] += 1
        self.open[h + length].append(window)
        self.held += 1
        return full

    def take(self, h: int) -> list:
        self.count[h] -= 1
        self.held -= 1
        return self.open[h].pop()

    def finish(self, length_of: Callable) -> Iterator[list]:
        """The windows left, all full but the last."""
        while self.held > 1:
            self.most_open = self.held - 1
            for piece in self.take(int(np.flatnonzero(self.count)[0])):
                yield from self.place(length_of(piece), piece)
        yield from (w for level in self.open for w in level)


@lru_cache(2)
def encoder(ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


def pack_documents(
    docs: DataFrame, ranks_path: str, pattern: str, specials: dict[str, int], size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, most_open: int = MOST_OPEN
) -> DataFrame:
    """Pieces of documents with their place in sequences of at most ``size`` ids.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids with ``with_ids``).  Each document's ids are
    those of its text (null: empty) and then ``end_id``, so every row has at
    least one piece; repeated rows and null ids are packed like any other.
    Columns of docs other than the id and the text are dropped.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path, pattern, tuple(specials.items()))
        split = lambda p, n: ((p[0], p[1], p[2][:n], p[3]), (p[0], p[1] + n, p[2][n:], p[3]))
        packer, serial, rows, id_type = LevelPacker(size, split, most_open), TaskContext.get().partitionId() << 33, [], None

        def out(window: list[tuple]) -> None:
            """A piece: doc_id, start, ids, doc_tokens."""
            nonlocal serial
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, serial, offset) + (ids,) * with_ids)
                offset += len(ids)
            serial += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
            rows.clear()
            return batch

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part, 1)):
                    ids = np.append(np.asarray(coder.encode_to_numpy(text, allowed_special="all"), "<u4"), np.uint32(end_id)).astype("<u4")
                    whole = len(ids) // size * size
                    for at in range(0, whole, size):
                        out([(doc_id, at, ids[at : at + size], len(ids))])
                    if whole < len(ids):
                        for window in packer.place(len(ids) - whole, (doc_id, whole, ids[whole:].copy(), len(ids))):
                            out(window)
                if rows:
                    yield flush()
        for window in packer.finish(lambda p: len(p[2])):
            out(window)
        if rows:
            yield flush()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
