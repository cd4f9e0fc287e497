"""Byte-level BPE by merge replay over the distinct pre-tokens of the whole corpus.

A first pass cuts texts into pre-tokens and packs them, block by block, as
codes: a token's id where a pre-token is a token, else the place of the
pre-token among the block's distinct others.  Those are dealt into buckets by
hash, so that equal words of all blocks meet in one place and are replayed
once: they are laid out in one linked list of symbols, and an inverted index
maps each mergeable pair (by the rank of what it makes) to the positions where
it stands.  Ranks are applied in order; a merge touches only its two
neighbours, whose new pairs enter the index.  The ids go back to the blocks,
in the order in which the words came, and the texts' ids are read off.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import texts_of

#: Text and rows of a block.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16
#: Buckets of words for each shuffle partition; a bucket's distinct words lie in memory together.
BUCKETS = 16
#: Most words remembered in a bucket; beyond that the memory starts anew.
KEPT_WORDS = 1_000_000
NO_IDS = np.zeros(0, "<u4")


class MergeTable:
    """Ranks of a ``.tiktoken`` file and every split of a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = {i: t for t, i in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.base = max(ranks.values()) + 1
        self.byte_table = np.array(self.byte_ids)
        self.pair_keys = np.array(sorted(self.pairs))
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()])

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: all merges of one rank at a time, over all words of the block.

        An empty word gives no ids; a word that is itself a token gives that one.
        A word in which a merge makes way for one of lower rank is done by
        ``replay_each``, which then takes that one first.
        """
        out: list[np.ndarray] = [NO_IDS] * len(words)
        todo = []
        for n, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[n] = np.array([whole], "<u4")
            elif word:
                todo.append(n)
        if not todo:
            return out
        length = np.fromiter((len(words[n]) for n in todo), np.int64, len(todo))
        end = np.cumsum(length)
        start, total = end - length, int(end[-1])
        sym = self.byte_table[np.frombuffer(b"".join(words[n] for n in todo), np.uint8)]
        owner = np.repeat(np.arange(len(todo)), length)
        nxt, prv = np.arange(1, total + 1), np.arange(-1, total - 1)
        nxt[end - 1] = prv[start] = -1
        pair = np.full(total, -1)  # rank of the pair that begins at a place
        where: dict[int, list[np.ndarray]] = {}  # the inverted index: rank -> places
        queue: list[int] = []

        def enter(places: np.ndarray) -> np.ndarray:
            """Look up the pairs that begin at places and put them into the index; returns their ranks."""
            ranks = self.find(sym[places], sym[nxt[places]])
            pair[places] = ranks
            known = ranks >= 0
            places, found = places[known], ranks[known]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for rank, group in zip(found[np.concatenate(([0], cuts))].tolist() if len(found) else (), np.split(places, cuts)):
                if rank not in where:
                    where[rank] = []
                    heapq.heappush(queue, rank)
                where[rank].append(group)
            return ranks

        enter(np.flatnonzero(nxt >= 0))
        odd = np.zeros(len(todo), bool)
        begins = np.zeros(total, bool)
        while queue:
            rank = heapq.heappop(queue)
            groups = where.pop(rank)
            at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            right = nxt[at]
            begins[at] = True
            if begins[right].any():  # overlapping: the leftmost of each run, then every other
                keep, taken = [], -1
                for i, j in zip(*(x.tolist() for x in (np.sort(at), nxt[np.sort(at)]))):
                    if i != taken:
                        keep.append(i)
                        taken = j
                begins[at] = False
                at = np.array(keep)
                right = nxt[at]
            else:
                begins[at] = False
            after = nxt[right]
            more = after >= 0
            early = self.find(np.full(int(more.sum()), rank), sym[after[more]])
            odd[owner[at[more]][(early >= 0) & (early < rank)]] = True
            sym[at], sym[right], pair[at], pair[right] = rank, -1, -1, -1
            nxt[at] = after
            prv[after[more]] = at[more]
            before = prv[at]
            touched = np.concatenate((at[more], before[before >= 0]))
            if len(touched):
                touched = np.unique(touched)
                made = enter(touched)
                odd[owner[touched[(made >= 0) & (made < rank)]]] = True
        alive = sym >= 0
        counts = np.bincount(owner[alive], minlength=len(todo))
        ids = sym[alive].astype("<u4")
        for n, piece in zip(todo, np.split(ids, np.cumsum(counts)[:-1])):
            out[n] = piece
        again = [todo[k] for k in np.flatnonzero(odd)]
        for n, piece in zip(again, self.replay_each([words[n] for n in again])):
            out[n] = np.array(piece, "<u4")
        return out

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 for those that don't merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def replay_each(self, words: list[bytes]) -> list[list[int]]:
        """The same with one merge at a time: the pair of least rank first, leftmost among equals."""
        out: list[list[int]] = [[]] * len(words)
        get, byte_ids = self.pairs.get, self.byte_ids
        sym, nxt, prv, starts = [], [], [], []
        where: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[n] = [whole]
            elif word:
                at = len(sym)
                starts.append((n, at))
                sym.extend([byte_ids[b] for b in word])
                end = len(sym)
                nxt.extend(range(at + 1, end + 1))
                prv.extend(range(at - 1, end - 1))
                nxt[-1] = prv[at] = -1
                for i in range(at, end - 1):
                    rank = get(sym[i] << 32 | sym[i + 1])
                    if rank is not None:
                        where.setdefault(rank, []).append(i)
        queue = list(where)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            spots = where.pop(rank, None)
            if not spots:
                continue
            spots.sort()
            for seen, i in enumerate(spots):
                j = nxt[i]
                if sym[i] < 0 or j < 0 or get(sym[i] << 32 | sym[j]) != rank:
                    continue
                sym[i], sym[j] = rank, -1
                after = nxt[i] = nxt[j]
                before, lower = prv[i], False
                if after >= 0:
                    prv[after] = i
                    made = get(rank << 32 | sym[after])
                    if made is not None:
                        if made not in where:
                            where[made] = []
                            heapq.heappush(queue, made)
                        where[made].append(i)
                        lower = made < rank
                if before >= 0:
                    made = get(sym[before] << 32 | rank)
                    if made is not None:
                        if made not in where:
                            where[made] = []
                            heapq.heappush(queue, made)
                        where[made].append(before)
                        lower |= made < rank
                if lower and seen + 1 < len(spots):  # a lower rank goes first; the rest waits
                    if rank not in where:
                        where[rank] = []
                        heapq.heappush(queue, rank)
                    where[rank].extend(spots[seen + 1 :])
                    break
        for n, i in starts:
            ids = []
            while i >= 0:
                ids.append(sym[i])
                i = nxt[i]
            out[n] = ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(2)
def merge_table(path: str) -> MergeTable:
    with open(path, "rb") as f:
        return MergeTable({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), "u1")
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def packed_words(words: list[bytes]) -> bytes:
    """Words as their lengths and all their bytes."""
    lengths, text = packed(np.fromiter(map(len, words), "<u4", len(words))), b"".join(words)
    return len(lengths).to_bytes(8, "little") + lengths + len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    text = pa.decompress(data[at + 8 :], int.from_bytes(data[at : at + 8], "little"), codec="zstd", asbytes=True)
    ends = np.cumsum(unpacked(data[8:at]), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class Codes(dict):
    """Code of each pre-token: its id if it is a token, else ``base`` and its place among the others seen so far."""

    def __init__(self, ranks: dict[bytes, int], base: int):
        super().__init__()
        self.ranks, self.base, self.others = ranks, base, []

    def __missing__(self, word: str) -> int:
        data = word.encode()
        code = self.ranks.get(data)
        if code is None:
            code = self.base + len(self.others)
            self.others.append(data)
        self[word] = code
        return code


class Block:
    """Texts of a block as codes; its other words lie in the order of their buckets."""

    def __init__(self, table: MergeTable, find, buckets: int):
        self.find, self.buckets, self.codes = find, buckets, Codes(table.ranks, table.base)
        self.ids, self.texts, self.held = [], [], 0

    def add(self, doc_id, text: str) -> None:
        words = self.find(text)
        self.ids.append(doc_id)
        self.texts.append(np.fromiter(map(self.codes.__getitem__, words), "<u4", len(words)))
        self.held += len(text)

    @property
    def full(self) -> bool:
        return self.held >= BLOCK_BYTES or len(self.ids) >= BLOCK_ROWS

    def row(self, part: int, serial: int) -> dict:
        """The block's row; it is named by where it was made and by its words, so no two blocks meet, whatever they hold."""
        others, base = self.codes.others, self.codes.base
        bucket = np.fromiter((zlib.crc32(w) % self.buckets for w in others), np.int64, len(others))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(others), "<u4")
        place[order] = np.arange(len(others))
        body = np.concatenate(self.texts) if self.texts else NO_IDS
        other = body >= base
        body[other] = base + place[body[other] - base]
        parts, name = [], hashlib.blake2b(f"{part}:{serial}".encode(), digest_size=16)
        for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            data = packed_words([others[i] for i in group.tolist()])
            name.update(data)
            parts.append({"bucket": int(bucket[group[0]]), "words": data})
        sizes = packed(np.fromiter(map(len, self.texts), "<u4", len(self.texts)))
        return {"block": name.digest(), "ids": self.ids, "sizes": sizes, "body": packed(body), "n_words": len(others), "parts": parts}


def text_ids(table: MergeTable, sizes: bytes, body: bytes, words: int, parts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Ids of each text of a block, given its words' ids in the order of the words."""
    found = [unpacked(x) for x in parts]
    lengths = np.concatenate([np.ones(table.base, np.int64), *(x[1 : 1 + int(x[0])] for x in found)]).astype(np.int64)
    if len(lengths) != table.base + words:
        raise ValueError("words of a block came back incomplete")
    flat = np.concatenate([np.arange(table.base, dtype="<u4"), *(x[1 + int(x[0]) :] for x in found)])
    begins = np.cumsum(lengths) - lengths
    codes, at = unpacked(body), 0
    for n in unpacked(sizes).tolist():
        own = codes[at : at + n]
        at += n
        sizes_of = lengths[own]
        ends = np.cumsum(sizes_of)
        yield flat[np.repeat(begins[own] - ends + sizes_of, sizes_of) + np.arange(ends[-1] if n else 0)]


def bpe_encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True
) -> DataFrame:
    """Encode each text and decode the ids again.

    A null text counts as empty: no ids, empty decoded bytes.  Rows are kept as
    they are, repeated rows and null ids too; other columns are dropped whatever
    their names.  A text longer than a block is the last of its block, which is
    then that much larger.

    A block is named by the task and place where it was cut, so no two blocks
    share a group, those without other words too; both readers of a block read
    one exchange, and if it were made twice with other texts the read would fail
    for want of words.  The number of buckets follows the shuffle partitions, so a
    bucket's words stay as many when both the corpus and that setting grow.

    digests=False returns (id, ids array<int>, decoded binary); digests=True
    returns (doc_id, n_tokens, ids_sha256, decoded_sha256).
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given as numbers, as few bytes here mean much work
    buckets = BUCKETS * partitions
    schema = f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        table, find, block = merge_table(ranks_path), regex.compile(pattern).findall, None
        shape, part, serial = None, TaskContext.get().partitionId(), 0

        def close(block: Block) -> pa.RecordBatch:
            nonlocal serial
            row = block.row(part, serial)
            serial += 1
            ids = pa.array([row.pop("ids")], pa.list_(shape))
            rest = pa.RecordBatch.from_pylist([row], pa.schema({"block": pa.binary(), "sizes": pa.binary(), "body": pa.binary(), "n_words": pa.int64(), "parts": pa.list_(pa.struct({"bucket": pa.int64(), "words": pa.binary()}))}))
            return pa.RecordBatch.from_arrays([rest.column(0), ids, *rest.columns[1:]], ["block", "ids", *rest.schema.names[1:]])

        for batch in batches:
            shape = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
                block = block or Block(table, find, buckets)
                block.add(doc_id, text)
                if block.full:
                    yield close(block)
                    block = None
        if block:
            yield close(block)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes whole rows of blocks, so that both readers of the exchange want the same columns and it is made once."""
        for batch in batches:
            names, parts = batch["block"], batch["parts"]
            rows = pa.compute.list_parent_indices(parts)
            flat = pa.compute.list_flatten(parts)
            yield pa.RecordBatch.from_arrays([names.take(rows), *flat.flatten()], ["block", "bucket", "words"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, last = merge_table(ranks_path), {}, None
        for batch in batches:
            rows, start = batch.to_pylist(), 0
            while start < len(rows):  # the rows of one bucket
                bucket = rows[start]["bucket"]
                end = next((i for i in range(start, len(rows)) if rows[i]["bucket"] != bucket), len(rows))
                if bucket != last or len(known) > KEPT_WORDS:
                    known, last = {}, bucket
                words = [unpacked_words(r["words"]) for r in rows[start:end]]
                fresh = list(set().union(*words).difference(known))
                known.update(zip(fresh, table.replay(fresh)))
                out = []
                for group in words:
                    ids = [known[w] for w in group]
                    out.append(packed(np.concatenate([[len(ids)], [len(x) for x in ids], *ids])))
                yield pa.RecordBatch.from_pydict({"block": [r["block"] for r in rows[start:end]], "bucket": [bucket] * len(out), "found": out}, pa.schema({"block": pa.binary(), "bucket": pa.int64(), "found": pa.binary()}))
                start = end

    def read_off(blocks: pa.Table, found: pa.Table) -> pa.Table:
        table, out = merge_table(ranks_path), {"ids": [], "decoded": []} if not digests else {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        by_bucket = dict(zip(found["bucket"].to_pylist(), found["found"].to_pylist()))
        parts = [by_bucket[b] for b in sorted(by_bucket)]
        for row in blocks.select(["sizes", "body", "n_words"]).to_pylist():
            for ids in text_ids(table, row["sizes"], row["body"], row["n_words"], parts):
                decoded = table.decode(ids.tolist())
                values = (ids.astype("i4"), decoded) if not digests else (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                for column, value in zip(out.values(), values):
                    column.append(value)
        kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        doc_ids = blocks["ids"].combine_chunks().flatten()
        return pa.table({"doc_id": doc_ids} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = texts.mapInArrow(cut, f"block binary, ids array<{kind}>, sizes binary, body binary, n_words long, parts array<struct<bucket: bigint, words: binary>>").repartition(partitions, "block")
    words = blocks.mapInArrow(parts_of, "block binary, bucket long, words binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    found = words.mapInArrow(replay, "block binary, bucket long, found binary")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(read_off, schema)
