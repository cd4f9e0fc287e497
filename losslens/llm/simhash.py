"""SimHash near-duplicates by pigeonhole blocks.

Equal fingerprints are one node.  Fingerprints are cut into ``blocks`` bit
blocks; two that differ in at most ``distance`` bits agree in at least
``blocks - distance`` of them, so they share one of the keys made of that many
blocks.  Rows meet on these keys, and inside a key Hamming distances are
verified.  A key's fingerprints are linked by a search that leaves one link per
fingerprint and no list of all pairs.  A key with many fingerprints is split:
every pair of its chunks meets in a group of bounded size.  Links then become
components by star contraction, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import bytes_of, drop_saved, hot_join, save, slices

#: Fingerprints of one key that are compared in one group.
CHUNK = 4096
#: Aim: about so many other fingerprints under a key by chance.
CHANCE = 0.25


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of word shingles: a bit is set if it is in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: -width + 1].tolist(), ends[width - 1 :].tolist())]
    total, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        bits = np.array(hashes[at : at + step], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 4) -> DataFrame:
    """The ``keep`` columns and ``fp`` (the fingerprint as a signed long); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                found = np.array([fingerprint(t, width) for t in bytes_of(part, last)], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(found)], [*keep, "fp"])

    picked = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, fp long")


def block_count(n: int, distance: int) -> int:
    """Fewest blocks for which a key is long enough that chance meetings stay about CHANCE for n fingerprints."""
    for blocks in range(distance + 1, 2 * distance + 3):
        if 64 * (blocks - distance) / blocks >= np.log2(max(2, n) / CHANCE):
            return blocks
    return 2 * distance + 2


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """Array of keys: each choice of blocks - distance blocks, its bits hashed with the choice's number."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    mask = lambda choice: sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in choice)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    choices = list(combinations(range(blocks), blocks - distance))
    # (number, masked bits) is the key itself, not a digest of it: no false meetings, no loss
    return F.array(*[F.struct(F.lit(i).cast("short").alias("i"), fp.bitwiseAND(F.lit(signed(mask(c))).cast("long")).alias("bits")) for i, c in enumerate(choices)])


def link_group(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join whatever is connected by distances up to ``distance``: one for each fingerprint but a component's first."""
    links, left = [], np.sort(fps)
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                links.extend((int(root), int(x)) for x in found)
    return links


def verify_groups(grouped: DataFrame, distance: int) -> DataFrame:
    """Links within runs of equal (i, bits, pair); rows must come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, links = None, []

        def cut(rows: np.ndarray) -> None:
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.concatenate((starts, [len(rows)])))
            two = starts[sizes == 2]
            a, b = rows[two, 3], rows[two + 1, 3]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            links.extend(zip(np.minimum(a, b)[near].tolist(), np.maximum(a, b)[near].tolist()))
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found = link_group(rows[at : at + n, 3].copy().view(np.uint64), distance)
                signed = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
                links.extend(zip(signed.min(axis=1).tolist(), signed.max(axis=1).tolist()))

        def out() -> pa.RecordBatch:
            a, b = zip(*set(links)) if links else ((), ())
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if rest is not None:
                rows = np.concatenate((rest, rows))
            if not len(rows):
                continue
            last = int(np.flatnonzero((rows[:, :3] == rows[-1, :3]).all(axis=1))[0])  # the last run may go on
            rest = rows[last:]
            if last:
                cut(rows[:last])
            if len(links) > 100_000:
                yield out()
        if rest is not None:
            cut(rest)
        yield out()

    return grouped.select("i", "bits", "pair", "fp").mapInArrow(run, "a long, b long").distinct()


def near_links(nodes: DataFrame, n: int, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``distance``."""
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"), block_count(n, distance), distance)).alias("k")).select("fp", "k.i", "k.bits")
    large = save(keyed.groupBy("i", "bits").count().where(F.col("count") > CHUNK), "large-keys")
    if large.isEmpty():
        grouped = keyed.withColumn("pair", F.lit(0))
    else:
        # a key of m fingerprints becomes g chunks; each chunk meets each other chunk in one group
        parts = F.ceil(F.coalesce(F.col("count"), F.lit(0)) / CHUNK).cast("int")
        chunk = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        meet = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(j, F.col("chunk")) * F.col("g") + F.greatest(j, F.col("chunk")))
        joined = keyed.join(large, ["i", "bits"], "left").withColumn("g", F.greatest(parts, F.lit(1))).withColumn("chunk", chunk)
        grouped = joined.select("fp", "i", "bits", F.explode(F.when(F.col("g") > 1, meet).otherwise(F.array(F.lit(0)))).alias("pair"))
    by = ["i", "bits", "pair"]
    return verify_groups(grouped.repartition(*by).sortWithinPartitions(*by), distance)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root the least node it is connected with.

    Alternating star contraction: each round hangs a node's larger neighbours on
    its least neighbour, then its smaller ones, until nothing changes.  The
    least neighbours are found by partial aggregates, and hubs meet theirs in a
    broadcast, so a hub's neighbours are spread over the tasks that read them.
    """
    links = save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n = links.count()
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, least, "u", "n", 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = save(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "u", "n", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = save(small, "links")
        drop_saved(large)
        before, n = n, after.count()
        same = before == n and after.exceptAll(links).isEmpty()
        drop_saved(links)
        links = after
        if same:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, fp, fingerprint, component_id, root for each row (and the ``keep`` columns).

    root, a fingerprint, is the same for all rows of a component.

    component_id is the least id among the rows connected by fingerprints that
    differ in at most ``distance`` bits; rows with equal fingerprints are always
    connected.  Null and empty texts have fingerprint zero and are linked like
    any other.  Null ids take part but never name a component, unless all its
    ids are null.
    """
    keep = keep or []
    found = save(fingerprints(docs.withColumn("doc_id", F.col(id_col)), ["doc_id", *keep], text_col, width), "fingerprints")
    return fingerprint_components(found, distance, keep)


def fingerprint_components(found: DataFrame, distance: int, keep: list[str] | None = None) -> DataFrame:
    """``simhash_components`` of saved rows with doc_id and fp (and the ``keep`` columns)."""
    keep = keep or []
    nodes = save(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    figures = nodes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    linked = components(near_links(nodes.select("fp"), figures[0], distance))
    rooted = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = hot_join(rooted, groups, "root", "members", figures[0]).select(F.col("fp").alias("__fp"), "root", "component_id", "rows")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # one text's copies share a fingerprint: those of many rows meet their component in a broadcast
    joined = hot_join(found, named.withColumnRenamed("__fp", "fp"), "fp", "rows", figures[1])
    return joined.select("doc_id", *keep, "fp", hexed.alias("fingerprint"), "component_id", "root")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, text_col: str = "text") -> DataFrame:
    """One row of each component stays: the one of least doc_id (null last; the earliest stored of equal ones).

    Texts are not shuffled to find it: rows get a number in a saved copy, and
    only numbers and fingerprints take part.  Columns may have any names.
    """
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    numbered = save(docs.select(own.alias("d"), F.monotonically_increasing_id().alias("__row")), "numbered")
    place = {c: F.col(f"d.c{i}") for i, c in enumerate(docs.columns)}
    plain = numbered.select("__row", place["doc_id"].alias("doc_id"), place[text_col].alias("text"))
    found = simhash_components(plain, distance, width, "doc_id", "text", ["__row"])
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row")).alias("first"))
    return numbered.join(first.select(F.col("first.__row").alias("__row")), "__row", "left_semi").select(*[v.alias(c) for c, v in place.items()])
