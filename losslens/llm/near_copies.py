"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one node.  First op7's method runs over all nodes: SimHash
fingerprints that differ in few bits meet by their blocks, and inside each of
its components the sets themselves are compared.  At a similarity of 0.8
fingerprints may be 13 bits apart, too far for blocks, so what op7 leaves apart
meets once more by MinHash bands: nodes that agree in all rows of a band share a
key, and what keys with unlike nodes connect is a cluster.  A pair at similarity
0.8 shares no key with a chance of (1 - 0.8^ROWS)^BANDS, 4e-9; more alike pairs
less.  Clusters too are compared by their sets, so no link rests on an estimate.
A component or cluster of many nodes is compared chunk by chunk, each with its
least node; where that leaves a cluster in parts, every pair of its chunks meets
too.  No caps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import bytes_of, hot_join, save, slices
from losslens.llm.simhash import components, fingerprint, fingerprint_components

WIDTH, LEAST_SIMILARITY = 5, 0.8
#: Bits by which fingerprints of op7's method may differ.
DISTANCE = 4
BANDS, ROWS = 64, 6
#: Nodes of one cluster that are compared in one group, and the most chunks whose pairs all meet.
CHUNK, MOST_CHUNKS = 64, BANDS
_rng = np.random.default_rng(42)
_MASKS, _ODD = _rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
_ODD |= np.uint32(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct XXH64 of the word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - width)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[: last + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist())), np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """One key a band, as signed longs: a hash of the band's number and its ROWS least values."""
    if not len(found):
        return []
    least, low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32), (found >> np.uint64(16)).astype(np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(least, ((low[at : at + 256] ^ _MASKS) * _ODD).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def signatures(numbered: DataFrame, text_col: str) -> DataFrame:
    """__row, doc_id, a digest of the shingle set, op7's fingerprint, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = bytes_of(part, 2)
                sets = [shingles(t) for t in texts]
                prints = pa.array(np.array([fingerprint(t, WIDTH) for t in texts], "<u8").view("<i8"))
                keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), prints, keys], ["__row", "doc_id", "digest", "fp", "keys"])

    kind = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.select("__row", "doc_id", F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"__row long, doc_id {kind}, digest binary, fp long, keys array<long>")


def link_sets(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join whatever is connected by similarities of LEAST_SIMILARITY: one for each node but a component's first."""
    links, sizes = [], np.array([len(s) for s in sets])
    left = np.arange(len(nodes))
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            one = sets[queue.pop()]
            # sizes too far apart can't reach the similarity; 10 * and 8 * keep the test in whole numbers
            fit = left[10 * np.minimum(sizes[left], len(one)) >= 8 * np.maximum(sizes[left], len(one))]
            if not len(fit):
                continue
            joined = np.concatenate([sets[i] for i in fit])
            hits = one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined
            both = np.add.reduceat(hits.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[fit])[:-1])))
            near = fit[10 * both >= 8 * (sizes[fit] + len(one) - both)]
            left = np.setdiff1d(left, near, assume_unique=True)
            queue.extend(near.tolist())
            links.extend((nodes[root], nodes[i]) for i in near.tolist())
    return links


def verified(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) inside each group of (root, part); groups has root, part and node, texts has node and __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def out() -> pa.RecordBatch:
            links = link_sets(nodes, sets)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for part in slices(batch, 3):
                for root, piece, node, text in zip(*(part.column(i).to_pylist() for i in range(3)), bytes_of(part, 3)):
                    if (root, piece) != key:
                        yield out()
                        key, nodes, sets = (root, piece), [], []
                    nodes.append(node)
                    sets.append(shingles(text))
        yield out()

    by = ["root", "part"]
    rows = groups.join(texts, "node").select(*by, "node", "__text")
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def meetings() -> Column:
    """The pairs of chunks (of g) that a row of ``chunk`` takes part in, each as a number."""
    return F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(j, F.col("chunk")) * F.col("g") + F.greatest(j, F.col("chunk")))


def chunked(clusters: DataFrame) -> DataFrame:
    """Rows (node, root) of clusters of several nodes, with ``chunk``, the node's among the ``g`` of its cluster; saved."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n")).withColumn("g", F.ceil(F.col("n") / CHUNK).cast("int")).where("n > 1")
    sized = hot_join(clusters, sizes, "root", "n", clusters.count())
    return save(sized.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")), "clusters")


def chunk_links(clusters: DataFrame, texts: DataFrame) -> DataFrame:
    """Links inside each chunk of ``chunked`` rows, the cluster's least node being in all of its chunks; saved."""
    parts = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array("chunk"))
    return save(verified(clusters.select("root", "node", F.explode(parts).alias("part")), texts), "copies")


def fingerprint_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) at a similarity of LEAST_SIMILARITY inside the components that op7's method finds; nodes has node and fp."""
    found = fingerprint_components(nodes.select(F.col("node").alias("doc_id"), "fp"), DISTANCE)
    clusters = chunked(save(found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")), "components"))
    return chunk_links(clusters, save(texts.join(clusters.select("node"), "node", "left_semi"), "candidates"))


def near_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes at a similarity of LEAST_SIMILARITY; nodes has node, fp and keys.

    op7's components come first; only keys under which these leave different
    parts make clusters.  Clusters of more than CHUNK nodes are first compared by
    chunks that share the cluster's least node, which joins most copies.  Where
    that leaves a cluster in parts, every pair of its chunks meets, up to
    MOST_CHUNKS of them, which are as many copies of a text as it has keys.  In
    larger clusters nodes meet by the keys that they really share, and only under
    keys that still connect different parts, so a text is never copied more
    often, however large the cluster that keys have strung together.  A key of
    more than CHUNK nodes in different parts is compared by pairs of chunks.  Both
    ways are exact.
    """
    first = fingerprint_links(nodes, texts)
    known = save(nodes.select("node", "keys").join(components(first).select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node")), "known")
    keyed = known.select("node", "part", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "a", "n")
    keyed = keyed.drop("part")
    linked = components(hot_join(keyed, shared, "key", "n", BANDS * nodes.count()).where("node <> a").select("a", F.col("node").alias("b")).distinct())
    clusters = chunked(save(linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()), "clusters"))
    wanted = save(texts.join(clusters.select("node"), "node", "left_semi"), "candidates")
    links = first.unionByName(chunk_links(clusters, wanted))
    large = clusters.where("g > 1")
    if large.isEmpty():
        return links
    named = save(large.join(components(links).select("node", F.col("root").alias("named")), "node", "left").withColumn("named", F.coalesce("named", "node")), "named")
    split = named.groupBy("root").agg(F.min("named").alias("x"), F.max("named").alias("y"), F.count("*").alias("n")).where("x <> y").select("root", "n")
    left = save(hot_join(named, split, "root", "n", named.count()), "apart")  # of clusters that the first links leave in parts
    near, far = left.where(F.col("g") <= MOST_CHUNKS), left.where(F.col("g") > MOST_CHUNKS)
    found = links.unionByName(save(verified(near.select("root", "node", F.explode(meetings()).alias("part")), wanted), "copies"))
    if far.isEmpty():
        return found
    again = save(keyed.join(far.select("node", "named"), "node"), "crowded")
    apart = again.groupBy("key").agg(F.min("named").alias("x"), F.max("named").alias("y"), F.count("*").alias("n")).where("x <> y").withColumn("g", F.ceil(F.col("n") / CHUNK).cast("int"))
    rest = hot_join(again, apart.select("key", "g", "n"), "key", "n", again.count()).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    return found.unionByName(save(verified(rest.select(F.col("key").alias("root"), "node", F.explode(meetings()).alias("part")), wanted), "copies"))


def drop_near_copies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of each component of near copies stays: the one of least doc_id (null last; the earliest stored of equal ones).

    Null texts and those without words are copies of each other; very long texts
    are cut into no pieces; repeated rows are copies; an empty table stays empty.
    Docs may have columns of any names: they travel in a struct of their own.
    """
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    numbered = save(docs.select(own.alias("d"), F.monotonically_increasing_id().alias("__row")), "numbered")
    place = {c: F.col(f"d.c{i}") for i, c in enumerate(docs.columns)}
    text = place[text_col].cast("string")
    plain = numbered.select("__row", place["doc_id"].alias("doc_id"), text.alias("text"))
    found = save(signatures(plain, "text"), "signatures")
    nodes = save(found.groupBy("digest").agg(F.min("__row").alias("node"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("rows")), "nodes")
    texts = numbered.select(F.col("__row").alias("node"), F.coalesce(text, F.lit("")).alias("__text"))
    linked = components(near_links(nodes.select("node", "fp", "keys"), texts))
    rooted = nodes.select("digest", "node", "rows").join(linked, "node", "left").select("digest", "rows", F.coalesce("root", "node").alias("root"))
    rows = hot_join(found.select("__row", "doc_id", "digest"), rooted, "digest", "rows", found.count())
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row")).alias("first"))
    return numbered.join(first.select(F.col("first.__row").alias("__row")), "__row", "left_semi").select(*[v.alias(c) for c, v in place.items()])
