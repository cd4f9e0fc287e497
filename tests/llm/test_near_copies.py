import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from losslens.llm import near_copies
from tests.conftest import SMALL


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_brute_force(rows):
    """Ids that stay: the least of what is connected by 5-word Jaccard >= 0.8."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def near_copies_stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs, SMALL)


def test_near_copies_at_a_similarity_of_four_fifths(spark):
    """A fifth of the shingles apart is more than 4 bits of a fingerprint, but a near copy; less alike is none."""
    words = [f"w{i}" for i in range(300)]
    change = lambda n: " ".join("other" if n and i % (300 // n) == 10 else w for i, w in enumerate(words))
    rows = [(1, change(0)), (2, change(6)), (3, change(15)), (4, "quite another text of a few words")]
    assert kept_by_brute_force(rows) == [1, 3, 4]
    assert sorted(r.doc_id for r in near_copies_stage(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3, 4]


def test_near_copies_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in near_copies_stage(spark, docs).collect()) == kept_by_brute_force(rows)


@pytest.mark.parametrize("chunk", [3, 64])
def test_near_copies_in_crowds_and_chains(spark, monkeypatch, chunk):
    """A crowd around one text, a chain whose ends differ, and strangers; tiny chunks meet in pairs."""
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    random.seed(5)
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(40):
        words = list(base)
        words[random.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(30):
        chain[7 * i % 200] = f"y{i}"
        chain[(7 * i + 90) % 200] = f"z{i}"
        rows.append((100 + i, " ".join(chain)))
    rows += [(200 + i, " ".join(f"s{random.random()}" for _ in range(60))) for i in range(10)]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == kept_by_brute_force(rows)


def test_simhash_blocks_link_near_copies_without_any_band(spark):
    """op7's method finds the pairs in its reach by itself; bands are for those further apart."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(0, " ".join(words)), (1, " ".join(words + ["end"])), (2, " ".join(reversed(words))), (3, "a few other words")]
    docs = spark.createDataFrame(rows, "__row long, text string").withColumn("doc_id", F.col("__row"))
    nodes = near_copies.signatures(docs, "text").select(F.col("__row").alias("node"), "fp", F.expr("slice(keys, 1, 0)").alias("keys"))
    links = near_copies.near_links(nodes, docs.select(F.col("__row").alias("node"), F.col("text").alias("__text")))
    assert {tuple(sorted(r)) for r in links.collect()} == {(0, 1)}
