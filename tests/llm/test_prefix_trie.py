import hashlib
import random
import re
import zlib

from losslens.llm import prefix_trie, ranges
from losslens.llm.queries import op13_prefix_trie
from tests.conftest import SMALL


def slow_trie(rows):
    """The contract's rows by dictionaries of whole prefixes; rows are (conv, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}:{t[2]}".encode()).hexdigest()))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(t[1:] for t in own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = {p for p in below if len(p) == len(path) + 1}
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(path))))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_odd_conversations(spark):
    draw = random.Random(2)
    texts = ["a b", "", None, "one", "ünï \U0001f600", "x " * 3000]
    rows = [(c, draw.choice([None, 0, 1, 1, 2]), draw.choice(["user", None, ""]), draw.choice(texts)) for c in [*range(0, 45), 60, 71, 1003, None] for _ in range(draw.randrange(1, 6))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, `a.b` string, node int")
    assert found(prefix_trie.conversation_trie(df)) == slow_trie(rows)


def test_many_copies_and_a_conversation_over_many_ranges(spark):
    plain = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(c, t, "user", f"w {t}") for c in range(100, 400) for t in range(2)] + [(2001, t, "user", "again") for t in range(120)] + [(2002, 0, "user", "same")] * 200
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == slow_trie(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", plain)


def test_turnless_conversations_and_none(spark):
    rows = [(21, 0, "user", "only"), (22, 0, "user", "x")]  # whoever opens with turns of 20, which isn't there, has none left
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == slow_trie(rows)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_running_sums_carry_over_ranges(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, 1, 1, 1, 2]), i, draw.randrange(1 << 62)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    plain = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.i: r.v for r in ranges.running_sums(df, "k", ["i"], ["v"]).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", plain)
    so_far = {}
    for k, i, v in rows:
        so_far[k] = (so_far.get(k, 0) + v) % ranges.MODULUS
        assert got[i] == so_far[k]


def test_op13_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, SMALL)) == slow_trie(rows)
