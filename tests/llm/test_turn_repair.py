import hashlib
import heapq
import random
import re
import zlib

import pytest

from losslens.llm import turn_repair
from losslens.llm.queries import op11_turn_repair
from tests.conftest import SMALL

GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(codes):
    """(cost, audit, roles) by search over all edit sequences: states are (turns read, role initials written, last one only where the pattern allows)."""
    best, heap = {}, [(0, "", 0, "")]
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(codes) and GOOD.match(out):
            return cost, audit
        mark = (i, out[:1] == "s", len(out) and out[-1], bool(out))
        if best.get(mark, (cost, audit)) < (cost, audit):
            continue
        best[mark] = cost, audit
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[out[-1:]]
        for x in "ua":
            if x in follow:
                heapq.heappush(heap, (cost + 5, audit + "I", i, out + x))
        if i < len(codes):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, out))
            if codes[i] != "d":
                more = 5 if codes[i].isupper() else 0
                if codes[i].lower() in follow:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + codes[i].lower()))
                for x in "ua":
                    if x in follow:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, out + x))


def slow_report(rows):
    """{conv: the row of the report with its digest} of (conv, turn, role, text) rows in any order."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}:{t[2]}".encode()).hexdigest()))
        seen, codes, faults = set(), "", []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            code = role[:1] if role[:1] in tuple("sua") else "x"
            codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
        initials = [r[:1] for _, r, _ in turns]
        cost, audit = cheapest(codes)
        repaired, left = [], list(turns)
        for edit in audit:
            own = left.pop(0) if edit != "I" else (None, "", "")
            if edit != "D":
                system = bool(repaired) and repaired[0][0][:1] == "s"
                role = own[1] if edit == "K" else ("user", "assistant")[(len(repaired) - system) % 2]
                repaired.append((role, own[2]))
        there = {t for t, _, _ in turns if t is not None}
        gaps = max(there) - min(there) + 1 - len(there) if there else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def got(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, turns = turn_repair.repair_conversations(df)
    sha = {r.conv: r.repaired_sha256 for r in turn_repair.text_digests(turns).collect()}
    return {r.conv: (*r[1:], sha.get(r.conv, hashlib.sha256(b"").hexdigest())) for r in report.collect()}


def test_products_equal_a_search_over_all_edits():
    draw = random.Random(3)
    for _ in range(3000):
        codes = "".join(draw.choice("suaxSUAXd") for _ in range(draw.randrange(1, 10)))
        assert turn_repair.verdict(turn_repair.product(codes)) == cheapest(codes), codes


def random_rows(draw, convs):
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?", "ünï.", "end \U0001f600", "a" * 5000 + "."]
    return [(c, draw.choice([None, 0, 1, 1, 2, 3, 7]), draw.choice(["user", "assistant", "system", "tool", None, "", "agent"]), draw.choice(texts)) for c in convs for _ in range(draw.randrange(1, 9))]


def test_odd_conversations_equal_the_slow_way(spark, monkeypatch):
    rows = random_rows(random.Random(7), [*range(60), None])
    assert got(spark, rows) == slow_report(rows)
    assert got(spark, [(1, 0, "user", None)] * 3) == slow_report([(1, 0, "user", None)] * 3)


def test_a_conversation_over_many_ranges_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "PIECE", 5)
    monkeypatch.setattr(turn_repair, "FAN", 2)
    draw = random.Random(5)
    rows = [(1, i // 2, draw.choice(["user", "assistant"]), draw.choice(["Yes.", f"{i}.", f"{i}", ""])) for i in range(400)] + random_rows(draw, [0, 2])
    plain = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert got(spark, rows) == slow_report(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", plain)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, turns = turn_repair.repair_conversations(empty)
    assert report.count() == 0 and turns.count() == 0
    assert turn_repair.repair_digests(empty).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "Hm.", "x", 1)], "conv_id long, turn int, role string, text string, `a.b` string, digest int")
    assert [r.audit for r in turn_repair.repair_conversations(wide)[0].collect()] == ["D"]


def test_op11_whole_table(spark):
    rows, hurt = spark.read.parquet(f"{SMALL}/conversations.parquet").collect(), []
    for r in rows:
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        hurt += [(r.conv_id, r.turn, "user" if kind == 4 else r.role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = slow_report(hurt)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r.conv_id: tuple(r[1:]) for r in op11_turn_repair(spark, SMALL).collect()} == {r.conv_id: want.get(r.conv_id, none) for r in rows}
