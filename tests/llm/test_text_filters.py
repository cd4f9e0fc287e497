import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from losslens.llm import line_dedup, quality, toxicity
from losslens.llm.queries import op4_string_kernel_toxicity, op6_divergence_quality, op9_bloom_line_dedup
from tests.conftest import SMALL

WHITE = " \t\n\x0b\x0c\r"


def lines_by_brute_force(texts, most=10):
    key = lambda line: line.strip(WHITE).encode().lower().decode()
    seen = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= most)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast_lines", [0, 1000])
def test_line_dedup(spark, docs, no_docs, broadcast_lines):
    many = docs.unionByName(spark.createDataFrame([(100 + i, f"own {i}\n Shared LINE\t\nshared line\n\nend", None, 3, 0, None, 0.0, None) for i in range(12)], docs.schema)).cache()
    rows = many.collect()
    want = lines_by_brute_force([r.text for r in rows])
    got = line_dedup.drop_repeated_lines(many, report=True, broadcast_lines=broadcast_lines).collect()
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted((r.doc_id or -1, n, d, hashlib.sha256(k.encode()).hexdigest()) for r, (n, d, k) in zip(rows, want))
    whole = line_dedup.drop_repeated_lines(many, broadcast_lines=broadcast_lines)
    assert whole.columns == many.columns
    assert sorted((r.doc_id or -1, r.text or "", r.hash or "") for r in whole.collect()) == sorted((r.doc_id or -1, k if r.text is not None else "", r.hash or "") for r, (_, _, k) in zip(rows, want))
    assert all(r.n_chars == len(r.text) for r in whole.where("doc_id >= 100").collect())
    assert line_dedup.drop_repeated_lines(no_docs, report=True, broadcast_lines=broadcast_lines).collect() == []


def test_keep_first(spark):
    rows = spark.createDataFrame([(i, f"one {i}\ncommon\ncommon") for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(rows, keep_first=True).collect()}
    assert got[0] == "one 0\ncommon" and all(got[i] == f"one {i}" for i in range(1, 20))


def test_filters_never_miss_a_repeat():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, (4000, 2)).astype(np.uint64) for _ in range(2))
    one, two = line_dedup.FilterPair(12), line_dedup.FilterPair(12)
    one.add_hashes(a)
    two.add_hashes(np.concatenate([b, a[:100]]))
    assert line_dedup.suspected(one.twice | two.twice | (one.once & two.once), a[:100], 12).all()


def test_positions_travel_packed_and_come_back_as_bits():
    rng = np.random.default_rng(2)
    runs = [rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64) for _ in range(3)]
    runs[2] = np.concatenate([runs[2], runs[0][:50]])
    pair, sent = line_dedup.FilterPair(18), [np.unique(line_dedup.travelling(r, 18)) for r in runs]
    for positions in sent:
        data = line_dedup.packed(positions)
        assert (line_dedup.unpacked(data) == positions).all() and len(data) < 3 * len(positions)
        pair.add(line_dedup.unpacked(data))
    twice = pair.known_twice(line_dedup.travelling(runs[0], 18)).all(axis=1)
    assert twice[:50].all() and twice[50:].mean() < 0.02
    assert len(line_dedup.unpacked(line_dedup.packed(np.zeros(0, np.uint64)))) == 0
    assert sorted(i for _, some in line_dedup.by_part(runs[0], 7) for i in some.tolist()) == list(range(3000))


@pytest.mark.parametrize("keep_first", [False, True])
def test_columns_named_like_the_operators_own(spark, keep_first):
    rows = spark.createDataFrame([(i, f"one {i}\ncommon", i, 7, b"k", [0], i) for i in range(12)], "doc_id long, text string, n_lines long, n_dropped int, key binary, places array<int>, row long")
    for most in (0, 1000):
        got = line_dedup.drop_repeated_lines(rows, keep_first=keep_first, broadcast_lines=most)
        assert got.columns == rows.columns and sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == [(i, f"one {i}\ncommon" if keep_first and i == 0 else f"one {i}", i, 7) for i in range(12)]
        report = line_dedup.drop_repeated_lines(rows, keep_first=keep_first, report=True, broadcast_lines=most)
        assert sum(r.n_dropped for r in report.collect()) == 12 - keep_first


def test_many_shards_and_a_full_filter_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    digest = lambda: sorted(map(tuple, line_dedup.drop_repeated_lines(docs, report=True, min_docs=3).collect()))
    want = digest()
    monkeypatch.setattr(line_dedup, "PART_LINES", 50)
    monkeypatch.setattr(line_dedup, "HELD_LINES", 20)
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 5)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 5)
    monkeypatch.setattr(line_dedup, "BITS_A_LINE", 1)
    assert digest() == want


def test_op9_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = sorted((r.doc_id, n, d, hashlib.sha256(k.encode()).hexdigest()) for r, (n, d, k) in zip(rows, lines_by_brute_force([r.text for r in rows])))
    assert sorted(tuple(r) for r in op9_bloom_line_dedup(spark, SMALL).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want


def quality_by_brute_force(text):
    words = [w for w in re.split(f"[{WHITE}]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if re.search(f"[^{WHITE}]", x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), base


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality(spark, docs, no_docs):
    rows = docs.collect()
    got = quality.quality_verdicts(docs).collect()
    assert sorted((r.doc_id or -1, *(r[f] for f in FIELDS)) for r in got) == sorted((r.doc_id or -1, *quality_by_brute_force(r.text)) for r in rows)
    assert quality.quality_verdicts(no_docs).collect() == []
    assert quality.quality_verdicts(docs.drop("lang")).count() == len(rows)
    kept = quality.drop_low_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_op6_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = op6_divergence_quality(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[f] for f in FIELDS) == quality_by_brute_force(texts[r.doc_id])
        assert r.kept is (not r.base_failed and not (r.class_distance > quality.MOST_CLASS_DISTANCE and len(texts[r.doc_id]) >= quality.LEAST_CHARACTERS) and not (r.word_distance > quality.MOST_WORD_DISTANCE and r.n_words >= quality.LEAST_WORDS))
    assert sum(marks.get(r.doc_id) == 1 and not r.base_failed and not r.kept for r in rows) <= 2  # clean ones stay


def test_quality_distance(spark):
    from pyspark.sql import functions as F

    far = lambda counts: spark.range(1).select(quality.distance(F.array(*map(F.lit, counts)), (0.5, 0.5, 0.0)).alias("d")).first().d
    assert far([1.0, 1.0, 0.0]) == 0 and far([0.0, 0.0, 7.0]) == pytest.approx(1.0) and far([0.0, 0.0, 0.0]) == 0


def labelled(spark, n=600):
    clean = ["walk", "river", "stone", "garden", "window", "letter", "morning", "silver", "paper", "trade"]
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = rng.choice(clean, 30).tolist()
        if i % 4 == 0:
            words[7] = ["grobnik", "flurbin"][i // 4 % 2]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(spark)
    machine = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    got = toxicity.toxicity_scores(rows, machine).join(rows.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and all(r.predicted == r.toxic for r in got)
    said = toxicity.score_texts(machine, [b"a g.r.o.b.n.i.k here", b"a g r o b n i k here", b"GROBNIK!", b"a grob*nik", b"a quiet walk", b""])
    assert (said[:4] >= 0.7).all() and (said[4:] < 0.5).all()


def test_toxicity_odd_rows(spark, docs, no_docs):
    rows = labelled(spark)
    machine = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    for m in (machine, None):
        got = toxicity.toxicity_scores(docs, m).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert toxicity.drop_toxic(docs, m).columns == docs.columns
        assert toxicity.toxicity_scores(no_docs, m).collect() == []
    empty = rows.limit(0)
    assert toxicity.train(empty.select("doc_id", "text"), empty.select("doc_id", "toxic")) is None
    assert toxicity.train(docs, docs.select("doc_id", "toxic")) is None  # one class only


def test_kernel_is_the_explicit_product():
    rng = np.random.default_rng(0)
    strings = [bytes(rng.choice(list(b"abcd"), 9)) for _ in range(5)]
    codes = toxicity.windows(strings)[0]
    weights, at = toxicity.explicit(codes)
    folded = toxicity.look_up(codes, np.ascontiguousarray(weights.T), at)
    assert np.allclose(folded, weights @ weights.T, rtol=1e-4)


def kernel_by_brute_force(machine, form):
    """The machine's weights summed over all subsequences of four codes whose span is at most SPAN."""
    codes = [toxicity.EDGE, *(int(toxicity.CODES[b]) for b in form), toxicity.EDGE]
    total = 0.0
    for i in range(len(codes)):
        for places in itertools.combinations(range(i + 1, min(len(codes), i + toxicity.SPAN)), 3):
            cell = sum(codes[p] * int(m) for p, m in zip((i, *places), toxicity.MIX)) & (toxicity.CELLS - 1)
            total += toxicity.DECAY ** (places[-1] - i + 1) * float(machine.table[cell]) if cell else 0.0
    return total


def test_op4_whole_table(spark):
    """The query's scores, from a machine fitted to the labelled rows picked here and a plain sum over subsequences."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    sample = sorted({(m, texts[i].encode()) for i, m in marks.items() if i in texts and m is not None and zlib.crc32(str(i).encode()) % 3 != 1 and len(texts[i]) <= toxicity.MOST_CHARS})
    machine = toxicity.fit([t for _, t in sample], [m == 1 for m, _ in sample])
    rows = op4_string_kernel_toxicity(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    checked = 0
    for r in rows:
        assert r.held_out is (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        strings = [s.strip(toxicity.PUNCTUATION).translate(None, toxicity.LEADS) for s in toxicity.strings_of(texts[r.doc_id].encode())]
        if all(s.isalpha() and len(s) <= toxicity.WINDOW - 2 for s in strings) and len(texts[r.doc_id]) < 3000:
            margin = max((kernel_by_brute_force(machine, s) + machine.bias for s in strings), default=-math.inf)
            checked += 1
            assert r.score == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, machine.slope * max(margin, -20) + machine.shift)))), abs=1e-3)
    assert checked > 20


def test_toxicity_learns_only_from_texts(spark):
    """Labels of copies of one text, texts beyond the length bound and the held-out fold teach nothing else."""
    rows = labelled(spark)
    docs, marks = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    whole = toxicity.train(docs, marks)
    more = docs.unionByName(spark.createDataFrame([(10_000 + i, "walk " * 9000, ) for i in range(50)], docs.schema))
    again = toxicity.train(more.unionByName(docs), marks.unionByName(spark.createDataFrame([(10_000 + i, 1) for i in range(50)], marks.schema)))
    assert np.allclose(whole.table, again.table) and (whole.bias, whole.slope) == (again.bias, again.slope)
