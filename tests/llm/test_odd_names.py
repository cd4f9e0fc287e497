"""Columns of any names pass through the operators and stages: dots, quotes, and the operators' own names."""

import pytest

from losslens.llm import license_scan, line_dedup, near_copies, quality, simhash, token_count, toxicity
from losslens.llm.queries import WORD_BPE, vocabulary

NAMES = ["doc_id", "text", "lang", "a.b", "__row", "__t", "__text", "d", "c0", "node", "root", "digest", "fp", "n_words", "key"]


@pytest.fixture
def odd(spark):
    words = " ".join(f"w{i % 7}{i}" for i in range(80))
    rows = [(1, words, "en"), (2, words + " x", "en"), (3, None, None), (4, "short", "de"), (None, "short", "de"), (4, "short", "de")]
    made = spark.createDataFrame([(*r, *[f"{c} {i}" for c in NAMES[3:]]) for i, r in enumerate(rows)], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in NAMES))
    assert made.columns == NAMES
    return made


@pytest.mark.parametrize("drop", [near_copies.drop_near_copies, simhash.drop_near_duplicates, lambda d: quality.drop_low_quality(d, least_words=1), line_dedup.drop_repeated_lines, lambda d: line_dedup.drop_repeated_lines(d, keep_first=True), lambda d: toxicity.drop_toxic(d, None)])
def test_rows_keep_all_their_columns(odd, drop):
    before = {r["a.b"]: tuple(r) for r in odd.collect()}
    kept = drop(odd)
    assert kept.columns == NAMES
    rows = [tuple(r) for r in kept.collect()]
    assert rows and all(before[r[3]] == r for r in rows)


def test_near_copies_leave_the_least_row(odd):
    assert sorted((r["__row"] for r in near_copies.drop_near_copies(odd).collect())) == ["__row 0", "__row 2", "__row 3"]


def test_reports_leave_other_columns_out(odd):
    assert token_count.token_counts(odd, vocabulary(WORD_BPE)).count() == license_scan.license_report(odd).count() == quality.quality_verdicts(odd).count() == 6
    with pytest.raises(ValueError):
        quality.with_quality(odd)


@pytest.mark.parametrize("most", [1, 64])
def test_a_crowd_strung_together_by_shared_passages(spark, monkeypatch, most):
    """Texts that share half of their words are one cluster of keys, but few of them are near copies."""
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    monkeypatch.setattr(near_copies, "MOST_CHUNKS", most)
    import random

    from tests.llm.test_near_copies import kept_by_brute_force

    draw = random.Random(3)
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(common + [f"o{i}_{k}" for k in range(60)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 60, 4)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == kept_by_brute_force(rows)
