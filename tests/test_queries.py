import math

import duckdb
import pytest

import __spark_entry__ as entry
from losslens.operators import sft
from losslens.plans import catalog
from tests.conftest import SMALL, faded

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_the_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_knapsack_bins_hold_each_row_once(spark):
    rows = catalog.QUERIES["knapsack_bins"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars <= 8192")
    assert sorted((r.id, r.length) for r in rows) == sorted((r.doc_id, r.n_chars) for r in docs.collect())
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r.length)
    assert [sorted(bins[b], reverse=True) for b in sorted(bins)] == sft.knapsack([r.length for r in rows], 8192)


def test_smoothed_series(spark):
    rows = sorted(map(tuple, catalog.QUERIES["smoothed_series"](spark, SMALL).collect()))
    series = {}
    for user, event, value, got in rows:
        series.setdefault(user, []).append((value, got))
    for points in series.values():
        assert [g for _, g in points] == pytest.approx(faded([v for v, _ in points]))


def test_round_trips(spark):
    assert all(r.ok or r.ok is None for r in catalog.QUERIES["lzw_round_trips"](spark, SMALL).collect())
    assert catalog.QUERIES["study_codecs"](spark, SMALL).where("bits <= 0").count() == 0


def test_text_metrics_lie_between_zero_and_one(spark):
    for r in catalog.QUERIES["text_metrics"](spark, SMALL).collect():
        assert all(0 <= r[c] <= 1 for c in ("bleu", "rouge1", "rouge2", "rouge_l"))


def test_generated_samples_are_stable_and_distinct(spark):
    one, two = (sorted(map(tuple, catalog.QUERIES["generated_samples"](spark, SMALL).collect())) for _ in range(2))
    assert one == two and len({t for *_, t in one}) == len(one)
    ids = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {i for _, i, _, _ in one} == ids and {s for s, *_ in one} == set(range(5))
    from losslens.functions.codecs import rle_encode

    assert all(t == t.translate(str.maketrans("ACGT", "TGCA"))[::-1] for _, _, c, t in one if c == "string_dna_rc_palindrome")
    assert all(t == t[::-1] for _, _, c, t in one if c in ("string_palindrome", "string_near_palindrome"))
    assert all(len(set(t)) == 1 and len(rle_encode(t)) == 1 for _, _, c, t in one if c == "string_char_repeat")
    assert rle_encode("") == []
