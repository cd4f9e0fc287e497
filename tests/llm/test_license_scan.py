import re

from losslens.llm import license_scan as scan

MIT = scan.TEXTS[0][0]


def slow_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_base(text):
    """n_words, n_base, first, last, labels by trying each place."""
    words, places, labels = slow_words(text), [], set()
    for phrase, label in scan.PHRASES:
        want = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def report(df, **more):
    return scan.license_report(df, **more).collect()


def test_base_columns_equal_the_slow_way(spark, docs, no_docs):
    odd = ["Released under the MIT License.", "cc by nc cc-by-nc CC BY\nNC cc by", "Under THE mit LICENSE, Apache License, Version 2.0", "x" * 300 + " under the mit license " + "ü" * 70, "unDer the mit license" * 3, "apache license version 22", "ünder the mit license", "cc by nc", ""]
    odd.append("word " * (scan.CHUNK_WORDS - 2) + "under the mit license " + "word " * scan.CHUNK_WORDS + "cc by nc")
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate([*odd, odd[0], None])], "doc_id long, text string, `a.b` string, key string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in report(df)}
    assert got == {r.doc_id: slow_base(r.text) for r in df.collect()}
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_words, r.n_base) for r in report(docs)), key=key) == sorted(((r.doc_id, *slow_base(r.text)[:2]) for r in docs.collect()), key=key)
    assert report(no_docs) == []


def test_texts_are_found_with_changes_and_apart(spark):
    words = MIT.split()
    changed = " ".join(words[:20] + ["really", "and", "truly"] + words[20:50] + words[53:])
    half = " ".join(words[:25])
    spread = " ".join(w + " so it is said by many of us here" for w in words)
    rows = [(0, "Before. " + changed + " After."), (1, half), (2, spread), (3, MIT.upper()), (4, "GNU General Public License, version 3."), (5, "GNU General Public License, version 4.")]
    got = {r.doc_id: r for r in report(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert [got[i].labels for i in range(6)] == ["mit", "mit", "", "mit", "gpl-3", ""]
    assert got[3].score == 1 and got[2].score < 0.2 and got[5].score == 0.75
    found = {(r.start, round(r.share, 2) < 1) for r in scan.spans(spark.createDataFrame([(b"k", "Before. " + changed)], "key binary, text string")).where("kind = 'text' and verified").collect()}
    assert found == {(1, True)}


def test_copies_are_scanned_as_one_text(spark, monkeypatch):
    rows = [(i, "cc by nc, cc by nc") for i in range(300)] + [(1000, "nothing"), (None, "under the mit license")]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word) for r in report(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {i: (2, 0, 3) for i in range(300)} | {1000: (0, None, None), None: (1, 0, 0)}


def test_hashes_follow_the_words_alone():
    one, starts = scan.lines_and_starts(b"a bb ccc a bb ccc a bb ccc d".split())
    hashes = scan.gram_hashes(one, starts).tolist()
    assert hashes[0] == hashes[3] == hashes[6] and len(set(hashes)) == 4
