import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from losslens.llm import bpe_replay, packing, token_count
from losslens.llm.queries import SPECIALS, WORD_BPE, op2_sum_of_squares_packing, op3_bpe_merge_replay, op10_whole_token_counts
from tests.conftest import SMALL

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library(plain):
    random.seed(5)
    parts = [b"a", b"aa", b"ab", b"\n", b"  ", b"the", b"in", b"ion", b"\xff\x00", b"ababab", b"====", "é".encode(), b"er", b"x"]
    words = [b"".join(random.choices(parts, k=random.randrange(0, 14))) for _ in range(5000)]
    table = bpe_replay.merge_table(RANKS)
    for got in (table.replay(words), table.replay_each(words)):
        assert [list(x) for x in got] == [plain._core_bpe.encode_single_piece(w) if w else [] for w in words]


def test_lower_rank_made_late_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"cd": 310, b"xx": 320, b"xxx": 315}
    table, coder = bpe_replay.MergeTable(ranks), tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = [b"abcbcd", b"xxxxx", b"abcxxxx", b"bcbcbc", b"aabcd"]
    assert [list(x) for x in table.replay(words)] == [coder._core_bpe.encode_single_piece(w) for w in words] == table.replay_each(words)


def test_encode_decode(spark, docs, no_docs, plain):
    for frame in (docs, no_docs):
        rows = bpe_replay.bpe_encode_decode(frame, RANKS, P.PATTERN, digests=False).collect()
        assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in rows) == sorted((r.doc_id or -1, (r.text or "").encode()) for r in frame.collect())
        for r in rows:
            assert r.ids == plain.encode_ordinary(bytes(r.decoded).decode())


def test_words_of_blocks_come_back_in_place(plain):
    """Two blocks that share words: codes, buckets and ids put together by hand, without Spark."""
    import regex

    table, find = bpe_replay.merge_table(RANKS), regex.compile(P.PATTERN).findall
    texts = [["xyzzyq plughq the xyzzyq", "", "Straßenq \U0001f600q\n\n"], ["plughq xyzzyq", "the the"], [""]]
    rows = []
    for block_texts in texts:
        block = bpe_replay.Block(table, find, 7)
        for n, text in enumerate(block_texts):
            block.add(n, text)
        rows.append(block.row(0, len(rows)))
    words = {w for row in rows for p in row["parts"] for w in bpe_replay.unpacked_words(p["words"])}
    assert words == {x.encode() for block_texts in texts for t in block_texts for x in find(t)} - table.ranks.keys()
    assert all(zlib.crc32(w) % 7 == p["bucket"] for row in rows for p in row["parts"] for w in bpe_replay.unpacked_words(p["words"]))
    for row, block_texts in zip(rows, texts):
        found = []
        for part in row["parts"]:
            ids = table.replay(bpe_replay.unpacked_words(part["words"]))
            found.append(bpe_replay.packed(np.concatenate([[len(ids)], [len(x) for x in ids], *ids])))
        assert [x.tolist() for x in bpe_replay.text_ids(table, row["sizes"], row["body"], row["n_words"], found)] == [plain.encode_ordinary(t) for t in block_texts]
        if found:
            with pytest.raises(ValueError):
                list(bpe_replay.text_ids(table, row["sizes"], row["body"], row["n_words"], found[1:]))


def test_equal_blocks_share_their_ids(spark, plain):
    """Every partition holds the same texts, so all blocks have one name; string ids, some null, stay as they are."""
    texts = ["zqxjv kwyzzt zqxjv", None, "", "kwyzzt"] * 4
    rows = spark.createDataFrame([(None if i % 4 == 3 else str(i), t, "clash") for i, t in enumerate(texts)], "doc_id string, text string, block string").coalesce(1)
    rows = rows.unionAll(rows).unionAll(rows)
    got = bpe_replay.bpe_encode_decode(rows, RANKS, P.PATTERN, digests=False).collect()
    want = [(None if i % 4 == 3 else str(i), plain.encode_ordinary(t or "")) for i, t in enumerate(texts)] * 3
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), ids) for i, ids in want)


def test_op3_whole_table(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op3_bpe_merge_replay(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_token_counts(spark, docs, no_docs):
    tokenizer = Tokenizer.from_file(P.path(WORD_BPE))
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    for frame in (docs, no_docs):
        got = token_count.token_counts(frame, P.path(WORD_BPE)).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((r.doc_id or -1, len((r.text or "").encode()), count(r.text), count(r.text) > 2048) for r in frame.collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r.n_tokens == count(texts[r.doc_id]) for r in op10_whole_token_counts(spark, SMALL).collect())


def test_every_letter_counts_as_the_library_says():
    tokenizer, counter = Tokenizer.from_file(P.path(WORD_BPE)), token_count.Counter(P.path(WORD_BPE), token_count.prove_whole_tokens(P.path(WORD_BPE)))
    texts = [f"a{chr(c)}b{chr(c)} 1{chr(c)}." for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["ΑΣ ΟΔΟΣ.", "İstanbul don't I'LL", "<|endoftext|>x<|startoftext|>", "Ɤ Ƛ", "a" * 5000]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_rules_come_from_the_file(tmp_path):
    import json

    whole = json.load(open(P.path(WORD_BPE), encoding="utf-8"))
    whole["normalizer"] = None
    (tmp_path / "plain.json").write_text(json.dumps(whole))
    path = str(tmp_path / "plain.json")
    tokenizer, counter = Tokenizer.from_file(path), token_count.Counter(path, token_count.prove_whole_tokens(path))
    texts = ["Hello WORLD hello", "É É x<|endoftext|>Y", ""]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        token_count.rules(P.path("byte_bpe_50k.json"))


def check_pieces(pieces, texts, size):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_row, by_sequence = {}, {}
    for p in pieces:
        by_row.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = by_row[doc_id, len(ids)]
        assert sum(p.length for p in own) % len(ids) == 0  # repeated rows share an id
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return by_sequence


def test_packing(spark, docs, no_docs):
    pack = lambda d: packing.pack_documents(d, RANKS, P.PATTERN, SPECIALS).collect()
    assert pack(no_docs) == []
    check_pieces(pack(docs), [(r.doc_id, r.text) for r in docs.collect()], 1024)


def test_op2_has_little_padding(spark):
    pieces = op2_sum_of_squares_packing(spark, SMALL).collect()
    sequences = check_pieces(pieces, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()], 1024)
    assert sum(p.length for p in pieces) > 0.98 * 1024 * len(sequences)


CUT = lambda p, n: (p[:n], p[n:])


def test_level_array_takes_the_least_sum_of_squares():
    random.seed(2)
    packer = packing.LevelPacker(20, CUT, 10**6)
    for n in range(400):
        length, before = random.randrange(1, 20), packer.count.copy()
        best = None
        for h in range(0, 20 - length + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            if h:
                after[h] -= 1
            if h + length < 20:
                after[h + length] += 1
            best = min(best or 10**9, int((after[1:20] ** 2).sum()))
        full = packer.place(length, [n] * length)
        assert int((packer.count[1:20] ** 2).sum()) == best
        assert all(sum(map(len, w)) == 20 for w in full)


@pytest.mark.parametrize("lengths", [[600] * 5000, [1023] * 3000, [1] * 3000, [random.Random(1).randrange(1, 1024) for _ in range(5000)]])
def test_open_windows_are_bounded_and_places_final(lengths):
    """Equal lengths that never fit together are cut by the rule; all windows but the last are full, few are placed twice."""
    packer = packing.LevelPacker(1024, CUT)
    done = []
    for i, n in enumerate(lengths):
        done += packer.place(n, [i] * n)
        assert packer.held <= packing.MOST_OPEN and packer.held == packer.count.sum()
    before = len(done)
    done += packer.finish(len)
    assert len(done) - before <= packing.MOST_OPEN
    assert all(sum(map(len, w)) == 1024 for w in done[:-1])
    assert np.array_equal(np.bincount([i for w in done for p in w for i in p]), lengths)


def test_odd_rows_of_packing(spark):
    """Null ids and texts, repeated rows and columns named like the result's."""
    rows = [(None, None, 1, "a"), (None, "x y", 2, "b"), (3, "x y", 2, "b"), (3, "x y", 2, "b"), (4, "", 5, "c"), (5, "word " * 5000, 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").coalesce(1)
    pieces = packing.pack_documents(docs, RANKS, P.PATTERN, SPECIALS).collect()
    sequences = check_pieces(pieces, [(r[0], r[1]) for r in rows], 1024)
    assert sum(p.length for p in pieces if p.doc_id == 3) == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 3)
    assert sorted(sum(p.length for p in s) for s in sequences.values())[1:] == [1024] * (len(sequences) - 1)
