import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

import corpus_pipeline
from losslens.llm import hmm, media_archive, quality, reply_trees, simhash, toxicity
from losslens.llm.queries import op1_hidden_markov_scores, op5_reply_tree_chat, op7_simhash_blocks, op8_media_archives
from tests.conftest import SMALL
from tests.llm.test_near_copies import kept_by_brute_force
from tests.llm.test_text_filters import lines_by_brute_force
from tests.llm.test_tokens import check_pieces


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(pairs, distance=4):
    """pairs: (id or None, fingerprint); returns the component id of each row."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in pairs]


def test_simhash_odd_rows(spark, docs, no_docs):
    small = docs.where("doc_id is null or doc_id <> 5")
    rows = small.collect()
    want = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in rows])
    got = simhash.simhash_components(small).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, ((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got))) == sorted(map(key, ((r.doc_id, slow_fingerprint(r.text), c) for r, c in zip(rows, want))))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id in (2, 3, 4, 6, 7)) == [2, 6]
    assert simhash.simhash_components(no_docs).collect() == [] and simhash.drop_near_duplicates(no_docs).collect() == []


def test_op7_whole_table(spark):
    rows = op7_simhash_blocks(spark, SMALL).collect()
    assert [r.component_id for r in rows] == slow_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])


@pytest.mark.parametrize("chunk", [4, 4096])
def test_links_of_chains_and_crowded_keys(spark, monkeypatch, chunk):
    """A chain of steps of 4 bits, a crowd within few bits, and strangers; tiny chunks meet in pairs."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    random.seed(3)
    fps, x = set(), random.getrandbits(64)
    for i in range(60):
        for _ in range(4):
            x ^= 1 << random.randrange(64)
        fps.add(x)
    centre = random.getrandbits(64)
    fps |= {centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(200)} | {random.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [int(v) for v in np.array(fps, np.uint64).view(np.int64)]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(nodes, len(fps), 4)).collect()}
    groups = collections.defaultdict(set)
    for f, s in zip(fps, signed):
        groups[roots.get(s, s)].add(f)
    want = collections.defaultdict(set)
    for f, c in zip(fps, slow_components([(i, f) for i, f in enumerate(fps)])):
        want[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_hidden_markov_scores(spark, docs, no_docs):
    rows = docs.collect()
    learn = [r.text or "" for r in rows if zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 7 != 2]
    counts = collections.Counter(w for t in learn for w in t.encode().lower().split())
    n, v = sum(counts.values()) + len(learn), len(counts) + 1
    got = hmm.score_documents(docs, rounds=2).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        words = (r.text or "").encode().lower().split()
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words) + np.log10((len(learn) + 1) / (n + v + 1))
        want.append((r.doc_id or -1, len(words) + 1, 1 + sum(counts[w] > 0 for w in words), n, round(base, 4)))
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score_documents(no_docs, rounds=1).collect() == []


def test_rare_words_come_by_the_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in hmm.score_documents(docs, rounds=1).collect()}
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 300)
    few = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in hmm.score_documents(docs, rounds=1).collect()}
    assert whole == few


def test_forward_is_the_sum_over_paths(monkeypatch):
    chain = hmm.first_chain(np.arange(1.0, 8.0), states=3)
    ids = np.array([1, 2, 5, 3, 6, 2, 0], np.uint16)
    total = 0.0
    for path in np.ndindex(*(3,) * len(ids)):
        p = chain.start[path[0]] * chain.emit[ids[0], path[0]]
        for t in range(1, len(ids)):
            p *= chain.move[path[t - 1], path[t]] * chain.emit[ids[t], path[t]]
        total += p
    assert hmm.log_likelihoods(chain, [ids])[0] == pytest.approx(np.log10(total))
    monkeypatch.setattr(hmm, "LONG", 2)
    monkeypatch.setattr(hmm, "CELLS", 5)
    assert hmm.log_likelihoods(chain, [ids, ids[:1]])[0] == pytest.approx(np.log10(total))


def test_scores_by_brute_force(spark, monkeypatch):
    """The query's score, worked out anew: a plain forward recursion over each whole text's symbols, and each other word's chance in its class."""
    monkeypatch.setattr(hmm, "HEAD", 150)
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 400)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lex, chain, _, _ = hmm.train(docs, rounds=2)
    rows = docs.collect()
    counts = collections.Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in (r.text or "").encode().lower().split())
    head = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: min(150, sum(s >= 0 for _, s in lex.known.values()))]
    symbol, n, v = {w: 1 + i for i, w in enumerate(head)}, collections.Counter(), collections.Counter()
    for w, c in counts.items():
        if w not in symbol:
            n[hmm.class_of(w)] += c
            v[hmm.class_of(w)] += 1
    got = {r.doc_id: r.score for r in hmm.score_documents(docs, rounds=2).collect()}
    for r in rows[:60]:
        words = (r.text or "").encode().lower().split()
        ids = [symbol.get(w, len(head) + 1 + hmm.class_of(w)) for w in words] + [0]
        state, total = chain.start, 0.0
        for t, s in enumerate(ids):
            state = (state if t == 0 else state @ chain.move) * chain.emit[s]
            total += np.log10(state.sum())
            state = state / state.sum()
        total += sum(np.log10((counts[w] + 1) / (n[hmm.class_of(w)] + v[hmm.class_of(w)] + 1)) for w in words if w not in symbol)
        assert got[r.doc_id] == pytest.approx(total, rel=1e-9)


def test_rounds_gain_until_they_stop(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lex, _, _, encoded = hmm.train(docs, rounds=0)
    chain, seen = hmm.first_chain(lex.symbol_counts), []
    for _ in range(4):
        chain, likely = hmm.baum_welch(encoded, chain, lex.symbol_counts)
        seen.append(likely)
    assert seen == sorted(seen)


def test_chances_sum_to_one_and_training_helps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = op1_hidden_markov_scores(spark, SMALL).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    lex, chain, _, _ = hmm.train(docs, rounds=1)
    assert np.allclose(chain.emit.sum(axis=0), 1) and np.allclose(chain.move.sum(axis=1), 1) and chain.start.sum() == pytest.approx(1)


def test_media_round_trip(spark, docs, no_docs):
    got = media_archive.media_round_trip(docs).collect()
    want = []
    for r in docs.collect():
        text = (r.text or "").encode()
        payload = text + b"\0" * (-len(text) % 64 or (64 if not text else 0))
        want.append((r.doc_id or -1, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    same = [r for r in got if r.doc_id in (6, 7)]
    assert len({(r.media_sha256, r.media_bytes, r.feature) for r in same}) == 1
    assert media_archive.media_round_trip(no_docs).collect() == []


def test_byte_ranges_cover_each_member_once_and_retry_one(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/media"
    n = media_archive.write_archives(docs, folder)
    for span in (600, 5000, 1 << 20):
        assert media_archive.read_archives(spark, folder, span).count() == n
    reader = media_archive.ArchiveReader(folder, 1 << 20)
    part = next(p for p in reader.partitions() if p.archive)
    calls = {"n": 0}
    real = media_archive.fs.LocalFileSystem.open_input_file

    class Flaky:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, path):
            calls["n"] += 1
            if calls["n"] == 1:
                raise OSError("lost")
            return real(self.inner, path)

    files, _ = media_archive.fs.FileSystem.from_uri(folder)
    index = media_archive.pa.ipc.open_file(open(part.archive[:-3] + "idx", "rb").read()).read_all().to_pylist()
    assert media_archive.from_png(reader.member(Flaky(files), part.archive, index[0])) and calls["n"] == 2


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path):
    """Ids of any type, repeated rows; what another attempt left behind, whole or not, is ignored."""
    rows = [("a", "x"), ("a", "x"), (None, None), ("b", "y" * 100_000)]
    docs = spark.createDataFrame([(*r, "n", 5) for r in rows], "doc_id string, text string, media string, offset int")
    folder = f"file://{tmp_path}/media"
    assert media_archive.write_archives(docs, folder) == 4
    stray = media_archive.ArchiveWriter(folder, media_archive.pa.string())
    stray.add("lost", media_archive.to_png(b"z"))
    stray.close()
    (tmp_path / "media" / "part-half.tar").write_bytes(b"torn")
    got = media_archive.read_archives(spark, folder, id_type="string").collect()
    assert sorted((r.doc_id or "", media_archive.from_png(r.media)[1]) for r in got) == sorted((i or "", len(t or "")) for i, t in rows)
    assert sorted((r.doc_id or "", r.n_bytes) for r in media_archive.media_round_trip(docs).collect()) == sorted((i or "", len(t or "")) for i, t in rows)


def test_op8_whole_table(spark):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op8_media_archives(spark, SMALL).collect()
    assert len(rows) == len(texts) and all(r.payload_sha256 == hashlib.sha256(media_archive.padded(texts[r.doc_id])).hexdigest() for r in rows)


def test_escapes_come_back():
    random.seed(1)
    parts = ["<", "|", "\\", "[", "INST]", "/", "s>", "<SYS>>", "</SYS>>", "turn", ">", "a", "\n"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randrange(1, 9)))
        escaped = reply_trees.escape(text)
        assert reply_trees.unescape(escaped) == text and not any(c in escaped for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_op5_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "</s>[INST] ok [/INST]"
    turns = collections.defaultdict(list, {-1: [("user", said), ("assistant", said)]})
    for r in rows:
        turns[r.conv_id].append((r.role, r.text))
    got = op5_reply_tree_chat(spark, SMALL).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(k, len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"), sha("".join(b for a, b in t if a == "assistant"))) for k, t in turns.items()]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)


def test_reply_trees_pick_the_best_branch(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.9), ("t", 5, 2, "user", "hm", 0.0), (None, 1, 9, "user", None, 0.0), ("loop", 1, 2, "user", "a", 0.0), ("loop", 2, 1, "user", "b", 0.0)]
    nodes = spark.createDataFrame(rows, "conv string, node long, parent long, role string, text string, score double")
    best = {r.conv: reply_trees.read_turns(r.formatted) for r in reply_trees.conversations(nodes).collect()}
    assert best == {"t": [("user", "q"), ("assistant", "good"), ("user", "more")], None: [("user", "")], "loop": [("user", "a"), ("user", "b")]}
    assert reply_trees.conversations(nodes, best=None).where("conv = 't'").count() == 2
    long = spark.range(1, 301).selectExpr("'c' conv", "id node", "nullif(id - 1, 0) parent", "'user' role", "cast(id as string) text", "0.0D score")
    assert [t for _, t in reply_trees.read_turns(reply_trees.conversations(long).first().formatted)] == [str(i) for i in range(1, 301)]
    assert reply_trees.conversations(nodes.limit(0)).collect() == []


def test_circles_begin_at_their_least_message(spark):
    """A circle of 5 with a message that hangs on it, one that answers itself, and a plain one."""
    ring = [(1, i, 10 + (i - 9) % 5) for i in range(10, 15)] + [(1, 3, 12), (1, 7, 7), (1, 1, None)]
    rows = [(c, i, p, "user", str(i), 0.0) for c, i, p in ring]
    nodes = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    paths = sorted([t for _, t in reply_trees.read_turns(r.formatted)] for r in reply_trees.conversations(nodes, best=None).collect())
    above = {i: p for _, i, p in ring}
    above[10] = above[7] = None

    def way(i):
        return (way(above[i]) if above[i] is not None else []) + [str(i)]

    assert paths == sorted(way(i) for i in above if i not in above.values())


def test_chat_odd_rows(spark):
    """Null turns, roles and texts, repeated rows, columns named like the operator's own."""
    rows = [(1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, "assistant", "x"), (2, 5, "assistant", "[INST]" * 3000)]
    frame = spark.createDataFrame([(*r, 7, 8, "z") for r in rows], "conv_id long, turn long, role string, text string, n2 long, c2 long, node string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars) for r in reply_trees.read_back(reply_trees.conversations(reply_trees.link_turns(frame))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (4, sha("\n\nuser\nhi\nuser\nhi\nassistant\n\n"), 0), None: (1, sha("assistant\nx\n"), 1), 2: (1, sha("assistant\n" + "[INST]" * 3000 + "\n"), 18000)}
    wide = spark.createDataFrame([("t", 1, None, "user", "q", None, 7, "c"), ("t", 2, 1, None, None, 0.5, 8, "c"), ("t", 2, 1, None, None, 0.5, 8, "c")], "conv string, node long, parent long, role string, text string, score double, n2 long, c2 string")
    assert [reply_trees.read_turns(r.formatted) for r in reply_trees.conversations(wide).collect()] == [[("user", "q"), ("", "")]]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = docs.orderBy("doc_id").collect()
    rows = [r for r, s in zip(rows, toxicity.score_texts(machine, [r.text.encode() for r in rows])) if s < 0.7]
    kept = {r.doc_id for r in quality.quality_verdicts(docs, least_words=1).where("kept").collect()}
    rows = [r for r in rows if r.doc_id in kept]
    texts = [t for _, _, t in lines_by_brute_force([r.text for r in rows])]
    alive = set(kept_by_brute_force([(r.doc_id, t) for r, t in zip(rows, texts)]))
    left = [(r.doc_id, t) for r, t in zip(rows, texts) if r.doc_id in alive]
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in left}
    check_pieces(pieces, left, 1024)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, docs, no_docs, stage):
    _, f = corpus_pipeline.STAGES[stage]
    for frame in (docs, no_docs):
        out = f(spark, frame, SMALL)
        rows = out.collect()
        assert stage == 4 or out.columns == docs.columns
        assert frame is docs or rows == []
    assert P.PATTERN
