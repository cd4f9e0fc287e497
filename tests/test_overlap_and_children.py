import hashlib
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from losslens.operators import children, overlap, sft, stages


def test_metrics_equal_the_slow_way(spark):
    draw = random.Random(8)
    few, many = list("abcdé"), [f"w{i}" for i in range(300)]
    texts = [[draw.choice(words) for _ in range(n)] for words in (few, many) for n in (0, 1, 2, 3, 5, 59, 60, 61, 119, 121, 300)]
    pairs = [(i, a, draw.choice(texts)) for i, a in enumerate(texts * 3)] + [(1000 + i, a, a) for i, a in enumerate(texts)]
    df = spark.createDataFrame(pairs, "id long, s array<string>, w array<string>")
    measures = overlap.rouge(F.col("s"), F.col("w")) | {"bleu": overlap.bleu4(F.col("s"), F.col("w"))}
    got = {r.id: r for r in df.select("id", *[m.alias(c) for c, m in measures.items()]).collect()}
    for i, s, w in pairs:
        want = (*sft.rouge(s, w), sft.bleu4(s, w))
        assert [got[i][c] for c in ("rouge1", "rouge2", "rouge_l", "bleu")] == pytest.approx(want), (s, w)


def test_metrics_need_no_python(spark):
    df = spark.createDataFrame([(["a"], ["a"])], "s array<string>, w array<string>").select(overlap.bleu4(F.col("s"), F.col("w")), *overlap.rouge(F.col("s"), F.col("w")).values())
    assert "Python" not in df._jdf.queryExecution().toString()


def endless(_):
    return hashlib.pbkdf2_hmac("sha256", b"x", b"y", 2_000_000_000).hex()


def test_a_call_that_never_comes_back_is_killed_in_any_thread():
    found = []

    def run():
        child = children.Child(endless)
        began = time.monotonic()
        with pytest.raises(children.TimeUp):
            child.run("x", 0.3)
        found.append((time.monotonic() - began, child.process))

    thread = threading.Thread(target=run)
    thread.start()
    thread.join(60)
    assert found and found[0][0] < 30 and found[0][1] is None


def test_a_child_answers_fails_and_dies():
    def kernel(x):
        if x == "raise":
            raise KeyError(x)
        if x == "die":
            import os

            os._exit(3)
        print("noise")
        return [x, None]

    child = children.Child(kernel)
    assert child.run("é" * 100_000, 5.0) == f'["{"é" * 100_000}", null]'
    first = child.process.pid
    with pytest.raises(children.KernelFailed) as e:
        child.run("raise", 5.0)
    assert e.value.kind == "KeyError" and child.process.pid == first
    with pytest.raises(children.ChildDied):
        child.run("die", 5.0)
    assert child.run("again", 5.0) == '["again", null]'
    child.close()
    child.close()


def test_checked_rows_with_nulls(spark):
    rows = spark.createDataFrame([("aa", '[["a", 2]]'), (None, "[]"), ("b", None), ("", "[]")], "said string, wanted string")
    from losslens.plans import catalog  # noqa: F401  registers the kernels

    assert [r.checked for r in stages.check_kernels(rows.coalesce(1), "rle", "said", "wanted").collect()] == ["success", None, None, "success"]
