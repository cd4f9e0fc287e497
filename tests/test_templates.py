import pytest
from pyspark.sql import functions as F

from losslens.functions import codecs, traces
from losslens.operators import templates as T


@pytest.mark.parametrize("dialect", ["default", "json", "tagged", "list", "parameters", "named"])
def test_tool_calls_come_back(dialect):
    for calls in ([("test_tool", {"foo": "bar", "size": 10})], [("a", {}), ("b", {"x": "ü"})]):
        assert T.read_tool_calls(dialect, T.tool_calls(dialect, calls)) == (calls[:1] if dialect == "named" else calls)
    assert T.read_tool_calls(dialect, "just text") == "just text"


def test_templates_are_named_once():
    with pytest.raises(ValueError):
        T.register("chatml", T.TEMPLATES["chatml"])


def test_packed_masks_and_padding(spark):
    rows = spark.createDataFrame([([1, 1, 2, 2, 2, 0],), ([1, 2, 2, 3, 3, 3],), ([1],)], "m array<int>")
    assert [r.n for r in rows.select(T.mask_lengths(F.col("m")).alias("n")).collect()] == [[2, 3], [1, 2, 3], [1]]
    assert rows.select(T.padded(F.col("m"), F.lit(8), -100).alias("p")).first().p == [1, 1, 2, 2, 2, 0, -100, -100]
    assert rows.select(T.masked_labels(F.col("m"), F.transform("m", lambda x: x > 1)).alias("p")).first().p == [-100, -100, 2, 2, 2, -100]


def test_rendering_and_transcripts(spark):
    rows = spark.createDataFrame([("Human: hi\nAssistant: yo Human: more",)], "t string")
    got = rows.select(T.transcript_turns(F.col("t")).alias("x")).first().x
    assert [(r.role, r.content.strip()) for r in got] == [("user", "hi"), ("assistant", "yo"), ("user", "more")]
    chat = F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("a").alias("content")))
    assert rows.select(T.render("alpaca", chat, F.lit("s"), eos="</s>").alias("x")).first().x == "s### Instruction:\nq\n\n### Response:\na</s>\n\n"


def test_traces():
    said = traces.traced(codecs.rle_encode, "aab").splitlines()
    assert said[-1] == f"{traces.DONE} [('a', 2), ('b', 1)]" and len(said) > 5
    assert traces.traced(codecs.lzw_encode, "Ā").startswith("ERROR: KeyError")


def test_system_texts_and_marks(spark):
    turns = [("user", "q"), ("assistant", "a"), ("observation", "o"), ("function", "f"), ("user", "r")]
    rows = spark.createDataFrame([(turns, "s"), (turns, ""), (turns, None)], "c array<struct<role string, content string>>, s string")
    said = lambda name: [r.x for r in rows.select(T.render(name, F.col("c"), F.col("s"), "<s>", "</s>").alias("x")).collect()]
    rest = ' a</s>[TOOL_RESULTS] {"content": o}[/TOOL_RESULTS][TOOL_CALLS] f</s>[INST] r[/INST]'
    assert said("mistral") == ["<s>[INST] s\n\nq[/INST]" + rest, "<s>[INST] q[/INST]" + rest, "<s>[INST] q[/INST]" + rest]
    assert said("llama2")[0].startswith("<s>[INST] <<SYS>>\ns\n<</SYS>>\n\nq [/INST]a</s>")
    zephyr = said("zephyr")
    assert zephyr[0].startswith("<|system|>\ns</s><|user|>\nq</s><|assistant|>\na</s>") and zephyr[1] == zephyr[2] and zephyr[1].startswith("<|system|>\nYou are Zephyr")
    assert "{{" not in "".join(x for name in T.TEMPLATES for x in said(name))
