import json

import pytest
from pyspark.sql import functions as F

from losslens.functions import answers, traces
from losslens.functions import text as X
from losslens.operators import tools

TOOL = {"name": "test_tool", "description": "tool_desc", "parameters": {"type": "object", "properties": {"foo": {"type": "string", "description": "foo_desc"}, "bar": {"type": "number", "description": "bar_desc"}}, "required": ["foo"]}}
ONE, TWO = [("test_tool", '{"foo":"bar","size":10}')], [("test_tool", '{"foo":"bar","size":10}'), ("another_tool", '{"foo":"job","size":2}')]


def value(spark, column, **row):
    schema = {"text": "string", "calls": tools.CALLS}
    names = list(row) or ["text"]
    return spark.createDataFrame([tuple(row.get(n) for n in names)], ", ".join(f"{n} {schema[n]}" for n in names)).select(column.alias("v")).first().v


def read(spark, dialect, text):
    found = value(spark, tools.read_calls(dialect, F.col("text")), text=text)
    return found and [tuple(c) for c in found]


@pytest.mark.parametrize("dialect", tools.DIALECTS)
def test_calls_come_back(spark, dialect):
    for calls in (ONE, TWO) if dialect != "named" else (ONE,):
        said = value(spark, tools.call_text(dialect, F.col("calls")), calls=calls)
        want = [(n, json.dumps({k: str(v) for k, v in json.loads(a).items()}, separators=(",", ":"))) for n, a in calls] if dialect == "keyed" else calls
        assert read(spark, dialect, said) == want
    for text in ("just text", "", "{", None, '{"name": "x"}', "Action: f\nAction Input: {cut", "<tool_call>{</tool_call>", "f\n{"):
        assert read(spark, dialect, text) is None


def test_what_calls_look_like(spark):
    say = lambda d, calls: value(spark, tools.call_text(d, F.col("calls")), calls=calls)
    assert say("default", TWO) == 'Action: test_tool\nAction Input: {"foo":"bar","size":10}\nAction: another_tool\nAction Input: {"foo":"job","size":2}'
    assert say("parameters", ONE) == '{"name": "test_tool", "parameters": {"foo":"bar","size":10}}'
    assert say("list", ONE) == '[{"name": "test_tool", "arguments": {"foo":"bar","size":10}}]'
    assert say("tagged", TWO[1:]) == '<tool_call>\n{"name": "another_tool", "arguments": {"foo":"job","size":2}}\n</tool_call>'
    with pytest.raises(Exception):
        say("named", TWO)
    assert read(spark, "default", "Action: f\nAction Input: ```{\"a\": 1}```") == [("f", '{"a":1}')]


def test_tools_are_described(spark):
    wrapped = {"type": "function", "function": TOOL}
    for given in ([TOOL], [wrapped]):
        say = lambda d, date="": value(spark, tools.tool_prompts(d, F.col("text"), date), text=json.dumps(given))  # noqa: E731, B023
        assert say("default") == tools.PROMPTS["default"].replace("{tools}", "> Tool Name: test_tool\nTool Description: tool_desc\nTool Args:\n  - foo (string, required): foo_desc\n  - bar (number): bar_desc\n\n").replace("{names}", "test_tool")
        assert say("list") == f"[AVAILABLE_TOOLS] {json.dumps([wrapped])}[/AVAILABLE_TOOLS]"
        assert say("parameters", "01 Jan 2025").endswith(f"Do not use variables.\n\n{json.dumps(wrapped, indent=4)}\n\n") and "Today Date: 01 Jan 2025" in say("parameters", "01 Jan 2025")
        assert f"<tools>\n{json.dumps(wrapped)}\n</tools>" in say("tagged") and f"<tools>\n{json.dumps(wrapped)}\n</tools>" in say("keyed")
        assert say("named").endswith(f"## test_tool\n\n{json.dumps(TOOL, indent=4)}\n{tools.NAMED_NOTE}")
    for text, want in (("[]", ""), ("{", None), ("[1]", None), (None, None)):
        assert value(spark, tools.tool_prompts("default", F.col("text")), text=text) == want
    with pytest.raises(ValueError):
        tools.tool_prompts("other", F.col("text"))


def test_slots(spark):
    row = {"text": "Hi {{content}}"}
    assert value(spark, tools.slots(["\n", {"eos"}]), **row) == ["\n", "<eos>"]
    assert value(spark, tools.slots([{"token": "bos"}, "Human: {{content}} {{content}}\n{{role}}"], content=F.col("text"), role=F.lit("r")), **row) == ["<bos>", "Human: Hi {{content}} {{content}}\nr"]
    with pytest.raises(ValueError):
        tools.slots(["{{content}}"])
    with pytest.raises(ValueError):
        tools.slots(["plain"], content=F.col("text"))
    calls = '<think>hm</think>[{"name": "f", "arguments": {"a": 1}}, {"name": "g", "arguments": {}}]'
    assert value(spark, tools.function_slots(["{{content}}", {"eos"}], "default", F.col("text")), text=calls) == ["<think>hm</think>Action: f\nAction Input: {\"a\":1}\nAction: g\nAction Input: {}", "<eos>"]
    assert value(spark, tools.function_slots(["{{content}}"], "list", F.col("text")), text='{"name": "f", "arguments": {}}') == ['[{"name": "f", "arguments": {}}]']


def test_last_code_and_input(spark):
    code = lambda t: value(spark, X.last_code(F.col("text")), text=t)
    assert code("```python\na\n``` ```python\nb\n```") == "b" and code("```python a") is None and code("none ```") is None and code(None) is None and code("```python```") == ""
    assert answers.last_input('{"input": 1} {"input": [2]} {"x"') == [2] and answers.last_input('{"a": 1}') is None
    assert answers.last_input("no") is answers.MISSING and answers.last_input(None) is answers.MISSING


def test_long_traces_say_what_they_leave_out():
    def kernel(n):
        out = "x" * n
        for _ in range(n):
            out += ""
        return out

    said = traces.traced(kernel, 300, most_lines=10, most_chars=20).split("\n")
    assert said[0] == ">>> Call to kernel" and "more)" in "".join(said[1:4]) and said[-2].startswith("... ") and said[-2].endswith(" more steps")
    assert said[-1] == f"{traces.DONE} {'x' * 300!r}" and len(said) == 13
