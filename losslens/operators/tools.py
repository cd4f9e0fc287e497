"""Tool calls and tool descriptions in the dialects of chat templates, and slots that contents are put into."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calls are an array of these; arguments are JSON texts.
CALLS = "array<struct<name:string,arguments:string>>"
#: default: Action lines; list: a JSON array; parameters: an object, or an array of several; tagged: an element each; named: name and arguments on lines of their own, one call only; keyed: an element each with its arguments as elements.
DIALECTS = ("default", "list", "parameters", "tagged", "named", "keyed")
#: What a dialect calls the arguments of a call.
FIELD = {"list": "arguments", "tagged": "arguments", "parameters": "parameters"}
PLACEHOLDER = re.compile(r"\{\{([a-zA-Z_][a-zA-Z0-9_]*)\}\}")


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def call_text(dialect: str, calls: Column) -> Column:
    """Calls as the text of an assistant's message; no calls give an empty text, several in a dialect that has one only are an error."""
    if dialect == "default":
        return F.array_join(F.transform(calls, lambda c: F.concat(F.lit("Action: "), c["name"], F.lit("\nAction Input: "), c["arguments"])), "\n")
    if dialect == "named":
        one = F.concat(F.get(calls, F.lit(0))["name"], F.lit("\n"), F.get(calls, F.lit(0))["arguments"])
        return F.when(F.size(calls) > 1, F.raise_error(F.lit("this dialect has one call only")).cast("string")).when(F.size(calls) == 0, "").otherwise(one)
    if dialect == "keyed":
        pairs = lambda c: F.map_entries(F.from_json(c["arguments"], "map<string,string>"))
        element = lambda p: F.concat(F.lit("\n<arg_key>"), p["key"], F.lit("</arg_key>\n<arg_value>"), p["value"], F.lit("</arg_value>"))
        return F.array_join(F.transform(calls, lambda c: F.concat(F.lit("<tool_call>"), c["name"], F.array_join(F.transform(pairs(c), element), ""), F.lit("\n</tool_call>"))), "\n")
    objects = F.transform(calls, lambda c: F.concat(F.lit('{"name": '), quoted(c["name"]), F.lit(f', "{FIELD[dialect]}": '), c["arguments"], F.lit("}")))
    if dialect == "tagged":
        return F.array_join(F.transform(objects, lambda o: F.concat(F.lit("<tool_call>\n"), o, F.lit("\n</tool_call>"))), "\n")
    array = F.concat(F.lit("["), F.array_join(objects, ", "), F.lit("]"))
    return array if dialect == "list" else F.when(F.size(calls) == 1, F.get(objects, F.lit(0))).otherwise(array)


def _json(text: Column) -> Column:
    """A JSON text in one form, null if it is none."""
    return F.to_json(F.try_parse_json(text))


def _whole(calls: Column) -> Column:
    """The calls if there are some and each has a name and arguments, else null."""
    return F.when((F.size(calls) > 0) & F.forall(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull()), calls)


def read_calls(dialect: str, text: Column) -> Column:
    """The calls in a text (``CALLS``, arguments without spaces between their parts), null if it holds none or a part of it isn't a call."""
    both = lambda name, arguments: F.struct(F.trim(name).alias("name"), arguments.alias("arguments"))
    if dialect == "default":
        action = r"(?s)Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*$)"
        names, inputs = (F.regexp_extract_all(text, F.lit(action), F.lit(i)) for i in (1, 2))
        bare = lambda a: F.btrim(F.btrim(F.btrim(a, F.lit(" \t\n\r")), F.lit('"')), F.lit("`"))
        return _whole(F.zip_with(names, inputs, lambda n, a: both(n, _json(bare(a)))))
    if dialect == "named":
        name = F.substring_index(text, "\n", 1)
        return F.when(F.contains(text, F.lit("\n")), _whole(F.array(both(name, _json(F.substr(text, F.length(name) + 2))))))
    if dialect == "keyed":
        elements = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
        keys, values = (lambda e, tag=tag: F.regexp_extract_all(e, F.lit(rf"(?s)<arg_{tag}>(.*?)</arg_{tag}>"), F.lit(1)) for tag in ("key", "value"))
        name = lambda e: F.nullif(F.regexp_extract(e, r"^\s*([a-zA-Z0-9_.-]+)\s*(?:<arg_key>|$)", 1), F.lit(""))
        given = lambda e: F.when(F.size(keys(e)) == F.size(values(e)), F.to_json(F.map_from_arrays(keys(e), F.slice(values(e), F.lit(1), F.size(keys(e))))))
        return _whole(F.transform(elements, lambda e: both(name(e), given(e))))
    field = FIELD[dialect]
    schema = f"array<struct<name:string,{field}:string>>"
    parsed = lambda x: F.from_json(F.when(_json(x).isNotNull(), x), schema)
    if dialect == "tagged":
        elements = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)"), F.lit(1))
        rows = F.transform(elements, lambda e: F.get(parsed(e), F.lit(0)))
    else:
        rows = parsed(text)
    return _whole(F.transform(rows, lambda r: both(r["name"], _json(r[field]))))


# How tools are described to a model, by dialect; {tools} and {names} are put in.
PROMPTS = {
    "default": 'You have access to the following tools:\n{tools}Use the following format if using a tool:\n```\nAction: tool name (one of [{names}])\nAction Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{"input": "hello world", "num_beams": 5}```)\n```\n',
    "list": "[AVAILABLE_TOOLS] {tools}[/AVAILABLE_TOOLS]",
    "parameters": 'Cutting Knowledge Date: December 2023\nToday Date: {date}\n\nYou have access to the following functions. To call a function, please respond with JSON for a function call. Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.\n\n{tools}',
    "tagged": '\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>{tools}\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>',
    "named": "你是一个名为 ChatGLM 的人工智能助手。你是基于智谱 AI 公司训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n# 可用工具{tools}",
    "keyed": "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>{tools}\n</tools>\n\nFor each function call, output the function name and arguments within the following XML format:\n<tool_call>{function-name}\n<arg_key>{arg-key-1}</arg_key>\n<arg_value>{arg-value-1}</arg_value>\n<arg_key>{arg-key-2}</arg_key>\n<arg_value>{arg-value-2}</arg_value>\n...\n</tool_call>\n",
}
NAMED_NOTE = "在调用上述函数时，请使用 Json 格式表示调用的参数。"


def described(tool: dict) -> str:
    """A tool as lines: name, description, and one line for each argument."""
    lines = []
    for name, about in tool["parameters"]["properties"].items():
        required = ", required" if name in tool["parameters"].get("required", []) else ""
        enum = f", should be one of [{', '.join(about['enum'])}]" if about.get("enum") else ""
        items = f", where each item should be {about['items'].get('type', '')}" if about.get("items") else ""
        lines.append(f"  - {name} ({about.get('type', '')}{required}): {about.get('description', '')}{enum}{items}\n")
    return f"> Tool Name: {tool['name']}\nTool Description: {tool.get('description', '')}\nTool Args:\n{''.join(lines)}\n"


def tool_prompt(dialect: str, tools_json: str, date: str = "") -> str:
    """A JSON array of tools (bare, or as ``function`` of an object) as the text that describes them; none gives an empty text."""
    tools = json.loads(tools_json)
    if not tools:
        return ""
    bare = [t.get("function", {}) if t.get("type") == "function" else t for t in tools]
    wrapped = [t if t.get("type") == "function" else {"type": "function", "function": t} for t in tools]
    dump = lambda x, indent=None: json.dumps(x, indent=indent, ensure_ascii=False)
    said = {
        "default": lambda: "".join(map(described, bare)), "list": lambda: dump(wrapped), "parameters": lambda: "".join(dump(t, 4) + "\n\n" for t in wrapped),
        "named": lambda: "".join(f"\n\n## {t['name']}\n\n{dump(t, 4)}\n{NAMED_NOTE}" for t in bare),
    }.get(dialect, lambda: "".join("\n" + dump(t) for t in wrapped))()
    form = PROMPTS[dialect].replace("{names}", ", ".join(t["name"] for t in bare)).replace("{date}", date)
    return form.replace("{tools}", said)


def tool_prompts(dialect: str, tools: Column, date: str = "") -> Column:
    """``tool_prompt`` of each row's tools; null for null and for what isn't a JSON array of tools."""
    if dialect not in PROMPTS:
        raise ValueError(f"no dialect {dialect}")

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else tool_prompt(dialect, text, date)
        except (ValueError, KeyError, TypeError, AttributeError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return run(tools)


def slots(parts: list[str | set | dict], **contents: Column) -> Column:
    """An array of a template's slots: in texts each name's first placeholder is filled; sets and dicts name tokens and stay, as ``<token>``.

    Without contents no text may have a placeholder; with contents one of them must.
    """
    texts = [p for p in parts if isinstance(p, str)]
    if bool(contents) != any(PLACEHOLDER.search(t) for t in texts):
        raise ValueError("a placeholder is required" if contents else "no placeholder is allowed here")

    def filled(text: str) -> Column:
        out, at = [], 0
        firsts = sorted((m.start(), m) for m in {m[1]: m for m in reversed(list(PLACEHOLDER.finditer(text)))}.values())
        for begin, m in firsts:
            if m[1] in contents:
                out += [F.lit(text[at:begin]), contents[m[1]].cast("string")]
                at = m.end()
        return F.concat(*out, F.lit(text[at:]))

    token = lambda p: F.lit("<" + (next(iter(p)) if isinstance(p, set) else p["token"]) + ">")
    return F.array(*[filled(p) if isinstance(p, str) else token(p) for p in parts])


def function_slots(parts: list[str | set | dict], dialect: str, content: Column) -> Column:
    """Slots with a message of calls (a JSON object, or an array of them) in the dialect; a thought before it stays in front."""
    thought = F.regexp_extract(content, r"(?s)<think>.*</think>", 0)
    rest = F.when(thought != "", F.replace(content, thought)).otherwise(content)
    calls = F.from_json(F.when(_json(rest).isNotNull(), rest), CALLS)
    return slots(parts, content=F.concat(thought, call_text(dialect, _whole(calls))))
