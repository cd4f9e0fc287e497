"""Chat templates as column expressions, tool-call dialects, and transcripts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from losslens.operators import mixing
from losslens.sources.saved import numbered, saved


@dataclass(frozen=True)
class Template:
    """Text around each role's content; ``{{bos}}`` and ``{{eos}}`` stand for a tokenizer's marks.

    ``system`` stands before the first turn, or inside the first user turn
    before its content if ``inside``.  Observations without a form of their own
    are formatted as user turns, function calls as answers.
    """

    user: str = "{{content}}"
    assistant: str = "{{content}}{{eos}}"
    system: str = "{{content}}"
    prefix: str = ""
    default_system: str = ""
    observation: str = ""
    function: str = ""
    inside: bool = False


TEMPLATES: dict[str, Template] = {}


def register(name: str, template: Template) -> None:
    if name in TEMPLATES:
        raise ValueError(f"template {name} is there already")
    TEMPLATES[name] = template


# The formats of common templates.
register("default", Template("Human: {{content}}{{eos}}\nAssistant:", "{{content}}{{eos}}\n", "System: {{content}}{{eos}}\n"))
register("alpaca", Template("### Instruction:\n{{content}}\n\n### Response:\n", "{{content}}{{eos}}\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"))
register("chatml", Template("<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n", "{{content}}<|im_end|>\n", "<|im_start|>system\n{{content}}<|im_end|>\n", observation="<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n"))
register("llama3", Template("<|start_header_id|>user<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{{content}}<|eot_id|>", "<|start_header_id|>system<|end_header_id|>\n\n{{content}}<|eot_id|>", "{{bos}}", observation="<|start_header_id|>ipython<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"))
register("vicuna", Template("USER: {{content}} ASSISTANT:", default_system="A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."))
register("llama2", Template("{{bos}}[INST] {{content}} [/INST]", system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", inside=True))
register("mistral", Template("[INST] {{content}}[/INST]", " {{content}}{{eos}}", "{{content}}\n\n", "{{bos}}", observation='[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]', function="[TOOL_CALLS] {{content}}{{eos}}", inside=True))
register("gemma", Template("<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n", "{{content}}<end_of_turn>\n", "{{content}}\n\n", "{{bos}}", observation="<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n", inside=True))
register("phi", Template("<|user|>\n{{content}}<|end|>\n<|assistant|>\n", "{{content}}<|end|>\n", "<|system|>\n{{content}}<|end|>\n"))
register("phi4", Template("<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>", "{{content}}<|im_end|>", "<|im_start|>system<|im_sep|>{{content}}<|im_end|>"))
register("deepseek", Template("User: {{content}}\n\nAssistant:", system="{{content}}\n\n", prefix="{{bos}}"))
register("zephyr", Template("<|user|>\n{{content}}{{eos}}<|assistant|>\n", system="<|system|>\n{{content}}{{eos}}", default_system="You are Zephyr, a helpful assistant."))
register("glm4", Template("<|user|>\n{{content}}<|assistant|>", "\n{{content}}", "<|system|>\n{{content}}", "[gMASK]<sop>", observation="<|observation|>\n{{content}}<|assistant|>", function="{{content}}"))
register("qwen", Template("<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n", "{{content}}<|im_end|>\n", "<|im_start|>system\n{{content}}<|im_end|>\n", default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant.", observation="<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n"))
register("orion", Template("Human: {{content}}\n\nAssistant: {{eos}}", prefix="{{bos}}"))
register("starchat", Template("<|user|>\n{{content}}<|end|>\n<|assistant|>", "{{content}}<|end|>\n", "<|system|>\n{{content}}<|end|>\n"))
register("granite3", Template("<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", "{{content}}<|end_of_text|>\n", "<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n"))
register("falcon", Template("User: {{content}}\nFalcon:", "{{content}}\n"))


def with_marks(t: Template, bos: str, eos: str) -> Template:
    """The template with a tokenizer's marks put in."""
    put = lambda v: v.replace("{{bos}}", bos).replace("{{eos}}", eos) if isinstance(v, str) else v
    return Template(**{k: put(v) for k, v in vars(t).items()})


def render(name: str, chat: Column, system: Column | None = None, bos: str = "", eos: str = "") -> Column:
    """A chat (array of role, content) as the template's text; a null or empty system text gives the template's default, if it has one."""
    t = with_marks(TEMPLATES[name], bos, eos)
    fill = lambda form, x: F.replace(F.lit(form), F.lit("{{content}}"), x)
    said = F.coalesce(F.nullif(system, F.lit("")), F.lit(t.default_system)) if system is not None else F.lit(t.default_system)
    head = F.when(said != "", fill(t.system, said)).otherwise("")

    def turn(m: Column, i: Column) -> Column:
        content = F.when(i == 0, F.concat(head, m["content"])).otherwise(m["content"]) if t.inside else m["content"]
        out = F.when(m["role"] == "user", fill(t.user, content)).when(m["role"] == "assistant", fill(t.assistant, m["content"]))
        return out.when(m["role"] == "observation", fill(t.observation or t.user, m["content"])).when(m["role"] == "function", fill(t.function or t.assistant, m["content"])).otherwise(fill(t.system, m["content"]))

    turns = F.array_join(F.transform(chat, turn), "")
    return F.concat(F.lit(t.prefix), turns) if t.inside else F.concat(F.lit(t.prefix), head, turns)


def _jinja_sum(form: str, variable: str) -> str:
    """A form as a sum of quoted texts and the variable."""
    quoted = ["'" + t.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" if t else "" for t in form.split("{{content}}")]
    return " + ".join(x for pair in zip(quoted, [variable] * (len(quoted) - 1) + [""]) for x in pair if x)


def to_jinja(name: str, bos: str = "", eos: str = "") -> str:
    """The template in the language of chat templates: a leading system message, then user and assistant turns."""
    t = with_marks(TEMPLATES[name], bos, eos)
    turn = lambda role, form: f"message['role'] == '{role}' %}}{{{{ {_jinja_sum(form, 'message[' + repr('content') + ']')} }}}}"
    parts = ["{{ " + _jinja_sum(t.prefix, "") + " }}"] if t.prefix else []
    if t.default_system:
        parts.append("{% set system_message = " + _jinja_sum(t.default_system, "") + " %}")
    parts.append("{% set turns = messages %}{% if messages[0]['role'] == 'system' %}{% set system_message = messages[0]['content'] %}{% set turns = messages[1:] %}{% endif %}")
    system = "{% if system_message is defined %}{{ " + _jinja_sum(t.system, "system_message") + " }}{% endif %}"
    if t.inside:  # the first user turn's content gets the system text before it
        before, after = t.user.split("{{content}}")
        first = "{% if message['role'] == 'user' and loop.first %}{{ " + (_jinja_sum(before, "") or "''") + " }}" + system + "{{ " + _jinja_sum("{{content}}" + after, "message['content']") + " }}{% elif "
        parts.append("{% for message in turns %}" + first + turn("user", t.user) + "{% elif " + turn("assistant", t.assistant) + "{% endif %}{% endfor %}")
        return "".join(parts)
    parts.append(system)
    parts.append("{% for message in turns %}{% if " + turn("user", t.user) + "{% elif " + turn("assistant", t.assistant) + "{% endif %}{% endfor %}")
    return "".join(parts)


def to_ollama(name: str, bos: str = "", eos: str = "") -> str:
    """The template in the language of model files: ``.System`` first, then ``.Messages`` by role."""
    t = with_marks(TEMPLATES[name], bos, eos)
    fill = lambda form, variable: form.replace("{{content}}", "{{ " + variable + " }}")
    system = "{{ if .System }}" + fill(t.system, ".System") + "{{ end }}"
    if t.inside:
        before, after = t.user.split("{{content}}")
        user = before + "{{ if eq $i 0 }}" + system.replace(".System", "$.System") + "{{ end }}{{ .Content }}" + after
        return t.prefix + '{{ range $i, $_ := .Messages }}{{ if eq .Role "user" }}' + user + '{{ else if eq .Role "assistant" }}' + fill(t.assistant, ".Content") + "{{ end }}{{ end }}"
    turn = '{{ if eq .Role "user" }}' + fill(t.user, ".Content") + '{{ else if eq .Role "assistant" }}' + fill(t.assistant, ".Content") + "{{ end }}"
    return t.prefix + system + "{{ range .Messages }}" + turn + "{{ end }}"


def infer_template(one_turn: str, two_turns: str, marks: tuple[str, str, str, str] = ("{q1}", "{a1}", "{q2}", "{a2}")) -> Template:
    """The template behind two texts that an unknown one rendered: q1 and a1, then q1, a1, q2 and a2.

    What the second has beyond the first is one more turn; the first's
    beginning that isn't in that turn's user form is the prefix.
    """
    q1, a1, q2, a2 = marks
    if not two_turns.startswith(one_turn):
        raise ValueError("a longer chat doesn't go on from the shorter one")
    before, rest = two_turns[len(one_turn) :].split(q2)
    between, after = rest.split(a2)
    head = one_turn.split(q1)[0]
    if not head.endswith(before) or one_turn.split(q1)[1] != between + a1 + after:
        raise ValueError("turns differ in form")
    return Template(before + "{{content}}" + between, "{{content}}" + after, prefix=head[: len(head) - len(before)])


def tool_calls(dialect: str, calls: list[tuple[str, dict]]) -> str:
    """Tool calls as text: ``default`` (Action lines), ``json`` (an array), ``tagged`` (one tag each), ``list`` (always an array), ``parameters`` (an array with that key), ``named`` (the first call's name, then its arguments)."""
    if dialect == "default":
        return "\n".join(f"Action: {n}\nAction Input: {json.dumps(a, ensure_ascii=False)}" for n, a in calls)
    rows = [{"name": n, "arguments": a} for n, a in calls]
    if dialect == "named":
        return f"{calls[0][0]}\n{json.dumps(calls[0][1], ensure_ascii=False)}"
    if dialect == "parameters":
        rows = [{"name": n, "parameters": a} for n, a in calls]
    if dialect == "list":
        return json.dumps(rows, ensure_ascii=False)
    if dialect in ("json", "parameters"):
        return json.dumps(rows[0] if len(rows) == 1 else rows, ensure_ascii=False)
    if dialect == "tagged":
        return "\n".join(f"<tool_call>\n{json.dumps(r, ensure_ascii=False)}\n</tool_call>" for r in rows)
    raise ValueError(f"no dialect {dialect}")


def read_tool_calls(dialect: str, text: str) -> list[tuple[str, dict]] | str:
    """The calls in a text, or the text itself if it holds none."""
    try:
        if dialect == "default":
            found = [(n.strip(), json.loads(a)) for n, a in re.findall(r"Action:\s*([^\n]+)\nAction Input:\s*(.+?)(?=\s*\nAction:|\s*$)", text, re.S)]
        elif dialect == "named":
            name, arguments = text.split("\n", 1)
            found = [(name.strip(), json.loads(arguments))]
        else:
            parts = re.findall(r"<tool_call>(.*?)</tool_call>", text, re.S) if dialect == "tagged" else [text]
            rows = [r for p in parts for r in (lambda v: v if isinstance(v, list) else [v])(json.loads(p))]
            found = [(r["name"], r["parameters" if dialect == "parameters" else "arguments"]) for r in rows]
    except (ValueError, KeyError, TypeError):
        return text
    return found or text


def transcript_turns(text: Column) -> Column:
    """``Human:`` and ``Assistant:`` parts of a transcript, in order, as role and content."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)((?:Human|Assistant):.*?)(?=(?:Human|Assistant):|$)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.when(p.startswith("Human:"), "user").otherwise("assistant").alias("role"), F.btrim(F.regexp_replace(p, "^(Human|Assistant):", ""), F.lit(" \t\n\x0b\x0c\r")).alias("content")))


def few_shot(questions: DataFrame, train: DataFrame, n: int, subject: str, seed: int = 42) -> DataFrame:
    """Each question with n training rows of its subject, the same on every run; a question without a subject gets none.

    Rows are numbered by subject, and a question draws n different places over
    its subject's whole count by a seeded hash (Floyd's sampling), so any row can
    be drawn whatever the size; rows out are questions times n.  Texts are
    fetched for the drawn rows only.
    """
    keyed = train.select(subject, "id", F.xxhash64("text").alias("key"))
    placed = numbered(keyed, subject, "id", "key", name="place")
    sizes = placed.groupBy(subject).agg(F.min("place").alias("first"), F.count("*").alias("size"))
    asked = saved(questions.select("id", subject).withColumn("asked", F.monotonically_increasing_id()), "asked")
    rows = F.least(F.lit(n).cast("long"), F.col("size"))
    draw = lambda i: mixing.draw(seed, F.concat(F.col("id").cast("string"), F.lit(":"), i.cast("string"))) % (F.col("size") - rows + i + 1)
    pick = lambda got, i: F.concat(got, F.array(F.when(F.array_contains(got, draw(i)), F.col("size") - rows + i).otherwise(draw(i))))
    places = F.aggregate(F.sequence(F.lit(0).cast("long"), rows - 1), F.array().cast("array<long>"), pick)
    drawn = asked.join(sizes, subject).select("asked", F.col("first"), F.posexplode(places).alias("i", "at")).select("asked", "i", (F.col("first") + F.col("at")).alias("place"))
    wanted = saved(drawn.join(placed, "place").select("asked", "i", "id", "key"), "wanted")
    texts = train.select("id", "text", F.xxhash64("text").alias("key")).join(wanted, ["id", "key"]).groupBy("asked", "i").agg(F.min("text").alias("text"))
    found = texts.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("got"))
    none = F.array().cast("array<string>")
    return asked.join(found, "asked", "left").select("id", F.coalesce(F.transform("got", lambda x: x["text"]), none).alias("shots"))


def padded(ids: Column, most: Column, pad: int) -> Column:
    """The array with ``pad`` up to ``most`` entries."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(most - F.size(ids), F.lit(0))))


def masked_labels(ids: Column, learned: Column) -> Column:
    """-100 where ``learned`` is false."""
    return F.zip_with(ids, learned, lambda x, keep: F.when(keep, x).otherwise(-100))


def mask_lengths(mask: Column) -> Column:
    """Run lengths of the sequences in a packed attention mask (numbers from 1, 0 is padding)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(mask), F.lit(1))), lambda i: F.size(F.filter(mask, lambda x: x == i)))
