"""Prompt construction: task fan-out, template fill, blinding, message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from losslens.operators.evaluate import TASKS

#: Which code and which description each task shows.
TASK_CODE = {TASKS[0]: "encode", TASKS[1]: "decode", TASKS[2]: "decode", TASKS[3]: "encode"}
#: Our own template; the marks in << >> are filled in this order, so a later value may fill marks inside an earlier one.
TEMPLATE = "Problem: <<<<query>>>>\nRules: <<<<io_req>>>>\nCode: <<<<refcode>>>>\nGiven: <<<<input>>>>\nAnswer as <<<<return_type>>>>"
#: Our own forms of a solution that is run on given arguments, and of one that is traced; they are texts only, nothing runs them.
PROGRAMS = {
    "solution": "<<<<refcode>>>>\n\nprint(<<<<function>>>>(<<<<args>>>>))\n",
    "traced": "import sys\n\n<<<<refcode>>>>\n\nif __name__ == \"__main__\":\n    sys.settrace(show_step)\n    main_solution(<<<<args>>>>)\n",
}
MARKS = ["query", "io_req", "refcode", "input", "return_type"]
# The pattern of codec names that a blinded text must not show, and what stands for them.
NAMES = (
    r"(?i)\b(?:RLE|Run[- ]?Length(?: Encoding| Compression)?|"
    r"AE|Arithmetic(?: Encoding| Coding| Compression)?|"
    r"LZW|Lempel[- ]?Ziv[- ]?Welch|"
    r"Huffman(?: Coding| Encoding| Compression)?)"
    r"(?:\s+(?:compression|encoding|coding|algorithm))?\b"
)
BLIND = "a custom algorithm"


def fan_out(ios: DataFrame, kinds: list[str] = TASKS) -> DataFrame:
    """Each row once for each task, with its number and the code it shows."""
    tasks = F.array(*[F.struct(F.lit(i).alias("n_task"), F.lit(t).alias("io_pred"), F.lit(TASK_CODE[t]).alias("code")) for i, t in enumerate(kinds)])
    return ios.select("*", F.inline(tasks))


def fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for mark in MARKS:
        out = F.replace(out, F.lit(f"<<<<{mark}>>>>"), values[mark])
    return out


def program(kind: str, refcode: Column, args: Column, function: Column | None = None) -> Column:
    """The text of a program of ``kind``: code and arguments put into its form."""
    out = F.replace(F.lit(PROGRAMS[kind]), F.lit("<<<<function>>>>"), function if function is not None else F.lit("main_solution"))
    return F.replace(F.replace(out, F.lit("<<<<args>>>>"), args), F.lit("<<<<refcode>>>>"), refcode)


def blind(text: Column) -> Column:
    return F.regexp_replace(text, NAMES, BLIND)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(prompt: Column, response: Column | None = None, system: Column | None = None) -> Column:
    """Chat messages; a null system text or response is left out."""
    parts = ([F.when(system.isNotNull(), message("system", system))] if system is not None else []) + [message("user", prompt)]
    parts += [F.when(response.isNotNull(), message("assistant", response))] if response is not None else []
    return F.filter(F.array(*parts), lambda m: m.isNotNull())


def message_text(chat: Column) -> Column:
    return F.concat(F.array_join(F.transform(chat, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n"), F.lit("\nAssistant:"))
