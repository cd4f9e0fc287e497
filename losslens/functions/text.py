"""Text functions as column expressions: runs, variants, answers, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(text: Column) -> Column:
    """Runs of equal characters, in order; no shuffle and no lambda over characters."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(.)\1*"), F.lit(0))


def rle_compact(found: Column) -> Column:
    """Run-length text of an array of runs: each one's character and length."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.substring(r, 1, 1), F.length(r).cast("string"))), "")


def rle_decode(pairs: Column) -> Column:
    """The text of an array of (ch, n)."""
    return F.array_join(F.transform(pairs, lambda p: F.repeat(p["ch"], p["n"])), "")


def base64_line(data: Column) -> Column:
    """Base64 without line breaks, whatever the session's setting."""
    return F.translate(F.base64(data), "\r\n", "")


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def codepoints(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("string")), " ")


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTNRYWSKMBDHV", "TGCANYRWSMKVHDB"))


def last_answer(text: Column) -> Column:
    """The text of the last answer block, or null."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?is)\[ANSWER\](.*?)\[/ANSWER\]"), F.lit(1)), F.lit(-1)))


def collapse_braces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\{\{", "{"), r"\}\}", "}")


def estimated_tokens(text: Column, per_token: float = 4.0) -> Column:
    return F.ceil(F.length(text) / per_token)


def clamp(text: Column, most: Column | int) -> Column:
    """The text, or its beginning (a tenth of ``most``, 800 characters at most) and its end where it is longer than ``most``."""
    most = F.lit(most) if isinstance(most, int) else most
    head = F.least(F.lit(800), F.floor(most / 10).cast("int"))
    tail = most.cast("int") - head - 5
    cut = F.when(tail > 0, F.concat(F.substring(text, F.lit(1), head), F.lit("\n...\n"), F.right(text, tail))).otherwise(F.substring(text, F.lit(1), most.cast("int")))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def with_budget(rows: DataFrame, system: str, user: str, context: int, answer: int, margin: int, most_chars: int, per_token: float) -> DataFrame:
    """Rows with ``user`` clamped and ``answer_tokens`` lowered until prompt, answer and margin fit into the context, as far as they can."""
    per_token = max(0.5, per_token)
    tokens = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / per_token).cast("long")
    answer, margin = max(1, answer), max(0, margin)
    first = rows.withColumn("_b_user", clamp(F.coalesce(user, F.lit("")), most_chars)).withColumn("_b_system", tokens(F.col(system)))
    room = F.lit(context - margin)
    left = F.lit(answer) if context - answer - margin >= 0 else F.greatest(F.lit(64), room - F.col("_b_system") - tokens(F.col("_b_user")))
    second = first.withColumn("_b_answer", left.cast("long")).withColumn("_b_prompt", room - F.col("_b_answer"))
    over = F.col("_b_system") + tokens(F.col("_b_user")) > F.col("_b_prompt")
    most = F.greatest(F.lit(512), F.floor(F.greatest(F.lit(0), F.col("_b_prompt") - F.col("_b_system")) * per_token).cast("int"))
    third = second.withColumn("_b_over", over).withColumn("_b_user", F.when(over, clamp(F.col("_b_user"), most)).otherwise(F.col("_b_user")))
    need = F.col("_b_system") + tokens(F.col("_b_user"))
    last = F.when(F.col("_b_over") & (need > F.col("_b_prompt")), F.greatest(F.lit(32), room - need)).otherwise(F.col("_b_answer"))
    return third.withColumn("answer_tokens", last.cast("long")).withColumn(user, F.col("_b_user")).drop("_b_user", "_b_system", "_b_answer", "_b_prompt", "_b_over")


def is_close(found: Column, target: Column, tolerance: float = 1e-3) -> Column:
    """Numbers within a tolerance relative to the target and with equal whole parts; NaN and infinities are like nothing."""
    finite = ~(F.isnan(found) | F.isnan(target) | (F.abs(found) == float("inf")) | (F.abs(target) == float("inf")))
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return finite & (F.abs(found - target) <= tolerance * F.abs(target)) & (whole(found) == whole(target))


def scrub_addresses(trace: Column) -> Column:
    """The trace without the first object address of each line (and what repeats it there)."""
    return F.array_join(F.transform(F.split(trace, "\n", -1), lambda line: F.replace(line, F.regexp_extract(line, " at 0x[0-9a-fA-F]+", 0), F.lit(""))), "\n")


def function_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(r"\bdef\s+\w+\s*\(.*?\)")).cast("long")


def critique_verdict(critique: Column) -> Column:
    """KEEP or REVISE: the last one said as a verdict, else REVISE if the word is there at all."""
    said = F.upper(F.try_element_at(F.regexp_extract_all(critique, F.lit(r"(?i)\bVERDICT:\s*(KEEP|REVISE)\b"), F.lit(1)), F.lit(-1)))
    return F.coalesce(said, F.when(F.upper(critique).contains("REVISE"), "REVISE").otherwise("KEEP"))


def latest_task(said: Column, anchor: str = "The input and output requirements are as follows:", code: str = "[PYTHON]", before: int = 2000, most: int = 10_000) -> Column:
    """What is said from the last anchor on, from ``before`` characters ahead of the last code mark in it, clamped."""
    last = lambda t, mark: F.length(t) - F.length(F.substring_index(t, mark, -1)) - len(mark)  # noqa: E731  characters before the last mark, negative without one
    from_anchor = F.when(F.contains(said, F.lit(anchor)), F.concat(F.lit(anchor), F.substring_index(said, anchor, -1))).otherwise(said)
    at = F.greatest(F.lit(0), last(from_anchor, code) - before) + 1
    focused = F.when(F.contains(from_anchor, F.lit(code)), F.substring(from_anchor, at, F.length(from_anchor))).otherwise(from_anchor)
    return clamp(focused, most)


def truncation_budget(source: Column, target: Column, cutoff: Column) -> tuple[Column, Column]:
    """Lengths of source and target that fit into ``cutoff``: each side's share, unless one is short enough anyway."""
    short_target, short_source = target * 2 < cutoff, source * 2 < cutoff
    most_target = F.when(short_target, cutoff).when(short_source, cutoff - source).otherwise(F.floor(cutoff * (target / (source + target))).cast("long"))
    new_target = F.least(most_target, target)
    return F.greatest(F.least(cutoff - new_target, source), F.lit(0)), new_target


def strip_thought(text: Column) -> Column:
    return F.ltrim(F.regexp_replace(text, r"(?s)<think>(.*?)</think>", ""))


def duration(seconds: Column) -> Column:
    """HH:MM:SS."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def last_code(text: Column, language: str = "python") -> Column:
    """What stands in the last code block of a language, trimmed; null if there is none or it isn't closed."""
    mark = f"```{language}"
    rest = F.substring_index(text, mark, -1)
    return F.when(F.contains(text, F.lit(mark)) & F.contains(rest, F.lit("```")), F.btrim(F.substring_index(rest, "```", 1), F.lit(" \t\n\x0b\x0c\r")))


def unicode_escaped(text: Column) -> Column:
    """Printable ASCII as it is, a backslash doubled, line ends and tabs by their letters, other characters by their code points in 2, 4 or 8 hex digits."""
    known = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def one(c: Column) -> Column:
        at = F.ascii(c)
        digits = lambda mark, n: F.concat(F.lit(f"\\{mark}"), F.lower(F.lpad(F.hex(at), n, "0")))
        out = F.when(c == "\\", known["\\"])
        for plain in ("\n", "\r", "\t"):
            out = out.when(c == plain, known[plain])
        return out.when((at >= 32) & (at < 127), c).when(at < 256, digits("x", 2)).when(at < 65536, digits("u", 4)).otherwise(digits("U", 8))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")


#: How an input is written for a prompt, by name.
WRITINGS = {"raw": lambda t: t, "base64": lambda t: base64_line(F.encode(t, "UTF-8")), "hex": lambda t: hex_lower(F.encode(t, "UTF-8")), "codepoints": lambda t: codepoints(t), "unicode_escape": unicode_escaped}
