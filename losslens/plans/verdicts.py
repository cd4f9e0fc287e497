"""Queries on verdicts: fixed cases dealt over all rows of a table, and SQL that states each case's values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from losslens.functions import answers, codecs
from losslens.functions import text as X
from losslens.plans.registry import query
from losslens.session import spread
from losslens.streaming.incremental import ModelClient, repair_formats


def quoted(value) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def dealt(table: str, key: str, fields: list[str], wanted: list[tuple]) -> str:
    """SQL: each row of the table with the values of its case, the cases taken in turn."""
    rows = ", ".join(f"({i}, " + ", ".join(map(quoted, w)) + ")" for i, w in enumerate(wanted))
    return f"WITH w(n, {', '.join(fields)}) AS (VALUES {rows}) SELECT {key}, {', '.join(f'w.{f}' for f in fields)} FROM {table} JOIN w ON w.n = {key} % {len(wanted)}"


def cases(rows: DataFrame, key: str, made: list[tuple], fields: list[str], judge) -> DataFrame:
    """Each row's case, judged where the row is; ``judge`` takes a case's parts."""

    @F.pandas_udf("struct<" + ", ".join(f"{f}:string" for f in fields) + ">")
    def run(number: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(*made[n % len(made)]) for n in number], columns=fields, dtype=object)

    return rows.select(key, run(key).alias("r")).select(key, "r.*")


RUNS = {"input": "AAB", "output": [["A", 2], ["B", 1]]}
CODES = {"input": "UU", "output": [85, 256]}
POINT = {"input": "HELLO", "output": 0.2275203}
#: What is said, the task, the codec, the truth; then status, message and predicted value.
VERDICTS = [
    (('so [ANSWER]{"output": [["A", 2], ["B", 1]]}[/ANSWER]', "output_prediction", "rle", RUNS), ("correct", "Correct output_prediction!", '[["A", 2], ["B", 1]]')),
    (('{"output": [["A", 1], ["A", 1], ["B", 1.0]]}', "output_prediction", "rle", RUNS), ("correct", "Correct output_prediction (semantic: non-canonical RLE decodes correctly)!", '[["A", 1], ["A", 1], ["B", 1]]')),
    (('{"output": [["A", 0]]}', "output_prediction", "rle", RUNS), ("wrong", "RLE output: element 0 second item must be positive int", '[["A", 0]]')),
    (('{"output": "[[\'A\', 3]]"}', "output_prediction", "rle", RUNS), ("wrong", "[Mismatch] output_prediction is not correct!", '[["A", 3]]')),
    (("[ANSWER]{'output': [85, 256.0],}[/ANSWER]", "output_prediction", "lzw", CODES), ("correct", "Correct output_prediction!", "[85, 256]")),
    (('{"output": [85.7, 256]}', "output_prediction", "lzw", CODES), ("wrong", "LZW output: element 0 is not an int (got float)", "[85.7, 256]")),
    (('{"output": "abc"}', "output_prediction", "lzw", CODES), ("wrong", "LZW output: expected list[int], got str", '"abc"')),
    (('{"foo": 3}', "output_prediction", "lzw", CODES), ("wrong", "LZW output: expected list[int], got dict", '{"foo": 3}')),
    (('{"output": null}', "output_prediction", "lzw", CODES), ("no answer", "LZW output: expected list[int], got NoneType", None)),
    (("I can't tell.", "output_prediction", "lzw", CODES), ("no answer", "Failed to extract a complete JSON from model output!", '"no answer"')),
    (("don't say: {'output': 'U{U'} or {'output': 'UU'}", "input_prediction", "lzw", CODES), ("correct", "Correct input_prediction!", '"UU"')),
    (('draft {"output": "x"} then {"OUTPUT": {"compressed": "UU"}}', "input_prediction", "lzw", CODES), ("correct", "Correct input_prediction!", '"UU"')),
    (('cut off {"output": "UU', "input_prediction_inversion", "lzw", CODES), ("correct", "Correct input_prediction_inversion!", '"UU"')),
    (('{"output": "HELLOEOF"}', "input_prediction", "ae", POINT), ("correct", "Correct input_prediction (semantic: spurious trailing EOF stripped)!", '"HELLOEOF"')),
    (('{"output": 0.2275}', "input_prediction", "ae", POINT), ("wrong", "[Mismatch] input_prediction is not correct!", '"0.2275"')),
    (('{"output": "Fraction(91, 400)"}', "output_prediction", "ae", POINT), ("correct", "Correct output_prediction!", '"Fraction(91, 400)"')),
    (('{{"output": 0.3}}', "output_prediction", "ae", POINT), ("wrong", "[Mismatch] output_prediction is not correct!", "0.3")),
    (('{"output": [0.3]}', "output_prediction", "ae", POINT), ("wrong", "AE output: expected number or string, got list", "[0.3]")),
    (('{"output": [1, 2]}', "output_prediction", "huffman", {"output": [1, 2]}), ("correct", "Correct output_prediction!", "[1, 2]")),
    (('{"output": [[1, 2], {"a": "0"}, 3]}', "output_prediction", "huffman", {"output": [[1, 2], {"a": "0"}, 3]}), ("correct", "Correct output_prediction!", '[[1, 2], {"a": "0"}, 3]')),
    (('{"output": 7}', "output_prediction", "huffman", {"output": [[1], {}, 0]}), ("wrong", "Huffman output (tupled): expected list with first element list[int]", "7")),
    (('{"output": 1}', "output_prediction", "huffman", {"output": "x"}), ("no answer", "Ground-truth output has wrong type (dataset issue?): Huffman ground-truth: expected list, got str", None)),
    (('{"output": 1}', "output_prediction", "ae", {"output": "x"}), ("no answer", "Ground-truth output has wrong type (dataset issue?): AE ground-truth: expected number, got str", None)),
    (('{"output": "UU"}', "input_prediction", "lzw", {"input": 5}), ("no answer", "Ground-truth input is not a string (dataset issue?)", None)),
    (('{"output": 1}', "output_prediction", "zip", {"output": 1}), ("no answer", "Unknown algo 'zip' for validation", "1")),
]


@query("X1 X2 X3 X4 X5 X7 X11 X12 X15 X16 X17 X18 C20 D5", dealt("labels", "doc_id", ["status", "message", "predicted"], [w for _, w in VERDICTS]), "labels")
def verdict_cases(labels):
    """Every branch of the verdict: extraction, repair, shapes of answers and of truths, fallbacks, messages."""

    def judge(*case):
        found = answers.check(*case)
        return found.status, found.message, found.predicted

    return cases(labels, "doc_id", [c for c, _ in VERDICTS], ["status", "message", "predicted"], judge)


def said(value: str) -> str:
    return json.dumps({"output": value})


#: Codec, writing, what is said, the truth; then the status.
WRITINGS = [
    (("huffman", "base64", said(" qg== "), "qg=="), "correct"), (("huffman", "base64", said("q"), "qg=="), "no answer"), (("huffman", "base64", said("qw=="), "qg=="), "wrong"),
    (("huffman", "hex", said("AA00"), "aa00"), "correct"), (("huffman", "hex", said("xyz"), "aa00"), "no answer"), (("huffman", "hex", said("aa01"), "aa00"), "wrong"),
    (("huffman", "spaced_decimal", said("170  0"), "170 0"), "correct"), (("huffman", "spaced_decimal", said("170 256"), "170 0"), "no answer"), (("huffman", "spaced_decimal", said("170"), "170 0"), "wrong"),
    (("huffman", "char_hex", said("A a 0 0"), "a a 0 0"), "correct"), (("huffman", "char_hex", said("aa 00"), "a a 0 0"), "no answer"), (("huffman", "char_hex", said("a a 0"), "a a 0 0"), "wrong"),
    (("huffman", "binary", said("10101010 00000000"), "10101010 00000000"), "correct"), (("huffman", "binary", said("1010"), "10101010"), "no answer"), (("huffman", "binary", said("10101011"), "10101010"), "wrong"),
    (("lzw", "csv", said("85, 256"), "85,256"), "correct"), (("lzw", "csv", said("85;256"), "85,256"), "no answer"), (("lzw", "csv", said("85,257"), "85,256"), "wrong"),
    (("lzw", "spaced", said("85   256"), "85 256"), "correct"), (("lzw", "spaced", said("85,256"), "85 256"), "no answer"), (("lzw", "spaced", said("85"), "85 256"), "wrong"),
    (("rle", "compact", said("U8A3"), "U8A3"), "correct"), (("rle", "compact", said("?!"), "U8A3"), "no answer"), (("rle", "compact", said("U8A4"), "U8A3"), "wrong"),
    (("rle", "spaced", said("U 8 A 3"), "U 8 A 3"), "correct"), (("rle", "spaced", said("U 8 A"), "U 8 A 3"), "no answer"), (("rle", "spaced", said("U 8 A 4"), "U 8 A 3"), "wrong"),
    (("ae", "fraction", said("Fraction(28, 29)"), "28/29"), "correct"), (("ae", "fraction", said("28 over 29"), "28/29"), "no answer"), (("ae", "fraction", said("27/29"), "28/29"), "wrong"),
    (("ae", "octal", said("1"), "1"), "no answer"), (("lzw", "csv", "nothing", "1"), "no answer"), (("lzw", "csv", said("1"), None), "no answer"),
]


@query("X19 X20 X21 P13", dealt("labels", "doc_id", ["status"], [(w,) for _, w in WRITINGS]), "labels")
def writing_cases(labels):
    """The ten alternative writings: an equal value written otherwise, one that can't be read, and another value."""
    return cases(labels, "doc_id", [c for c, _ in WRITINGS], ["status"], lambda codec, writing, text, truth: (answers.check_writing(text, "output_prediction", codec, writing, truth).status,))


#: What is said; then the answers of the second and the third extractor as JSON (null: none).
EXTRACTED = [
    ('x ```json\n{"Output": 3}\n``` y', '{"output": 3}', None),
    ('[ANSWER]{{"output": [1, 2]}}[/ANSWER]', '{"output": [1, 2]}', None),
    ('[ANSWER]{"output": {"return": 7}}[/ANSWER]', '{"output": {"return": 7}}', "7"),
    ('first {"a": 1} then [1, {"b": "}"}]', '[1, {"b": "}"}]', "1"),
    ("it is (4, 5)", "[4, 5]", None),
    ('so \\boxed{\\{"output": 9\\}}', '{"output": 9}', None),
    ('"{\\"output\\": \\"q\\"}"', '{"output": "q"}', None),
    ('{"return": "r"} and more', '{"return": "r"}', '"r"'),
    ("```\n{\"k\": 1}\n``` {\"one\": {\"two\": 2}} {\"k\": 2.5}", '{"k": 1}', "2.5"),
    ("{'output': None, 'x': True}", '{"output": null, "x": true}', None),
    ("no answer here", None, None),
    ('[THOUGHT]{"output"[/THOUGHT]: 6}', '{"output": 6}', None),
]


@query("X8 X9", dealt("labels", "doc_id", ["fenced", "scalar"], [w for _, *w in EXTRACTED]), "labels")
def extractor_cases(labels):
    """What the extractor that looks for code fences first finds, and the one for plain values."""
    text = lambda x: None if x is answers.MISSING else json.dumps(x)
    return cases(labels, "doc_id", [(c[0],) for c in EXTRACTED], ["fenced", "scalar"], lambda t: (text(answers.extract_fenced(t)), text(answers.extract_scalar(t))))


#: Answer, truth as JSON, codec, task; then the score.
SCORES = [
    (('[ANSWER]{"output": 0.5004}[/ANSWER]', "0.5", "ae", "output_prediction"), 1), (('{"output": 0.6}', "0.5", "ae", "output_prediction"), 0),
    (('{"output": "XEOF"}', '"X"', "ae", "input_prediction"), 1), (('{"output": "XEOF"}', '"X"', "lzw", "input_prediction"), 0),
    (('{"return": [1, 2]}', '{"return": [1, 2]}', "lzw", "output_prediction"), 1), (("  Straße ", '"STRASSE"', None, None), 1), (("nope", '"yes"', None, None), 0), (('{"output": 3}', "3", "lzw", None), 1),
]


@query("X30", dealt("labels", "doc_id", ["em"], [(str(w),) for _, w in SCORES]), "labels")
def reflection_scores(labels):
    return cases(labels, "doc_id", [c for c, _ in SCORES], ["em"], lambda *case: (str(answers.reflection_score(*case)),))


#: A text; then its codebook by symbol and its bytes in hexadecimal, equal counts being joined as a heap made in one step orders them.
PREFIX_CODES = [("abracadabra", "a=0 b=111 c=101 d=100 r=110", "7ca8f8"), ("aabbc", "a=0 b=11 c=10", "3e"), ("HELLO", "E=01 H=10 L=11 O=00", "9f00"), ("zzzz", "z=0", "00"), ("", "", "")]


@query("C12 C14", dealt("labels", "doc_id", ["codebook", "bytes"], [w for _, *w in PREFIX_CODES]), "labels")
def prefix_codebooks(labels):
    return cases(labels, "doc_id", [(c[0],) for c in PREFIX_CODES], ["codebook", "bytes"], codecs.huffman_digest)


@query("X14", "SELECT event_id, (abs(a - b) <= 0.001 * abs(b) AND trunc(a) = trunc(b)) AS close FROM (SELECT event_id, value - 50 AS a, (value - 50) * (1 + (event_id % 5 - 2) * 0.0007::DOUBLE) AS b FROM events)", "events")
def close_numbers(events):
    a = F.col("value") - 50
    return events.select("event_id", X.is_close(a, a * (1 + (F.col("event_id") % 5 - 2) * F.lit(0.0007))).alias("close"))


CRITIQUES = ["fine. VERDICT: KEEP", "VERDICT: keep or Verdict: Revise", "please revise this", "all good", "VERDICT:REVISED, VERDICT: KEEP!", ""]
CRITIQUE_SQL = "list_element([" + ", ".join(map(quoted, CRITIQUES)) + f"], (event_id % {len(CRITIQUES)} + 1)::INT)"


@query("X28", rf"""WITH c AS (SELECT event_id, {CRITIQUE_SQL} AS c FROM events) SELECT event_id, coalesce(upper(regexp_extract_all(c, '(?i)\bVERDICT:\s*(KEEP|REVISE)\b', 1)[-1]), CASE WHEN contains(upper(c), 'REVISE') THEN 'REVISE' ELSE 'KEEP' END) AS verdict FROM c""", "events")
def critique_verdicts(events):
    said = F.element_at(F.array(*map(F.lit, CRITIQUES)), (F.col("event_id") % len(CRITIQUES) + 1).cast("int"))
    return events.select("event_id", X.critique_verdict(said).alias("verdict"))


@query("X26", """WITH p AS (SELECT doc_id, CASE WHEN length(text) > 8000 THEN substr(text, 1, 800) || chr(10) || '...' || chr(10) || right(text, 7195) ELSE text END AS t, ceil(length('Review. ' || lang) / 2.0)::BIGINT AS s FROM documents),
o AS (SELECT *, s + ceil(length(t) / 2.0)::BIGINT > 880 AS over, greatest(512, greatest(0, 880 - s) * 2)::BIGINT AS most FROM p),
u AS (SELECT *, CASE WHEN over AND length(t) > most THEN substr(t, 1, least(800, most // 10)) || chr(10) || '...' || chr(10) || right(t, most - least(800, most // 10) - 5) ELSE t END AS u FROM o)
SELECT doc_id, sha256(u) AS user_sha256, CASE WHEN over AND s + ceil(length(u) / 2.0)::BIGINT > 880 THEN greatest(32, 1136 - s - ceil(length(u) / 2.0)::BIGINT) ELSE 256 END::BIGINT AS answer_tokens FROM u""", "documents")
def prompt_budgets(documents):
    """Each text as a user message of 1200 tokens of context, 256 of them for the answer and 64 to spare."""
    rows = documents.select("doc_id", F.concat(F.lit("Review. "), "lang").alias("system"), F.col("text").alias("user"))
    return X.with_budget(rows, "system", "user", 1200, 256, 64, 8000, 2.0).select("doc_id", F.sha2("user", 256).alias("user_sha256"), "answer_tokens")


@query("X23", """WITH t AS (SELECT doc_id, replace(replace(text, ' the ', ' at 0x7F3a '), ' de ', ' at 0x10 at 0x1 ') AS t FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(string_split(t, chr(10)), lambda l: CASE WHEN regexp_matches(l, ' at 0x[0-9a-fA-F]+') THEN replace(l, regexp_extract(l, ' at 0x[0-9a-fA-F]+'), '') ELSE l END), chr(10))) AS scrubbed_sha256 FROM t""", "documents")
def scrubbed_traces(documents):
    trace = F.replace(F.replace("text", F.lit(" the "), F.lit(" at 0x7F3a ")), F.lit(" de "), F.lit(" at 0x10 at 0x1 "))
    return documents.select("doc_id", F.sha2(X.scrub_addresses(trace), 256).alias("scrubbed_sha256"))


@query("X25", r"SELECT doc_id, len(regexp_extract_all(replace(text, ' of ', ' def of (x, y) '), '\bdef\s+\w+\s*\(.*?\)'))::BIGINT AS functions FROM documents", "documents")
def function_counts(documents):
    return documents.select("doc_id", X.function_count(F.replace("text", F.lit(" of "), F.lit(" def of (x, y) "))).alias("functions"))


class FirstNumber(ModelClient):
    """A stand-in that brings the first number of what it is given into the answer's form, and fails on its first try."""

    failed = False

    def complete(self, prompts: list[str]) -> list[str]:
        import re

        if not self.failed:
            self.failed = True
            raise TimeoutError("busy")
        found = [re.search(r"------\n.*?(\d+)", p, re.S) for p in prompts]
        return [f'[ANSWER]\n{{"output": {m[1]}}}\n[/ANSWER]' if m else "" for m in found]


@query("D8 R4", "SELECT item_id, item_id::VARCHAR AS value, item_id % 3 <> 0 AS repaired FROM benchmark", "benchmark")
def format_repairs(benchmark):
    """Texts with a plain answer are read; the others go to the model once more, to be reformatted."""
    marked = F.concat(F.lit('[ANSWER]{"output": '), F.col("item_id").cast("string"), F.lit("}[/ANSWER]"))
    bare = F.concat(F.lit("it is "), F.col("item_id").cast("string"), F.lit(" or so\n"), "text")
    rows = benchmark.select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat("text", marked)).otherwise(bare).alias("text"))
    return repair_formats(rows, FirstNumber(), context=1_000_000, most_chars=1_000_000).select("item_id", "value", "repaired")


CODE_SQL = "CASE conv_id % 4 WHEN 0 THEN 'so ```python' || chr(10) || 'old()' || chr(10) || '``` or ```python' || chr(10) || text || chr(10) || '```.' WHEN 1 THEN '```python' || text WHEN 2 THEN text ELSE '```python ' || text || '``` and ```json {}```' END"
WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("X10", f"""WITH s AS (SELECT conv_id, turn, text, {CODE_SQL} AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 4 IN (0, 3) THEN sha256(trim(text, {WHITE_SQL})) END AS code_sha256, sha256(CASE WHEN conv_id % 3 = 0 THEN text WHEN conv_id % 3 = 1 THEN turn::VARCHAR ELSE 'none' END) AS input_sha256 FROM s""", "conversations")
def code_and_inputs(conversations):
    """The last code block of each message, and the input in its last JSON object."""
    code = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("so ```python\nold()\n``` or ```python\n"), "text", F.lit("\n```."))).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("```python"), "text")).when(F.col("conv_id") % 4 == 2, F.col("text")).otherwise(F.concat(F.lit("```python "), "text", F.lit("``` and ```json {}```")))
    given = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("input")))).when(F.col("conv_id") % 3 == 1, F.to_json(F.struct(F.col("turn").alias("input"), F.lit("{").alias("note")))).otherwise(F.lit("no object {"))
    said = F.concat(F.lit('first {"input": 0} then '), given)
    said = F.when(F.col("conv_id") % 3 == 2, F.lit("no object {")).otherwise(said)

    @F.pandas_udf("string")
    def inputs(texts: pd.Series) -> pd.Series:
        found = [answers.last_input(t) for t in texts]
        return pd.Series(["none" if x is answers.MISSING else str(x) for x in found], dtype=object)

    return conversations.select("conv_id", "turn", F.sha2(X.last_code(code), 256).alias("code_sha256"), F.sha2(inputs(said), 256).alias("input_sha256"))


@query("X1 X2 X3 X4 X5 X6 X7 X12 X13 X16 X18", """WITH k AS (SELECT conv_id, turn, CASE conv_id % 8 WHEN 0 THEN 'correct' WHEN 1 THEN 'correct' WHEN 2 THEN 'wrong' WHEN 3 THEN 'no answer' WHEN 4 THEN 'correct' WHEN 5 THEN 'correct' WHEN 6 THEN CASE WHEN reverse(text) = text THEN 'correct' ELSE 'wrong' END ELSE 'correct' END AS status, CASE WHEN conv_id % 8 IN (5, 6) THEN 'input_prediction' ELSE 'output_prediction' END AS task FROM conversations WHERE text <> '')
SELECT conv_id, turn, status, CASE WHEN status = 'no answer' THEN 'Failed to extract a complete JSON from model output!' WHEN conv_id % 8 = 7 THEN 'Correct output_prediction (semantic: non-canonical RLE decodes correctly)!' WHEN status = 'correct' THEN 'Correct ' || task || '!' ELSE '[Mismatch] ' || task || ' is not correct!' END AS message FROM k""", "conversations")
def judged_texts(conversations):
    """Answers about each turn's own text in eight forms: tagged, with a comma too many, wrong, none, in doubled braces, inputs, and split runs."""
    text_json = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")
    # the text is escaped once and then cut into characters, not each character by itself
    escaped, character = F.regexp_replace(text_json(F.col("text")), r'^"|"$', ""), r"(?s)(\\u[0-9A-Fa-f]{4}|\\.|.)"
    written = lambda c, n: F.concat(F.lit('["'), c, F.lit('", '), n.cast("string"), F.lit("]"))
    slashed = lambda r, c: written(c, (F.length(r) / F.length(c)).cast("int"))
    pair = lambda r: F.when(F.startswith(r, F.lit("\\")), slashed(r, F.regexp_extract(r, character, 1))).otherwise(written(F.substring(r, 1, 1), F.length(r)))
    pairs = F.transform(F.regexp_extract_all(escaped, F.lit(character + r"\1*"), F.lit(0)), pair)
    listed = lambda p: F.concat(F.lit("["), F.array_join(p, ", "), F.lit("]"))
    single = F.regexp_replace(escaped, character, '["$1", 1], ')
    more = F.concat(pairs, F.array(F.lit('["+", 9]')))
    kind = F.col("conv_id") % 8
    said = F.when(kind == 0, F.concat(F.lit('so [ANSWER]{"output": '), listed(pairs), F.lit("}[/ANSWER]")))
    said = said.when(kind == 1, F.concat(F.lit('{"output": '), listed(pairs), F.lit(",}"))).when(kind == 2, F.concat(F.lit('{"output": '), listed(more), F.lit("}"))).when(kind == 3, F.lit("I can't tell."))
    said = said.when(kind == 4, F.concat(F.lit('{{"output": '), listed(pairs), F.lit("}}"))).when(kind == 5, F.concat(F.lit('{"output": '), text_json(F.col("text")), F.lit("}"))).when(kind == 6, F.concat(F.lit('{"output": '), text_json(F.reverse("text")), F.lit("}")))
    said = said.otherwise(F.concat(F.lit('{"output": ['), single, F.lit('["x", 1], ["x", 1]]}')))
    task = F.when(kind.isin(5, 6), "input_prediction").otherwise("output_prediction")
    truth = F.when(kind == 7, F.concat("text", F.lit("xx"))).otherwise(F.col("text"))

    @F.pandas_udf("struct<status:string,message:string>")
    def judge(said: pd.Series, task: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [answers.check(s, k, "rle", {"input": t, "output": [list(p) for p in codecs.rle_encode(t)]}, values=False) for s, k, t in zip(said, task, text)]
        return pd.DataFrame([(v.status, v.message) for v in found], columns=["status", "message"], dtype=object)

    return spread(conversations).where("text <> ''").select("conv_id", "turn", judge(said, task, truth).alias("v")).select("conv_id", "turn", "v.*")
