"""Queries on tool calls, tool descriptions and slots, over whole conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from losslens.operators import languages, templates, tools
from losslens.plans.registry import query

#: One to three calls of each turn; a name of its own and the text as an argument.
CALLS_SQL = "list_transform(range(1 + conv_id % 3), lambda i: {'n': 'tool_' || role || i, 'a': to_json({'said': text, 'turn': turn + i})::VARCHAR})"
OBJECTS_SQL = """list_transform(calls, lambda c: '{"name": "' || c.n || '", "FIELD": ' || c.a || '}')"""
SAID_SQL = {
    "default": "list_aggregate(list_transform(calls, lambda c: 'Action: ' || c.n || chr(10) || 'Action Input: ' || c.a), 'string_agg', chr(10))",
    "list": "'[' || list_aggregate(" + OBJECTS_SQL.replace("FIELD", "arguments") + ", 'string_agg', ', ') || ']'",
    "parameters": "CASE WHEN len(calls) = 1 THEN '' ELSE '[' END || list_aggregate(" + OBJECTS_SQL.replace("FIELD", "parameters") + ", 'string_agg', ', ') || CASE WHEN len(calls) = 1 THEN '' ELSE ']' END",
    "tagged": "list_aggregate(list_transform(" + OBJECTS_SQL.replace("FIELD", "arguments") + ", lambda o: '<tool_call>' || chr(10) || o || chr(10) || '</tool_call>'), 'string_agg', chr(10))",
    "keyed": "list_aggregate(list_transform(calls, lambda c: '<tool_call>' || c.n || chr(10) || '<arg_key>said</arg_key>' || chr(10) || '<arg_value>' || text || '</arg_value>' || chr(10) || '<arg_key>turn</arg_key>' || chr(10) || '<arg_value>' || (c.a->>'turn') || '</arg_value>' || chr(10) || '</tool_call>'), 'string_agg', chr(10))",
}
DIALECT_SQL = " ".join(f"WHEN '{d}' THEN {s}" for d, s in SAID_SQL.items())


@query("X44 X45", f"""WITH c AS (SELECT *, {CALLS_SQL} AS calls FROM conversations), d AS (SELECT c.*, dialect FROM c, (VALUES {", ".join(f"('{d}')" for d in SAID_SQL)}) v(dialect))
SELECT conv_id, turn, dialect, sha256(CASE dialect {DIALECT_SQL} END) AS said_sha256, len(calls)::BIGINT AS n_calls, list_aggregate(list_transform(calls, lambda c: c.n), 'string_agg', ',') AS names, sha256(list_aggregate(list_transform(calls, lambda c: c.a->>'said'), 'string_agg', chr(10))) AS arguments_sha256 FROM d""", "conversations")
def tool_call_round_trips(conversations):
    """One to three calls of each turn written in each dialect and read back: names, and the texts in the arguments."""
    step = F.sequence(F.lit(0).cast("long"), F.col("conv_id") % 3)
    arguments = lambda i: F.to_json(F.struct(F.col("text").alias("said"), (F.col("turn") + i).alias("turn")))
    calls = F.transform(step, lambda i: F.struct(F.concat(F.lit("tool_"), "role", i.cast("string")).alias("name"), arguments(i).alias("arguments")))
    rows = conversations.select("conv_id", "turn", calls.alias("calls"))
    written = [F.struct(F.lit(d).alias("dialect"), tools.call_text(d, F.col("calls")).alias("said")) for d in SAID_SQL]
    said = rows.select("conv_id", "turn", F.explode(F.array(*written)).alias("w")).select("conv_id", "turn", "w.*")
    back = F.lit(None).cast(tools.CALLS)
    for d in SAID_SQL:
        back = F.when(F.col("dialect") == d, tools.read_calls(d, F.col("said"))).otherwise(back)
    texts = F.transform("back", lambda c: F.get_json_object(c["arguments"], "$.said"))
    return said.withColumn("back", back).select("conv_id", "turn", "dialect", F.sha2("said", 256).alias("said_sha256"), F.size("back").cast("long").alias("n_calls"), F.array_join(F.transform("back", lambda c: c["name"]), ",").alias("names"), F.sha2(F.array_join(texts, "\n"), 256).alias("arguments_sha256"))


@query("X44", """WITH t AS (SELECT doc_id, 'find_' || lang AS name, 'Texts of ' || source || '.' AS about, n_chars FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
l AS (SELECT doc_id, 'default' AS dialect, 'You have access to the following tools:' || chr(10) || '> Tool Name: ' || name || chr(10) || 'Tool Description: ' || about || chr(10) || 'Tool Args:' || chr(10) || '  - text (string, required): ' || n_chars || ' characters' || chr(10) || '  - kind (array): , should be one of [a, b], where each item should be string' || chr(10) || chr(10)
  || 'Use the following format if using a tool:' || chr(10) || '```' || chr(10) || 'Action: tool name (one of [' || name || '])' || chr(10) || 'Action Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{"input": "hello world", "num_beams": 5}```)' || chr(10) || '```' || chr(10) AS said FROM t
UNION ALL SELECT doc_id, 'list', '[AVAILABLE_TOOLS] [{"type": "function", "function": {"name": "' || name || '", "description": "' || about || '", "parameters": {"type": "object", "properties": {"text": {"type": "string", "description": "' || n_chars || ' characters"}, "kind": {"type": "array", "enum": ["a", "b"], "items": {"type": "string"}}}, "required": ["text"]}}}][/AVAILABLE_TOOLS]' FROM t)
SELECT doc_id, dialect, sha256(said) AS said_sha256 FROM l""", "documents")
def tool_descriptions(documents):
    """A tool of each document described in two dialects."""
    rows = documents.where("lang IS NOT NULL AND source IS NOT NULL")
    kind = lambda name: F.lit(name).alias("type")
    text = F.struct(kind("string"), F.concat(F.col("n_chars").cast("string"), F.lit(" characters")).alias("description"))
    some = F.struct(kind("array"), F.array(F.lit("a"), F.lit("b")).alias("enum"), F.struct(kind("string")).alias("items"))
    given = F.struct(kind("object"), F.struct(text.alias("text"), some.alias("kind")).alias("properties"), F.array(F.lit("text")).alias("required"))
    tool = F.struct(F.concat(F.lit("find_"), "lang").alias("name"), F.concat(F.lit("Texts of "), "source", F.lit(".")).alias("description"), given.alias("parameters"))
    rows = rows.select("doc_id", F.to_json(F.array(tool)).alias("tools"))
    out = [F.struct(F.lit(d).alias("dialect"), F.sha2(tools.tool_prompts(d, F.col("tools")), 256).alias("said_sha256")) for d in ("default", "list")]
    return rows.select("doc_id", F.explode(F.array(*out)).alias("o")).select("doc_id", "o.*")


@query("X44", """SELECT conv_id, turn, sha256('<bos>' || 'Human: ' || text || chr(10) || 'Again: {{content}} ' || role) AS filled_sha256 FROM conversations""", "conversations")
def filled_slots(conversations):
    """Slots with tokens, a text filled once for each name, and what is left of a second placeholder."""
    parts = tools.slots([{"bos"}, "Human: {{content}}\nAgain: {{content}} {{role}}"], content=F.col("text"), role=F.col("role"))
    return conversations.select("conv_id", "turn", F.sha2(F.array_join(parts, ""), 256).alias("filled_sha256"))


BOS, EOS = "<s>", "</s>"
#: Templates that are compared; their default system texts stand where a conversation has none.
NAMES = sorted(templates.TEMPLATES)


def _form_sql(form: str, value: str) -> str:
    """SQL of a form with a value in it."""
    quoted = ["'" + part.replace("'", "''") + "'" for part in form.split("{{content}}")]
    return "(" + f" || {value} || ".join(quoted) + ")"


def _rendered_sql(name: str) -> str:
    t = templates.with_marks(templates.TEMPLATES[name], BOS, EOS)
    default = "'" + t.default_system.replace("'", "''") + "'" if t.default_system else "NULL"
    head = f"coalesce({_form_sql(t.system, f'coalesce(system, {default})')}, '')"
    user = f"CASE WHEN i = 1 THEN {head} ELSE '' END || text" if t.inside else "text"
    turns = f"string_agg(CASE role WHEN 'user' THEN {_form_sql(t.user, f'({user})')} ELSE {_form_sql(t.assistant, 'text')} END, '' ORDER BY i)"
    prefix = "'" + t.prefix.replace("'", "''") + "'"
    return f"SELECT conv_id, '{name}' AS template, sha256({prefix} || {'' if t.inside else f'any_value({head}) || '}{turns}) AS text_sha256 FROM said GROUP BY conv_id"


@query("X43", "WITH s AS (SELECT conv_id, max(text) FILTER (role = 'system' AND turn = 0) AS system FROM conversations GROUP BY conv_id), said AS (SELECT c.conv_id, role, text, system, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS i FROM conversations c JOIN s ON s.conv_id = c.conv_id WHERE role IN ('user', 'assistant')), r AS (" + " UNION ALL ".join(map(_rendered_sql, NAMES)) + ") SELECT conv_id, template, language, text_sha256 FROM r, (VALUES ('jinja'), ('ollama')) l(language)", "conversations")
def evaluated_templates(conversations):
    """Each conversation by each template as written in two template languages, which are read and evaluated."""
    said = F.struct("turn", "role", F.col("text").alias("content"))
    chats = conversations.where("role IN ('user', 'assistant') OR (role = 'system' AND turn = 0)").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("m"))
    chats = chats.where(F.exists("m", lambda x: x["role"] != "system"))
    chat = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    rows = chats.select("conv_id", chat.alias("messages"))
    system = F.when(F.get("messages", F.lit(0))["role"] == "system", F.get("messages", F.lit(0))["content"])
    rows = rows.select("conv_id", "messages", system.alias("system"), F.filter("messages", lambda x: x["role"] != "system").alias("turns"))
    made = []
    for name in NAMES:
        jinja = languages.Jinja(templates.to_jinja(name, BOS, EOS)).over(F.col("messages"))
        default = F.lit(templates.TEMPLATES[name].default_system)
        ollama = languages.ModelFile(templates.to_ollama(name, BOS, EOS)).over(F.col("turns"), F.coalesce("system", default))
        made += [F.struct(F.lit(name).alias("template"), F.lit(k).alias("language"), F.sha2(v, 256).alias("text_sha256")) for k, v in (("jinja", jinja), ("ollama", ollama))]
    return rows.select("conv_id", F.explode(F.array(*made)).alias("t")).select("conv_id", "t.*")
