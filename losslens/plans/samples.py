"""Queries that write files and scan them again, and on generated samples and training examples."""

from __future__ import annotations

import hashlib
import json
import pickle
import time

import pandas as pd
from pyspark.sql import functions as F

from losslens.functions import codecs
from losslens.functions import text as X
from losslens.operators import alignment as A
from losslens.operators import stages
from losslens.operators.evaluate import TASKS
from losslens.operators.templates import read_tool_calls, render, tool_calls
from losslens.plans.evaluation import VERIFIED_SQL, verified
from losslens.plans.registry import query
from losslens.plans.verdicts import cases, dealt
from losslens.session import spread
from losslens.sources import generators as G
from losslens.sources import scans
from losslens.sources.files import newest_snapshot, read_files
from losslens.sources.saved import fresh

SHORT = "CASE WHEN item_id % 2 = 0 THEN 'rle' ELSE 'huffman' END"


def artifacts(benchmark, folder: str) -> int:
    """Raw artifacts of the benchmark texts; every third has no sidecar."""
    counts = codecs.column(lambda t: json.dumps({c: t.count(c) for c in sorted(set(t))}, ensure_ascii=False), "string")
    algo = F.when(F.col("item_id") % 2 == 0, "rle").otherwise("huffman")
    rows = benchmark.select(F.col("item_id").alias("id"), algo.alias("algo"), F.lit("text").alias("category"), F.col("text").alias("input"), F.reverse("text").alias("output"), F.when(F.col("item_id") % 3 != 0, counts("text")).alias("sidecar"), F.lit("freq").alias("kind"))
    return scans.write_artifacts(rows, folder)


@query("S5 K5 J2", """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 0 ELSE len(list_distinct(string_split(text, '')))::BIGINT END AS symbols, '{}' AS codebook FROM benchmark""", "benchmark")
def sidecar_lookup(benchmark):
    """Artifacts written as files, then each item's sidecars found by the number in their names."""
    spark, folder = benchmark.sparkSession, fresh(benchmark.sparkSession, "raw")
    artifacts(benchmark, folder)
    found = scans.with_sidecars(benchmark.select("item_id"), "item_id", folder, "freq", "codebook")
    return found.select("item_id", F.size(F.from_json("freq", "map<string,long>")).cast("long").alias("symbols"), "codebook")


@query("K6 A9", "SELECT " + "algo, split, count(*)::BIGINT AS files FROM (SELECT item_id, " + SHORT + " AS algo, unnest(['input', 'output', CASE WHEN item_id % 3 <> 0 THEN 'output' END]) AS split FROM benchmark) WHERE split IS NOT NULL GROUP BY ALL", "benchmark")
def dataset_cards(benchmark):
    """The rows of the card's first table, read from its text."""
    spark, folder = benchmark.sparkSession, fresh(benchmark.sparkSession, "raw")
    artifacts(benchmark, folder)
    card = scans.dataset_card(spark, folder, "Raw samples")
    rows = [[c.strip(" `") for c in line.strip("|").split("|")] for line in card.split("### File Type")[0].splitlines() if line.startswith("| `")]
    return spark.createDataFrame([(a, s, int(n)) for a, s, n in rows], "algo string, split string, files long")


@query("S6 S7 F6 F7", f"""WITH {VERIFIED_SQL}, v AS (SELECT *, CASE WHEN ord % 2 = 0 THEN 'lzw' ELSE 'rle' END AS algo, 'm-' || (ord % 3) AS model FROM verified WHERE io_pred IN ('{TASKS[0]}', '{TASKS[1]}'))
SELECT algo, model, round(avg((status = 'correct')::INT::DOUBLE), 6) AS accuracy, count(*)::BIGINT AS n FROM v GROUP BY ALL""", "labels")
def verified_files(labels):
    """Verdicts written to result files by codec and model, found again by globs, codec and model read from the paths; two tasks of four."""
    spark, folder = labels.sparkSession, fresh(labels.sparkSession, "results")
    model = F.concat(F.lit("m-"), (F.col("ord") % 3).cast("string"))
    rows = verified(labels).withColumn("algo", F.when(F.col("ord") % 2 == 0, "lzw").otherwise("rle")).withColumn("model", model)
    part = F.expr("ord div 10000").cast("string")  # no file, and so no row, has more lines
    name = F.concat("algo", F.lit("/run"), part, F.lit("_gens_model_"), "model", F.lit("_temp_0.2_n5_verified.jsonl"))
    lines = rows.select(name.alias("name"), F.to_json(F.struct("io_pred", "status")).alias("line")).groupBy("name").agg(F.array_join(F.collect_list("line"), "\n").alias("content"))  # a result file each
    scans.write_named(lines.unionByName(spark.createDataFrame([("lzw/run_gens_model_m-0.jsonl", "not json\n")], "name string, content string")), folder)
    found = scans.read_verified(spark, [f"{folder}/*/*_verified.jsonl", f"{folder}/none/*.jsonl"], "io_pred string, status string")
    return found.where(F.col("io_pred").isin(TASKS[:2])).groupBy("algo", "model").agg(F.round(F.avg((F.col("status") == "correct").cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("S8 A8", """WITH d AS (SELECT CASE WHEN doc_id % 3 = 2 THEN 'local/m' ELSE 'm-' || (doc_id % 3) END AS model, text, lang FROM documents)
SELECT model, count(*)::BIGINT AS requests, sum(greatest(1, length('Say: ' || text) // 4))::BIGINT AS input_tokens, sum(greatest(1, length(lang) // 4))::BIGINT AS output_tokens FROM d WHERE NOT contains(model, '/') GROUP BY model""", "documents")
def tree_usage(documents):
    """Generations in JSON line files of folders in folders."""
    spark, folder = documents.sparkSession, fresh(documents.sparkSession, "tree")
    model = F.when(F.col("doc_id") % 3 == 2, "local/m").otherwise(F.concat(F.lit("m-"), (F.col("doc_id") % 3).cast("string")))
    said = F.array(F.struct(F.lit("Say:").alias("content")), F.struct(F.col("text").alias("content")))
    rows = documents.select(F.col("lang").alias("part"), model.alias("model"), said.alias("messages"), F.col("lang").alias("output"))
    lines = rows.select("part", F.to_json(F.struct("model", "messages", "output")).alias("value"))
    here = F.coalesce(F.col("part") == "en", F.lit(False))
    lines.where(here).select("value").write.text(f"{folder}/en/a/b")
    lines.where(~here).select("value").write.text(f"{folder}/other")
    return scans.tree_usage(spark, folder, "*.txt")


def daily_usage(documents):
    """Documents as a service's usage: ids of a hundred are a bucket, languages are models."""
    start = F.expr("doc_id div 100 * 86400")
    return documents.groupBy(start.alias("start_time"), F.col("lang").alias("model")).agg(F.count("*").alias("num_model_requests"), F.sum("n_chars").alias("input_tokens"), F.sum(F.col("doc_id") % 7).alias("output_tokens"))


def usage_of(found):
    return found.groupBy("model").agg(F.sum("requests").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("buckets"))


USAGE_SQL = """WITH b AS (SELECT doc_id // 100 AS start, lang AS model, count(*) AS requests, sum(n_chars) AS input_tokens, sum(doc_id % 7) AS output_tokens FROM documents GROUP BY ALL)
SELECT model, sum(requests)::BIGINT AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*)::BIGINT AS buckets FROM b GROUP BY model"""


@query("S9", USAGE_SQL, "documents")
def paged_usage(documents):
    """Daily usage laid out as a service's pages, read by following their cursors."""
    spark, folder = documents.sparkSession, fresh(documents.sparkSession, "pages")
    scans.write_pages(daily_usage(documents), folder)
    return usage_of(scans.read_pages(spark, client="folder", path=folder))


YAML_MODELS = """models:
  - id: click
    size: 7B
    category: api
    active: true
  - id: view
    active: yes
  - id: purchase
    size: 70
    category: local
  - size: lost
"""


@query("S10 S11 F10", "WITH m(id, size, category, active) AS (VALUES ('click', '7B', 'api', true), ('view', 'unknown', 'unknown', true), ('purchase', '70', 'local', false)) SELECT id, size, category, count(event_id)::BIGINT AS n FROM m LEFT JOIN events ON event_type = id WHERE active GROUP BY ALL", "events")
def yaml_models(events):
    """The active models of a YAML registry with their events."""
    spark, folder = events.sparkSession, fresh(events.sparkSession, "yaml")
    scans.write_named(spark.createDataFrame([("models.yaml", YAML_MODELS)], "name string, content string"), folder)
    models = scans.yaml_registry(spark, f"{folder}/models.yaml").where("active")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return models.join(counts, F.col("id") == F.col("event_type"), "left").select("id", "size", "category", F.coalesce("n", F.lit(0)).alias("n"))


@query("S16 F13", "SELECT item_id AS place, text AS prompt, reverse(text) AS response FROM benchmark", "benchmark")
def registered_dataset(benchmark):
    """A dataset named in a registry, its columns under their roles' names; ranked data isn't for this stage."""
    spark, folder = benchmark.sparkSession, fresh(benchmark.sparkSession, "datasets")
    benchmark.select("item_id", F.col("text").alias("ask"), F.reverse("text").alias("say")).write.parquet(f"{folder}/rows")
    info = {"rows": {"file_name": "rows", "columns": {"prompt": "ask", "response": "say", "place": "item_id"}}, "ranked": {"file_name": "rows", "ranking": True}, "far": {"hf_hub_url": "a/b", "file_name": "rows"}}
    scans.write_named(spark.createDataFrame([("dataset_info.json", json.dumps(info))], "name string, content string"), folder)
    return scans.load_dataset(spark, folder, "rows").select("place", "prompt", "response")


@query("S19", """SELECT conv_id, 'q2 ' || text AS instruction, 'good' AS chosen, 'bad ' || text AS rejected, 1::BIGINT AS n_history, 'a1 ' || text AS last FROM conversations WHERE turn = 0""", "conversations")
def preference_transcripts(conversations):
    """Two transcripts that differ in their last answer, as question, answers and history."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = conversations.where("turn = 0").withColumn("text", text)
    before = F.concat(F.lit("\n\nHuman: q1\n\nAssistant: a1 "), "text", F.lit("\n\nHuman: q2 "), "text", F.lit("\n\nAssistant: "))
    pair = A.preference_pair(F.concat(before, F.lit("good")), F.concat(before, F.lit("bad "), "text"))
    return rows.select("conv_id", pair.alias("p")).select("conv_id", "p.instruction", "p.chosen", "p.rejected", F.size("p.history").cast("long").alias("n_history"), F.element_at("p.history", -1)["answered"].alias("last"))


@query("S20", "SELECT chr((65 + item_id % 4)::INT) AS answer, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS question_chars FROM benchmark GROUP BY 1", "benchmark")
def choice_files(benchmark):
    """Questions written to CSV files without a header and read by their six names."""
    spark, folder = benchmark.sparkSession, fresh(benchmark.sparkSession, "choices")
    benchmark.select("text", F.lit("one, two"), F.lit('say "x"'), F.col("item_id").cast("string"), F.lit("d"), F.chr(65 + F.col("item_id") % 4)).write.options(header="false", escape='"', quoteAll="true").csv(folder)
    return scans.read_choices(spark, folder).groupBy("answer").agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("question_chars"))


@query("K9", "SELECT item_id::VARCHAR AS label, sha256(text) AS prompt_sha256, CASE WHEN item_id % 2 = 0 THEN reverse(text) END AS predict FROM benchmark", "benchmark")
def prediction_files(benchmark):
    """Predictions written as JSON lines, nulls kept."""
    spark, folder = benchmark.sparkSession, fresh(benchmark.sparkSession, "predictions")
    scans.write_predictions(benchmark.select(F.col("text").alias("prompt"), F.when(F.col("item_id") % 2 == 0, F.reverse("text")).alias("predict"), F.col("item_id").cast("string").alias("label")), folder)
    return spark.read.schema("prompt string, predict string, label string").json(folder).select("label", F.sha2("prompt", 256).alias("prompt_sha256"), "predict")


@query("G6", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'service:' || chr(10) || '  title: Lantern' || c_custkey || chr(10) || '  release: 4.0' || (c_custkey % 9 + 1) || chr(10) || '  verbose: no' || chr(10) WHEN 1 THEN 'copies: 1' || (c_custkey % 4) || chr(10) || 'picture:' || chr(10) || '  label: calm-' || (c_custkey % 3) || chr(10) ELSE 'version: 2' || (c_custkey % 3) || chr(10) || 'jobs:' || chr(10) || '  row:' || chr(10) || '    machine: small-' || c_custkey || chr(10) END AS text FROM customer", "customer")
def yaml_texts(customer):
    """Three kinds of configuration texts, numbered by customers."""
    i = F.col("c_custkey")
    text = F.when(i % 3 == 0, G.yaml_text("app_config", i)).when(i % 3 == 1, G.yaml_text("helm_values", i)).otherwise(G.yaml_text("circleci_config", i))
    return customer.select(i.alias("id"), text.alias("text"))


FIELDS = {"level": G.LEVELS, "endpoint": G.ENDPOINTS, "module": G.MODULES, "method": G.METHODS}
_PICK = {name: "list_element([" + ", ".join(f"'{v}'" for v in values) + f"], (event_id // {step} % {len(values)} + 1)::INT)" for (name, values), step in zip(FIELDS.items(), (1, 5, 30, 150))}


@query("G5", f"""WITH e AS (SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _PICK.items())}, event_id % 29 * 0.125::DOUBLE AS duration FROM events)
SELECT event_id, CASE WHEN duration > 2.5 THEN 'log_slow_request' WHEN endpoint = '/status' THEN 'log_status_check' WHEN endpoint = '/metrics' THEN 'log_metrics_request' WHEN endpoint = '/auth/login' THEN 'log_auth_login' WHEN module = 'db' AND level = 'ERROR' THEN 'log_db_error' WHEN module = 'auth' AND level IN ('WARNING', 'ERROR', 'CRITICAL') THEN 'log_auth_failure' ELSE 'log_' || lower(level) END AS category,
'[t] ' || level || ' - ' || method || ' ' || endpoint || ' by user:u in ' || duration || 's from 10.0.0.1 (' || module || ')' AS line FROM e""", "events")
def log_records(events):
    """All fields of a log line, and its category by the first rule that holds."""
    pick = lambda values, step: F.element_at(F.array(*map(F.lit, values)), (F.expr(f"event_id div {step}") % len(values) + 1).cast("int"))
    level, endpoint, module, method = (pick(v, s) for v, s in zip(FIELDS.values(), (1, 5, 30, 150)))
    duration = F.col("event_id") % 29 * F.lit(0.125)
    line = G.log_line(F.lit("t"), level, method, endpoint, F.lit("u"), duration, F.lit("10.0.0.1"), module)
    return events.select("event_id", G.log_category(level, endpoint, module, duration).alias("category"), line.alias("line"))


def _draw(n, *salt, key: str = "id") -> str:
    """SQL of ``generators.draw``."""
    return f"(('0x' || substr(md5({' || '.join([key, "':42'", *[f"':' || {s}" for s in salt]])}), 1, 13))::BIGINT % {n})"


def _pick(values: list[str], *salt) -> str:
    return f"list_element({values}, {_draw(len(values), *salt)} + 1)"


def _letters(alphabet: str, length, *salt, first: int = 1, key: str = "id") -> str:
    return f"array_to_string(list_transform(range({first}, {length} + {first}), lambda i: substr('{alphabet}', {_draw(len(alphabet), 'i', *salt, key=key)} + 1, 1)), '')"


_REPEATS = f"(CASE WHEN length(m) * 8 > 40 THEN 8 ELSE 8 + {_draw('(40 // length(m) - 7)', 5)} END)"
_CHOSEN = f"list_transform(list_sort(list_transform(range(1, 121), lambda i: {{'h': {_draw(1 << 52, 'i')}, 'i': i}}))[1:(id // 10 % 4)], lambda p: p.i)"
DNA_SQL = f"""WITH d AS (SELECT doc_id AS id, doc_id FROM documents), k AS (SELECT id, {_pick(G.MOTIFS, 1)} AS m, {_pick(G.SITES, 2)} AS site, id // 40 AS family FROM d),
s AS (SELECT *, {_letters('ACGT', 120, key='family')} AS shared, {_CHOSEN} AS chosen, {_letters('ACGT', f'(120 + {_draw(181, 6)})', 7)} AS long FROM k)
SELECT id, CASE id % 10 WHEN 0 THEN {_letters('ACGT', f'(60 + {_draw(141, 10)})', 11)} WHEN 1 THEN repeat(m, {_REPEATS}) WHEN 2 THEN site || reverse(translate(site, 'ACGT', 'TGCA'))
WHEN 3 THEN 'ATG' || array_to_string(list_transform(range(1, 21 + {_draw(41, 3)}), lambda i: {_pick(G.CODONS, 4, 'i')}), '') || {_pick(G.STOPS, 12)}
WHEN 4 THEN {_letters('ACGT', 20, 13)} || repeat({_pick(G.SATELLITES, 14)}, 6 + {_draw(15, 15)}) || {_letters('ACGT', 20, 16)}
WHEN 5 THEN array_to_string(list_transform(string_split(shared, ''), lambda c, i: CASE WHEN list_contains(chosen, i) THEN substr(replace('ACGT', c, ''), {_draw(3, '(i - 1)')} + 1, 1) ELSE c END), '')
WHEN 6 THEN repeat('G', 6 + {_draw(9, 17)}) || {_letters('GC', 10, 18)} || {_letters('ACGT', 60, 19)} || {_letters('GC', 10, 20)} || repeat('C', 6 + {_draw(9, 21)})
WHEN 7 THEN '>seq_' || (id // 10) || chr(10) || array_to_string(regexp_extract_all(long, '.{{1,60}}'), chr(10))
WHEN 8 THEN repeat({_pick(G.REPEATED, 22)}, 20 + {_draw(101, 23)})
ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, 11 + {_draw(41, 9)}), lambda i: array_to_string(list_transform(range(1, 4 + {_draw(4, 8)}), lambda j: substr('ACGT', {_draw(4, 'i', 'j')} + 1, 1)), '')))), '') END AS text FROM s"""


@query("G1 G3", DNA_SQL, "documents")
def generated_dna(documents):
    """A DNA-like text for each document's id, ten categories in turn."""
    return G.dna(spread(documents.select(F.col("doc_id").alias("id")))).select("id", "text")


def _table(mark: str, cell: str, headers: int) -> str:
    names = f" || {mark} || ".join(f"'col{i}'" for i in range(1, 6))
    return " || ".join([f"{names} || chr(10)"] * headers) + f" || array_to_string(list_transform(range(5), lambda r: array_to_string(list_transform(range(5), lambda c: {cell}), {mark})), chr(10))"


_AT = "(r * 5 + c)"
_SMALL = "array_to_string(list_transform(range(1, LENGTH + 1), lambda i: substr('ALPHABET', DRAW + 1, 1)), '')"
_CELLS = {
    "numeric": f"{_draw(1001, 40, _AT)}::VARCHAR", "alphanumeric": f"{_draw(1001, 40, _AT)}::VARCHAR",
    "mixed_types": f"CASE {_draw(3, 41, _AT)} WHEN 0 THEN {_draw(501, 42, _AT)}::VARCHAR WHEN 1 THEN {_pick(['TRUE', 'FALSE', 'NULL'], 43, _AT)} ELSE " + _SMALL.replace("LENGTH", "4").replace("ALPHABET", G.SMALL).replace("DRAW", _draw(26, "i", 44, _AT)) + " END",
    "repeated_header": _SMALL.replace("LENGTH", "3").replace("ALPHABET", G.CAPITALS + G.SMALL).replace("DRAW", _draw(52, "i", 47, _AT)),
    "sparse": f"CASE WHEN {_draw(5, 45, _AT)} = 0 THEN {_draw(101, 46, _AT)}::VARCHAR ELSE '' END",
}
_KINDS = [(name, kind) for name in ("csv", "tsv") for kind in _CELLS]
TABLES_SQL = "WITH d AS (SELECT doc_id AS id FROM documents) SELECT id, CASE id % 10 " + " ".join(f"WHEN {i} THEN 'tabular_{name}_{kind}'" for i, (name, kind) in enumerate(_KINDS)) + " END AS category, sha256(CASE id % 10 " + " ".join(f"WHEN {i} THEN " + _table("','" if name == "csv" else "chr(9)", _CELLS[kind], 2 if kind == "repeated_header" else 1) for i, (name, kind) in enumerate(_KINDS)) + " END) AS text_sha256 FROM d"


@query("G7", TABLES_SQL, "documents")
def generated_tables(documents):
    """A small table for each document's id, ten kinds in turn."""
    return G.tables(spread(documents.select(F.col("doc_id").alias("id")))).select("id", "category", F.sha2("text", 256).alias("text_sha256"))


@query("G4 G8", None, "documents")
def generated_samples(documents):
    """A sample of each of the five sources for each document's id, equal texts once."""
    return G.mixed(spread(documents.select(F.col("doc_id").alias("id"))))


@query("X37 F8", """WITH c AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS p, max(CASE WHEN turn = 1 THEN text END) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN p IS NULL OR p = '' THEN 'more' WHEN conv_id % 2 = 0 THEN p || chr(10) || 'more' ELSE p END AS asked, (CASE WHEN conv_id % 5 = 0 THEN 3 ELSE 1 END)::BIGINT AS n_prompt,
       CASE WHEN conv_id % 3 = 0 THEN '' ELSE r END AS first, CASE WHEN conv_id % 3 = 0 THEN r WHEN conv_id % 3 = 1 THEN '' END AS second FROM c WHERE r IS NOT NULL AND (conv_id % 2 = 0 OR (p IS NOT NULL AND p <> ''))""", "conversations")
def instruction_chats(conversations):
    """Instruction, input and answer as messages: with history, liked or disliked, or plain; rows without an answer are dropped."""
    first = conversations.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("p"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("r"))
    i = F.col("conv_id")
    rows = first.where("r IS NOT NULL").select("conv_id", "p", F.when(i % 2 == 0, "more").otherwise("").alias("q"), "r", F.when(i % 3 == 0, False).when(i % 3 == 1, True).alias("liked"), F.when(i % 5 == 0, F.array(F.array(F.lit("old"), F.lit("said")))).alias("h"))
    rows = rows.where("q <> '' OR (p IS NOT NULL AND p <> '')")
    got = A.from_instructions(rows, {"prompt": "p", "query": "q", "response": "r", "kto_tag": "liked", "history": "h"})
    got = got.where((F.size("_prompt") % 2 == 1) & (F.size("_response") >= 1))
    return got.select("conv_id", F.element_at("_prompt", -1)["content"].alias("asked"), F.size("_prompt").cast("long").alias("n_prompt"), F.col("_response")[0]["content"].alias("first"), F.get("_response", F.lit(1))["content"].alias("second"))


@query("X38 S17", """WITH t AS (SELECT conv_id, list({'r': role, 'c': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, CASE WHEN m[1].r = 'system' THEN m[1].c ELSE '' END AS system, CASE WHEN m[1].r = 'system' THEN m[2:] ELSE m END AS m FROM t),
o AS (SELECT *, len(m) % 2 = 0 AND coalesce(list_bool_and(list_transform(m, lambda x, i: x.r = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)), true) AS sound FROM s)
SELECT conv_id, sha256(coalesce(system, '')) AS system_sha256, (CASE WHEN sound THEN greatest(len(m) - 1, 0) ELSE 0 END)::BIGINT AS n_prompt, CASE WHEN sound AND len(m) > 0 THEN sha256(m[-1].c) END AS answer_sha256 FROM o""", "conversations")
def turn_chats(conversations):
    """Lists of turns as prompt and answer; examples out of turn are emptied."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role"), F.col("text").alias("content")))).alias("t"))
    rows = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    got = A.from_turns(rows, {"messages": "m"}, {"user": "user", "assistant": "assistant", "observation": "observation", "function": "function", "system": "system"})
    return got.select("conv_id", F.sha2("_system", 256).alias("system_sha256"), F.size("_prompt").cast("long").alias("n_prompt"), F.sha2(F.get("_response", F.lit(0))["content"], 256).alias("answer_sha256"))


@query("X49 W4", """WITH d AS (SELECT vec_id, vec_id // 10 AS batch, label FROM embeddings) SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'good' || label ELSE 'bad' || label END AS answer, vec_id % 3 = 0 AS liked,
coalesce(lag(CASE WHEN vec_id % 3 = 0 THEN 'good' ELSE 'bad' END || label) OVER w, last_value(CASE WHEN vec_id % 3 = 0 THEN 'good' ELSE 'bad' END || label) OVER (PARTITION BY batch ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM d WINDOW w AS (PARTITION BY batch ORDER BY vec_id)""", "embeddings")
def feedback_pairs(embeddings):
    """Liked and disliked answers, each with that of the row before it in its batch."""
    good = F.col("vec_id") % 3 == 0
    said = F.concat(F.when(good, "good").otherwise("bad"), F.col("label").cast("string"))
    rows = embeddings.select("vec_id", F.expr("vec_id div 10").alias("batch"), A.tagged(F.array(A.message("assistant", said)), good).alias("_response"))
    got = A.with_other_response(rows, "batch", "vec_id")
    answer, liked = A.answer_of(F.col("_response"))
    return got.select("vec_id", answer.alias("answer"), liked.alias("liked"), A.answer_of(F.col("_kl_response"))[0].alias("other"))


@query("X46", None, "embeddings")
def history_masks(embeddings):
    """Ids and labels of three turns in a budget of 40, in each way of masking."""
    part = lambda a, b: F.transform(F.slice("embedding", F.lit(a), F.lit(b)), lambda x: F.abs(stages.thousandths(x)))
    pairs = F.array(*[F.struct(part(a, b).alias("source"), part(a + b, c).alias("target")) for a, b, c in ((1, 9, 5), (15, 20, 4), (39, 3, 11))])
    ways = {"plain": {}, "history": {"mask_history": True}, "prompt": {"train_on_prompt": True}, "eos": {"efficient_eos": True}, "eos_history": {"efficient_eos": True, "mask_history": True}}
    made = [F.struct(F.lit(name).alias("way"), A.multiturn(pairs, 40, **way).alias("m")) for name, way in ways.items()]
    return embeddings.select("vec_id", F.explode(F.array(*made)).alias("w")).select("vec_id", "w.way", "w.m.input_ids", "w.m.labels")


@query("X50", """WITH m AS (SELECT vec_id, list_transform(range(1, 9), lambda i: CASE WHEN i > 6 + vec_id % 2 THEN 0 WHEN i <= 1 + vec_id % 4 THEN 1 ELSE 2 END) AS m FROM embeddings)
SELECT vec_id, list_aggregate(list_transform(range(1, 9), lambda i: list_aggregate(list_transform(range(1, 9), lambda j: (m[i] = m[j] AND m[j] <> 0 AND j <= i)::INT::VARCHAR), 'string_agg', '')), 'string_agg', ' ') AS seen FROM m""", "embeddings")
def attention_matrices(embeddings):
    """Who may look at whom in packed sequences of eight places."""
    i = F.col("vec_id")
    mask = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.when(k > 6 + i % 2, 0).when(k <= 1 + i % 4, 1).otherwise(2))
    rows = F.transform(A.attention_matrix(mask), lambda row: F.array_join(F.transform(row, lambda x: x.cast("int").cast("string")), ""))
    return embeddings.select("vec_id", F.array_join(rows, " ").alias("seen"))


@query("A22", """SELECT o_orderkey, (3 * (t * l * 6 * 64.0 * 256 + t * l * (4 * 64.0 * 64 + 2 * floor(2 * 64.0 * 64 * 2 / 8)) + b * l * 4 * 64.0 * s * s) + 3 * t * 64.0 * 1000 * 2)::DOUBLE AS flops FROM (SELECT o_orderkey, (o_orderkey % 4 + 1)::DOUBLE AS b, (o_orderkey % 7 * 128 + 128)::DOUBLE AS s, (o_orderkey % 3 + 1)::DOUBLE AS l, (o_orderkey % 4 + 1)::DOUBLE * (o_orderkey % 7 * 128 + 128) AS t FROM orders)""", "orders")
def training_flops(orders):
    """Operations of a training step by batch, length and depth."""
    k = F.col("o_orderkey")
    return orders.select(k, A.step_flops(k % 4 + 1, k % 7 * 128 + 128, F.lit(64), F.lit(256), k % 3 + 1, F.lit(1000), F.lit(8), F.lit(2)).alias("flops"))


_GAIN = "((c - r) - (0.5::DOUBLE * c - 0.25::DOUBLE * r))"


@query("A29 A30", f"""WITH e AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, range(len(embedding))), lambda z: CASE WHEN z[2] % 3 <> 0 THEN -abs(z[1]::DOUBLE) ELSE 0 END)) - 0.01 AS c, list_sum(list_transform(embedding, lambda x: -abs(x::DOUBLE))) - 0.02 AS r FROM embeddings)
SELECT vec_id, round(c, 6) AS chosen, round(0.9 * ln(1 + exp(-0.1 * {_GAIN})) + 0.1 * ln(1 + exp(0.1 * {_GAIN})), 6) AS sigmoid, round(greatest(1 - 0.1 * {_GAIN}, 0), 6) AS hinge, round(pow({_GAIN} - 5, 2), 6) AS ipo,
round(-c + 0.1 * ln(1 + exp(-((c - r) - (ln(1 - exp(c)) - ln(1 - exp(r)))))), 6) AS orpo, round(ln(1 + exp(-0.1 * (c - r - 5))), 6) AS simpo FROM e""", "embeddings")
def preference_losses(embeddings):
    """Five losses of pairs of log probabilities, the chosen one summed under a mask."""
    logs = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    labels = F.transform("embedding", lambda x, i: F.when(i % 3 != 0, 1).otherwise(A.IGNORED))
    rows = embeddings.select("vec_id", (A.masked_sum(logs, labels) - 0.01).alias("c"), (F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) - 0.02).alias("r"))
    c, r = F.col("c"), F.col("r")
    loss = lambda kind: F.round(A.preference_loss(kind, c, r, 0.5 * c, 0.25 * r, smoothing=0.1 if kind == "sigmoid" else 0.0), 6).alias(kind)
    return rows.select("vec_id", F.round("c", 6).alias("chosen"), *[loss(k) for k in ("sigmoid", "hinge", "ipo", "orpo", "simpo")])


@query("X53 W10", """SELECT event_id, '{"current_steps":' || event_id || ',"total_steps":3000' || CASE WHEN event_id % 2 = 0 THEN ',"loss":' || (event_id % 8 * 0.125::DOUBLE) ELSE '' END || ',"percentage":' || round_even(event_id / 3000 * 100, 2) || CASE WHEN event_id % 3 = 0 THEN ',"total_tokens":' || (event_id * 7) ELSE '' END || '}' AS log FROM events""", "events")
def loss_logs(events):
    """A training log's row as JSON: unknown values are left out, the share done is added."""
    i = F.col("event_id")
    row = F.struct(i.alias("current_steps"), F.lit(3000).alias("total_steps"), F.when(i % 2 == 0, i % 8 * F.lit(0.125)).alias("loss"), F.bround(i / 3000 * 100, 2).alias("percentage"), F.when(i % 3 == 0, i * 7).alias("total_tokens"))
    return events.select("event_id", F.to_json(row).alias("log"))


_NAMES = ["openai/gpt-oss", "gpt-4", "org/model", "openai/a/b"]
_NAME_SQL = "list_element([" + ", ".join(f"'{n}'" for n in _NAMES) + f"], (event_id % {len(_NAMES)} + 1)::INT)"


@query("X54", f"""WITH n AS (SELECT event_id, {_NAME_SQL} AS n, event_id % 3 = 0 AS tuned FROM events) SELECT event_id, n || CASE WHEN tuned THEN '+lora' ELSE '' END AS model, regexp_replace(n, '^openai/', '') || CASE WHEN tuned THEN '+lora' ELSE '' END AS api_model, contains(n, '/') AND NOT starts_with(n, 'openai/') AS is_local FROM n""", "events")
def model_names(events):
    """The name shown, the name a service is asked by, and whether the model is a local one."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    suffix = F.when(F.col("event_id") % 3 == 0, "+lora").otherwise("")
    return events.select("event_id", F.concat(name, suffix).alias("model"), F.concat(F.regexp_replace(name, "^openai/", ""), suffix).alias("api_model"), (F.contains(name, F.lit("/")) & ~name.startswith("openai/")).alias("is_local"))



#: A chat of a system text, a question and an answer in each template, with the marks <s> and </s>.
RENDERED = {
    "default": "System: s</s>\nHuman: q</s>\nAssistant:a</s>\n",
    "alpaca": "s### Instruction:\nq\n\n### Response:\na</s>\n\n",
    "chatml": "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n",
    "llama3": "<s><|start_header_id|>system<|end_header_id|>\n\ns<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nq<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\na<|eot_id|>",
    "vicuna": "sUSER: q ASSISTANT:a</s>",
    "llama2": "<s>[INST] <<SYS>>\ns\n<</SYS>>\n\nq [/INST]a</s>",
    "mistral": "<s>[INST] s\n\nq[/INST] a</s>",
    "gemma": "<s><start_of_turn>user\ns\n\nq<end_of_turn>\n<start_of_turn>model\na<end_of_turn>\n",
    "phi": "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n",
    "phi4": "<|im_start|>system<|im_sep|>s<|im_end|><|im_start|>user<|im_sep|>q<|im_end|><|im_start|>assistant<|im_sep|>a<|im_end|>",
    "deepseek": "<s>s\n\nUser: q\n\nAssistant:a</s>",
    "zephyr": "<|system|>\ns</s><|user|>\nq</s><|assistant|>\na</s>",
    "glm4": "[gMASK]<sop><|system|>\ns<|user|>\nq<|assistant|>\na",
    "qwen": "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n",
    "orion": "<s>sHuman: q\n\nAssistant: </s>a</s>",
    "starchat": "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n<|assistant|>a<|end|>\n",
    "granite3": "<|start_of_role|>system<|end_of_role|>s<|end_of_text|>\n<|start_of_role|>user<|end_of_role|>q<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>a<|end_of_text|>\n",
    "falcon": "sUser: q\nFalcon:a\n",
}


@query("X41", dealt("labels", "doc_id", ["name", "said"], list(RENDERED.items())), "labels")
def template_values(labels):
    """Each template's whole text."""
    chat = F.array(A.message("user", "q"), A.message("assistant", "a"))
    made = F.array(*[F.struct(F.lit(name).alias("name"), render(name, chat, F.lit("s"), "<s>", "</s>").alias("said")) for name in RENDERED])
    return labels.select("doc_id", F.element_at(made, (F.col("doc_id") % len(RENDERED) + 1).cast("int")).alias("t")).select("doc_id", "t.*")


_CALL = '{"foo": "bar", "size": 10}'
#: One call of a tool in each dialect.
CALLS = {
    "default": f"Action: test_tool\nAction Input: {_CALL}", "json": f'{{"name": "test_tool", "arguments": {_CALL}}}', "tagged": f'<tool_call>\n{{"name": "test_tool", "arguments": {_CALL}}}\n</tool_call>',
    "list": f'[{{"name": "test_tool", "arguments": {_CALL}}}]', "parameters": f'{{"name": "test_tool", "parameters": {_CALL}}}', "named": f"test_tool\n{_CALL}",
}


@query("X44 X45", dealt("labels", "doc_id", ["dialect", "said", "name"], [(d, t, "test_tool") for d, t in CALLS.items()]), "labels")
def tool_call_values(labels):
    """A call written in each dialect, and the name read back from it."""
    return cases(labels, "doc_id", [(d,) for d in CALLS], ["dialect", "said", "name"], lambda d: (d, said := tool_calls(d, [("test_tool", {"foo": "bar", "size": 10})]), read_tool_calls(d, said)[0][0]))


def _endless(text: str):
    """Minutes of work inside one call of C code, which no alarm ends."""
    return hashlib.pbkdf2_hmac("sha256", text.encode(), b"salt", 2_000_000_000).hex()


stages.KERNELS.register("endless", _endless)


@query("D1 D2", """SELECT conv_id, turn, CASE WHEN conv_id % 97 = 0 AND turn = 0 THEN 'timeout' WHEN conv_id % 3 = 0 THEN 'success' WHEN conv_id % 3 = 1 THEN 'AssertionError' ELSE 'KeyError' END AS checked FROM conversations WHERE text IS NOT NULL""", "conversations")
def checked_runs(conversations):
    """Registered kernels run on each text: against the value that the JVM finds, against a wrong one, failing and endless ones."""
    rows = conversations.where("text IS NOT NULL").select("conv_id", "turn", "text")
    endless = (F.col("conv_id") % 97 == 0) & (F.col("turn") == 0)
    pair = lambda r: F.concat(F.lit("["), F.regexp_replace(F.to_json(F.array(F.substring(r, 1, 1))), r"^\[|\]$", ""), F.lit(", "), F.length(r).cast("string"), F.lit("]"))
    right = F.concat(F.lit("["), F.array_join(F.transform(X.runs(F.col("text")), pair), ", "), F.lit("]"))
    kinds = [
        ("rle", ~endless & (F.col("conv_id") % 3 == 0), F.col("text"), right, 5.0),
        ("rle", ~endless & (F.col("conv_id") % 3 == 1), F.col("text"), F.lit("[[]]"), 5.0),
        ("lzw", ~endless & (F.col("conv_id") % 3 == 2), F.concat("text", F.lit("\u0100")), F.lit("[]"), 5.0),
        ("endless", endless, F.col("text"), F.lit("[]"), 0.05),
    ]
    out = None
    for kernel, here, said, wanted, seconds in kinds:
        part = stages.check_kernels(rows.where(here).select("conv_id", "turn", said.alias("said"), wanted.alias("wanted")), kernel, "said", "wanted", seconds).select("conv_id", "turn", "checked")
        out = part if out is None else out.unionByName(part)
    return out


@query("F14", "SELECT doc_id, len(regexp_extract_all(replace(text, ' and ', ' <image> '), '<image>'))::BIGINT AS marks, len(regexp_extract_all(replace(text, ' and ', ' <image> '), '<image>')) = doc_id % 4 AS matching FROM documents", "documents")
def media_checks(documents):
    """Whether a text has as many image marks as images."""
    marks = F.regexp_count(F.replace("text", F.lit(" and "), F.lit(" <image> ")), F.lit("<image>")).cast("long")
    images = F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    return documents.select("doc_id", marks.alias("marks"), (marks == F.size(images)).alias("matching"))


@query("X39", "SELECT item_id, item_id % 2 = 0 AS found, 'gone-' || item_id AS other FROM benchmark", "benchmark")
def media_paths(benchmark):
    """Media names resolved below a folder where the files are there."""
    spark, folder = benchmark.sparkSession, fresh(benchmark.sparkSession, "media")
    name = F.concat(F.lit("img-"), F.col("item_id").cast("string"), F.lit(".png"))
    scans.write_named(benchmark.where("item_id % 2 = 0").select(name.alias("name"), F.lit("x").alias("content")), folder)
    rows = benchmark.select("item_id", F.array(name, F.concat(F.lit("gone-"), F.col("item_id").cast("string"))).alias("media"))
    got = scans.with_found_media(rows, "media", folder)
    return got.select("item_id", F.contains(F.col("paths")[0], F.lit("/")).alias("found"), F.col("paths")[1].alias("other"))


@query("S13", "SELECT item_id, sha256(text) AS text_sha256 FROM benchmark", "benchmark")
def pickled_rows(benchmark):
    """Lists of rows pickled into files, twenty a file, and read again as plain data."""
    spark, folder = benchmark.sparkSession, fresh(benchmark.sparkSession, "pickles")

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return pd.Series([pickle.dumps([dict(r) if isinstance(r, dict) else r.asDict() for r in some]) for some in rows])

    lists = benchmark.groupBy(F.expr("item_id div 20").alias("part")).agg(F.collect_list(F.struct("item_id", "text")).alias("rows"))  # twenty rows
    scans.write_named(lists.select(F.concat(F.col("part").cast("string"), F.lit(".pkl")).alias("name"), packed("rows").alias("content")), folder)
    return read_files(spark, folder, "item_id long, text string").select("item_id", F.sha2("text", 256).alias("text_sha256"))


@query("T11", "SELECT 'hub/' || max(source) AS newest FROM documents", "documents")
def newest_snapshots(documents):
    """The folder whose configuration file changed last: one for each source, and the last by name written again."""
    spark, folder = documents.sparkSession, fresh(documents.sparkSession, "hub")
    sources = documents.select("source").distinct()
    names = sources.select(F.explode(F.array(F.concat("source", F.lit("/config.json")), F.concat("source", F.lit("/other.json")))).alias("name"), F.lit("{}").alias("content"))
    scans.write_named(names, f"{folder}/hub")
    time.sleep(1.1)  # some file systems keep whole seconds
    last = sources.agg(F.max("source").alias("source"))
    scans.write_named(last.select(F.concat("source", F.lit("/config.json")).alias("name"), F.lit("{}").alias("content")), f"{folder}/hub")
    found = newest_snapshot(spark, folder)
    return spark.createDataFrame([("/".join(found.split("/")[-2:]),)], "newest string")
