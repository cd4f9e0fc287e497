"""Queries on the smaller operators: lookups, wrappers, samples, tokenizers, model calls, artifact names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from losslens.plans.registry import query
from losslens.streaming.incremental import ModelClient, call_bounded, call_model

#: Our own code texts by codec, plain and blinded.
CODE = {("rle", False): "def rle(x): ...", ("rle", True): "def f(x): ...", ("lzw", False): "def lzw(x): ...", ("lzw", True): "def g(x): ..."}
CODE_SQL = "code(algo, blind, text) AS (VALUES " + ", ".join(f"('{a}', {b}, '{t}')" for (a, b), t in CODE.items()) + ")"
REGISTRY = [("click", "small", "api"), ("view", "large", "local"), ("purchase", "large", None), ("signup", None, "api"), ("logout", None, None)]


@query("P6 P10 P11 P12 J2", f"WITH {CODE_SQL} SELECT item_id, c.text || chr(10) || 'def decode(x): ...' AS refcode, CASE WHEN item_id % 3 = 0 THEN 'raw' ELSE 'Input is base64. ' || 'raw' END AS io_req FROM benchmark b JOIN code c ON c.algo = CASE WHEN item_id % 2 = 0 THEN 'rle' ELSE 'lzw' END AND c.blind = (item_id % 5 = 0)", "benchmark")
def code_lookup(benchmark):
    code = F.broadcast(benchmark.sparkSession.createDataFrame([(a, b, t) for (a, b), t in CODE.items()], "algo string, blind boolean, code string"))
    rows = benchmark.select("item_id", F.when(F.col("item_id") % 2 == 0, "rle").otherwise("lzw").alias("algo"), (F.col("item_id") % 5 == 0).alias("blind"))
    note = F.when(F.col("item_id") % 3 == 0, "raw").otherwise("Input is base64. raw")
    return rows.join(code, ["algo", "blind"]).select("item_id", F.concat("code", F.lit("\ndef decode(x): ...")).alias("refcode"), note.alias("io_req"))


@query("P15 P17", "SELECT doc_id, sha256('Question: ' || replace(text, chr(10) || chr(10), chr(10)) || chr(10) || 'Trace:') AS prompt_sha256 FROM documents", "documents")
def translation_prompts(documents):
    return documents.select("doc_id", F.sha2(F.concat(F.lit("Question: "), F.replace("text", F.lit("\n\n"), F.lit("\n")), F.lit("\nTrace:")), 256).alias("prompt_sha256"))


@query("F5", "SELECT doc_id, (strlen(text) < 1024 AND len(string_split(text, chr(10))) < 20) AS small FROM documents", "documents")
def size_predicate(documents):
    return documents.select("doc_id", ((F.octet_length("text") < 1024) & (F.size(F.split("text", "\n")) < 20)).alias("small"))


@query("J4 S11", "WITH m(id, size, category) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in REGISTRY) + ") SELECT coalesce(category, 'unknown') AS category, count(*)::BIGINT AS n FROM events JOIN m ON id = event_type GROUP BY 1", "events")
def model_dimension(events):
    models = events.sparkSession.createDataFrame(REGISTRY, "id string, size string, category string").select("id", F.coalesce("category", F.lit("unknown")).alias("category"))
    return events.join(F.broadcast(models), F.col("event_type") == F.col("id")).groupBy("category").agg(F.count("*").alias("n"))


@query("J10", "SELECT vec_id, list_sum(list_transform(list_zip(embedding, range(len(embedding))), lambda z: CASE WHEN z[1] > 0 THEN z[2] ELSE 0 END))::BIGINT AS places FROM embeddings", "embeddings")
def positional_zip(embeddings):
    places = F.transform(F.arrays_zip(F.col("embedding").alias("e"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("i")), lambda z: F.when(z["e"] > 0, z["i"]).otherwise(0))
    return embeddings.select("vec_id", F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query("T5 T8", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100", "documents")
def seeded_sample(documents):
    """A sample of 100 in a fixed shuffled order: the limit is the feature."""
    return documents.select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(100)


@query("X29 X31 X22", """SELECT event_id, lower(trim(' ' || event_type || ' ')) AS norm, '{"output":' || (value::BIGINT) || '}' AS answer, CASE WHEN value > 50 THEN value END AS safe FROM events""", "events")
def formatted_answers(events):
    rounded = F.bround("value").cast("long")
    nan = F.when(F.col("value") > 50, F.col("value")).otherwise(F.lit(float("nan")))
    return events.select("event_id", F.lower(F.trim(F.concat(F.lit(" "), "event_type", F.lit(" ")))).alias("norm"), F.to_json(F.struct(rounded.alias("output"))).alias("answer"), F.when(~F.isnan(nan), nan).alias("safe"))


@query("D9 A10", r"""WITH d AS (SELECT o_orderkey, o_orderkey::VARCHAR || (o_orderkey * 7919)::VARCHAR AS s FROM orders) SELECT o_orderkey, length(s)::BIGINT AS single_digits, len(regexp_extract_all(s, '[0-9]{1,3}'))::BIGINT AS digit_groups FROM d""", "orders")
def digit_tokens(orders):
    """Tokens of a digit string for a tokenizer of single digits and for one of groups of three."""
    s = F.concat(F.col("o_orderkey").cast("string"), (F.col("o_orderkey") * 7919).cast("string"))
    return orders.select("o_orderkey", F.length(s).cast("long").alias("single_digits"), F.regexp_count(s, F.lit("[0-9]{1,3}")).cast("long").alias("digit_groups"))


@query("D7", "SELECT item_id, split_part(text, chr(10), -1) AS answer FROM benchmark", "benchmark")
def model_answers(benchmark):
    """Answers of the stand-in client, asked in batches inside each partition."""
    return call_model(benchmark.select("item_id", F.col("text").alias("prompt")), ModelClient()).select("item_id", "answer")


@query("X33", "SELECT doc_id, format('{:03d}_{}.txt', doc_id, lang) AS name, '/media/' || lang || '/' || doc_id || '.png' AS path FROM documents", "documents")
def artifact_names(documents):
    return documents.select("doc_id", F.format_string("%03d_%s.txt", "doc_id", "lang").alias("name"), F.concat(F.lit("/media/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))


@query("R4 D7", "SELECT conv_id, turn, split_part(text, chr(10), -1) AS answer FROM conversations", "conversations")
def bounded_answers(conversations):
    """Answers of the stand-in client to every turn, never more than four calls at a time over all tasks."""
    rows = conversations.select("conv_id", F.col("turn").alias("at"), F.col("text").alias("prompt"))
    return call_bounded(rows, ModelClient(), 4, quantum=2000).select("conv_id", F.col("at").alias("turn"), "answer")


@query("W10 X35", """WITH w AS (SELECT conv_id, turn, row_number() OVER o AS step, count(*) OVER (PARTITION BY conv_id) AS steps, sum(length(text)) OVER o AS elapsed FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, elapsed / step AS average, (steps - step) * elapsed // step AS remaining FROM w)
SELECT conv_id, turn, elapsed::BIGINT AS elapsed, round(average, 6) AS average, remaining::BIGINT AS remaining, format('{}:{:02d}:{:02d}', (remaining // 3600)::BIGINT, (remaining % 3600 // 60)::BIGINT, (remaining % 60)::BIGINT) AS eta FROM r""", "conversations")
def step_progress(conversations):
    """A conversation's turns as steps that take a second a character: elapsed time, average step, and what is left at each step."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    steps = conversations.groupBy("conv_id").agg(F.count("*").alias("steps"))
    rows = conversations.select("conv_id", "turn", F.row_number().over(by).alias("step"), F.sum(F.length("text")).over(by).alias("elapsed")).join(steps, "conv_id")
    left = F.expr("(steps - step) * elapsed div step")
    eta = F.format_string("%d:%02d:%02d", F.expr("remaining div 3600"), F.expr("remaining % 3600 div 60"), F.expr("remaining % 60"))
    return rows.withColumn("remaining", left).select("conv_id", "turn", "elapsed", F.round(F.col("elapsed") / F.col("step"), 6).alias("average"), "remaining", eta.alias("eta"))
