"""Queries on sinks and sources, model inputs by stage, rounds, reports and named functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from losslens.functions import codecs
from losslens.operators import prompts, report, stages
from losslens.plans.registry import query
from losslens.sources import files
from losslens.sources.saved import fresh, saved
from losslens.streaming.incremental import Lessons, ModelClient, reflect

stages.KERNELS.register("rle", codecs.rle_encode)
stages.KERNELS.register("lzw", codecs.lzw_encode)
stages.KERNELS.register("huffman", codecs.huffman_encode)

TEXTS_SQL = "SELECT doc_id, sha256(text) AS text_sha256 FROM documents"


def _digest(rows):
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("S2 K1", TEXTS_SQL, "documents")
def json_lines_round_trip(documents):
    """All documents written as JSON lines and read again by the strict reader."""
    path = fresh(documents.sparkSession, "jsonl")
    files.write_jsonl(documents.select("doc_id", "text"), path)
    return _digest(files.read_jsonl(documents.sparkSession, path, "doc_id long, text string", strict=True))


@query("K2 S12", TEXTS_SQL, "documents")
def csv_round_trip(documents):
    """Half of the documents written as CSV by an earlier run, then rewritten together with the rest."""
    first, both = (fresh(documents.sparkSession, "csv") for _ in range(2))
    rows, early = documents.select("doc_id", "text"), F.col("lang") == "en"
    files.write_csv(documents.where(early).select(rows.columns), first)
    rest = documents.where(~F.coalesce(early, F.lit(False))).select(rows.columns)
    return _digest(files.rewrite_csv(rest, first, "doc_id long, text string", both))


@query("S4", r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT length(line)::BIGINT AS width, count(*)::BIGINT AS lines FROM l WHERE trim(line, ' ') <> '' GROUP BY 1""", "documents")
def line_files(documents):
    """Texts written to line files; lines that aren't blank by their width."""
    path = fresh(documents.sparkSession, "lines")
    documents.where("text IS NOT NULL").select(F.col("text").alias("value")).write.text(path)
    return files.read_lines(documents.sparkSession, path).groupBy(F.length("value").cast("long").alias("width")).agg(F.count("*").alias("lines"))


@query("S14", "SELECT doc_id AS id, length(text)::BIGINT AS n FROM documents UNION ALL SELECT item_id, length(text) FROM benchmark", "documents", "benchmark")
def files_by_extension(documents, benchmark):
    """A folder of ORC files and one of JSON files, each told by its extension."""
    spark, orc, js = documents.sparkSession, fresh(documents.sparkSession, "orc"), fresh(documents.sparkSession, "json")
    documents.select(F.col("doc_id").alias("id"), "text").write.option("compression", "none").orc(orc)
    benchmark.select(F.col("item_id").alias("id"), "text").write.json(js)
    read = [files.read_files(spark, p, "id long, text string") for p in (orc, js)]
    return read[0].unionByName(read[1]).select("id", F.length("text").cast("long").alias("n"))


@query("S21 K8", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n_ids FROM embeddings", "embeddings")
def tokenized_reload(embeddings):
    """Inputs built and saved once, then loaded from where they were saved."""
    spark, path = embeddings.sparkSession, fresh(embeddings.sparkSession, "tokenized")
    build = lambda: embeddings.select("vec_id", F.filter("embedding", lambda x: x > 0).alias("ids"))
    files.reload_or_build(spark, path, build)
    return files.reload_or_build(spark, path, build).select("vec_id", F.size("ids").cast("long").alias("n_ids"))


@query("J14 X45 X46", """WITH e AS (SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS s, len(list_filter(embedding, lambda x: x <= 0))::BIGINT AS t FROM embeddings)
SELECT vec_id AS id, stage, CASE WHEN stage = 'ppo' THEN s ELSE s + t END AS n, CASE WHEN stage = 'pt' THEN s + t ELSE t END AS learned FROM e CROSS JOIN (VALUES ('pt'), ('sft'), ('rm'), ('kto'), ('ppo')) v(stage)""", "embeddings")
def stage_inputs(embeddings):
    """Each stage's inputs of the same samples: positive parts stand for sources, the others for targets."""
    ids = lambda keep: F.transform(F.filter("embedding", keep), lambda x: F.abs(stages.thousandths(x)))
    rows = embeddings.select(F.col("vec_id").alias("id"), ids(lambda x: x > 0).alias("source"), ids(lambda x: x <= 0).alias("target"), (F.col("vec_id") % 2 == 0).alias("desirable")).withColumn("rejected", F.reverse("target"))
    out = None
    for stage in ("pt", "sft", "rm", "kto", "ppo"):
        learned = F.size(F.filter("labels", lambda x: x != stages.IGNORED))
        part = stages.processor(stage)(rows).select("id", F.lit(stage).alias("stage"), F.size("input_ids").cast("long").alias("n"), learned.cast("long").alias("learned"))
        out = part if out is None else out.unionByName(part)
    return out


@query("J14 X47", """WITH RECURSIVE e AS (SELECT vec_id, list_transform(list_filter(embedding, lambda x: x > 0), lambda x: abs(trunc(x * 1000))::INT) AS s, list_transform(list_filter(embedding, lambda x: x <= 0), lambda x: abs(trunc(x * 1000))::INT) AS t FROM embeddings),
l AS (SELECT list({'n': len(s) + len(t), 'id': vec_id} ORDER BY len(s) + len(t), vec_id) AS rest FROM e WHERE len(s) + len(t) <= 256),
fill(step, bin, room, rest, got) AS (SELECT 0, 0::BIGINT, 256::BIGINT, rest, NULL::STRUCT(n BIGINT, id BIGINT) FROM l UNION ALL
SELECT step + 1, CASE WHEN p IS NULL THEN bin + 1 ELSE bin END, CASE WHEN p IS NULL THEN 256 ELSE room - p.n END, CASE WHEN p IS NULL THEN rest ELSE list_filter(rest, lambda y: y <> p) END, p FROM (SELECT *, list_filter(rest, lambda x: x.n <= room)[-1] AS p FROM fill WHERE len(rest) > 0)),
packs AS (SELECT bin AS id, string_agg(vec_id::VARCHAR, ',' ORDER BY step) AS ids, flatten(list(list_concat(s, t) ORDER BY step)) AS input_ids, flatten(list(list_concat(list_transform(s, lambda x: -100), t) ORDER BY step)) AS labels,
  flatten(list(range(len(s) + len(t)) ORDER BY step)) AS positions, list(len(s) + len(t) ORDER BY step) AS sizes FROM fill JOIN e ON vec_id = got.id GROUP BY bin),
filled AS (SELECT *, 257 - len(input_ids) AS more FROM packs)
SELECT id, ids, len(sizes)::BIGINT AS samples, md5(array_to_string(list_concat(input_ids, list_transform(range(more), lambda i: 0)), ',')) AS input_md5, md5(array_to_string(list_concat(labels, list_transform(range(more), lambda i: -100)), ',')) AS labels_md5,
  md5(array_to_string(list_concat(positions, list_transform(range(more), lambda i: 0)), ',')) AS positions_md5, md5(array_to_string(list_concat(flatten(list_transform(sizes, lambda n, i: list_transform(range(n), lambda k: i))), list_transform(range(more), lambda i: 0)), ',')) AS attention_md5 FROM filled""", "embeddings")
def packed_stage_inputs(embeddings):
    """Packs of at most 256 ids, padded to 257, with the number of each sample as its attention mask."""
    ids = lambda keep: F.transform(F.filter("embedding", keep), lambda x: F.abs(stages.thousandths(x)))
    rows = embeddings.select(F.col("vec_id").alias("id"), ids(lambda x: x > 0).alias("source"), ids(lambda x: x <= 0).alias("target"))
    packs = stages.packed_supervised(rows, 256)
    digest = lambda c: F.md5(F.array_join(c, ",").cast("binary"))
    return packs.select("id", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("samples"), digest("input_ids").alias("input_md5"), digest("labels").alias("labels_md5"), digest("positions").alias("positions_md5"), digest("attention").alias("attention_md5"))


@query("R5", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) <= 40 AS validation FROM documents", "documents")
def stream_split(documents):
    """The first 40 documents of a shuffled stream are for validation: the count is the feature."""
    key = F.struct(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return stages.take_and_skip(documents, 40, F.concat(key["col1"], F.lpad(key["doc_id"].cast("string"), 20, "0"))).select("doc_id", "validation")


@query("R6", """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events WHERE value > 90) SELECT event_id, event_type FROM r WHERE rn <= 3""", "events")
def lessons_memory(events):
    """The newest lessons of a kind as they were known at the start; those that the run appends don't show."""
    spark, path = events.sparkSession, fresh(events.sparkSession, "lessons")
    rows = events.select("event_id", "event_type", "value")
    rows.where("value > 90").select("event_id", "event_type").write.parquet(path)
    memory = Lessons(spark, path, "event_id long, event_type string")
    memory.append(rows.where("value < 10").select("event_id", "event_type"))
    return memory.newest("event_type", "event_id", 3)


@query("R7", r"""WITH a AS (SELECT item_id AS id, regexp_extract(text, '[^\n]*$') AS said FROM benchmark), r AS (SELECT id, k, repeat('Not right: ', k) || said AS answer, (length(said) + 11 * k) % 4 = 0 AS em FROM a, (VALUES (0), (1), (2)) v(k)),
f AS (SELECT id, min(k) FILTER (em) AS resolved FROM r GROUP BY id) SELECT r.id, r.answer, f.resolved FROM r JOIN f ON r.id = f.id AND r.k = coalesce(f.resolved, 0)""", "benchmark")
def reflection_rounds(benchmark):
    """Three rounds of the stand-in client, which repeats a prompt's last line; an answer is right if its length is a multiple of 4."""
    rows = benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    score = lambda d: d.withColumn("em", (F.length("answer") % 4 == 0).cast("int"))
    return reflect(rows, ModelClient(), score, lambda d, n: saved(d, f"round{n}"), 2)


@query("D2", """WITH c AS (SELECT item_id, generate_subscripts(string_split(text, ''), 1) AS i, unnest(string_split(text, '')) AS ch FROM benchmark), g AS (SELECT item_id, ch IS DISTINCT FROM lag(ch) OVER (PARTITION BY item_id ORDER BY i) AS starts FROM c)
SELECT item_id, count(*) FILTER (starts)::BIGINT AS pairs, count(*)::BIGINT AS characters FROM g GROUP BY item_id""", "benchmark")
def kernel_outputs(benchmark):
    """The JSON that the run-length kernel returns for each item, parsed again."""
    pairs = F.from_json("output", "array<array<string>>")
    out = stages.run_kernels(benchmark.where("text IS NOT NULL"), "rle", "text")
    return out.select("item_id", pairs.alias("p")).select("item_id", F.size("p").cast("long").alias("pairs"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x[1].cast("long")).alias("characters"))


@query("D6", """WITH c AS (SELECT item_id, generate_subscripts(string_split(text, ''), 1) AS i, unnest(string_split(text, '')) AS ch FROM benchmark), g AS (SELECT item_id, ch, i - row_number() OVER (PARTITION BY item_id, ch ORDER BY i) AS run FROM c),
r AS (SELECT item_id, ch, run, count(*) AS n FROM g GROUP BY ALL) SELECT item_id, count(*)::BIGINT AS runs, max(n)::BIGINT AS longest FROM r GROUP BY item_id""", "benchmark")
def runs_by_table_function(benchmark):
    """Runs of each item by the registered table function."""
    stages.register_functions(benchmark.sparkSession)
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text")
    runs = benchmark.sparkSession.sql("SELECT item_id, r.n FROM {rows}, LATERAL runs_of(text) AS r", rows=rows)
    return runs.groupBy("item_id").agg(F.count("*").alias("runs"), F.max("n").cast("long").alias("longest"))


@query("K3", """SELECT event_id, to_json(event_id)::VARCHAR || ',' || (event_id % 7) || ',' || to_json(event_type)::VARCHAR || ',' || coalesce(CASE WHEN value > 50 THEN 1 WHEN value > 20 THEN 0 END::VARCHAR, '') || ',' || coalesce(CASE WHEN user_id % 3 > 0 THEN to_json('a "' || user_id || '"')::VARCHAR END, 'null') AS line FROM events""", "events")
def stats_csv_lines(events):
    """Lines of a statistics file: some cells as JSON, some bare and empty where null."""
    rows = events.select("event_id", "event_type", (F.col("event_id") % 7).alias("place"), F.when(F.col("value") > 50, 1).when(F.col("value") > 20, 0).alias("em"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit('a "'), F.col("user_id").cast("string"), F.lit('"'))).alias("said"))
    return files.stats_lines(rows, ["event_id", "event_type", "said"], ["place", "em"], ["event_id", "place", "event_type", "em", "said"]).select("event_id", "line")


SCORES_SQL = """s AS (SELECT lang AS algo, source AS task, avg((n_chars % 2)::DOUBLE) * 100 AS score, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT lang, 'OVERALL', avg((n_chars % 2)::DOUBLE) * 100, count(*) FROM documents GROUP BY 1)"""


def _scores(documents):
    hit = (F.avg((F.col("n_chars") % 2).cast("double")) * 100).alias("score")
    by = documents.groupBy("lang", "source").agg(hit, F.count("*").alias("n")).select(F.col("lang").alias("algo"), F.col("source").alias("task"), "score", "n")
    return by.unionByName(documents.groupBy("lang").agg(hit, F.count("*").alias("n")).select(F.col("lang").alias("algo"), F.lit("OVERALL").alias("task"), "score", "n"))


@query("K4", f"WITH {SCORES_SQL} SELECT algo, task, format('{{:<12}} {{:<20}} {{:>9}} {{:>10}}', CASE WHEN task = 'OVERALL' THEN '' ELSE algo END, task, format('{{:.1f}}', round(score, 6)), n) AS line FROM s", "documents")
def report_lines(documents):
    """The flat table of a report, line by line."""
    return report.flat_lines(_scores(documents).withColumn("score", F.round("score", 6)), 5, 20)


LANGS = ["de", "en", "es", "fr"]


@query("K4 A10", "WITH s AS (SELECT source AS algo, lang AS task, avg((n_chars % 2)::DOUBLE) * 100 AS score, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT source, 'OVERALL', avg((n_chars % 2)::DOUBLE) * 100, count(*) FROM documents GROUP BY 1) SELECT 'm' AS model, algo, " + ", ".join(f"max(round(score, 6)) FILTER (task = '{lang}') AS {lang}" for lang in LANGS) + ", max(n) FILTER (task = 'OVERALL') AS n FROM s GROUP BY algo", "documents")
def report_pivot(documents):
    """Each source's scores by language in a row."""
    named = documents.select(F.col("source").alias("lang"), F.col("lang").alias("source"), "n_chars")
    return report.pivot(_scores(named).withColumn("score", F.round("score", 6)).withColumn("model", F.lit("m")), LANGS)


@query("X55", "SELECT item_id, sha256(text || chr(10) || chr(10) || 'print(solve(' || item_id || '))' || chr(10)) AS program_sha256 FROM benchmark", "benchmark")
def program_texts(benchmark):
    """Texts of programs; nothing runs them."""
    return benchmark.select("item_id", F.sha2(prompts.program("solution", F.col("text"), F.col("item_id").cast("string"), F.lit("solve")), 256).alias("program_sha256"))
