"""Queries on texts, prompts, filters, sets, order and fine-tuning data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from losslens.functions import text as X
from losslens.operators import prompts as P
from losslens.operators import sft
from losslens.operators.evaluate import TASKS
from losslens.plans.registry import query
from losslens.session import spread
from losslens.sources.saved import numbered


@query("C9 C11 W5", """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
f AS (SELECT *, (ch IS DISTINCT FROM lag(ch) OVER (PARTITION BY doc_id ORDER BY i))::INT AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
g AS (SELECT doc_id, run, min(ch) AS ch, count(*) AS n FROM r GROUP BY ALL)
SELECT doc_id, count(*)::BIGINT AS n_runs, sha256(string_agg(ch || n, '' ORDER BY run)) AS compact_sha256 FROM g GROUP BY doc_id""", "documents")
def run_lengths(documents):
    found = spread(documents).select("doc_id", X.runs(F.col("text")).alias("runs"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(X.rle_compact(F.col("runs")), 256).alias("compact_sha256"))


@query("C10", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents", "documents")
def run_length_decoding(documents):
    pairs = F.transform(X.runs(F.col("text")), lambda r: F.struct(F.substring(r, 1, 1).alias("ch"), F.length(r).alias("n")))
    return documents.select("doc_id", F.sha2(X.rle_decode(pairs), 256).alias("text_sha256"))


@query("C16 C17 W11", """WITH c AS (SELECT lang, doc_id, unnest(string_split(text, '')) AS ch FROM documents), g AS (SELECT lang, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT lang, ch, n::BIGINT AS n, (sum(n) OVER (PARTITION BY lang ORDER BY ch) - n)::BIGINT AS below FROM g""", "documents")
def character_frequencies(documents):
    counts = documents.select("lang", F.explode(F.split("text", "")).alias("ch")).groupBy("lang", "ch").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("below", F.coalesce(below, F.lit(0)))


@query("C18 C19", """SELECT doc_id, sha256(base64(encode(text))) AS base64_sha256, sha256(lower(hex(encode(text)))) AS hex_sha256, sha256(array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)::VARCHAR), ' ')) AS codepoints_sha256 FROM documents""", "documents")
def text_variants(documents):
    raw = F.encode("text", "UTF-8")
    sha = lambda x: F.sha2(x, 256)
    return spread(documents).select("doc_id", sha(X.base64_line(raw)).alias("base64_sha256"), sha(X.hex_lower(raw)).alias("hex_sha256"), sha(X.codepoints(F.col("text"))).alias("codepoints_sha256"))


FILLED_SQL = "replace(replace(replace(replace(replace('" + P.TEMPLATE + "', '<<<<query>>>>', text), '<<<<io_req>>>>', 'io of ' || code), '<<<<refcode>>>>', 'def ' || code || '(x): ...'), '<<<<input>>>>', text), '<<<<return_type>>>>', 'list')"


@query("P1 P2 P3 P4 P7 P13 P14 X33", "WITH t(n_task, io_pred, code) AS (VALUES " + ", ".join(f"({i}, '{t}', '{P.TASK_CODE[t]}')" for i, t in enumerate(TASKS)) + f") SELECT format('{{}}_0_{{}}', item_id, n_task) AS id, io_pred, length({FILLED_SQL})::BIGINT AS n, sha256({FILLED_SQL}) AS prompt_sha256 FROM benchmark CROSS JOIN t", "benchmark")
def task_prompts(benchmark):
    rows = P.fan_out(benchmark)
    values = {"query": F.col("text"), "io_req": F.concat(F.lit("io of "), "code"), "refcode": F.concat(F.lit("def "), "code", F.lit("(x): ...")), "input": F.col("text"), "return_type": F.lit("list")}
    prompt = P.fill(P.TEMPLATE, values)
    return rows.select(F.format_string("%d_0_%d", "item_id", "n_task").alias("id"), "io_pred", F.length(prompt).cast("long").alias("n"), F.sha2(prompt, 256).alias("prompt_sha256"))


@query("P5", "SELECT doc_id, sha256(regexp_replace('Huffman coding algorithm and LZW: ' || text, '" + P.NAMES + "', 'a custom algorithm', 'g')) AS blind_sha256 FROM documents", "documents")
def blinded_texts(documents):
    return documents.select("doc_id", F.sha2(P.blind(F.concat(F.lit("Huffman coding algorithm and LZW: "), "text")), 256).alias("blind_sha256"))


@query("P8 P9 P16 S17 X41", """SELECT conv_id, count(*)::BIGINT AS n, sha256(string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'Assistant:') AS chat_sha256 FROM conversations GROUP BY conv_id""", "conversations")
def chat_texts(conversations):
    chat = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("chat"))
    return chat.select("conv_id", "n", F.sha2(P.message_text(F.col("chat")), 256).alias("chat_sha256"))


@query("F1 F2", r"SELECT doc_id FROM documents WHERE NOT starts_with(text, 'ERROR: ') AND NOT contains(text, '!!!') AND right(trim(text), 1) = '.' AND len(string_split(text, chr(10))) < 30", "documents")
def usable_traces(documents):
    t = F.col("text")
    return documents.where(~t.startswith("ERROR: ") & ~t.contains("!!!") & (F.right(F.trim(t), F.lit(1)) == ".") & (F.size(F.split(t, "\n")) < 30)).select("doc_id")


@query("F3 F9", "SELECT lang, count(*) FILTER (length(text) <= 4000)::BIGINT AS fits, count(*) FILTER (length(text) > 4000)::BIGINT AS too_long FROM documents GROUP BY lang", "documents")
def length_filter(documents):
    n = F.length("text")
    return documents.groupBy("lang").agg(F.count_if(n <= 4000).alias("fits"), F.count_if(n > 4000).alias("too_long"))


@query("", "SELECT page_id, len(regexp_extract_all(html, '<p')) ::BIGINT AS marks, (len(regexp_extract_all(html, '<p')) = len(regexp_extract_all(html, '</p>'))) AS balanced FROM pages", "pages")
def media_counts(pages):
    a, b = F.regexp_count("html", F.lit("<p")), F.regexp_count("html", F.lit("</p>"))
    return pages.select("page_id", a.cast("long").alias("marks"), (a == b).alias("balanced"))


@query("", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '([^/?#]*)$', 1) AS leaf, regexp_replace(url, '^https?://', '') AS bare FROM pages", "pages")
def path_columns(pages):
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([^/?#]*)$", 1).alias("leaf"), F.regexp_replace("url", "^https?://", "").alias("bare"))


@query("S1 S3 X32", "SELECT event_id, (props->>'k')::BIGINT AS k, json_valid(props) AS valid FROM events", "events")
def lenient_json(events):
    parsed = F.from_json("props", "k long")
    return events.select("event_id", parsed["k"].alias("k"), F.expr("try_parse_json(props) is not null").alias("valid"))


@query("X1 X6", r"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first [ANSWER]{{"output": 0}}[/ANSWER] then ' || text || ' [answer] {{"output": ' || doc_id || '}} [/answer]' ELSE text END AS t FROM documents),
a AS (SELECT doc_id, trim(regexp_extract_all(t, '(?is)\[ANSWER\](.*?)\[/ANSWER\]', 1)[-1]) AS answer FROM g)
SELECT doc_id, replace(replace(answer, '{{', '{'), '}}', '}') AS answer, (replace(replace(answer, '{{', '{'), '}}', '}')->>'output')::BIGINT AS output FROM a""", "documents")
def extracted_answers(documents):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('first [ANSWER]{{"output": 0}}[/ANSWER] then '), F.col("text"), F.lit(' [answer] {{"output": '), F.col("doc_id").cast("string"), F.lit("}} [/answer]"))).otherwise(F.col("text"))
    answer = X.collapse_braces(X.last_answer(text))
    return documents.select("doc_id", answer.alias("answer"), F.get_json_object(answer, "$.output").cast("long").alias("output"))


@query("X13", "SELECT a.vec_id, list_bool_and(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE) <= greatest(0.5 * greatest(abs(z[1]::DOUBLE), abs(z[2]::DOUBLE)), 0.5))) AS close FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "embeddings")
def tolerant_equality(embeddings):
    b = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    near = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= F.greatest(0.5 * F.greatest(F.abs(x.cast("double")), F.abs(y.cast("double"))), F.lit(0.5)))
    return embeddings.join(b, "vec_id").select("vec_id", F.forall(near, lambda x: x).alias("close"))


@query("X24 X42", r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+'))::BIGINT AS names, split_part(text, chr(10), -1) AS last_line, sha256(ltrim(regexp_replace('<think>' || lang || '</think> ' || text, '(?s)<think>(.*?)</think>', '', 'g'), ' ')) AS said_sha256 FROM documents""", "documents")
def trace_texts(documents):
    thought = F.concat(F.lit("<think>"), "lang", F.lit("</think> "), "text")
    return documents.select("doc_id", F.regexp_count("text", F.lit("[A-Z][a-z]+")).cast("long").alias("names"), F.substring_index("text", "\n", -1).alias("last_line"), F.sha2(X.strip_thought(thought), 256).alias("said_sha256"))


@query("X26", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, sha256(CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 200) || chr(10) || '...' || chr(10) || right(text, 1795) END) AS clamped_sha256 FROM documents", "documents")
def clamped_texts(documents):
    return documents.select("doc_id", X.estimated_tokens(F.col("text")).cast("long").alias("tokens"), F.sha2(X.clamp(F.col("text"), 2000), 256).alias("clamped_sha256"))


FOCUS_SQL = "'one The input and output requirements are as follows: two ' || text || CASE WHEN doc_id % 2 = 0 THEN ' The input and output requirements are as follows: three ' || text || ' [PYTHON] four' ELSE '' END"


@query("X27", f"""WITH t AS (SELECT doc_id, {FOCUS_SQL} AS t, 'The input and output requirements are as follows:' AS m FROM documents), a AS (SELECT doc_id, m || split_part(t, m, -1) AS t FROM t),
c AS (SELECT doc_id, CASE WHEN contains(t, '[PYTHON]') THEN substr(t, greatest(0, length(t) - length(split_part(t, '[PYTHON]', -1)) - 8 - 2000) + 1) ELSE t END AS t FROM a)
SELECT doc_id, sha256(CASE WHEN length(t) <= 10000 THEN t ELSE substr(t, 1, 800) || chr(10) || '...' || chr(10) || right(t, 9195) END) AS focus_sha256 FROM c""", "documents")
def focus_texts(documents):
    """What a conversation says from its last task on."""
    anchor = "The input and output requirements are as follows:"
    more = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(f" {anchor} three "), "text", F.lit(" [PYTHON] four"))).otherwise("")
    said = documents.select("doc_id", F.concat(F.lit(f"one {anchor} two "), "text", more).alias("said"))
    return said.select("doc_id", F.sha2(X.latest_task(F.col("said")), 256).alias("focus_sha256"))


@query("X34", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, (o_orderdate::DATE + 1) AS next_day, epoch(o_orderdate::DATE)::BIGINT AS midnight FROM orders", "orders")
def date_ranges(orders):
    day = F.to_date("o_orderdate")
    return orders.select("o_orderkey", F.trunc(day, "month").alias("month"), F.date_add(day, 1).alias("next_day"), F.unix_timestamp(day.cast("timestamp")).alias("midnight"))


@query("X35 X36", "SELECT event_id, format('{:02d}:{:02d}:{:02d}', event_id // 3600, event_id % 3600 // 60, event_id % 60) AS took, round_even(value, 1) AS rounded FROM events", "events")
def durations(events):
    return events.select("event_id", X.duration(F.col("event_id")).alias("took"), F.bround("value", 1).alias("rounded"))


@query("X40", """WITH s AS (SELECT doc_id, n_chars % 3000 AS a, n_chars % 1777 AS b, 1000 AS c FROM documents), t AS (SELECT *, least(CASE WHEN b * 2 < c THEN c WHEN a * 2 < c THEN c - a ELSE floor(c * (b / (a + b)))::BIGINT END, b) AS target FROM s)
SELECT doc_id, greatest(least(c - target, a), 0)::BIGINT AS source, target::BIGINT AS target FROM t""", "documents")
def truncation_budgets(documents):
    source, target = X.truncation_budget(F.col("n_chars") % 3000, F.col("n_chars") % 1777, F.lit(1000))
    return documents.select("doc_id", source.cast("long").alias("source"), target.cast("long").alias("target"))


@query("X38 W9", """WITH c AS (SELECT conv_id, list(role ORDER BY turn) FILTER (role <> 'system') AS roles, max(text) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(length(system), 0)::BIGINT AS system_chars, len(roles)::BIGINT AS n, list_bool_and(list_transform(roles, lambda r, i: r = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) AND len(roles) % 2 = 0 AS aligned FROM c""", "conversations")
def aligned_chats(conversations):
    turn = F.when(F.col("role") != "system", F.struct("turn", "role"))
    c = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system"))
    parity = F.transform("turns", lambda t, i: t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return c.select("conv_id", F.coalesce(F.length("system"), F.lit(0)).cast("long").alias("system_chars"), F.size("turns").cast("long").alias("n"), (F.forall(parity, lambda x: x) & (F.size("turns") % 2 == 0)).alias("aligned"))


@query("X46", """WITH c AS (SELECT conv_id, sum(length(text)) AS total, sum(length(text)) FILTER (role = 'assistant') AS learned, arg_max(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END, turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, (total - coalesce(learned, 0))::BIGINT AS ignored, coalesce(learned, 0)::BIGINT AS learned, last::BIGINT AS last_only FROM c""", "conversations")
def label_masks(conversations):
    n, said = F.length("text"), F.col("role") == "assistant"
    return conversations.groupBy("conv_id").agg(F.sum(F.when(~said, n).otherwise(0)).alias("ignored"), F.sum(F.when(said, n).otherwise(0)).alias("learned"), F.max_by(F.when(said, n).otherwise(0), "turn").cast("long").alias("last_only"))


@query("X48 A28 W12", """WITH o AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS off FROM documents), w AS (SELECT sum(n_chars) // 4096 AS whole FROM documents),
p AS (SELECT doc_id, off, n_chars, unnest(range((off // 4096)::BIGINT, ((off + n_chars - 1) // 4096 + 1)::BIGINT)) AS block FROM o WHERE n_chars > 0)
SELECT block::BIGINT AS block, count(*)::BIGINT AS pieces, sum(least(off + n_chars, (block + 1) * 4096) - greatest(off, block * 4096))::BIGINT AS length, min(doc_id) AS first FROM p, w WHERE block < whole GROUP BY block""", "documents")
def pretrain_blocks(documents):
    """All texts end to end, cut into blocks of 4096; the tail is dropped."""
    return sft.blocks(documents, "doc_id", "n_chars", 4096).groupBy("block").agg(F.count("*").alias("pieces"), F.sum("length").alias("length"), F.min("doc_id").alias("first"))


@query("X51", "SELECT item_id, sha256('Q: ' || text || chr(10) || 'A. ' || length(text) || chr(10) || 'B. ' || item_id || chr(10) || 'Answer:') AS prompt_sha256, chr((65 + item_id % 4)::INT) AS letter FROM benchmark", "benchmark")
def choice_prompts(benchmark):
    prompt = F.concat(F.lit("Q: "), "text", F.lit("\nA. "), F.length("text").cast("string"), F.lit("\nB. "), F.col("item_id").cast("string"), F.lit("\nAnswer:"))
    return benchmark.select("item_id", F.sha2(prompt, 256).alias("prompt_sha256"), F.chr(65 + F.col("item_id") % 4).alias("letter"))


@query("W4", """WITH d AS (SELECT doc_id, doc_id // 50 AS batch, n_chars FROM documents) SELECT doc_id, coalesce(lag(n_chars) OVER (PARTITION BY batch ORDER BY doc_id), last_value(n_chars) OVER (PARTITION BY batch ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM d""", "documents")
def rotated_pairs(documents):
    w = Window.partitionBy("batch").orderBy("doc_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return documents.withColumn("batch", F.expr("doc_id div 50")).select("doc_id", F.coalesce(F.lag("n_chars").over(w), F.last("n_chars").over(whole)).alias("other"))


@query("T3 T4 S22", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 10", "documents")
def longest_page(documents):
    """A page of the top list: the offset and limit are the feature."""
    return documents.orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(25).select("doc_id", "n_chars")


@query("T7", "SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT % 10 = 0) AS validation FROM documents", "documents")
def stable_split(documents):
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("long")
    return documents.select("doc_id", (part % 10 == 0).alias("validation"))


@query("U2", """WITH a AS (SELECT doc_id AS id, 0 AS src, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE lang = 'en'), b AS (SELECT item_id AS id, 1 AS src, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark),
m AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, src, ((rn - 1) * 2 + src)::BIGINT AS place FROM u, m WHERE rn <= n""", "documents", "benchmark")
def interleaved_sources(documents, benchmark):
    """Round robin until the shorter source ends; ids are numbered range by range."""
    parts = [numbered(documents.where("lang = 'en'").select(F.col("doc_id").alias("id")), "id", name="rn"), numbered(benchmark.select(F.col("item_id").alias("id")), "id", name="rn")]
    least = min(p.count() for p in parts)
    rows = parts[0].withColumn("src", F.lit(0)).unionByName(parts[1].withColumn("src", F.lit(1)))
    return rows.where(F.col("rn") < least).select("id", "src", (F.col("rn") * 2 + F.col("src")).cast("long").alias("place"))


@query("U3 G8 G9", "SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text", "documents")
def keep_first(documents):
    """Keep-first dedup as an aggregate: copies fold before the shuffle, so a hot text is no hot task."""
    digest = F.sha2("text", 256)  # what is shuffled in the text's place
    return documents.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("U4", "SELECT min(event_id) AS event_id, props FROM events GROUP BY props", "events")
def canonical_json(events):
    return events.groupBy(F.expr("to_json(parse_json(props))").alias("c")).agg(F.min("event_id").alias("event_id"), F.min("props").alias("props")).select("event_id", "props")


@query("U1 U7", "SELECT 'd' AS kind, doc_id AS id, length(text)::BIGINT AS n FROM documents UNION ALL SELECT 'b', item_id, length(text) FROM benchmark UNION ALL SELECT 'p', page_id, length(html) FROM pages", "documents", "benchmark", "pages")
def merged_sources(documents, benchmark, pages):
    one = lambda d, k, i, t: d.select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.length(t).cast("long").alias("n"))
    return one(documents, "d", "doc_id", "text").unionByName(one(benchmark, "b", "item_id", "text")).unionByName(one(pages, "p", "page_id", "html"))


@query("G2", "SELECT item_id, reverse(translate(text, 'ACGTNRYWSKMBDHV', 'TGCANYRWSMKVHDB')) AS rc FROM benchmark", "benchmark")
def reverse_complements(benchmark):
    return benchmark.select("item_id", X.reverse_complement(F.col("text")).alias("rc"))


@query("X41", """WITH c AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) WHEN 'assistant' THEN text || '<|im_end|>' || chr(10) ELSE '<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10) END, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(t) AS text_sha256 FROM c""", "conversations")
def rendered_chats(conversations):
    from losslens.operators.templates import render

    chat = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("chat"))
    return chat.select("conv_id", F.sha2(render("chatml", F.col("chat")), 256).alias("text_sha256"))


@query("S18", r"""SELECT conv_id, count(*) FILTER (role <> 'system')::BIGINT AS n, sha256(coalesce(string_agg(role || ':' || trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10) ORDER BY turn) FILTER (role <> 'system'), '')) AS turns_sha256 FROM conversations GROUP BY conv_id""", "conversations")
def transcripts(conversations):
    """Conversations written as transcripts and parsed again: roles and texts."""
    from losslens.operators.templates import transcript_turns

    said = F.when(F.col("role") == "user", F.concat(F.lit("Human: "), "text")).when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), "text"))
    c = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("turn", said.alias("s"))))).alias("t"))
    turns = transcript_turns(F.array_join(F.transform("t", lambda x: x["s"]), "\n"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["content"]))
    return c.select("conv_id", F.size(turns).cast("long").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("turns_sha256"))


@query("T10", """WITH train AS (SELECT conv_id % 5 AS subject, text, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id * 1000 + turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id % 5) AS size FROM conversations),
q AS (SELECT doc_id AS id, doc_id % 5 AS subject, size, least(3, size) AS n FROM labels LEFT JOIN (SELECT DISTINCT subject, size FROM train) t ON t.subject = doc_id % 5),
p AS (SELECT id, subject, list_reduce(list_concat([[]::BIGINT[]], list_transform(range(n), lambda i: [i])), lambda got, x: list_append(got, CASE WHEN list_contains(got, {draw}) THEN size - n + x[1] ELSE {draw} END)) AS places FROM q)
SELECT id, len(any_value(places))::BIGINT AS n_shots, sha256(coalesce(string_agg(text, chr(10) ORDER BY list_position(places, place)), '')) AS shots_sha256 FROM p LEFT JOIN train t ON t.subject = p.subject AND list_contains(places, place) GROUP BY id""".replace("{draw}", "('0x' || substr(md5('42:' || id || ':' || x[1]), 1, 13))::BIGINT % (size - n + x[1] + 1)"), "labels", "conversations")
def few_shot_prompts(labels, conversations):
    """Three shots for each label's document out of all turns of its subject, and a digest of their texts in order."""
    from losslens.operators.templates import few_shot

    questions = labels.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("subject"))
    train = conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", (F.col("conv_id") % 5).alias("subject"))
    return few_shot(questions, train, 3, "subject").select("id", F.size("shots").cast("long").alias("n_shots"), F.sha2(F.array_join("shots", "\n"), 256).alias("shots_sha256"))


@query("X46 X50 A28", """WITH e AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN trunc(x * 1000)::INT ELSE -100 END) AS labels FROM embeddings)
SELECT vec_id, n::BIGINT AS n, len(list_filter(labels, lambda x: x = -100))::BIGINT AS ignored, md5(array_to_string(list_concat(labels, list_transform(range(greatest(80 - n, 0)), lambda i: -100)), ',')) AS labels_md5 FROM e""", "embeddings")
def padded_batches(embeddings):
    """Labels of what is learned, padded to 80."""
    from losslens.operators.stages import thousandths
    from losslens.operators.templates import masked_labels, padded

    ids = F.transform("embedding", thousandths)
    labels = masked_labels(ids, F.transform("embedding", lambda x: x > 0))
    ignored = F.size(F.filter(labels, lambda x: x == -100))
    return embeddings.select("vec_id", F.size(ids).cast("long").alias("n"), ignored.cast("long").alias("ignored"), F.md5(F.array_join(padded(labels, F.lit(80), -100), ",").cast("binary")).alias("labels_md5"))


@query("D3 D4", r"""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM benchmark), g AS (SELECT item_id, (ch IS DISTINCT FROM lag(ch) OVER (PARTITION BY item_id ORDER BY i))::INT AS starts FROM c)
SELECT item_id, '>>> Call to rle_encode' AS first_line, sum(starts)::BIGINT AS returned FROM g GROUP BY item_id""", "benchmark")
def codec_traces(benchmark):
    """Traces of run-length encoding of each benchmark text: what was called, and how many pairs came back."""
    from losslens.functions import codecs, traces

    trace = codecs.column(lambda t: traces.traced(codecs.rle_encode, t), "string")
    last = F.substring_index("t", f"\n{traces.DONE} ", -1)
    return benchmark.select("item_id", trace("text").alias("t")).select("item_id", F.substring_index("t", "\n", 1).alias("first_line"), F.regexp_count(last, F.lit(r"""['"], [0-9]+\)""")).cast("long").alias("returned"))


ESCAPED_SQL = r"""array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = chr(92) THEN chr(92) || chr(92) WHEN c = chr(10) THEN chr(92) || 'n' WHEN c = chr(13) THEN chr(92) || 'r' WHEN c = chr(9) THEN chr(92) || 't'
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 256 THEN chr(92) || 'x' || lpad(lower(hex(unicode(c))), 2, '0') WHEN unicode(c) < 65536 THEN chr(92) || 'u' || lpad(lower(hex(unicode(c))), 4, '0') ELSE chr(92) || 'U' || lpad(lower(hex(unicode(c))), 8, '0') END), '')"""
WRITTEN_SQL = {"raw": "text", "base64": "base64(encode(text))", "hex": "lower(hex(encode(text)))", "codepoints": "array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ' ')", "unicode_escape": ESCAPED_SQL}
_GRID = "replace(replace(replace('" + P.TEMPLATE + "', '<<<<query>>>>', 'undo: ' || task), '<<<<io_req>>>>', 'written as ' || writing), '<<<<refcode>>>>', 'def f(x): ...')"


@query("C19 P7 P13 P14", "WITH w AS (SELECT conv_id, turn, text, writing, CASE writing " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WRITTEN_SQL.items()) + " END AS said FROM conversations, (VALUES " + ", ".join(f"('{k}')" for k in WRITTEN_SQL) + ") v(writing)), t AS (SELECT *, CASE WHEN task = 'output_prediction' THEN 'list' ELSE 'str' END AS kind FROM w, (VALUES ('output_prediction'), ('input_prediction_inversion')) t(task)) SELECT conv_id, turn, writing, task, sha256(replace(replace(" + _GRID + ", '<<<<return_type>>>>', kind), '<<<<input>>>>', said)) AS prompt_sha256 FROM t", "conversations")
def writing_grid(conversations):
    """The study's grid: each text in five writings, each with a task and its inverse, the input put into the whole prompt last."""
    written = F.array(*[F.struct(F.lit(name).alias("writing"), write(F.col("text")).alias("said")) for name, write in X.WRITINGS.items()])
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(kind).alias("kind")) for t, kind in (("output_prediction", "list"), ("input_prediction_inversion", "str"))])
    rows = conversations.select("conv_id", "turn", F.explode(written).alias("w")).select("conv_id", "turn", "w.*", F.explode(tasks).alias("t")).select("*", "t.task", "t.kind")
    values = {"query": F.concat(F.lit("undo: "), "task"), "io_req": F.concat(F.lit("written as "), "writing"), "refcode": F.lit("def f(x): ..."), "return_type": F.col("kind"), "input": F.col("said")}
    return rows.select("conv_id", "turn", "writing", "task", F.sha2(P.fill(P.TEMPLATE, values), 256).alias("prompt_sha256"))
