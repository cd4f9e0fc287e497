"""Queries on verdicts, usage and studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from losslens.operators.evaluate import PRICES, TASKS, accuracy, compare, pass_at_k, task_of, usage
from losslens.plans.registry import query

TASK_SQL = "list_element(['" + "','".join(TASKS) + "'], (doc_id % 4 + 1)::INT)"
VERIFIED_SQL = f"verified AS (SELECT doc_id AS ord, doc_id // 16 AS itemid, doc_id % 2 AS ioid, {TASK_SQL} AS io_pred, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN toxic = 1 THEN 'no answer' ELSE 'wrong' END AS status FROM labels)"


def verified(labels: DataFrame) -> DataFrame:
    """Labels as verdicts: good and clean is correct, toxic is no answer."""
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("toxic") == 1, "no answer").otherwise("wrong")
    return labels.select(F.col("doc_id").alias("ord"), F.expr("doc_id div 16").alias("itemid"), (F.col("doc_id") % 2).alias("ioid"), task_of(F.col("doc_id") % 4).alias("io_pred"), status.alias("status"))


@query("A1 W1 T1", f"""WITH {VERIFIED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY itemid, ioid, io_pred ORDER BY ord) AS n FROM verified),
g AS (SELECT itemid, ioid, io_pred, max((status = 'correct')::INT) AS hit FROM ranked WHERE n <= 5 GROUP BY ALL)
SELECT coalesce(io_pred, 'OVERALL') AS io_pred, round(avg(hit) * 100, 4) AS pass_at_k, count(*)::BIGINT AS n_groups FROM g GROUP BY ROLLUP (io_pred)""", "labels")
def verdict_pass_at_k(labels):
    return pass_at_k(verified(labels), 5, ["itemid", "ioid"])


@query("A2 A3", f"WITH {VERIFIED_SQL} SELECT coalesce(io_pred, 'OVERALL') AS io_pred, round(avg((status = 'correct')::INT::DOUBLE), 6) AS accuracy, count(*)::BIGINT AS n FROM verified GROUP BY ROLLUP (io_pred)", "labels")
def verdict_accuracy(labels):
    return accuracy(verified(labels))


@query("J7 A3", f"""WITH {VERIFIED_SQL}, acc AS (SELECT ord % 3 = 0 AS part, coalesce(io_pred, 'OVERALL') AS io_pred, round(avg((status = 'correct')::INT::DOUBLE), 6) AS a FROM verified GROUP BY GROUPING SETS ((ord % 3 = 0, io_pred), (ord % 3 = 0)))
SELECT coalesce(x.io_pred, y.io_pred) AS io_pred, x.a AS base, y.a AS other, round(y.a - x.a, 6) AS delta FROM (SELECT * FROM acc WHERE part) x FULL JOIN (SELECT * FROM acc WHERE NOT part) y ON x.io_pred = y.io_pred""", "labels")
def accuracy_comparison(labels):
    rows = verified(labels)
    return compare(rows.where(F.col("ord") % 3 == 0), rows.where(F.col("ord") % 3 != 0))


@query("A4 A31 R2", f"WITH {VERIFIED_SQL} SELECT (ord // 100)::BIGINT AS batch, status, count(*)::BIGINT AS n FROM verified GROUP BY ALL", "labels")
def batch_status_counts(labels):
    return verified(labels).groupBy(F.expr("ord div 100").alias("batch"), "status").agg(F.count("*").alias("n"))


@query("J13 T2", f"WITH {VERIFIED_SQL} SELECT ioid, " + ", ".join(f"round(avg(CASE WHEN io_pred = '{t}' THEN (status = 'correct')::INT::DOUBLE END), 6) AS \"{t}\"" for t in TASKS) + " FROM verified GROUP BY ioid", "labels")
def accuracy_pivot(labels):
    hit = verified(labels).withColumn("hit", (F.col("status") == "correct").cast("double"))
    return hit.groupBy("ioid").pivot("io_pred", TASKS).agg(F.round(F.avg("hit"), 6))


@query("J1 F4", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'correct' WHEN l.quality = 0 THEN 'wrong' END, 'no answer') AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "documents", "labels")
def ground_truth_lookup(documents, labels):
    found = documents.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return found.select("doc_id", F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "wrong").otherwise("no answer").alias("status"))


@query("J3", "SELECT d.doc_id, f.event_type AS feedback FROM documents d LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id) f ON f.user_id = d.doc_id", "documents", "events")
def last_feedback(documents, events):
    last = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("feedback"))
    return documents.select("doc_id").join(last, F.col("doc_id") == F.col("user_id"), "left").select("doc_id", "feedback")


@query("J6 U6 R1", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "documents", "labels")
def resume_missing(documents, labels):
    return documents.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")


MODELS = ["gpt-4.1-mini-2025", "gpt-4o", "gpt-4.1", "other-model", "gpt-4o-mini"]
MODEL_SQL = "list_element(['" + "','".join(MODELS) + "'], (user_id % 5 + 1)::INT)"
PRICE_SQL = "prices(place, prefix, p_in, p_cached, p_out) AS (VALUES " + ", ".join(f"({i}, '{p}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (p, a, b, c) in enumerate(PRICES)) + ")"


@query("A5 A6 A7 J5 X32", f"""WITH {PRICE_SQL}, r AS (SELECT {MODEL_SQL} AS model, 1 AS requests, event_id % 997 AS input_tokens, coalesce((props->>'k')::BIGINT, 0) AS cached_tokens, user_id % 311 AS output_tokens FROM events),
s AS (SELECT model, sum(requests) AS requests, sum(input_tokens) AS input_tokens, sum(cached_tokens) AS cached_tokens, sum(output_tokens) AS output_tokens FROM r GROUP BY model),
p AS (SELECT s.*, (SELECT min_by({{'a': p_in, 'b': p_cached, 'c': p_out}}, place) FROM prices WHERE starts_with(s.model, prefix)) AS p FROM s),
c AS (SELECT *, (greatest(input_tokens - cached_tokens, 0) * p.a + cached_tokens * p.b + output_tokens * p.c) / 1e6 AS cost FROM p)
SELECT coalesce(model, 'TOTAL') AS model, sum(requests)::BIGINT AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 6) AS cost FROM c GROUP BY ROLLUP (model)""", "events")
def usage_cost(events):
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("user_id") % 5 + 1).cast("int"))
    cached = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    return usage(events.select(model.alias("model"), F.lit(1).alias("requests"), (F.col("event_id") % 997).alias("input_tokens"), cached.alias("cached_tokens"), (F.col("user_id") % 311).alias("output_tokens")))


@query("A8", "SELECT source, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, count(*)::BIGINT AS n FROM documents GROUP BY source", "documents")
def token_estimates(documents):
    return documents.groupBy("source").agg(F.sum(F.greatest(F.lit(1), F.expr("length(text) div 4"))).cast("long").alias("tokens"), F.count("*").alias("n"))


@query("A9", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, l_linenumber), ())", "lineitem")
def grouped_counts(lineitem):
    a, b, c = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    return lineitem.groupingSets([[a, b], [a, c], []], a, b, c).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@query("A10 A11 A16", "SELECT event_type, lang, sum(n)::BIGINT AS total, round(avg(n), 4) AS mean, round(coalesce(stddev_samp(n), 0), 4) AS std, min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM (SELECT event_type, lang, n_chars % 1000 AS n FROM documents JOIN events ON doc_id = event_id) GROUP BY ALL", "documents", "events")
def study_statistics(documents, events):
    n = F.col("n_chars") % 1000
    joined = documents.join(events, F.col("doc_id") == F.col("event_id")).select("event_type", "lang", n.alias("n"))
    return joined.groupBy("event_type", "lang").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 4).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("J8 A12", """WITH m AS (SELECT user_id, event_type, max(event_id % 100) AS v FROM events GROUP BY ALL)
SELECT a.event_type AS model_a, b.event_type AS model_b, count(*) FILTER (a.v < b.v)::BIGINT AS wins, count(*) FILTER (a.v > b.v)::BIGINT AS losses, count(*) FILTER (a.v = b.v)::BIGINT AS ties, round(avg(a.v - b.v), 6) AS mean_diff
FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""", "events")
def pairwise_models(events):
    m = events.groupBy("user_id", "event_type").agg(F.max(F.col("event_id") % 100).alias("v"))
    a, b = m.select("user_id", F.col("event_type").alias("model_a"), F.col("v").alias("x")), m.select("user_id", F.col("event_type").alias("model_b"), F.col("v").alias("y"))
    pairs = a.join(b, "user_id").where(F.col("model_a") < F.col("model_b"))
    return pairs.groupBy("model_a", "model_b").agg(F.count_if(F.col("x") < F.col("y")).alias("wins"), F.count_if(F.col("x") > F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("mean_diff"))


@query("A13", "SELECT source, arg_max(doc_id, {'n': n_chars, 'd': -doc_id}) AS doc_id FROM documents GROUP BY source", "documents")
def worst_sample(documents):
    return documents.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@query("A14 U5", """WITH s AS (SELECT DISTINCT p_brand, p_type FROM part), n AS (SELECT p_brand, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT a.p_brand AS x, b.p_brand AS y, count(*) AS m FROM s a JOIN s b ON a.p_type = b.p_type AND a.p_brand < b.p_brand GROUP BY ALL)
SELECT x, y, m::BIGINT AS shared, (a.n + b.n - m)::BIGINT AS either, round(m / (a.n + b.n - m), 6) AS jaccard FROM i JOIN n a ON a.p_brand = x JOIN n b ON b.p_brand = y""", "part")
def vocabulary_overlap(part):
    values = part.select("p_brand", "p_type").distinct()
    sizes = values.groupBy("p_brand").agg(F.count("*").alias("n"))
    # brands meet on the values they share: pairs that share nothing are never made
    a, b = values.select(F.col("p_brand").alias("x"), "p_type"), values.select(F.col("p_brand").alias("y"), "p_type")
    shared = a.join(b, "p_type").where("x < y").groupBy("x", "y").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col("p_brand").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("p_brand").alias("y"), F.col("n").alias("ny")), "y")
    either = F.col("nx") + F.col("ny") - F.col("shared")
    return both.select("x", "y", "shared", either.alias("either"), F.round(F.col("shared") / either, 6).alias("jaccard"))


@query("A15 F11 F12 X52", """WITH w AS (SELECT lang, unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) AS w FROM documents), v AS (SELECT * FROM w WHERE w <> '')
SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (length(w) = 1)::BIGINT AS one, count(*) FILTER (length(w) = 2)::BIGINT AS two, count(*) FILTER (length(w) = 3)::BIGINT AS three, count(*) FILTER (length(w) >= 4)::BIGINT AS more, max(length(w))::BIGINT AS longest, count(*) FILTER (regexp_full_match(w, '[0-9]+'))::BIGINT AS digits, count(*) FILTER (regexp_full_match(w, '[0-9.e+-]+'))::BIGINT AS numeric FROM v GROUP BY lang""", "documents")
def token_lengths(documents):
    w = documents.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    n = F.length("w")
    return w.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(n == 1).alias("one"), F.count_if(n == 2).alias("two"), F.count_if(n == 3).alias("three"), F.count_if(n >= 4).alias("more"), F.max(n).cast("long").alias("longest"), F.count_if(F.col("w").rlike("^[0-9]+$")).alias("digits"), F.count_if(F.col("w").rlike("^[0-9.e+-]+$")).alias("numeric"))


@query("A17 W2 W7", """WITH r AS (SELECT user_id, event_id % 6 AS round, value > 50 AS em FROM events), f AS (SELECT user_id, min(CASE WHEN em THEN round END) AS first FROM r GROUP BY user_id),
c AS (SELECT n.i AS round, count(first) AS resolved FROM (SELECT unnest(range(6)) AS i) n LEFT JOIN f ON f.first = n.i GROUP BY n.i)
SELECT round::BIGINT AS round, resolved::BIGINT AS resolved, (sum(resolved) OVER (ORDER BY round))::BIGINT AS so_far, round(100 * sum(resolved) OVER (ORDER BY round) / (SELECT count(*) FROM f), 4) AS percent FROM c""", "events")
def reflection_resolution(events):
    first = events.groupBy("user_id").agg(F.min(F.when(F.col("value") > 50, F.col("event_id") % 6)).alias("first"))
    rounds = events.sparkSession.range(6).withColumnRenamed("id", "round")
    counts = rounds.join(F.broadcast(first.groupBy("first").agg(F.count("*").alias("resolved"))), F.col("round") == F.col("first"), "left").select("round", F.coalesce("resolved", F.lit(0)).cast("long").alias("resolved"))
    total = first.agg(F.count("*").alias("total"))
    so_far = F.sum("resolved").over(Window.orderBy("round"))  # six rows
    return counts.withColumn("so_far", so_far).crossJoin(total).select("round", "resolved", "so_far", F.round(100 * F.col("so_far") / F.col("total"), 4).alias("percent"))


@query("A18", "SELECT user_id, arg_max(event_id, {'em': (value > 50)::INT, 'r': -event_id}) AS best FROM events GROUP BY user_id", "events")
def best_candidate(events):
    return events.groupBy("user_id").agg(F.max_by("event_id", F.struct((F.col("value") > 50).cast("int"), -F.col("event_id"))).alias("best"))


@query("A19 W3", "WITH h AS (SELECT (n_chars // 500 * 500)::BIGINT AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY 1) SELECT bucket, n, (sum(n) OVER (ORDER BY bucket))::BIGINT AS running, round(sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS share FROM h", "documents")
def length_cdf(documents):
    h = documents.groupBy(F.expr("n_chars div 500 * 500").alias("bucket")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy("bucket"))  # a row for each bucket
    return h.select("bucket", "n", running.alias("running"), F.round(running / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("A20 A27", "SELECT lang, round(3e-4 * sqrt(2048 * 8 * (sum(length(text)) / sum(length(text) + 100)) / 4e6), 10) AS lr, round(sum(n_chars) * 3 / 60.0, 4) AS tps FROM documents GROUP BY lang", "documents")
def learning_rate(documents):
    ratio = F.sum(F.length("text")) / F.sum(F.length("text") + 100)
    return documents.groupBy("lang").agg(F.round(3e-4 * F.sqrt(2048 * 8 * ratio / 4e6), 10).alias("lr"), F.round(F.sum("n_chars") * 3 / F.lit(60.0), 4).alias("tps"))


@query("A21 A33 A35", """SELECT vec_id, round(exp(-list_sum(list_transform(embedding, lambda x: -abs(x::DOUBLE))) / len(embedding)), 6) AS ppl, round(embedding[len(list_filter(embedding, lambda x: x > 0))]::DOUBLE, 6) AS reward, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings""", "embeddings")
def sequence_scores(embeddings):
    nll = F.aggregate("embedding", F.lit(0.0), lambda a, x: a - F.abs(x.cast("double")))
    last = F.size(F.filter("embedding", lambda x: x > 0))
    return embeddings.select("vec_id", F.round(F.exp(-nll / F.size("embedding")), 6).alias("ppl"), F.round(F.when(last > 0, F.try_element_at("embedding", last)).cast("double"), 6).alias("reward"), (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"))


@query("A24 A25 A30", """WITH p AS (SELECT a.label, a.embedding[1]::DOUBLE AS c, b.embedding[1]::DOUBLE AS r, list_sum(list_transform(list_zip(a.embedding[:-2], b.embedding[2:]), lambda z: ((z[1] > 0) = (z[2] > 0))::INT)) / (len(a.embedding) - 1) AS acc FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT label, round(avg((c > r)::INT::DOUBLE), 6) AS preferred, round(avg(acc), 6) AS token_accuracy, round(avg(ln(1 + exp(-(c - r)))), 6) AS loss FROM p GROUP BY label""", "embeddings")
def preference_metrics(embeddings):
    b = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    n = F.size("embedding")
    same = F.zip_with(F.slice("embedding", F.lit(1), n - 1), F.slice("other", F.lit(2), n - 1), lambda x, y: F.when((x > 0) == (y > 0), 1.0).otherwise(0.0))
    acc = F.aggregate(same, F.lit(0.0), lambda a, x: a + x) / (n - 1)
    c, r = F.col("embedding")[0].cast("double"), F.col("other")[0].cast("double")
    rows = embeddings.join(b, "vec_id").select("label", c.alias("c"), r.alias("r"), acc.alias("acc"))
    return rows.groupBy("label").agg(F.round(F.avg((F.col("c") > F.col("r")).cast("double")), 6).alias("preferred"), F.round(F.avg("acc"), 6).alias("token_accuracy"), F.round(F.avg(F.log1p(F.exp(-(F.col("c") - F.col("r"))))), 6).alias("loss"))


@query("A26 J11 S11", """SELECT coalesce(r_name, 'Average') AS category, round(100 * avg((c_acctbal > 0)::INT::DOUBLE), 4) AS accuracy, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)""", "customer", "nation", "region")
def accuracy_by_category(customer, nation, region):
    category = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = customer.join(category, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name").agg(F.round(100 * F.avg((F.col("c_acctbal") > 0).cast("double")), 4).alias("accuracy"), F.count("*").alias("n")).select(F.coalesce("r_name", F.lit("Average")).alias("category"), "accuracy", "n")


@query("A32", "SELECT source, arg_min(lang, doc_id) AS lang FROM documents WHERE lang IS NOT NULL GROUP BY source", "documents")
def first_known(documents):
    return documents.where("lang is not null").groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"))


@query("A34", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) AS mean FROM lineitem GROUP BY 1", "lineitem")
def weighted_mean(lineitem):
    return lineitem.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 2).alias("mean"))


@query("J9 W6 T6", """WITH l AS (SELECT event_type AS scope, event_id, ts FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ts DESC, event_id DESC) AS n FROM (SELECT * FROM l UNION ALL SELECT 'global', event_id, ts FROM l))
SELECT scope, n::BIGINT AS n, event_id FROM t WHERE n <= 3""", "events")
def newest_lessons(events):
    lessons = events.select(F.col("event_type").alias("scope"), "event_id", "ts")
    both = lessons.unionByName(lessons.withColumn("scope", F.lit("global")))
    newest = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("ts"), F.desc("event_id")))
    return both.withColumn("n", newest).where("n <= 3").select("scope", F.col("n").cast("long").alias("n"), "event_id")


@query("J12", "SELECT (r_regionkey * 25 + n_nationkey)::BIGINT AS cell, r_name, n_name, (r_regionkey * 25 + n_nationkey) // 25 AS row, (r_regionkey * 25 + n_nationkey) % 25 AS col FROM region CROSS JOIN nation", "region", "nation")
def experiment_grid(region, nation):
    cell = F.col("r_regionkey").cast("long") * 25 + F.col("n_nationkey")
    return region.crossJoin(F.broadcast(nation)).select(cell.alias("cell"), "r_name", "n_name", (F.floor(cell / 25)).cast("int").alias("row"), (cell % 25).cast("int").alias("col"))


@query("R8 W10", "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*)::BIGINT AS n, date_diff('second', min(ts), max(ts))::BIGINT AS elapsed FROM events GROUP BY ALL", "events")
def hourly_usage(events):
    return events.groupBy(F.window("ts", "1 hour").start.alias("bucket"), "event_type").agg(F.count("*").alias("n"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("elapsed"))
