"""Queries on mixed, shuffled and packed streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from losslens.operators import mixing
from losslens.plans.registry import query
from losslens.sources import scans
from losslens.sources.saved import fresh

LANGS, SHARES, SEED = ["en", "de", "fr"], [0.5, 0.2, 0.3], 42
SOURCES_SQL = f"""rows AS (SELECT doc_id, list_position({LANGS}, lang) - 1 AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS size FROM documents WHERE lang IN {tuple(LANGS)}),
sizes AS (SELECT DISTINCT source, size FROM rows)"""
DRAW_SQL = "('0x' || substr(md5('{seed}:' || {at}), 1, 13))::BIGINT"


def drawn_sql(pick: str) -> str:
    limits = mixing.bounds(SHARES)
    source = " ".join(f"WHEN d < {b} THEN {i}" for i, b in enumerate(limits[:-1]))
    return f"""WITH {SOURCES_SQL},
slots AS (SELECT slot, CASE {source} ELSE {len(limits) - 1} END AS source FROM (SELECT slot, {DRAW_SQL.format(seed=SEED, at="slot")} AS d FROM (SELECT unnest(range((SELECT 12 * max(size) + 1000 FROM sizes))) AS slot))),
ranked AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS cursor FROM slots),
ends AS (SELECT {pick}(slot) AS last FROM ranked JOIN sizes USING (source) WHERE cursor = size - 1)
SELECT k.source::INT AS source, slot, doc_id FROM ranked k JOIN rows r ON r.source = k.source AND r.rn = k.cursor % r.size, ends WHERE slot <= last"""


def _sources(documents):
    return [documents.where(F.col("lang") == lang).select("doc_id") for lang in LANGS]


@query("U2", drawn_sql("min"), "documents")
def interleave_by_shares(documents):
    """Three languages by uneven probabilities until the first of them ends."""
    return mixing.interleave(_sources(documents), "doc_id", SHARES, SEED)


@query("U2", drawn_sql("max"), "documents")
def interleave_over_sampled(documents):
    """The same until the last of them ends; those that ended before begin anew."""
    return mixing.interleave(_sources(documents), "doc_id", SHARES, SEED, over=True)


@query("U2", f"WITH {SOURCES_SQL}, turns AS (SELECT unnest(range((SELECT max(size) FROM sizes))) AS turn) SELECT source::INT AS source, turn * {len(LANGS)} + source AS slot, doc_id FROM turns JOIN rows ON rn = turn % size", "documents")
def interleave_in_turn(documents):
    """The languages in turn until the longest ends; the others begin anew."""
    return mixing.interleave(_sources(documents), "doc_id", over=True)


BUFFER = 500


@query("T8", f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at_ FROM documents), s AS (SELECT *, CASE WHEN at_ < {BUFFER} THEN at_ ELSE {DRAW_SQL.format(seed=SEED, at="at_")} % {BUFFER} END AS slot FROM n),
l AS (SELECT *, lead(at_) OVER (PARTITION BY slot ORDER BY at_) AS leaves FROM s), rest AS (SELECT doc_id, row_number() OVER (ORDER BY {DRAW_SQL.format(seed=SEED, at="(-at_ - 1)")}, at_) - 1 + greatest((SELECT count(*) FROM n) - {BUFFER}, 0) AS place FROM l WHERE leaves IS NULL)
SELECT doc_id, leaves - {BUFFER} AS place FROM l WHERE leaves IS NOT NULL UNION ALL SELECT doc_id, place FROM rest""", "documents")
def shuffle_buffer(documents):
    """All documents through a shuffle buffer of 500."""
    return mixing.shuffled(documents.select("doc_id"), "doc_id", BUFFER, SEED)


@query("S16 T5", f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY {DRAW_SQL.format(seed=SEED, at="doc_id")}, doc_id) - 1 AS sample, count(*) OVER () AS have FROM documents),
more AS (SELECT k AS sample, {DRAW_SQL.format(seed=SEED + 1, at="k")} % have AS at_ FROM (SELECT unnest(range(any_value(have), any_value(have) * 3 // 2)) AS k, any_value(have) AS have FROM n))
SELECT doc_id, sample FROM n UNION ALL SELECT n.doc_id, m.sample FROM more m JOIN n ON n.sample = m.at_""", "documents")
def over_sampled(documents):
    """A sample half as large again as the table: each row once, then more of them."""
    return mixing.sampled(documents.select("doc_id"), "doc_id", documents.count() * 3 // 2, SEED)


@query("S16 X38", """SELECT conv_id, count(*)::BIGINT AS turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS turns_sha256, count(*) FILTER (role = 'system')::BIGINT AS system FROM conversations GROUP BY conv_id""", "conversations")
def registered_conversations(conversations):
    """Conversations kept under other names, found by a registry's columns, tags and split."""
    spark, folder = conversations.sparkSession, fresh(conversations.sparkSession, "registry")
    who = F.when(F.col("role") == "user", "person").when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    said = F.array_sort(F.collect_list(F.struct("turn", who.alias("who"), F.col("text").alias("words"))))
    conversations.groupBy(F.col("conv_id").alias("number")).agg(said.alias("said")).write.parquet(f"{folder}/talks/train")
    tags = {"role_tag": "who", "content_tag": "words", "user_tag": "person", "assistant_tag": "model"}
    info = {"talks": {"file_name": "talks", "split": "train", "formatting": "sharegpt", "columns": {"messages": "said", "place": "number"}, "tags": tags}}
    scans.write_named(spark.createDataFrame([("dataset_info.json", json.dumps(info))], "name string, content string"), folder)
    rows = scans.load_dataset(spark, folder, "talks")
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select(F.col("place").alias("conv_id"), F.size("messages").cast("long").alias("turns"), F.sha2(F.array_join(lines, "\n"), 256).alias("turns_sha256"), F.size(F.filter("messages", lambda m: m["role"] == "system")).cast("long").alias("system"))


@query("A20", """WITH c AS (SELECT conv_id, sum(length(text)) AS n, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS learned FROM conversations GROUP BY conv_id)
SELECT conv_id, round(learned / n, 6) AS valid, round(3e-4 * sqrt(2048 * 8 * (learned / n) / 4e6), 10) AS lr FROM c WHERE n > 0""", "conversations")
def learned_share(conversations):
    """The share of a conversation's characters that labels keep, and the learning rate that follows from it."""
    labels = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    c = conversations.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"), F.sum(labels).alias("learned")).where("n > 0")
    valid = F.col("learned") / F.col("n")
    return c.select("conv_id", F.round(valid, 6).alias("valid"), F.round(3e-4 * F.sqrt(2048 * 8 * valid / 4e6), 10).alias("lr"))
