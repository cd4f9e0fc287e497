"""The queries of this package, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from losslens.llm import bpe_replay, hmm, license_scan, line_dedup, media_archive, packing, prefix_trie, quality, reply_trees, simhash, token_count, toxicity, turn_repair
from losslens.llm.common import bound_batches, documents
from losslens.llm.conversation_sql import OP11_SQL, OP13_SQL

RANKS, WORD_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
SPECIALS = {"<|endoftext|>": 50256}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(documents(spark, sf_dir))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary(RANKS), pattern(), SPECIALS)


def op3_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.bpe_encode_decode(documents(spark, sf_dir), vocabulary(RANKS), pattern())


def op4_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity_scores(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return reply_trees.read_back(reply_trees.conversations(reply_trees.link_turns(rows.unionByName(fixed)), unique=True))


def op6_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir))


def op7_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op8_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_archive.media_round_trip(documents(spark, sf_dir))


def op9_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(documents(spark, sf_dir), report=True)


def op10_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), vocabulary(WORD_BPE))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return turn_repair.repair_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_hidden_markov_scores, op2_sum_of_squares_packing, op3_bpe_merge_replay, op4_string_kernel_toxicity, op5_reply_tree_chat, op6_divergence_quality, op7_simhash_blocks, op8_media_archives, op9_bloom_line_dedup, op10_whole_token_counts, op11_turn_repair, op12_license_diagonals, op13_prefix_trie, pipeline]
    return {f.__name__: f for f in own}


#: op9's rows as plain SQL.  Operators without SQL are tested against brute force.
OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT doc_id, line, place,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), bad AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(b.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN b.key IS NULL THEN k.line END, chr(10) ORDER BY k.place), '')) AS kept_sha256
FROM keyed k LEFT JOIN bad b ON k.key = b.key
GROUP BY k.doc_id
"""


#: op5's rows: turns in their order, the template's texts with control strings escaped.
OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role_0, text AS text_0 FROM conversations
  UNION ALL SELECT -1, n, who, '</s>[INST] ok [/INST]', who, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, who)
), escaped AS (
  SELECT *, length(regexp_replace(role, '{control}', '\1\2\\\3', 'g')) + length(regexp_replace(text, '{control}', '\1\2\\\3', 'g')) + {marks} AS chars FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role_0 NULLS FIRST, text_0 NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role_0 NULLS FIRST, text_0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""".replace("{control}", reply_trees.CONTROL.pattern).replace("{marks}", str(len(reply_trees.TURN + reply_trees.TEXT + reply_trees.END_TURN)))


def _divergence(counts: str, shares: str) -> str:
    """SQL of the Jensen-Shannon distance of a list of counts and a list of shares."""
    p, q = f"(z[1] / list_sum({counts}))", f"(z[2] / list_sum({shares}))"
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(list_sum(list_transform(list_zip({counts}, {shares}), lambda z: ({part(p, q)} + {part(q, p)}) / 2)), 0)) ELSE 0 END"


def op6_sql() -> str:
    """op6's rows: base counts by windows, distances by lists."""
    refs = ", ".join(f"('{k}', {list(quality.CLASSES[k])}::DOUBLE[], {list(v)}, {[*v.values(), 1 - sum(v.values())]}::DOUBLE[])" for k, v in quality.COMMON.items())
    return rf"""
WITH refs(name, classes, names, shares) AS (VALUES {refs}),
docs AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docs),
windows AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
base AS (
  SELECT d.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0) AS n_repeat_words, length(t) AS n,
         length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) AS digits,
         length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS white, length(t) - length(regexp_replace(t, '[.,;:!?''"()\-]+', '', 'g')) AS marks
  FROM docs d LEFT JOIN repeats r ON r.doc_id = d.doc_id
),
common AS (SELECT b.doc_id, r.name, r.classes, r.shares, b.n_words, [letters, digits, white, marks, n - letters - digits - white - marks]::DOUBLE[] AS seen,
                  list_transform(r.names, lambda y: len(list_filter(w, lambda x: x = y)))::DOUBLE[] AS found
           FROM base b JOIN refs r ON r.name = b.lang OR b.lang IS NULL OR b.lang NOT IN (SELECT name FROM refs)),
whole AS (SELECT *, list_append(found, n_words - list_sum(found)) AS hits FROM common),
far AS (SELECT doc_id, min({_divergence("seen", "classes")}) AS class_far, min({_divergence("hits", "shares")}) AS word_far FROM whole GROUP BY doc_id),
judged AS (SELECT b.*, class_far, word_far, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base b JOIN far f ON f.doc_id = b.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       round(class_far, 6) AS class_distance, round(word_far, 6) AS word_distance,
       NOT (base_failed OR (n >= {quality.LEAST_CHARACTERS} AND class_far > {quality.MOST_CLASS_DISTANCE}) OR (n_words >= {quality.LEAST_WORDS} AND word_far > {quality.MOST_WORD_DISTANCE})) AS kept
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_reply_tree_chat": OP5_SQL, "op6_divergence_quality": op6_sql(), "op9_bloom_line_dedup": OP9_SQL, "op11_turn_repair": OP11_SQL, "op12_license_diagonals": license_scan.license_sql(), "op13_prefix_trie": OP13_SQL}
