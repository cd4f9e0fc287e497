"""Queries on codecs, answers, packing and metrics: Arrow-batched Python where no built-in says it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from losslens.functions import codecs
from losslens.operators import overlap, sft
from losslens.plans.registry import query
from losslens.session import spread


@query("C1 C2", None, "documents")
def lzw_round_trips(documents):
    """Codes of each whole text, and whether decoding gives it back; null where a character lies outside the 256 of the seed."""
    trip = codecs.column(codecs.lzw_round_trip, "struct<n_codes long, ok boolean>")
    return spread(documents).select("doc_id", trip("text").alias("r")).select("doc_id", "r.*")


@query("C12 C13 C14", """WITH RECURSIVE c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL),
w(doc_id, weights, bits) AS (SELECT doc_id, list_sort(list(n)), CASE WHEN count(*) = 1 THEN max(n) ELSE 0 END FROM n GROUP BY doc_id UNION ALL
SELECT doc_id, list_sort(list_append(weights[3:], weights[1] + weights[2])), bits + weights[1] + weights[2] FROM w WHERE len(weights) > 1),
b AS (SELECT doc_id, max(bits) AS bits FROM w GROUP BY doc_id)
SELECT doc_id, count(*)::BIGINT AS symbols, any_value(bits)::BIGINT AS bits, CASE WHEN count(*) > 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS kraft, true AS ok FROM n JOIN b USING (doc_id) GROUP BY doc_id""", "documents")
def huffman_round_trips(documents):
    """Symbols, length in bits and Kraft sum of each codebook (1, or a half for one symbol), and whether decoding gives the text back."""
    trip = codecs.column(codecs.huffman_summary, "struct<bits long, symbols long, kraft double, ok boolean>")
    return spread(documents).select("doc_id", trip("text").alias("r")).select("doc_id", "r.symbols", "r.bits", "r.kraft", "r.ok")


@query("C5 C7 C8", r"""WITH p AS (SELECT conv_id, turn, unnest(range(ceil(length(text) / 8.0)::BIGINT)) AS k, rpad(text, (ceil(length(text) / 8.0) * 8)::INT, 'x') AS t FROM conversations WHERE text <> ''),
c AS (SELECT conv_id, turn, k, string_split(t[k * 8 + 1:k * 8 + 8], '') AS s FROM p), i AS (SELECT *, list_transform(s, lambda x: len(list_filter(s, lambda y: unicode(y) < unicode(x)))::HUGEINT) AS below, list_transform(s, lambda x: len(list_filter(s, lambda y: y = x))::HUGEINT) AS n FROM c),
l AS (SELECT conv_id, turn, k, below[1] * 2097152 + n[1] * (below[2] * 262144 + n[2] * (below[3] * 32768 + n[3] * (below[4] * 4096 + n[4] * (below[5] * 512 + n[5] * (below[6] * 64 + n[6] * (below[7] * 8 + n[7] * below[8])))))) AS low FROM i),
d AS (SELECT conv_id, turn, k, CASE WHEN low = 0 THEN '0' ELSE '0.' || rtrim(lpad((low * 59604644775390625::HUGEINT)::VARCHAR, 24, '0'), '0') END AS low FROM l)
SELECT conv_id, turn, count(*)::BIGINT AS pieces, sha256(string_agg(low, ' ' ORDER BY k)) AS lows_sha256 FROM d GROUP BY conv_id, turn""", "conversations")
def arithmetic_bounds(conversations):
    """Exact lower bounds, as decimals, of each text in pieces of 8 characters, the last one filled up."""
    lows = codecs.column(codecs.piecewise_lower_digest, "struct<pieces long, lows_sha256 string>")
    return spread(conversations).where("text <> ''").select("conv_id", "turn", lows("text").alias("r")).select("conv_id", "turn", "r.*")


@query("C4", "WITH t(doc_id) AS (SELECT doc_id FROM documents) SELECT doc_id, true AS inside FROM t", "documents")
def arithmetic_midpoints(documents):
    """The binary64 midpoint of each whole text lies in [0, 1]."""
    mid = codecs.column(codecs.ae_encode_float, "double")
    return spread(documents).select("doc_id", mid("text").alias("m")).select("doc_id", ((F.col("m") >= 0) & (F.col("m") <= 1)).alias("inside"))


@query("C5 C6", """WITH t AS (SELECT doc_id, ceil(length(text) / 16.0)::BIGINT AS pieces FROM documents) SELECT doc_id, pieces, pieces AS ok FROM t""", "documents")
def arithmetic_round_trips(documents):
    """Exact arithmetic coding of every text in pieces of 16 characters (fractions grow with the square of a piece): all must decode."""

    @F.pandas_udf("struct<pieces:long,ok:long>")
    def trip(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([x or (None, None) for x in codecs.piecewise_round_trips(texts)], columns=["pieces", "ok"], dtype=object)

    return spread(documents).select("doc_id", trip("text").alias("r")).select("doc_id", "r.*")


def comes_back(text: str) -> bool:
    table, total = codecs.intervals(text)
    low, high = codecs.ae_encode_exact(text)
    return codecs.ae_decode_exact((low + high) / 2, table, total, len(text)) == text


@query("C5 C6", "SELECT item_id, length(text)::BIGINT AS n, true AS ok FROM benchmark", "benchmark")
def arithmetic_whole_texts(benchmark):
    """The same of each whole benchmark text, in one fraction."""
    return spread(benchmark).select("item_id", F.length("text").cast("long").alias("n"), codecs.column(comes_back, "boolean")("text").alias("ok"))


@query("C3 C15 C21", None, "benchmark")
def study_codecs(benchmark):
    """Alphabet-seeded codes and age-ordered prefix codes of each benchmark text."""
    lzw = codecs.column(lambda t: codecs.lzw_encode(t, t), "array<int>")
    bits = codecs.column(lambda t: (lambda book: sum(len(book[c]) for c in t))(codecs.huffman_codebook_ordered(t)), "long")
    return benchmark.select("item_id", lzw("text").alias("codes"), bits("text").alias("bits"))


@query("T9 F9", """WITH RECURSIVE l AS (SELECT list({'n': n_chars, 'id': doc_id} ORDER BY n_chars, doc_id) AS rest FROM documents WHERE n_chars <= 8192),
fill(bin, room, rest, got) AS (SELECT 0::BIGINT, 8192::BIGINT, rest, NULL::STRUCT(n BIGINT, id BIGINT) FROM l UNION ALL
SELECT CASE WHEN p IS NULL THEN bin + 1 ELSE bin END, CASE WHEN p IS NULL THEN 8192 ELSE room - p.n END, CASE WHEN p IS NULL THEN rest ELSE list_filter(rest, lambda y: y <> p) END, p FROM (SELECT *, list_filter(rest, lambda x: x.n <= room)[-1] AS p FROM fill WHERE len(rest) > 0))
SELECT bin, got.id AS id, got.n AS length FROM fill WHERE got IS NOT NULL""", "documents")
def knapsack_bins(documents):
    """All documents of up to 8192 characters in bins of that size, by the greedy rule over the whole table."""
    return sft.pack_lengths(documents, "doc_id", "n_chars", 8192).drop("place")


@query("W8", None, "events")
def smoothed_series(events):
    return sft.smoothed(events, "user_id", "event_id", "value")


METRICS_SQL = r"""WITH RECURSIVE p AS (SELECT a.conv_id, a.turn, list_filter(string_split_regex(a.text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS s, list_filter(string_split_regex(b.text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant'),
rolled AS (SELECT conv_id, turn, k, side, array_to_string(x[i + 1:i + k], ' ') AS g FROM (SELECT *, unnest(range(greatest(len(x) - k + 1, 0))) AS i FROM (SELECT conv_id, turn, 's' AS side, s AS x FROM p UNION ALL SELECT conv_id, turn, 'w', w FROM p), (VALUES (1), (2), (3), (4)) v(k))),
shared AS (SELECT conv_id, turn, k, sum(least(a, b)) AS hit FROM (SELECT conv_id, turn, k, g, count(*) FILTER (side = 's') AS a, count(*) FILTER (side = 'w') AS b FROM rolled GROUP BY ALL) GROUP BY ALL),
hits AS (SELECT p.*, len(s) AS n, len(w) AS m, list_transform([1, 2, 3, 4], lambda k: coalesce(h[k], 0)) AS h FROM p LEFT JOIN (SELECT conv_id, turn, map(list(k), list(hit)) AS h FROM shared GROUP BY ALL) USING (conv_id, turn)),
cells(conv_id, turn, i, j, v) AS (SELECT conv_id, turn, 0, unnest(range(1, len(w) + 1)), 0 FROM p UNION ALL
  SELECT conv_id, turn, i + 1, j, max(best) OVER (PARTITION BY conv_id, turn ORDER BY j) FROM (SELECT c.*, greatest(v, CASE WHEN s[i + 1] = w[j] THEN coalesce(lag(v) OVER (PARTITION BY c.conv_id, c.turn ORDER BY j), 0) + 1 ELSE 0 END) AS best FROM cells c JOIN p USING (conv_id, turn) WHERE i < len(s))),
lcs AS (SELECT conv_id, turn, max(v) AS l FROM cells GROUP BY ALL),
scored AS (SELECT conv_id, turn, n, m, h, coalesce(l, 0) AS l, CASE WHEN n = 0 OR h[1] = 0 THEN 0 ELSE exp(least(0, 1 - m / n) + (ln(h[1] / n) + ln(CASE WHEN h[2] = 0 THEN 0.5 ELSE h[2] END / greatest(n - 1, 1)) + ln(CASE WHEN h[3] = 0 THEN pow(0.5, 1 + (h[2] = 0)::INT) ELSE h[3] END / greatest(n - 2, 1)) + ln(CASE WHEN h[4] = 0 THEN pow(0.5, 1 + (h[2] = 0)::INT + (h[3] = 0)::INT) ELSE h[4] END / greatest(n - 3, 1))) / 4) END AS bleu FROM hits LEFT JOIN lcs USING (conv_id, turn))
SELECT conv_id, round(avg(bleu), 6) AS bleu, round(avg(CASE WHEN h[1] > 0 THEN 2 * h[1] / (n + m) ELSE 0 END), 6) AS rouge1, round(avg(CASE WHEN h[2] > 0 THEN 2 * h[2] / (n + m - 2) ELSE 0 END), 6) AS rouge2, round(avg(CASE WHEN l > 0 THEN 2 * l / (n + m) ELSE 0 END), 6) AS rouge_l FROM scored GROUP BY conv_id"""


@query("A23", METRICS_SQL, "conversations")
def text_metrics(conversations):
    """BLEU-4 and ROUGE of each assistant turn against the turn before it, averaged by conversation."""
    words = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    before = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), words("text").alias("asked"))
    pairs = conversations.where("role = 'assistant'").select("conv_id", "turn", words("text").alias("said")).join(before, ["conv_id", "turn"])
    said, asked = F.col("said"), F.col("asked")
    measures = {"bleu": overlap.bleu4(said, asked)} | overlap.rouge(said, asked)
    return pairs.select("conv_id", *[m.alias(c) for c, m in measures.items()]).groupBy("conv_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in measures])
