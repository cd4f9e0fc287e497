"""License scan by diagonal voting.

Every rolling 3-word gram of a document meets the grams of the templates in a
Spark join on its hash, and on its words, so a hit is a true one.  A hit votes
for its diagonal: where the template would begin in the document.  Votes are
gathered as bit sets of template positions; neighbouring diagonals of a template
(words put in or left out) become one span, and a span that holds enough of its
template is verified and gives the template's label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from losslens.llm.common import HOT_KEYS, HOT_ROWS, bytes_of, save, slices

#: Words of a gram; diagonals up to GAP words apart are neighbours; the least share of a text's grams, and the longest span in multiples of the text.
K, GAP, LEAST_SHARE, LONGEST_SPAN = 3, 6, 0.6, 2
#: Words of a document that travel in a row, bits of a set in a long, partitions of a hot text's copies.
CHUNK_WORDS, BITS, SALTS = 8192, 62, 32
#: A code point of a word, in texts of any case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases and their labels, which must be found whole.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Short notices of public licenses, found whole.
NOTICES = [
    ("permission is hereby granted free of charge to any person", "mit"), ("licensed under the apache license", "apache-2"),
    ("gnu general public license version 3", "gpl-3"), ("gnu general public license version 2", "gpl-2"), ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2"), ("mozilla public license v 2 0", "mpl-2"), ("eclipse public license", "epl"), ("bsd 3 clause", "bsd-3"), ("bsd 2 clause", "bsd-2"), ("under the isc license", "isc"), ("boost software license", "bsl"),
    ("creative commons attribution noncommercial", "cc-by-nc"), ("creative commons attribution sharealike", "cc-by-sa"), ("creative commons attribution 4 0", "cc-by"), ("cc by sa", "cc-by-sa"), ("cc0 1 0 universal", "cc0"), ("released into the public domain", "public-domain"),
]
# Passages of public license texts, found in part and with words put in.
TEXTS = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "bsd-2"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache-2"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "gpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense"),
]

#: Letters and digits in lower case, all else but bytes of other code points a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased."""
    return text.translate(FOLD).split()


def templates() -> list[tuple[int, str, str, list[bytes]]]:
    """(number, kind, label, words): phrase, notice or text."""
    kinds = [("phrase", p) for p in PHRASES] + [("notice", p) for p in NOTICES] + [("text", p) for p in TEXTS]
    return [(i, kind, label, words_of(text.encode())) for i, (kind, (text, label)) in enumerate(kinds)]


#: A longer word is in no template; a mark that is no word stands for it.
LONGEST_WORD = max(len(w) for *_, words in templates() for w in words)
OTHER = b"~"
#: Longs that hold the positions of any template.
WIDTH = max(len(words) - K + 1 for *_, words in templates()) // BITS + 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


_UP, _DOWN = powers(_BASE, 1 << 16), powers(_UNDO, 1 << 16)


def gram_hashes(line: bytes, starts: np.ndarray) -> np.ndarray:
    """Hashes of all grams of words joined by a space (starts: of each word, and one past the last word's space): sums of bytes times powers, moved to the power 0."""
    if len(starts) <= K:
        return np.zeros(0, np.int64)
    global _UP, _DOWN
    if len(line) + 2 > len(_UP):
        _UP, _DOWN = powers(_BASE, 2 * len(line)), powers(_UNDO, 2 * len(line))
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum((np.frombuffer(line, np.uint8).astype(np.uint64) + np.uint64(1)) * _UP[: len(line)], out=sums[1:])
    first, end = starts[:-K], starts[K:] - 1
    return ((sums[end] - sums[first]) * _DOWN[first]).astype(np.int64)


def lines_and_starts(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    kept = [w if len(w) <= LONGEST_WORD else OTHER for w in words]
    starts = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, kept), np.int64, len(kept)) + 1, out=starts[1:])
    return b" ".join(kept), starts


def template_grams(spark: SparkSession) -> DataFrame:
    """(hash, gram, template, at): a row for each gram of each template, a few hundred in all."""
    rows = []
    for i, _, _, words in templates():
        line, starts = lines_and_starts(words)
        rows += [(int(h), b" ".join(words[at : at + K]), i, at) for at, h in enumerate(gram_hashes(line, starts).tolist())]
    return spark.createDataFrame(rows, "hash long, gram binary, template int, at int")


def gram_rows(texts: DataFrame) -> DataFrame:
    """key, first (number of the row's first word), line, starts, hashes: the grams of each text, CHUNK_WORDS of them in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out: tuple[list, ...] = ([], [], [], [], [])
                for key, text in zip(part.column(0).to_pylist(), bytes_of(part, 1)):
                    words = words_of(text)
                    for at in range(0, len(words) - K + 1, CHUNK_WORDS):
                        line, starts = lines_and_starts(words[at : at + CHUNK_WORDS + K - 1])
                        for column, value in zip(out, (key, at, line, starts.astype(np.int32), gram_hashes(line, starts))):
                            column.append(value)
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["key", "first", "line", "starts", "hashes"])

    return texts.mapInArrow(run, "key binary, first long, line binary, starts array<int>, hashes array<long>")


def spans(texts: DataFrame) -> DataFrame:
    """(key, template, kind, label, start, words, share, verified) of each span that holds grams of a template.

    texts has key and text; equal keys must have equal texts (copies count
    once).  A span of a phrase or notice is one diagonal and verified if whole.  A
    span of a text is a run of diagonals at most GAP apart, verified if LEAST_SHARE
    of the text's grams are in it and it isn't over LONGEST_SPAN times the text,
    or if one of its diagonals alone has that share.  Diagonals of one document
    and template meet in one task: a document's own hits, never those of others.
    """
    own = templates()
    grams = gram_rows(texts).select("key", "first", "line", "starts", F.posexplode("hashes").alias("i", "hash"))
    begin = F.get("starts", F.col("i"))
    words = F.substring(F.col("line"), begin + 1, F.get("starts", F.col("i") + K) - begin - 1)
    known = F.broadcast(template_grams(texts.sparkSession).withColumnRenamed("hash", "known"))
    hits = grams.join(known, (F.col("hash") == F.col("known")) & (words == F.col("gram"))).select("key", "template", "at", (F.col("first") + F.col("i") - F.col("at")).alias("diagonal"))
    bit = F.expr(f"shiftleft(1L, at % {BITS})")
    votes = [F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / BITS) == j, bit)), F.lit(0).cast("long")).alias(f"b{j}") for j in range(WIDTH)]
    lines = hits.groupBy("key", "template", "diagonal").agg(*votes, F.min("at").alias("low"), F.max("at").alias("high"))
    about = F.broadcast(texts.sparkSession.createDataFrame([(i, kind, label, len(words), len(words) - K + 1) for i, kind, label, words in own], "template int, kind string, label string, n_words int, n_grams int"))
    count = lambda columns: sum((F.bit_count(c) for c in columns), F.lit(0))
    lines = lines.join(about, "template").withColumn("alone", count([F.col(f"b{j}") for j in range(WIDTH)]) / F.col("n_grams"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("kind") != "text") | (F.col("diagonal") - F.lag("diagonal").over(order) > GAP), F.lit(True))
    runs = lines.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order))
    first, last = F.min(F.col("diagonal") + F.col("low")), F.max(F.col("diagonal") + F.col("high") + K)
    union = [F.bit_or(f"b{j}") for j in range(WIDTH)]
    found = runs.groupBy("key", "template", "run", "kind", "label", "n_words", "n_grams").agg(F.min("diagonal").alias("diagonal"), first.alias("start"), (last - first).alias("words"), F.max("alone").alias("alone"), count(union).alias("n"))
    short = F.col("words") <= LONGEST_SPAN * F.col("n_words")
    share = F.when((F.col("kind") == "text") & short, F.col("n") / F.col("n_grams")).otherwise(F.col("alone"))
    verified = F.when(F.col("kind") == "text", share >= LEAST_SHARE).otherwise(share == 1)
    return found.select("key", "template", "kind", "label", F.when(F.col("kind") == "text", F.col("start")).otherwise(F.col("diagonal")).alias("start"), "words", share.alias("share"), verified.alias("verified"))


def salted_left_join(left: DataFrame, right: DataFrame, on: str, name: str = "_salt") -> DataFrame:
    """left's rows with those of right that have their key (right has each once); rows of a hot key (HOT_KEYS at most) are dealt over SALTS tasks."""
    total = left.count()
    hot = F.broadcast(left.groupBy(on).count().where(F.col("count") > max(HOT_ROWS, total // HOT_KEYS)).select(on, F.lit(True).alias("_hot")))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    one = left.join(hot, on, "left").withColumn(name, F.when(F.col("_hot"), (F.monotonically_increasing_id() % SALTS).cast("int")).otherwise(0)).drop("_hot")
    other = right.join(hot, on, "left").withColumn(name, F.explode(F.when(F.col("_hot"), salts).otherwise(F.array(F.lit(0))))).drop("_hot")
    return one.join(other, [on, name], "left").drop(name)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def license_report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document.

    Base labels are those of PHRASES; ``labels`` has those of all verified spans;
    ``score`` is the largest share of a template that a span of the document
    holds.  A null text is empty; an empty or short one has no labels and a score
    of 0; texts of any length are scanned whole, CHUNK_WORDS at a time; copies of a
    text are scanned each and counted once; repeated rows have a row each.
    doc_id is passed on as it is, null too; other columns, of any name, are left
    out; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    whole = docs.select("doc_id", text.alias("text"))
    keyed = save(whole.select("doc_id", text_key(F.col("text")).alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words")), "license-docs")
    found = spans(whole.select(text_key(F.col("text")).alias("key"), "text"))
    base = F.col("verified") & (F.col("kind") == "phrase")
    names = lambda x: F.concat_ws(",", F.array_sort(F.collect_set(F.when(x, F.col("label")))))
    by_text = found.groupBy("key").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("verified")).alias("labels"), F.max("share").alias("score"),
    )
    joined = salted_left_join(keyed, by_text, "key")
    filled = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return joined.select("doc_id", *[F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in columns])


def license_sql() -> str:
    """The report's rows in DuckDB's SQL, by words and windows."""
    quoted = lambda words: "'" + " ".join(w.decode() for w in words) + "'"
    grams = ", ".join(f"({quoted(words[at : at + K])}, {i}, {at})" for i, _, _, words in templates() for at in range(len(words) - K + 1))
    about = ", ".join(f"({i}, '{kind}', '{label}', {len(words)}, {len(words) - K + 1})" for i, kind, label, words in templates())
    return rf"""
WITH grams(gram, template, at_) AS (VALUES {grams}), about(template, kind, label, n_words, n_grams) AS (VALUES {about}),
docs AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM docs),
rolled AS (SELECT id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS gram FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
lines AS (SELECT id, template, i - at_ AS diagonal, list(DISTINCT at_) AS ats, min(at_) AS low, max(at_) AS high FROM rolled JOIN grams USING (gram) GROUP BY ALL),
marked AS (SELECT l.*, a.* EXCLUDE (template), (kind <> 'text' OR coalesce(diagonal - lag(diagonal) OVER o > {GAP}, true))::INT AS apart FROM lines l JOIN about a USING (template) WINDOW o AS (PARTITION BY id, template ORDER BY diagonal)),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY id, template ORDER BY diagonal) AS run FROM marked),
found AS (SELECT id, template, kind, label, n_words, n_grams, min(diagonal) AS diagonal, max(diagonal + high + {K}) - min(diagonal + low) AS words, max(len(ats) / n_grams) AS alone, len(list_distinct(flatten(list(ats)))) / n_grams AS both_ FROM runs GROUP BY id, template, run, kind, label, n_words, n_grams),
spans AS (SELECT *, CASE WHEN kind = 'text' AND words <= {LONGEST_SPAN} * n_words THEN both_ ELSE alone END AS share FROM found),
judged AS (SELECT *, CASE WHEN kind = 'text' THEN share >= {LEAST_SHARE} ELSE share = 1 END AS verified FROM spans)
SELECT any_value(d.doc_id) AS doc_id, any_value(len(d.w))::BIGINT AS n_words, (count(*) FILTER (verified AND kind = 'phrase'))::BIGINT AS n_base,
       min(diagonal) FILTER (verified AND kind = 'phrase') AS first_word, max(diagonal) FILTER (verified AND kind = 'phrase') AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (verified AND kind = 'phrase'))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (verified))), ','), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM docs d LEFT JOIN judged j ON j.id = d.id GROUP BY d.id
"""
