"""Quality rules from histograms, in DataFrame functions only.

A text's histogram over character classes and over common words is compared
with the reference of its language by Jensen-Shannon distance (base 2).  Each
rule is applied only to texts long enough for its histogram to mean something.
Everything is worked out inside a row: no shuffle, no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
# Shares of character classes (letters, digits, white space,
# sentence punctuation, other characters) in running text.
CLASSES = {
    "en": (0.800, 0.005, 0.165, 0.027, 0.003),
    "de": (0.815, 0.005, 0.150, 0.027, 0.003),
    "fr": (0.800, 0.005, 0.163, 0.029, 0.003),
    "es": (0.803, 0.005, 0.163, 0.026, 0.003),
}
# Shares of common words among all words of running text.
COMMON = {
    "en": {"the": 0.060, "of": 0.034, "and": 0.027, "to": 0.024, "a": 0.019, "in": 0.018, "is": 0.011, "that": 0.011, "it": 0.009, "for": 0.009, "was": 0.008, "on": 0.007, "with": 0.007, "as": 0.006, "be": 0.006, "by": 0.005},
    "de": {"der": 0.055, "die": 0.036, "und": 0.027, "in": 0.019, "den": 0.015, "von": 0.013, "zu": 0.012, "das": 0.011, "mit": 0.009, "sich": 0.008, "für": 0.007, "des": 0.007, "im": 0.007, "auf": 0.007, "ist": 0.006, "nicht": 0.006},
    "fr": {"de": 0.058, "la": 0.033, "le": 0.027, "et": 0.020, "les": 0.017, "des": 0.014, "en": 0.012, "un": 0.011, "du": 0.010, "une": 0.009, "que": 0.008, "est": 0.008, "pour": 0.007, "qui": 0.007, "dans": 0.006, "par": 0.005},
    "es": {"de": 0.060, "la": 0.036, "que": 0.027, "el": 0.022, "en": 0.019, "y": 0.018, "los": 0.012, "se": 0.011, "del": 0.010, "las": 0.009, "un": 0.008, "por": 0.008, "con": 0.007, "no": 0.007, "una": 0.006, "su": 0.006},
}
#: A rule rejects above its distance, from so many characters or words on.
MOST_CLASS_DISTANCE, LEAST_CHARACTERS = 0.17, 200
#: A text without any common word is only 0.367 (de) to 0.385 (es) away from its reference, so the word rule rejects from below that.
MOST_WORD_DISTANCE, LEAST_WORDS = 0.30, 150


def fenced(x: Column) -> Column:
    """x itself, but with a part that the optimizer takes for nondeterministic: it is worked out once here and not copied into later filters and lambdas."""
    return F.when(F.spark_partition_id() >= 0, x)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+", -1), "")


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array ``w``.

    Windows are sorted by 33 bits of a hash, their place in the other 31; those
    whose neighbour has equal bits are compared by their words, so the count is
    exact.  ``w`` must be a column that is there already, as it is indexed.
    """
    place = lambda q: q.bitwiseAND(F.lit((1 << 31) - 1))
    top = lambda q: F.shiftright(q, 31)
    one = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  evaluates x once
    beside = lambda a, i, same: (F.coalesce(same(F.get(a, i - 1)), F.lit(False))) | (F.coalesce(same(F.get(a, i + 1)), F.lit(False)))
    keys = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(-(1 << 31))).bitwiseOR(i.cast("long")))
    alike = one(F.sort_array(keys), lambda s: F.filter(s, lambda q, i: beside(s, i, lambda r: top(r) == top(q))))
    window = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("at"))
    same = lambda e: lambda r: (r["a"] == e["a"]) & (r["b"] == e["b"]) & (r["c"] == e["c"])
    sure = one(F.array_sort(F.transform(alike, lambda q: window(place(q).cast("int")))), lambda s: F.filter(s, lambda e, i: beside(s, i, same(e))))
    spots = F.sort_array(F.transform(sure, lambda e: e["at"]))
    return one(spots, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)).cast("long")


def distance(counts: list[Column] | Column, shares: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of a histogram (an array column of doubles) and a reference; 0 for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    scale = sum(shares)
    pairs = F.zip_with(counts, F.array(*[F.lit(s / scale) for s in shares]), lambda x, q: F.struct((x / F.greatest(total, F.lit(1.0))).alias("p"), q.alias("q")))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.transform(pairs, lambda z: (part(z["p"], (z["p"] + z["q"]) / 2) + part(z["q"], (z["p"] + z["q"]) / 2)) / 2)
    return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))).otherwise(0.0)


def by_language(lang: Column, per: dict[str, Column]) -> Column:
    """The value for the text's language; the least of all where the language is null or has no reference."""
    out = None
    for name, value in per.items():
        out = F.when(lang == name, value) if out is None else out.when(lang == name, value)
    return out.otherwise(F.least(*per.values()))


def with_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_words: int = 50) -> DataFrame:
    """All columns of docs and a struct ``__quality`` with the base counts, the distances and the verdict.

    A text of fewer than ``least_words`` words fails, and one most of whose
    words lie in repeated windows; a null text has no words.  Docs without a language column are
    compared with every reference, and the least distance counts.  Columns of
    docs keep their values whatever their names, but for names of the
    operator's own, which begin with two underscores.
    """
    if clash := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"column names of the operator's own: {clash}")
    lang = F.col(f"`{lang_col}`") if lang_col in docs.columns else F.lit(None).cast("string")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    text = docs.select(*keep, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__t"))
    left = lambda classes: F.length(F.regexp_replace("__t", classes, ""))
    n = F.length("__t")
    letters, digits, white, marks = n - left(r"\p{L}+"), n - left(r"[0-9]+"), n - left(SPACE + "+"), n - left(r"[.,;:!?'\"()\-]+")
    ready = text.select("*", fenced(words(F.col("__t"))).alias("__w"))
    counted = ready.select(
        "*",
        fenced(F.struct(
            n.alias("n"),
            F.transform(F.array(letters, digits, white, marks, n - letters - digits - white - marks), lambda x: x.cast("double")).alias("classes"),
            by_words(F.col("__w"), lang).alias("common"),
        )).alias("__c"),
    )
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = counted.select(
        *keep,
        "__c",
        F.size("__w").cast("long").alias("__n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("__word_chars"),
        left(r"[^#*$%&|<>]+").cast("long").alias("__n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("__n_dup_lines"),
        fenced(repeated_words(F.col("__w"))).alias("__n_repeat_words"),
    )
    failed = (F.col("__n_words") < least_words) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    class_far = by_language(lang, {k: distance(F.col("__c.classes"), v) for k, v in CLASSES.items()})
    word_far = by_language(lang, {k: distance(F.transform(F.concat(F.get("__c.common", F.lit(i)), F.array(F.col("__n_words").cast("double") - F.aggregate(F.get("__c.common", F.lit(i)), F.lit(0.0), lambda a, x: a + x))), lambda x: x), (*v.values(), 1 - sum(v.values()))) for i, (k, v) in enumerate(COMMON.items())})
    judged = base.select(*keep, *[F.col(c) for c in base.columns if c.startswith("__n_") or c == "__word_chars"], fenced(failed).alias("__failed"), F.col("__c.n").alias("__n"), fenced(class_far).alias("__class"), fenced(word_far).alias("__word"))
    far = ((F.col("__n") >= LEAST_CHARACTERS) & (F.col("__class") > MOST_CLASS_DISTANCE)) | ((F.col("__n_words") >= LEAST_WORDS) & (F.col("__word") > MOST_WORD_DISTANCE))
    return judged.select(
        *keep,
        F.struct(
            F.col("__n_words").alias("n_words"),
            F.col("__word_chars").alias("word_chars"),
            F.col("__n_symbols").alias("n_symbols"),
            F.col("__n_dup_lines").alias("n_dup_lines"),
            F.col("__n_repeat_words").alias("n_repeat_words"),
            F.col("__failed").alias("base_failed"),
            F.round("__class", 6).alias("class_distance"),
            F.round("__word", 6).alias("word_distance"),
            (~(F.col("__failed") | far)).alias("kept"),
        ).alias("__quality"),
    )


def by_words(w: Column, lang: Column) -> Column:
    """For each language the counts of its common words; left empty (zeros) for languages that the text is not in."""

    def counts(names: list[str]) -> Column:
        found = F.filter(w, lambda x: x.isin(names))
        return F.get(F.transform(F.array(found), lambda f: F.array(*[F.size(F.filter(f, (lambda name: lambda x: x == name)(name))).cast("double") for name in names])), F.lit(0))

    known = lang.isin(list(COMMON))
    zero = lambda names: F.array(*[F.lit(0.0)] * len(names))
    return F.array(*[F.when((lang == k) | ~F.coalesce(known, F.lit(False)), counts(list(v))).otherwise(zero(v)) for k, v in COMMON.items()])


def _renamed(docs: DataFrame, text_col: str, lang_col: str) -> tuple[DataFrame, str, str]:
    """docs under names that clash with nothing, and what its text and language columns are then called."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names[text_col], names.get(lang_col, "none")


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_words: int = 50) -> DataFrame:
    """doc_id and the fields of ``__quality`` for every row; other columns may have any names."""
    wanted = [c for c in ("doc_id", text_col, lang_col) if c in docs.columns]
    return with_quality(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(wanted)]), text_col, lang_col, least_words).select("doc_id", "__quality.*")


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_words: int = 50) -> DataFrame:
    """The rows that are kept, all their columns as they were, whatever their names; texts without words go, repeated rows stay or go together.

    With ``least_words`` of 1 short texts are judged by their repeats only: the
    histograms have least lengths of their own.
    """
    plain, text, lang = _renamed(docs, text_col, lang_col)
    kept = with_quality(plain, text, lang, least_words).where("__quality.kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
