"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that can stand as one pre-token is encoded on
its own by the library; those that give exactly their one id are proven whole
tokens.  Pre-tokens found in that set count one without any merging.  Only the
rest goes through the library's merges, and each such word once per block.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import slices, texts_of

#: Capitals whose small letter the library takes one by one (no final sigma) or from a newer Unicode than Python's.
LOWER = {ord("Σ"): "σ", 0xA7CB: "\u0264", 0xA7DC: "\u019b"}
#: Words with their merged counts kept at most before the memory starts anew.
KEPT_WORDS = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


@lru_cache(2)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass(frozen=True)
class Rules:
    """What a vocabulary file says of normalizing, cutting and ending words."""

    pattern: str
    suffix: str
    compose: bool
    lower: bool


@lru_cache(2)
def rules(path: str) -> Rules:
    """The file's rules; ValueError for a kind of vocabulary that Counter doesn't count like the library.

    Known are byte-level merges over the matches of one pattern, with any of
    canonical composition, runs of white space made one space (which no match
    may contain) and lower case before it.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    steps = whole.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = [x["type"] for x in steps.get("normalizers", [steps]) if x != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
    cut = whole.get("pre_tokenizer") or {}
    cut = cut.get("pretokenizers", [cut])
    model = whole["model"]
    known = (
        steps in ([], ["NFC"], ["Lowercase"], ["NFC", "Lowercase"])
        and [x.get("type") for x in cut] == ["Split", "ByteLevel"]
        and (cut[0]["behavior"], cut[0]["invert"], cut[1]["add_prefix_space"], cut[1]["use_regex"]) == ("Removed", True, False, False)
        and model["type"] == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not any(whole.get(x) for x in ("truncation", "padding"))
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole["added_tokens"])
    )
    if not known:
        raise ValueError(f"{path}: not a vocabulary of the kind counted here")
    return Rules(cut[0]["pattern"]["Regex"], model.get("end_of_word_suffix") or "", "NFC" in steps, "Lowercase" in steps)


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that, alone as a text, the library encodes as just that one token."""
    suffix = rules(path).suffix
    tokenizer = load(path)
    back = {c: b for b, c in enumerate(byte_letters())}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    surfaces, ids = [], []
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        if token in special or not token.endswith(suffix):
            continue
        try:
            surfaces.append(bytes(back[c] for c in token.removesuffix(suffix)).decode())
            ids.append(i)
        except (KeyError, UnicodeDecodeError):
            continue
    coded = tokenizer.encode_batch(surfaces, add_special_tokens=False)
    return frozenset(s for s, i, e in zip(surfaces, ids, coded) if e.ids == [i])


class Counter(dict):
    """pre-token -> number of tokens; starts with the proven whole tokens at one each."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex

        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.model = whole, load(path).model
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.rules = rules(path)
        self.find = regex.compile(self.rules.pattern).findall
        special = [t.content for t in load(path).get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.begin = commonprefix(special)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))
        return n

    def trim(self) -> None:
        if len(self) > len(self.whole) + KEPT_WORDS:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))

    def count(self, text: str) -> int:
        parts = [text]
        if self.special and self.begin in text:
            parts = self.special.split(text)
        n = len(parts) - 1
        for part in parts:
            if self.rules.compose:
                part = unicodedata.normalize("NFC", part)
            if self.rules.lower:
                part = part.translate(LOWER).lower()
            n += sum(map(self.__getitem__, self.find(part)))
        return n


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens; rows are kept one for one,
    repeated ones too, and other columns dropped whatever their names.  A
    vocabulary whose rules aren't known here raises ValueError (see ``rules``).
    The set of whole tokens goes to the executors: it is bounded by the vocabulary.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, whole.value)
        for batch in batches:
            for part in slices(batch, 1):
                texts = texts_of(part, 1)
                counter.trim()
                n = [counter.count(t) for t in texts]
                arrays = [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
