"""Model inputs by training stage, splits of a stream of samples, and functions by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from losslens.operators import sft
from losslens.operators.children import Child, ChildDied, KernelFailed, TimeUp

IGNORED = -100


def _joined(source: Column, target: Column) -> list[Column]:
    """Ids of both, and labels that ignore the source."""
    return [F.concat(source, target), F.concat(F.array_repeat(F.lit(IGNORED), F.size(source)), target)]


def thousandths(x: Column) -> Column:
    """A number times 1000 in its own type, cut to a whole one: a float's product is rounded as a float, not as a double."""
    return (x * F.lit(1000).cast("float")).cast("int")


def pretraining(rows: DataFrame) -> DataFrame:
    ids = F.concat("source", "target")
    return rows.select("id", ids.alias("input_ids"), ids.alias("labels"))


def supervised(rows: DataFrame) -> DataFrame:
    ids, labels = _joined(F.col("source"), F.col("target"))
    return rows.select("id", ids.alias("input_ids"), labels.alias("labels"))


def packed_supervised(rows: DataFrame, capacity: int = 2048, pad: int = 0) -> DataFrame:
    """Samples packed by length over the whole table, each pack padded to ``capacity`` + 1.

    ``attention`` numbers the samples of a pack from 1 (0 where padded),
    ``positions`` counts inside each sample; padded labels are ignored.  Longer
    samples than the capacity are left out, as in ``pack_lengths``.
    """
    samples = supervised(rows)
    bins = sft.pack_lengths(samples.withColumn("length", F.size("input_ids")), "id", "length", capacity).select("id", "bin", "place")
    parts = samples.join(bins, "id").groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("place", "id", "input_ids", "labels"))).alias("s"))  # no more than the capacity
    fill = lambda ids, value: F.concat(ids, F.array_repeat(F.lit(value), capacity + 1 - F.size(ids)))
    number = F.flatten(F.transform("s", lambda x, i: F.array_repeat(i + 1, F.size(x["input_ids"]))))
    counted = F.flatten(F.transform("s", lambda x: F.when(F.size(x["input_ids"]) > 0, F.sequence(F.lit(0), F.size(x["input_ids"]) - 1)).otherwise(F.array().cast("array<int>"))))
    filled = [fill(ids, value).alias(name) for name, ids, value in (("input_ids", F.flatten("s.input_ids"), pad), ("labels", F.flatten("s.labels"), IGNORED), ("attention", number, 0), ("positions", counted, 0))]
    return parts.select(F.col("bin").alias("id"), F.col("s.id").alias("ids"), *filled)


def pairwise(rows: DataFrame) -> DataFrame:
    """Needs ``rejected`` beside ``target``."""
    (good, good_labels), (bad, bad_labels) = _joined(F.col("source"), F.col("target")), _joined(F.col("source"), F.col("rejected"))
    return rows.select("id", good.alias("input_ids"), good_labels.alias("labels"), bad.alias("rejected_input_ids"), bad_labels.alias("rejected_labels"))


def feedback(rows: DataFrame) -> DataFrame:
    """Needs ``desirable``."""
    ids, labels = _joined(F.col("source"), F.col("target"))
    return rows.select("id", ids.alias("input_ids"), labels.alias("labels"), F.col("desirable").alias("kto_tag"))


def unsupervised(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("source").alias("input_ids"), F.col("target").alias("labels"))


def processor(stage: str, packing: bool = False, generate: bool = False) -> Callable[[DataFrame], DataFrame]:
    """What makes a stage's inputs of rows (id, source, target): any other stage, and generation, learn nothing."""
    if stage == "sft" and not generate:
        return packed_supervised if packing else supervised
    return {"pt": pretraining, "rm": pairwise, "kto": feedback}.get(stage, unsupervised)


def take_and_skip(rows: DataFrame, size: int, key: Column) -> DataFrame:
    """Rows with ``validation``: true for the first ``size`` in the order of ``key``, as a shuffled stream's take and skip.

    Only the key of the last row taken comes to the driver; keys must differ.
    """
    if not isinstance(size, int) or size < 0:
        raise ValueError("a stream is split by a whole number of rows")
    if size == 0:
        return rows.withColumn("validation", F.lit(False))
    last = rows.select(key.alias("k")).orderBy("k").limit(size).agg(F.max("k").alias("k")).first().k
    return rows.withColumn("validation", F.coalesce(key <= F.lit(last), F.lit(False)))


class Registry:
    """Objects by name; a name is given once."""

    def __init__(self, kind: str) -> None:
        self.kind, self.found = kind, {}

    def register(self, name: str, what):
        if name in self.found:
            raise ValueError(f"{self.kind} {name} is there already")
        self.found[name] = what
        return what

    def __getitem__(self, name: str):
        if name not in self.found:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self.found))}")
        return self.found[name]


#: Functions of this library that data may name; nothing else is ever run for a row.
KERNELS = Registry("kernel")


def run_kernels(rows: DataFrame, kernel: str, value: str, out: str = "output") -> DataFrame:
    """Rows with what a registered kernel returns for a column, as JSON; ``ERROR: `` and the reason where it raises."""
    from losslens.functions import codecs

    call = KERNELS[kernel]

    def run(x):
        try:
            return json.dumps(call(x), ensure_ascii=False)
        except Exception as e:  # a failing run is a result
            return f"ERROR: {type(e).__name__}: {e}"

    return rows.withColumn(out, codecs.column(run, "string")(value))


def check_kernels(rows: DataFrame, kernel: str, value: str, expected: str, seconds: float = 5.0, out: str = "checked") -> DataFrame:
    """Rows with what came of running a registered kernel on a predicted input: ``success`` if it gives the expected JSON, ``AssertionError`` if another value, the name of what it raised, ``ChildDied``, or ``timeout``.

    Each task has one child process, which is killed with its group after
    ``seconds``, even in code that never comes back to the interpreter.
    """
    call = KERNELS[kernel]

    def one(child: Child, said, wanted: str) -> str:
        try:
            found = child.run(said, seconds)
        except TimeUp:
            return "timeout"
        except ChildDied:
            return "ChildDied"
        except KernelFailed as e:
            return e.kind
        return "success" if json.loads(found) == json.loads(wanted) else "AssertionError"

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        child = Child(call)
        try:
            for said, wanted in parts:
                yield pd.Series([None if a is None or b is None else one(child, a, b) for a, b in zip(said, wanted)], dtype=object)
        finally:
            child.close()

    return rows.withColumn(out, run(value, expected))


def register_functions(spark: SparkSession) -> None:
    """``rle_encode``, ``lzw_encode`` as SQL functions, and the table function ``runs_of(text)`` of (ch, n)."""
    from losslens.functions import codecs

    class RunsOf:
        def eval(self, text: str):
            if text is not None:
                yield from codecs.rle_encode(text)

    spark.udf.register("rle_encode", codecs.column(lambda t: [list(map(str, p)) for p in codecs.rle_encode(t)], "array<array<string>>"))
    spark.udf.register("lzw_encode", codecs.column(codecs.lzw_encode, "array<int>"))
    spark.udtf.register("runs_of", F.udtf(RunsOf, returnType="ch string, n int"))
