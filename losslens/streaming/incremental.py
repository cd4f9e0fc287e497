"""Incremental runs: resumable verification of arriving files, and the critique-and-revise loop."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from losslens.functions.answers import MISSING, extract_scalar
from losslens.functions.text import with_budget
from losslens.sources.files import reload


def verify_stream(spark: SparkSession, folder: str, schema: str, verify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: list[str], files: int = 100) -> StreamingQuery:
    """Verify files as they arrive; a key already in ``out`` is skipped, one of equal keys in a batch is kept.

    Each micro-batch lands in its own folder, overwritten if the batch is
    repeated after a failure, so a rerun changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        fresh = rows.dropDuplicates(key)
        try:
            done = spark.read.option("basePath", out).parquet(out).where(F.col("batch") != number).select(*key)
            fresh = fresh.join(done, key, "left_anti")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        verify(fresh).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling hours of an event stream by type; later rows than ``late`` are dropped with their closed hour."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class Lessons:
    """Lessons of earlier runs, read once at the start; what this run appends is seen by the next run only."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.path, self.known = path, reload(spark, path)
        if self.known is None:
            self.known = spark.createDataFrame([], schema)

    def append(self, lessons: DataFrame) -> None:
        lessons.write.mode("append").parquet(self.path)

    def newest(self, key: str, order: str, n: int) -> DataFrame:
        """The n newest known lessons of each key; the group limit sends n rows of a hot key from each task at most."""
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        return self.known.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


class ModelClient:
    """What a model must offer: answers to a list of prompts.  This one is a deterministic stand-in that echoes a prompt's last line."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [(p.splitlines() or [""])[-1] for p in prompts]


def ask(client: ModelClient, prompts: list[str], workers: int, tries: int, pause: float) -> list[str | None]:
    """The client's answers in order, ``workers`` prompts at a time; one that fails ``tries`` times, with a pause between, has none."""

    def one(prompt: str) -> str | None:
        for left in reversed(range(tries)):
            try:
                return client.complete([prompt])[0]
            except Exception:  # a client's own errors: the next try may do
                if left:
                    time.sleep(pause)
        return None

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, prompts))


def call_model(rows: DataFrame, client: ModelClient, prompt: str = "prompt", answer: str = "answer", batch: int = 64, workers: int = 1, tries: int = 2, pause: float = 5.0) -> DataFrame:
    """Rows with the client's answers: in batches inside each partition, or with ``workers`` prompts at a time in each.

    The partitions of rows times ``workers`` bound the calls that run at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf[prompt].fillna("").tolist()
            if workers > 1:
                answers = ask(client, texts, workers, tries, pause)
            else:
                answers = [a for at in range(0, len(texts), batch) for a in client.complete(texts[at : at + batch])]
            yield pdf.assign(**{answer: answers})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, `{answer}` string")


def leases(waiting: list[int], bound: int, turn: int = 0) -> list[int]:
    """How many calls each task may run at once: the bound dealt one by one, from another task each turn, to those that have prompts waiting."""
    out = [0] * len(waiting)
    while sum(out) < bound:
        before = sum(out)
        for k in range(len(waiting)):
            i = (k + turn) % len(waiting)
            if out[i] < waiting[i] and sum(out) < bound:
                out[i] += 1
        if sum(out) == before:
            break
    return out


def call_bounded(rows: DataFrame, client: ModelClient, bound: int, prompt: str = "prompt", answer: str = "answer", quantum: int = 256, tries: int = 2, pause: float = 5.0) -> DataFrame:
    """Rows with the client's answers, ``bound`` calls at a time over the whole cluster, and ``turn`` and ``done``: when they came, in a task's order of completion.

    The tasks run together in a barrier stage.  Before each turn they tell each
    other how many prompts they have waiting and find from that, each by itself,
    the same leases; a task then runs as many calls at once as its lease says, for
    at most ``quantum`` prompts a call.  A task that is lost ends the stage, which
    Spark runs again from its input.  A null prompt is an empty one; a prompt that
    fails ``tries`` times has a null answer.
    """
    if bound < 1:
        raise ValueError("at least one call must be allowed")
    spark = rows.sparkSession
    tasks = max(1, min(bound, spark.sparkContext.defaultParallelism))
    names = rows.columns
    at = names.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, turn, done, held = BarrierTaskContext.get(), 0, 0, []
        source = ((batch, i) for batch in batches for i in range(batch.num_rows))

        def one(place: tuple[pa.RecordBatch, int]) -> tuple:
            batch, i = place
            return batch.slice(i, 1), ask(client, [batch.column(at)[i].as_py() or ""], 1, tries, pause)[0]

        while True:
            held += islice(source, bound * quantum - len(held))
            waiting = [int(x) for x in context.allGather(str(len(held)))]
            if not any(waiting):
                return
            mine = leases(waiting, bound, turn)[context.partitionId()]
            some, held = held[: mine * quantum], held[mine * quantum :]
            if some:
                out, answers = [], []
                with ThreadPoolExecutor(mine) as pool:
                    for future in as_completed([pool.submit(one, x) for x in some]):
                        row, said = future.result()
                        out.append(row)
                        answers.append(said)
                whole = pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(answers, pa.string()), pa.array([turn] * len(out), pa.int64()), pa.array(range(done, done + len(out)), pa.int64())], [*names, answer, "turn", "done"])
                done += len(out)
            turn += 1

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(tasks).mapInArrow(run, f"{kinds}, `{answer}` string, turn long, done long", barrier=True)


# What a model is asked to bring an answer into its form.
REPAIR_SYSTEM = 'You must output ONLY:\n[ANSWER]\n{"output": <value>}\n[/ANSWER]\nNo other text, code, or explanations.'
REPAIR_USER = ("Rewrite into the required format. If it already contains the needed value, keep it.\n------\n", "\n------")


def repair_formats(rows: DataFrame, client: ModelClient, text: str = "text", context: int = 4096, answer: int = 256, margin: int = 128, most_chars: int = 8000, per_token: float = 2.0, workers: int = 4, pause: float = 0.1) -> DataFrame:
    """Rows with ``value``, the plain answer in their text as JSON; texts without one are first given to the model to reformat, within its budget.

    ``repaired`` says so; a text that has none even then has a null value.
    """

    @F.pandas_udf("string")
    def value(said: pd.Series) -> pd.Series:
        found = [MISSING if t is None else extract_scalar(t) for t in said]
        return pd.Series([None if x is MISSING else json.dumps(x) for x in found], dtype=object)

    read = rows.withColumn("value", value(text))
    asked = read.where(F.col("value").isNull()).withColumn("_system", F.lit(REPAIR_SYSTEM)).withColumn("_user", F.concat(F.lit(REPAIR_USER[0]), F.coalesce(text, F.lit("")), F.lit(REPAIR_USER[1])))
    asked = with_budget(asked, "_system", "_user", context, answer, margin, most_chars, per_token).withColumn("_prompt", F.concat("_system", F.lit("\n"), "_user"))
    fixed = call_model(asked, client, "_prompt", "_fixed", workers=workers, pause=pause).withColumn("value", value("_fixed"))
    names = [*rows.columns, "value"]
    return read.where(F.col("value").isNotNull()).select(*names, F.lit(False).alias("repaired")).unionByName(fixed.select(*names, F.lit(True).alias("repaired")))


def reflect(rows: DataFrame, client: ModelClient, score: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], DataFrame], rounds: int = 3) -> DataFrame:
    """Critique and revise: every round takes all unresolved rows at once.

    ``score`` adds ``em`` (0 or 1) to rows with id, prompt, answer; ``save``
    writes a round and reads it back, which cuts the lineage.  Returns the best
    answer of each id (most em, then the earliest round) and its first resolved
    round (null: none).
    """
    history, asked = None, rows.select("id", "prompt")
    for n in range(rounds + 1):
        now = save(score(call_model(asked, client)).select("id", "prompt", "answer", "em").withColumn("round", F.lit(n)), n)
        history = now if history is None else history.unionByName(now)
        asked = now.where("em = 0").select("id", F.concat("prompt", F.lit("\nNot right: "), "answer").alias("prompt"))
    return history.groupBy("id").agg(F.max_by("answer", F.struct("em", -F.col("round"))).alias("answer"), F.min(F.when(F.col("em") == 1, F.col("round"))).alias("resolved"))
