"""Verification as a stateful stream: each item keeps what it has seen and how its outputs fared."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from losslens.sources.appends import CommittedLines

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings (dots as two underscores) inside the block; what was there comes back."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class SeenOnce(StatefulProcessor):
    """Passes each output of an item on once, verified, with how many of the item's outputs in this part have had its status so far.

    State of a part: the outputs that were seen, and a counter for each item and
    status.  A batch asks for a counter once and writes it back once.
    """

    def __init__(self, keys: list[str], output: str, verify: Callable[[dict], str]):
        self.keys, self.output, self.verify = keys, output, verify

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "output string", "there boolean")
        self.counts = handle.getMapState("counts", "status string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for some in rows:
            out = []
            for row in some.to_dict("records"):
                item = [row[k] for k in self.keys]
                name = json.dumps([*item, row[self.output]], default=str)
                if self.seen.containsKey((name,)):
                    continue
                self.seen.updateValue((name,), (True,))
                status = self.verify(row)
                counted = json.dumps([*item, status], default=str)
                if counted not in counts:
                    counts[counted] = self.counts.getValue((counted,))[0] if self.counts.containsKey((counted,)) else 0
                counts[counted] += 1
                out.append((*item, key[0], row[self.output], status, counts[counted]))
            if out:
                yield pd.DataFrame(out, columns=[*self.keys, "part", self.output, "status", "so_far"])
        for counted, n in counts.items():
            self.counts.updateValue((counted,), (n,))

    def close(self) -> None:
        pass


#: Parts of the state; outputs are dealt over them by a hash of item and output.
PARTS = 64


def verified_stream(stream: DataFrame, keys: list[str], output: str, verify: Callable[[dict], str], parts: int = PARTS) -> DataFrame:
    """keys, part, output, status and so_far (of the item in the part) of each output of an item (``keys``), once, in append mode.

    Outputs are dealt over ``parts`` states, so an item with a third of all rows is
    many tasks and small items share one; what was seen lies in the state store,
    on disk.
    """
    dealt = stream.withColumn("part", F.pmod(F.xxhash64(*keys, output), F.lit(parts)).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "part", output]) + ", status string, so_far long"
    return dealt.groupBy("part").transformWithStateInPandas(SeenOnce(keys, output, verify), schema, "Append", "None")


def status_counts(verified: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status and n: how many outputs of each item have each status, from the last counters of its parts."""
    last = verified.groupBy(*keys, "part", "status").agg(F.max("so_far").alias("n"))
    return last.groupBy(*keys, "status").agg(F.sum("n").alias("n"))


def run_verification(spark: SparkSession, source: str, schema: str, keys: list[str], output: str, verify: Callable[[dict], str], out: str, checkpoint: str, files: int = 1000, chunk: int = 50) -> StreamingQuery:
    """Verifies what lies in the folder ``source`` (Parquet) and hasn't been verified, and ends.

    Started again with the same checkpoint it goes on where it stopped, with the
    state it had; a micro-batch that failed is repeated, and its rows count once
    (``committed_lines``).
    """
    spark.dataSource.register(CommittedLines)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(source)
        done = verified_stream(stream, keys, output, verify)
        query = done.writeStream.format("committed_lines").option("path", out).option("chunk", chunk).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()  # inside the block: settings are read when the stream begins
        return query
