"""Tables in the folder that all executors share, and row numbers in an order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master (tests) a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="losslens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/losslens/{label}-{uuid.uuid4().hex}"
    for made in _scopes[-1:]:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end; results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def saved(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with ``_range`` (numbered by the order) and ``_within`` (their place there, from 0); a hot key is spread over ranges."""
    at = F.monotonically_increasing_id()
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(cut.withColumn("_range", F.shiftright(at, 33)).withColumn("_within", at.bitwiseAND(F.lit((1 << 33) - 1))), "ranged")


def numbered(rows: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """Rows with their number from 0 in the order; no task sees more than its range.

    The driver gets one count of each range, as many as there are partitions.
    """
    cut, starts, total = ranged(rows, *order), [], 0
    for place, n in sorted(tuple(r) for r in cut.groupBy("_range").count().collect()):
        starts.append((place, total))
        total += n
    starts = rows.sparkSession.createDataFrame(starts, "_range long, _start long")
    return cut.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_within")).drop("_range", "_within", "_start")
