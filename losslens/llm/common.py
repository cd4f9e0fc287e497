"""Helpers shared by the operators: the shared folder, saved tables, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from losslens.session import spread
from losslens.sources.saved import delete, fresh
from losslens.sources.saved import saved as save

#: ASCII white space, the only separators between words here.
WHITE = " \t\n\x0b\x0c\r"
#: Text handled at a time inside a Python worker, so memory doesn't follow batch sizes.
SLICE_BYTES = 4 << 20


#: Rows that go to a Python worker at a time.
BATCH_ROWS = 1000
#: A key is hot beyond this many rows, and beyond one part in HOT_KEYS of all; so there are never more than HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 64, 1000


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a saved table that nothing reads any more."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, root)


@contextmanager
def bucketed(rows: DataFrame, label: str, by: str) -> Iterator[DataFrame]:
    """Rows saved in the shared folder as a table bucketed by a column, so that joins on it leave them where they lie; gone after the block."""
    spark = rows.sparkSession
    name, path = f"losslens_{label.replace('-', '_')}_{uuid.uuid4().hex}", fresh(spark, label)
    rows.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def without_dots(docs: DataFrame) -> DataFrame:
    """docs with other names for columns whose names hold a dot or a backtick, which ``mapInArrow`` can't take."""
    taken, out = set(docs.columns), []
    for i, c in enumerate(docs.columns):
        name = c
        if "." in c or "`" in c:
            name = f"column {i}"
            while name in taken:
                name += "_"
        out.append(name)
    return docs.toDF(*out)


def hot_join(left: DataFrame, right: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """left's rows with right's columns; right has each key once (null is a key too).

    ``weight`` is right's column with the number of left's rows that have the
    key, ``total`` about the number of left's rows.  Hot keys, HOT_KEYS at most,
    are broadcast, so that none of them fills a task; the others meet in a shuffle.
    """
    hot = F.col(weight) > max(HOT_ROWS, total // HOT_KEYS)
    named = right.withColumnRenamed(on, "__key")
    same = left[on].eqNullSafe(F.col("__key"))
    few = F.broadcast(named.where(hot).drop(weight))
    most = left.join(F.broadcast(named.where(hot).select("__key")), same, "left_anti").join(named.where(~hot).drop(weight), F.col(on).eqNullSafe(F.col("__key")))
    return left.join(few, same).drop("__key").unionByName(most.drop("__key"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text each (a longer row stands alone)."""
    sizes = batch.column(column).cast(pa.binary())
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(sizes).to_pylist()):
        n = n or 0
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """Texts, null as the empty one."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """UTF-8 texts, null as the empty one."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session pass at most so many rows at a time to Python workers: whole texts may be long, and a batch lies in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
