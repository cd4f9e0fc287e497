"""Running sums over sorted ranges: what a window says, without a key's rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from losslens.llm.common import save

#: Sums are taken modulo this, so hashes can be added up like counts.
MODULUS = 1 << 62


def running_sums(rows: DataFrame, key: str, order: list[str | Column], values: list[str], label: str = "running") -> DataFrame:
    """rows, each of ``values`` (longs from 0 up, no nulls) as its sum over the key's rows up to this one, modulo 2**62.

    ``order`` tells the rows of a key apart (ties come in any order).  Rows are
    sorted range by range, each range is summed on its own, and the sum of a key
    that goes on in the next range is carried there: the driver gets one row of
    each range, so a key with a third of all rows is many tasks.  A null key is a
    key; an empty table gives an empty one.  Columns whose names begin with
    ``_range`` can't be in rows.
    """
    if clash := [c for c in rows.columns if c.startswith("_range")]:
        raise ValueError(f"column names kept for the ranges: {clash}")
    names, by = rows.columns, [F.col(key).asc_nulls_first(), *order]
    key_at, value_at = names.index(key), [names.index(v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, runs, last, held = TaskContext.get().partitionId(), 0, 0, None, np.zeros(len(values), np.uint64)
        for batch in batches:
            n, keys = batch.num_rows, batch.column(key_at).to_pylist()
            if not n:
                continue
            starts = np.fromiter((a != b for a, b in zip(keys, [last, *keys])), bool, n)
            starts[0] |= at == 0
            place = np.arange(n)
            begun = np.maximum.accumulate(np.where(starts, place, -1))
            columns = list(batch.columns)
            for i, v in enumerate(value_at):
                own = batch.column(v).to_numpy(zero_copy_only=False).astype(np.uint64)
                total = np.cumsum(own)
                sums = np.where(begun >= 0, total - (total - own)[begun], total + held[i]) & np.uint64(MODULUS - 1)
                columns[v], held[i] = pa.array(sums.astype(np.int64)), sums[-1]
            run_no = np.cumsum(starts) + runs
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int64)), pa.array(place + at), pa.array(run_no == 1)], [*names, "_range", "_range_place", "_range_first"])
            at, runs, last = at + n, int(run_no[-1]), keys[-1]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    cut = save(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, f"{kinds}, _range long, _range_place long, _range_first boolean"), label)
    ends = cut.groupBy("_range").agg(
        F.min_by(F.struct(F.col(key).alias("key")), "_range_place").alias("first"),
        F.max_by(F.struct(F.col(key).alias("key"), F.array(*values).alias("sums")), "_range_place").alias("last"),
        F.min("_range_first").alias("single"),
    )
    carries, before, sums = [], None, [0] * len(values)
    for r in sorted(ends.collect(), key=lambda r: r["_range"]):  # a row for each range
        carry = sums if before is not None and before.key == r.first.key else [0] * len(values)
        carries.append((r["_range"], carry))
        before, sums = r.last, [(s + (c if r.single else 0)) % MODULUS for s, c in zip(r.last.sums, carry)]
    carries = rows.sparkSession.createDataFrame(carries, "_range long, _range_carry array<long>")
    carried = lambda i: F.when(F.col("_range_first"), F.col("_range_carry")[i]).otherwise(F.lit(0))
    summed = {v: (F.col(f"`{v}`") + carried(i)).bitwiseAND(F.lit(MODULUS - 1)) for i, v in enumerate(values)}
    return cut.join(F.broadcast(carries), "_range").withColumns(summed).drop("_range", "_range_place", "_range_first", "_range_carry")
