"""File sources and sinks: JSON lines, line files, sidecars, registries."""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: How a null is written to CSV.
NULL = "\\N"
#: Readers by file extension.
READERS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text", "orc": "orc"}


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines go, and a bad line is dropped, or fails the read if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("row"), F.expr("try_parse_json(value)").alias("any"))
    return parsed.where(F.col("any").isNotNull()).select("row.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def read_by_extension(spark: SparkSession, path: str, extension: str, **options: str) -> DataFrame:
    if extension not in READERS:
        raise ValueError(f"no reader for .{extension}")
    return spark.read.options(**options).format(READERS[extension]).load(path)


def extension_of(spark: SparkSession, path: str) -> str:
    """The extension of a file, or the one that all files of a folder share; names that start with _ or . don't count.

    A folder without files, or with files of two kinds, raises.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place) if f.isFile()]
    kinds = {n.rsplit(".", 1)[-1].lower() for n in names if n[0] not in "_."}
    if len(kinds) != 1:
        raise ValueError(f"{path} holds files of {len(kinds)} kinds, not of one")
    return kinds.pop()


def read_files(spark: SparkSession, path: str, schema: str | StructType | None = None, **options: str) -> DataFrame:
    """Any of the known kinds, told by the extension; ``arrow`` and ``pkl`` need a schema."""
    kind = extension_of(spark, path)
    if kind in BINARY:
        if schema is None:
            raise ValueError(f".{kind} needs a schema")
        return read_binary_tables(spark, path, schema, BINARY[kind])
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}")
    reader = spark.read.options(**options).format(READERS[kind])
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_binary_tables(spark: SparkSession, path: str, schema: str | StructType, parse: Callable[[bytes, pa.Schema], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of files that ``parse`` turns into batches, a file a row of the scan; missing columns are null, others are left out."""
    want = spark.createDataFrame([], schema).schema
    kinds = to_arrow_schema(want)

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in files:
            for content in some.column(0):
                for part in parse(content.as_py(), kinds):
                    columns = [part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in kinds]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, want)


def arrow_batches(content: bytes, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of an Arrow file or stream."""
    source = pa.BufferReader(content)
    if content[:6] == b"ARROW1":
        reader = pa.ipc.open_file(source)
        yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
    else:
        yield from pa.ipc.open_stream(source)


class _Plain(pickle.Unpickler):
    """Reads plain containers only: a pickle that names any class or function raises, so nothing in it is run."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} isn't plain data")


def pickle_batches(content: bytes, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one pickled list of dicts."""
    yield from pa.Table.from_pylist(_Plain(io.BytesIO(content)).load(), schema=kinds).to_batches()


BINARY = {"arrow": arrow_batches, "pkl": pickle_batches}


def newest_snapshot(spark: SparkSession, root: str, marker: str = "config.json") -> str | None:
    """The folder under ``root`` whose ``marker`` file changed last, or None; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(root)
    found = files.select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"), "modificationTime").agg(F.max_by("folder", F.struct("modificationTime", "folder")).alias("folder")).first()
    return found.folder


def reload(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that an earlier run saved, or None where the folder is missing or empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(place) and len(fs.listStatus(place)) else None


def reload_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The saved table, else the built one, saved first."""
    if reload(spark, path) is None:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside are doubled, so any text comes back with ``read_csv``."""
    rows.write.mode("overwrite").options(header="true", escape='"', quoteAll="true", emptyValue="", nullValue=NULL).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).options(header="true", escape='"', multiLine="true", nullValue=NULL).csv(path)


def rewrite_csv(fresh: DataFrame, path: str, schema: str | StructType, next_path: str) -> DataFrame:
    """All rows of the earlier runs in ``path`` and the fresh ones, written anew to ``next_path`` (a rerun changes nothing)."""
    write_csv(read_csv(fresh.sparkSession, path, schema).unionByName(fresh), next_path)
    return read_csv(fresh.sparkSession, next_path, schema)


def json_cell(value: Column) -> Column:
    """A value as JSON, null as ``null``."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def stats_lines(rows: DataFrame, encoded: list[str], bare: list[str], order: list[str]) -> DataFrame:
    """``line``: the columns in ``order`` with commas between, ``encoded`` ones as JSON, ``bare`` ones as they are and empty where null."""
    cells = {c: json_cell(F.col(c)) for c in encoded} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in bare}
    return rows.select("*", F.concat_ws(",", *[cells[c] for c in order]).alias("line"))


def with_path_columns(rows: DataFrame) -> DataFrame:
    """algo (the parent folder) and model (file name without _verified and sampling marks) from each row's file."""
    path = F.col("_metadata.file_path")
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.[a-z]+$", 1), r"_verified$", "")
    return rows.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("algo"), F.regexp_replace(name, r"_temp_[0-9.]+_n[0-9]+k?$", "").alias("model"))


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with nulls kept."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def model_registry(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """id, size, category (unknown where missing), active: a small dimension table; a row without id is dropped."""
    rows = [(e["id"], e.get("size"), e.get("category") or "unknown", bool(e.get("active"))) for e in entries if e.get("id")]
    return spark.createDataFrame(rows, "id string, size string, category string, active boolean")
