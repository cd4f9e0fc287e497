"""An append sink of JSON lines that counts only what was committed, for batches and streams."""

from __future__ import annotations

import datetime
import decimal
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Folders below the sink's path: lines, and one file for each commit with the names of the files that it made count.
CHUNKS, COMMITS = "chunks", "commits"


@dataclass
class Written(WriterCommitMessage):
    """The files of one task and how many rows are in them."""

    files: list[str] = field(default_factory=list)
    rows: int = 0


def plain(value):
    """What JSON can say of a value of a row."""
    if isinstance(value, Row):
        return value.asDict(recursive=True)
    if isinstance(value, (datetime.date, datetime.datetime, decimal.Decimal)):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return value.decode("latin-1")
    raise TypeError(f"no JSON form of {type(value).__name__}")


class LinesWriter:
    """Writes a task's rows in files of ``chunk`` rows, each closed as soon as it is full, so a task holds one line at a time.

    Names are never used twice: what a failed or repeated attempt has left is in
    no commit, and so never read.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool = False):
        self.path, self.chunk, self.names, self.overwrite = options["path"].rstrip("/"), int(options.get("chunk", 50)), schema.names, overwrite
        if self.chunk < 1:
            raise ValueError("a chunk has at least one row")

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        done, out, n = Written(), None, 0
        files.create_dir(posixpath.join(root, CHUNKS), recursive=True)
        try:
            for row in iterator:
                if out is None:
                    done.files.append(f"{uuid.uuid4().hex}.jsonl")
                    out, n = files.open_output_stream(posixpath.join(root, CHUNKS, done.files[-1])), 0
                out.write((json.dumps(dict(zip(self.names, row)), ensure_ascii=False, default=plain) + "\n").encode())
                n += 1
                done.rows += 1
                if n == self.chunk:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return done

    def _commit(self, name: str, messages: list[Written | None]) -> None:
        """The names of the tasks' files in one file, which appears as a whole."""
        files, root = fs.FileSystem.from_uri(self.path)
        folder = posixpath.join(root, COMMITS)
        files.create_dir(folder, recursive=True)
        if self.overwrite:
            files.delete_dir_contents(folder)
        target = posixpath.join(folder, name)
        if files.get_file_info(target).type == fs.FileType.File:  # this epoch counts already
            return self._drop(messages)
        passing = posixpath.join(folder, f"_{uuid.uuid4().hex}")
        with files.open_output_stream(passing) as out:
            for m in messages:
                for f in m.files if m else []:
                    out.write(f"{f}\n".encode())
        files.move(passing, target)

    def _drop(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for f in m.files if m else []:
                try:
                    files.delete_file(posixpath.join(root, CHUNKS, f))
                except FileNotFoundError:
                    pass


class BatchLinesWriter(LinesWriter, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(f"{uuid.uuid4().hex}.txt", messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)


class StreamLinesWriter(LinesWriter, DataSourceStreamWriter):
    """Epochs have names, so one that is run again after a failure adds nothing."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(f"epoch-{batchId}.txt", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._drop(messages)


class CommittedLines(DataSource):
    """df.write.format("committed_lines").mode("append").save(path), or the same of a stream; options ``path`` and ``chunk`` (rows of a file)."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema: StructType, overwrite: bool) -> BatchLinesWriter:
        return BatchLinesWriter(dict(self.options), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamLinesWriter:
        return StreamLinesWriter(dict(self.options), schema)


def append_lines(rows: DataFrame, path: str, chunk: int = 50, overwrite: bool = False) -> None:
    """Rows appended to the sink in one commit; if a task fails for good, none of them counts."""
    rows.sparkSession.dataSource.register(CommittedLines)
    rows.write.format("committed_lines").option("chunk", chunk).mode("overwrite" if overwrite else "append").save(path)


def committed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all commits; lines of files that no commit names are left out.

    Names of files meet in a join, so neither names nor lines come to the driver.
    """
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    counted = spark.read.text(f"{path.rstrip('/')}/{COMMITS}").select(F.col("value").alias("_file")).distinct()
    lines = spark.read.text(f"{path.rstrip('/')}/{CHUNKS}").select(name.alias("_file"), "value")
    return lines.join(counted, "_file", "left_semi").select(F.from_json("value", schema).alias("row")).select("row.*")
