"""Media columns in archives, behind a Spark data source.

Payloads become 64-pixel-wide grey PNG images (8-bit samples, lossless) packed
into tar archives, each beside an index of member offsets.  The ``media_archive``
data source lists the archive directory, plans byte ranges over the archives,
and each range streams, as Arrow batches, the members that begin inside it.  A
member is read by its own offset and, if that fails, retried on its own.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from losslens.llm.common import bytes_of, fresh, slices

WIDTH = 64
#: An archive is closed at this size; a byte range plans about RANGE_BYTES.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 16 << 20
#: The list of complete archives: their names, sizes and members, one row each.
COMMIT = "_archives"
TRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def to_png(text: bytes) -> bytes:
    """The padded text as an image; a private chunk holds the unpadded length."""
    payload = padded(text)
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row led by filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"nbYt", struct.pack(">Q", len(text))) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length of an image made by to_png; raises ValueError for anything else or damage."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, body, unpadded = len(SIGNATURE), b"", 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body += data
        elif kind == b"nbYt":
            (unpadded,) = struct.unpack(">Q", data)
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes(), unpadded


def feature(payload: bytes) -> str:
    """Height, mean, variance and the entropy of the samples' histogram, rounded to be the same anywhere."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    return f"h={n // WIDTH};mean={total / n:.4f};var={squares / n - (total / n) ** 2:.3f};entropy={abs(entropy):.4f}"


class ArchiveWriter:
    """Writes members one after another, into archives under names of their own; each has an index of its members beside it.

    An index (an Arrow file) has for each member its header's offset, its
    content's offset, length and crc32, and its id.
    """

    def __init__(self, folder: str, id_type: pa.DataType):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.schema = pa.schema([("start", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("id", id_type)])
        self.out, self.done = None, []

    def add(self, key, media: bytes) -> None:
        if self.out is None:
            self.name = f"part-{uuid.uuid4().hex}"
            self.out, self.at, self.index = self.files.open_output_stream(posixpath.join(self.folder, self.name + ".tar")), 0, []
        info = tarfile.TarInfo(f"{len(self.index):09d}.png")
        info.size = len(media)
        header = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(header)
        self.out.write(media)
        self.out.write(b"\0" * (-len(media) % 512))
        self.index.append((self.at, self.at + len(header), len(media), zlib.crc32(media), key))
        self.at += len(header) + len(media) + -len(media) % 512
        if self.at >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            with self.files.open_output_stream(posixpath.join(self.folder, self.name + ".idx")) as f, pa.ipc.new_file(f, self.schema) as index:
                index.write_batch(pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*self.index), self.schema)], schema=self.schema))
            self.done.append((self.name, self.at + 1024, len(self.index)))
            self.out = None


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Store each text's padded UTF-8 bytes (null: empty) as an image; returns the number of members.

    Ids keep their type; null and repeated ids, repeated rows and equal texts
    are members of their own, a text of any length is one member.  Every attempt
    of a task writes under names of its own, and only the archives of the
    attempts that Spark takes are listed, at the end, in one file; those of
    other attempts are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            writer = writer or ArchiveWriter(folder, batch.schema.field(0).type)
            for part in slices(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), bytes_of(part, 1)):
                    writer.add(key, to_png(text))
        if writer:
            writer.close()
        columns = list(zip(*writer.done)) if writer and writer.done else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["name", "size", "members"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = sorted(map(tuple, rows.mapInArrow(run, "name string, size long, members long").collect()))  # a row for each ARCHIVE_BYTES
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(posixpath.join(root, COMMIT)) as f:
        f.write(json.dumps(done).encode())
    return sum(n for _, _, n in done)


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, span: int):
        self.folder, self.span = folder, span

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over the archives listed as complete; none of these is opened."""
        files, root = fs.FileSystem.from_uri(self.folder)
        with files.open_input_stream(posixpath.join(root, COMMIT)) as f:
            found = json.loads(f.read())
        ranges = [ByteRange(posixpath.join(root, name + ".tar"), at, min(at + self.span, n)) for name, n, _ in found for at in range(0, n, self.span)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, _ = fs.FileSystem.from_uri(self.folder)
        with files.open_input_file(partition.archive[: -len("tar")] + "idx") as f:
            index = pa.ipc.open_file(f).read_all()
        start = index["start"].to_numpy()
        mine = index.filter(pa.array((start >= partition.start) & (start < partition.end)))
        kind, held, size = mine.schema.field("id").type, [], 0
        for i, member in enumerate(mine.to_pylist()):
            held.append((member["id"], member["at"], self.member(files, partition.archive, member)))
            size += member["size"]
            if size >= 2 << 20 or i + 1 == len(mine):
                ids, at, media = zip(*held)
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([partition.archive] * len(ids), pa.string()), pa.array(at, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "archive", "offset", "media"])
                held, size = [], 0

    source = None

    def member(self, files: fs.FileSystem, archive: str, member: dict) -> bytes:
        """One member by its offset; a failed or damaged read reopens the archive there, for this member alone."""
        for attempt in range(TRIES):
            try:
                if self.source is None or self.source[0] != archive:
                    self.source = archive, files.open_input_file(archive)
                media = self.source[1].read_at(member["size"], member["at"])
                if zlib.crc32(media) != member["crc"]:
                    raise OSError(f"damaged member at {member['at']} of {archive}")
                return media
            except OSError:
                self.source = None
                if attempt + 1 == TRIES:
                    raise
                time.sleep(0.2 * 2**attempt)
        raise AssertionError


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder): doc_id (of option idType), archive, offset, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return f"doc_id {self.options.get('idType', 'long')}, archive string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, id_type: str = "long") -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).option("idType", id_type).load(folder)


def describe_media(media: DataFrame) -> DataFrame:
    """Decode the images read back and describe them: one row per member, ids may be null or repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(1).to_pylist():
                payload, n = from_png(stored)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read it back through the data source, and describe what came back.

    One row for each row of docs; null texts count as empty, ids keep their
    type, other columns are dropped.  The archives lie in the shared folder
    until a ``scratch`` around the query ends.
    """
    spark = docs.sparkSession
    folder = fresh(spark, "media")
    write_archives(docs, folder, id_col, text_col)
    return describe_media(read_archives(spark, folder, id_type=docs.schema[id_col].dataType.simpleString()))
