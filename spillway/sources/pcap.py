"""Capture files as rows: plain or gzip, in folders, or as members of archives.

A capture is not splittable, so a file is one task's; rows leave in batches while it is
read.  Gzip is told by its first bytes, not by its name.  read_pcap takes files through Spark,
up to 2 GB each; read_large streams files of any size from a file system that pyarrow
reaches.  capture_report says of each file how many records it gave and how it ended.
"""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    InputPartition,
    WriterCommitMessage,
)

from .. import schemas

# Magic numbers, fixed values: byte order and fractions of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
LARGEST, ROWS, BUFFER = 65_536, 4_096, 1 << 20


def records(content: bytes | BinaryIO) -> Generator[tuple[int, int, bytes], None, str]:
    """(microseconds, captured length, bytes) of each record; empty ones are left out, and an overlong or cut one ends the file.

    What ended it is the generator's value: 'end', 'no capture', 'cut short', 'overlong record' or 'damaged gzip'.
    """
    stream = io.BytesIO(content) if isinstance(content, bytes) else content
    stream = io.BufferedReader(stream, BUFFER) if isinstance(stream, io.RawIOBase) else stream
    start = stream.read(2)
    stream = _Rest(start, stream)
    if start == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    try:
        head = stream.read(24)
        order, divide = MAGIC.get(head[:4], (None, 1))
        if order is None or len(head) < 24:
            return "no capture"
        while len(h := stream.read(16)) == 16:
            sec, fraction, size, captured = struct.unpack(order + "4I", h)
            if size > LARGEST:
                return "overlong record"
            data = stream.read(size)
            if len(data) < size:
                return "cut short"
            if size:
                yield sec * 1_000_000 + fraction // divide, captured, data
        return "cut short" if h else "end"
    except (EOFError, OSError, zlib.error):
        return "damaged gzip"


class _Rest:
    """A stream whose first bytes have been looked at."""

    def __init__(self, start: bytes, stream: BinaryIO):
        self.start, self.stream = start, stream

    def read(self, n: int) -> bytes:
        head, self.start = self.start[:n], self.start[n:]
        return head + self.stream.read(n - len(head)) if len(head) < n else head


def _members(path: str, content: bytes) -> Iterator[bytes]:
    """Files in a zip or tar archive."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from (z.read(n) for n in sorted(z.namelist()) if not n.endswith("/"))
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            yield from (t.extractfile(m).read() for m in t if m.isfile())


def _decode(files: DataFrame, archives: bool) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.timestamp("us", "UTC")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple[int, int, bytes]] = []
                for one in _members(path, content) if archives else (content,):
                    for r in records(one):
                        rows.append(r)
                        if len(rows) == ROWS:
                            yield _batch(rows, path, kind)
                            rows = []
                if rows:
                    yield _batch(rows, path, kind)

    return files.select("path", "content").mapInArrow(read, schemas.PACKETS)


def _batch(rows: list[tuple[int, int, bytes]], feed: str, kind: pa.DataType) -> pa.RecordBatch:
    ts, size, data = zip(*rows)
    return pa.RecordBatch.from_pydict({"ts": pa.array(ts, kind), "feed_id": pa.array([feed] * len(ts)), "caplen": pa.array(size, pa.int32()), "data": pa.array(data, pa.binary())})


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Packets of a file, a folder or a pattern; feed_id is the file.  Order by ts where order matters."""
    return _decode(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), False)


def read_pcap_archives(spark: SparkSession, list_file: str) -> DataFrame:
    """Packets of all members of the archives named in a text file, a name a line."""
    # the names only; archives are read by the executors
    names = [r.value.strip() for r in spark.read.text(list_file).collect() if r.value.strip()]
    return _decode(spark.read.format("binaryFile").load(names), True)


def stream_pcap(spark: SparkSession, folder: str, files_per_trigger: int = 8, newest_first: bool = False) -> DataFrame:
    """Packets of capture files as they land in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", newest_first).load(folder)
    return _decode(files, False)


def capture_report(spark: SparkSession, path: str) -> DataFrame:
    """feed_id, records, bytes and ending of each file: 'end' where it was read to its end, else what is wrong with it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = size = 0
                found = records(content)
                while True:
                    try:
                        size += len(next(found)[2])
                        n += 1
                    except StopIteration as e:
                        yield pa.RecordBatch.from_pydict({"feed_id": [name], "records": [n], "bytes": [size], "ending": [e.value]})
                        break

    return files.mapInArrow(read, "feed_id string, records long, bytes long, ending string")


def write_pcap(packets: DataFrame, folder: str) -> None:
    """One capture for each partition, microsecond little-endian, through Spark's own committer as rows of bytes."""
    packets = packets.select(F.unix_micros("ts").alias("us"), "data")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = io.BytesIO()
        out.write(HEADER)
        for batch in batches:
            for us, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.write(_record(us, data))
        yield pa.RecordBatch.from_pydict({"content": pa.array([out.getvalue()], pa.binary())})

    packets.mapInArrow(pack, "content binary").write.mode("overwrite").parquet(folder)


HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LARGEST, 1)


def _record(us: int, data: bytes) -> bytes:
    return struct.pack("<4I", us // 1_000_000, us % 1_000_000, len(data), len(data)) + data


def file_system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}")


def file_names(path: str) -> list[str]:
    """The file of a path, or all files of a folder by name but those under a name that begins with '_' or '.'."""
    from pyarrow import fs

    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.is_file:
        return [info.path]
    found = (x.path for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file)
    own = len(info.path.rstrip("/"))
    return sorted(x for x in found if not any(part.startswith(("_", ".")) for part in x[own:].split("/")))


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Captures(DataSource):
    """Format 'captures': .pcap files, streamed when read and rotated when written.

    Options: path; for writing ``interval`` in seconds, each with files of its own, and
    ``packets``, after which a task begins another file (0: never).  Files are written beside
    the others under a name that begins with '_' and take their own name when all tasks are
    done.  A stream's files are named by their batch, which a note in ``_batches`` ends: a
    batch that is written once more leaves the files of the first time, or all of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return schemas.PACKETS

    def reader(self, schema) -> DataSourceReader:
        return _CaptureReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _CaptureWriter(self.options["path"], int(self.options.get("interval", 0)), int(self.options.get("packets", 0)), uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], int(self.options.get("interval", 0)), int(self.options.get("packets", 0)), uuid.uuid4().hex)


class _CaptureReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        # names only, a task for each file
        return [_File(x) for x in file_names(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        kind, rows = pa.timestamp("us", "UTC"), []
        with system.open_input_stream(partition.path, buffer_size=BUFFER, compression=None) as stream:
            for r in records(stream):
                rows.append(r)
                if len(rows) == ROWS:
                    yield _batch(rows, partition.path, kind)
                    rows = []
        if rows:
            yield _batch(rows, partition.path, kind)


#: Files that a task writes at once: packets of a stream are in no order, so several intervals are open.
OPEN = 16


class _Spool:
    """Files of one task under names of their own, in the folder of its job."""

    def __init__(self, path: str, interval: int, packets: int, job: str):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.system, root = file_system(path)
        self.held, self.interval, self.packets = f"{root}/_{job}", interval, packets
        self.task, self.attempt = context.partitionId(), context.taskAttemptId()
        self.system.create_dir(self.held, recursive=True)
        #: (name until all is done, name then, packets) of each file, and those that are open, by interval.
        self.files: list[list] = []
        self.open: dict[int, tuple] = {}

    def add(self, us: int, data: bytes) -> None:
        start = us // 1_000_000 // self.interval * self.interval if self.interval else 0
        found = self.open.pop(start, None)
        if found is not None and self.packets and found[1][2] == self.packets:
            found[0].close()
            found = None
        if found is None:
            if len(self.open) == OPEN:
                self.open.pop(next(iter(self.open)))[0].close()
            name = f"{start if self.interval else us // 1_000_000:012d}-{self.task:05d}-{len(self.files):05d}.pcap"
            file = [f"{self.held}/{self.attempt}-{name}", name, 0]
            self.files.append(file)
            found = self.system.open_output_stream(file[0]), file
            found[0].write(HEADER)
        found[0].write(_record(us, data))
        found[1][2] += 1
        self.open[start] = found  # the last used one is the last to be closed

    def close(self) -> None:
        while self.open:
            self.open.popitem()[1][0].close()


class _CaptureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, interval: int, packets: int, job: str):
        self.path, self.interval, self.packets, self.job = path, interval, packets, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        spool = _Spool(self.path, self.interval, self.packets, self.job)
        try:
            for batch in iterator:
                times = batch.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
                for us, data in zip(times, batch.column("data").to_pylist()):
                    spool.add(us, data)
        finally:
            spool.close()
        return _Written([(own, name) for own, name, _ in spool.files])

    def commit(self, messages: list[_Written]) -> None:
        self._move(messages, self.job[:8])
        self._clear()

    def _move(self, messages: list[_Written], prefix: str) -> None:
        system, root = file_system(self.path)
        for m in messages:
            for own, name in m.files if m else ():
                system.move(own, f"{root}/{prefix}-{name}")

    def _clear(self) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.job}")

    def abort(self, messages: list[_Written]) -> None:
        self._clear()


class _StreamWriter(DataSourceStreamArrowWriter):
    """A batch's files are moved first and noted last, so a batch counts when it is noted."""

    def __init__(self, path: str, interval: int, packets: int, job: str):
        self.batches = _CaptureWriter(path, interval, packets, job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return self.batches.write(iterator)

    def commit(self, messages: list[_Written], batchId: int) -> None:
        from pyarrow import fs

        system, root = file_system(self.batches.path)
        note, prefix = f"{root}/_batches/{batchId:012d}", f"batch{batchId:012d}"
        if system.get_file_info(note).type == fs.FileType.NotFound:
            # what a commit that did not get to its end has left
            for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.base_name.startswith(f"{prefix}-"):
                    system.delete_file(x.path)
            self.batches._move(messages, prefix)
            system.create_dir(f"{root}/_batches", recursive=True)
            with system.open_output_stream(note) as out:
                out.write(b"done")
        for folder in {own.rsplit("/", 1)[0] for m in messages if m for own, _ in m.files}:
            if system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir(folder)
        self.batches._clear()

    def abort(self, messages: list[_Written], batchId: int) -> None:
        self.batches._clear()


def read_large(spark: SparkSession, path: str) -> DataFrame:
    """Packets of capture files of any size, read as a stream."""
    spark.dataSource.register(Captures)
    return spark.read.format("captures").option("path", path).load()


def write_captures(packets: DataFrame, folder: str, interval: int = 0, per_file: int = 0) -> None:
    """.pcap files in time order within each file; another one begins with each ``interval`` seconds and after ``per_file`` packets (0: never)."""
    packets.sparkSession.dataSource.register(Captures)
    rows = packets.select("ts", "feed_id", "caplen", "data").repartitionByRange("ts").sortWithinPartitions("ts")
    rows.write.format("captures").option("path", folder).option("interval", interval).option("packets", per_file).mode("append").save()


def stream_captures_out(packets: DataFrame, folder: str, checkpoint: str, interval: int = 0, per_file: int = 0, every: str | None = None):
    """A query that writes a stream's packets as .pcap files, other ones with each ``interval`` seconds and after ``per_file`` packets; without ``every`` it ends when all is written."""
    packets.sparkSession.dataSource.register(Captures)
    w = packets.select("ts", "feed_id", "caplen", "data").writeStream.format("captures").option("path", folder)
    w = w.option("interval", interval).option("packets", per_file).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of captures written by write_pcap."""
    files = spark.read.schema("content binary").parquet(folder)
    return _decode(files.select(F.input_file_name().alias("path"), "content"), False)
