"""Captures of any size read by many tasks: byte ranges of plain ones, members of archives.

1. A task looks at each file and names its extents: the file itself, each member that an
   archive stores as it is (tar, zip without compression), or a stream that can only be read
   from its beginning (gzip, compressed members and archives).  No archive is held, a
   task reads directories and headers only.
2. A plain extent is cut into ranges of ``split`` bytes.  Where a range's first record begins
   is found from the bytes around its border: of the chains of sound record headers there
   the one that most candidates run into counts, and the range begins where that chain
   is past any single record's length.
3. Each range's headers are then walked from its first record to the next range's.  A range
   is right if the one before it ends exactly where it begins.  The first that is not is
   walked again from that end, until all meet or the capture ends there: so the ranges
   that are read hold the records of a walk from the first byte, whatever the payloads look
   like, and nothing behind a damaged record, where such a walk ends too.
4. A task reads a range's records, holding one buffer.

The plan of ranges is a table of a few numbers a range, written once.  Files are opened by
pyarrow where a task needs them, so they must lie in a file system that it reaches.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..shared import written
from .pcap import BUFFER, LARGEST, MAGIC, ROWS, _batch, file_names, file_system, records

#: Bytes of a range.
SPLIT = 64 << 20
#: Bytes around a border in which headers are looked for: a record, and the way over which a chain must be sound.
LOOK = 4 * (LARGEST + 16)
EXTENT = "path string, member string, base long, size long, coding string"
RANGE = f"{EXTENT}, k long, first long, stop long, exit long, ending string"


class _Part(io.RawIOBase):
    """A part of a file as a stream."""

    def __init__(self, file, base: int, size: int):
        self.file, self.at, self.end = file, base, base + size
        file.seek(base)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        data = self.file.read(min(len(out), self.end - self.at))
        out[: len(data)] = data
        self.at += len(data)
        return len(data)


def _extents(file, size: int) -> Iterator[tuple[str, int, int, str]]:
    """(member, first byte, bytes, coding) of what a file holds; coding: plain, or how it is to be streamed."""
    start = file.read(512)
    file.seek(0)
    if start[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(file) as z:
            for m in sorted(z.infolist(), key=lambda m: m.filename):
                if m.is_dir():
                    continue
                if m.compress_type == zipfile.ZIP_STORED:
                    file.seek(m.header_offset)
                    name, extra = struct.unpack("<26x2H", file.read(30))
                    base = m.header_offset + 30 + name + extra
                    yield m.filename, base, m.file_size, _coding(file, base)
                else:
                    yield m.filename, 0, m.file_size, "zip"
    elif start[257:262] == b"ustar":
        with tarfile.open(fileobj=file, mode="r:") as t:
            for m in t:
                if m.isfile():
                    yield m.name, m.offset_data, m.size, _coding(file, m.offset_data)
    elif start[:2] == b"\x1f\x8b":
        try:
            with tarfile.open(fileobj=file, mode="r:gz") as t:
                packed = t.next() is not None
        except (tarfile.TarError, EOFError, OSError):
            packed = False
        yield "", 0, size, "tar.gz" if packed else "gzip"
    else:
        yield "", 0, size, "plain"


def _coding(file, base: int) -> str:
    at = file.tell()
    file.seek(base)
    start = file.read(2)
    file.seek(at)
    return "gzip" if start == b"\x1f\x8b" else "plain"


def chained(data: bytes, order: str, limit: int) -> int | None:
    """The place in ``data`` of a record header that most chains of sound headers run into, past one record's length.

    ``limit``: above every fraction of a second.  None where no chain is sound up to the end
    of ``data``.
    """
    n = len(data) - 16
    if n <= LARGEST + 16:
        return None
    raw = np.frombuffer(data, np.uint8)
    kind = order + "u4"
    second, fraction, size, captured = (np.ndarray((n,), kind, raw, offset=4 * i, strides=(1,)).astype(np.int64) for i in range(4))
    sound = (size <= LARGEST) & (size > 0) & (size <= captured) & (fraction < limit) & (second > 0)
    bad = n + LARGEST + 32
    reach = np.where(sound, np.arange(n) + 16 + size, bad)
    reach = np.append(reach, np.arange(n, bad + 1))  # beyond the data: stays
    far = reach.copy()
    past = LARGEST + 16
    while True:  # how far the chain of each place goes
        further = far[far]
        if np.array_equal(further, far):
            break
        far = further
    begins = np.flatnonzero(sound[:past] & (far[:past] != bad))
    if not len(begins):
        return None
    at = begins
    while (at < past).any():
        at = np.where(at < past, reach[at], at)
    places, votes = np.unique(at, return_counts=True)
    best = int(places[votes.argmax()])
    return best if best < n else None


def walk(file, at: int, stop: int, end: int, order: str, divide: int, keep: bool) -> Generator[tuple[int, int, bytes], None, tuple[int, str]]:
    """Records that begin from ``at`` up to before ``stop`` of a capture that ends at ``end``; with ``keep`` their times and bytes.

    The generator's value: where the walk ended, and 'on', 'end', 'cut short' or 'overlong record'.
    """
    file.seek(at)
    left = end - at
    buffer, i = b"", 0

    def more(need: int) -> None:
        nonlocal buffer, i, left
        got = file.read(min(left, max(BUFFER, need)))
        left -= len(got)
        buffer, i = buffer[i:] + got, 0

    while at < stop:
        if len(buffer) - i < 16:
            more(16)
            if len(buffer) < 16:
                return at, "cut short" if buffer else "end"
        second, fraction, size, captured = struct.unpack_from(order + "4I", buffer, i)
        if size > LARGEST:
            return at, "overlong record"
        if len(buffer) - i < 16 + size:
            more(16 + size)
            if len(buffer) < 16 + size:
                return at, "cut short"
        if size and keep:
            yield second * 1_000_000 + fraction // divide, captured, buffer[i + 16 : i + 16 + size]
        i += 16 + size
        at += 16 + size
    return at, "end" if at >= end else "on"


def _through(found: Generator) -> tuple[int, str]:
    while True:
        try:
            next(found)
        except StopIteration as e:
            return e.value


class _Files:
    """The file that a task has open."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def open(self, path: str):
        if path != self.path:
            self.close()
            system, name = file_system(path)
            self.path, self.file = path, system.open_input_file(name)
        self.file.seek(0)
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file = None, None


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, object]]:
    """The rows of a table of files, extents or ranges, with their files open."""
    files = _Files()
    try:
        for batch in batches:
            for row in batch.to_pylist():
                yield row, files.open(row["path"])
    finally:
        files.close()


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, file in _each(batches):
        size = file.size()
        try:
            found = list(_extents(file, size))
        except (zipfile.BadZipFile, tarfile.TarError, struct.error):
            found = [("", 0, size, "plain")]
        member, base, length, coding = (list(x) for x in zip(*found)) if found else ([], [], [], [])
        yield pa.RecordBatch.from_pydict(
            {"path": [row["path"]] * len(found), "member": member, "base": pa.array(base, pa.int64()), "size": pa.array(length, pa.int64()), "coding": coding}
        )


def _head(file, base: int) -> tuple[str | None, int]:
    file.seek(base)
    head = file.read(24)
    return MAGIC.get(head[:4], (None, 1)) if len(head) == 24 else (None, 1)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the headers of each range; ``first`` and ``stop`` are looked for where they are not given."""
    for row, file in _each(batches):
        order, divide = _head(file, row["base"])
        end = row["base"] + row["size"]

        def border(at: int) -> int | None:
            file.seek(at)
            found = chained(file.read(min(LOOK, end - at)), order, 1_000_000 * divide)
            return None if found is None else at + found

        if order is None:
            row |= {"exit": row["base"], "ending": "no capture"}
        else:
            if row["first"] is None:
                row["first"] = border(row["base"] + row["k"] * row["split"]) if row["k"] else row["base"] + 24
            if row["stop"] is None:
                last = (row["k"] + 2) * row["split"] > row["size"]
                stop = end if last else border(row["base"] + (row["k"] + 1) * row["split"])
                # without a sound chain at the border the next range begins at the first record behind it
                row["stop"] = row["base"] + (row["k"] + 1) * row["split"] if stop is None else stop
            if row["first"] is not None:
                row["exit"], row["ending"] = _through(walk(file, row["first"], row["stop"], end, order, divide, False))
        row.pop("split")
        yield pa.RecordBatch.from_pylist([row], _ranges)


_ranges = pa.schema([
    (c, pa.string() if c in ("path", "member", "coding", "ending") else pa.int64()) for c in ("path", "member", "base", "size", "coding", "k", "first", "stop", "exit", "ending")
])


def _tasks(df: DataFrame) -> DataFrame:
    """Rows spread over many small tasks: each row is much work."""
    n = df.count()
    return df.repartition(max(1, min(n, 100_000)))


def extents(spark: SparkSession, paths: Iterable[str] | DataFrame) -> DataFrame:
    """EXTENT rows of all captures in files; a DataFrame names files in its first column."""
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(p,) for p in paths], "path string")
    return written(_tasks(paths.select(F.col(paths.columns[0]).alias("path"))).mapInArrow(_look, EXTENT))


def ranges(found: DataFrame, split: int = SPLIT) -> DataFrame:
    """RANGE rows of the plain extents; those to be read hold exactly the records of a walk through the whole extent."""
    if split < LOOK:
        raise ValueError(f"a range has {LOOK} bytes at least")
    n = F.greatest(F.lit(1), F.floor(F.col("size") / split)).cast("long")  # the last one has what is left, too
    null = F.lit(None).cast("long")
    cut = found.where("coding = 'plain'").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    cut = cut.withColumns({"first": null, "stop": null, "exit": null, "ending": F.lit(None).cast("string"), "split": F.lit(split).cast("long")})
    state = written(_tasks(cut).mapInArrow(_place, RANGE))
    of = Window.partitionBy("path", "base").orderBy("k")
    while True:
        before = F.lag(F.struct("exit", "ending")).over(of)
        own = (F.col("_before.ending") == "on") & (F.col("first") == F.col("_before.exit"))
        meets = (F.col("k") == 0) | F.coalesce(own, F.lit(False))
        seen = state.withColumn("_before", before).withColumn("_wrong", (~meets).cast("int"))
        seen = written(seen.withColumn("_wrong", F.sum("_wrong").over(of)))
        # the first range that does not meet the one before, where that one goes on
        again = seen.where("_wrong = 1 and _before.ending = 'on' and not first <=> _before.exit")
        if again.isEmpty():
            return seen.where("_wrong = 0 and ending <> 'no capture'").select(*state.columns)
        own = [c for c in state.columns if c not in ("first", "exit", "ending")]
        redone = again.select(*own, F.col("_before.exit").alias("first"), null.alias("exit"), F.lit(None).cast("string").alias("ending"), F.lit(split).cast("long").alias("split"))
        redone = _tasks(redone.select(*cut.columns)).mapInArrow(_place, RANGE)
        keys = ["path", "base", "k"]
        state = written(seen.select(*state.columns).join(again.select(*keys), keys, "left_anti").unionByName(redone))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.timestamp("us", "UTC")

    def streams(row: dict, file) -> Iterator:
        if row["coding"] == "plain":
            order, divide = _head(file, row["base"])
            yield walk(file, row["first"], row["stop"], row["base"] + row["size"], order, divide, True)
        elif row["coding"] == "zip":
            with zipfile.ZipFile(file) as z, z.open(row["member"]) as member:
                yield records(member)
        elif row["coding"] == "tar.gz":
            with tarfile.open(fileobj=file, mode="r|gz") as t:
                for m in t:
                    if m.isfile():
                        yield records(t.extractfile(m))
        else:
            yield records(io.BufferedReader(_Part(file, row["base"], row["size"]), BUFFER))

    for row, file in _each(batches):
        rows: list[tuple[int, int, bytes]] = []
        for found in streams(row, file):
            for r in found:
                rows.append(r)
                if len(rows) == ROWS:
                    yield _batch(rows, row["path"], kind)
                    rows = []
        if rows:
            yield _batch(rows, row["path"], kind)


def read_split(spark: SparkSession, paths: Iterable[str] | DataFrame, split: int = SPLIT) -> DataFrame:
    """Packets of capture files and archives of any size; a task reads a range of ``split`` bytes, or a stream that cannot be cut."""
    found = extents(spark, paths)
    cut = ranges(found, split)
    streams = found.where("coding <> 'plain'")
    more = {c: F.lit(None).cast("string" if c == "ending" else "long") for c in ("k", "first", "stop", "exit", "ending")}
    return _tasks(written(cut.unionByName(streams.withColumns(more)))).mapInArrow(_read, schemas.PACKETS)


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, or the one file, by name; those that begin with '_' or '.' are left out."""
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    return spark.createDataFrame([(scheme + n,) for n in file_names(path)], "path string")


def read_archives(spark: SparkSession, list_file: str, split: int = SPLIT) -> DataFrame:
    """Packets of all members of the archives named in a text file, a name a line; the names stay in Spark."""
    names = spark.read.text(list_file).select(F.trim("value").alias("path")).where("path <> ''")
    return read_split(spark, names, split)
