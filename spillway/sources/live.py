"""A stream of captures: feeds as folders of files that are read on from where the last batch ended.

Each folder below the path is a feed (files in the path itself are the feed '').  A feed's files
come in the order of their names, as rotated captures do, and the last may still grow:
records that are not whole yet wait.  An offset is, for each feed, the file and the byte
behind the last record taken.  A batch takes at most so many packets of all feeds together,
which the driver counts by walking that many headers; a gzip file is taken whole, as a batch
of its own for its feed.

Spark logs a batch's offsets before it asks for its partitions, and on a restart asks again
for those of a batch that did not end.  The reader writes the last end that it was asked for
into ``progress`` and begins there when it is new, so each packet is read once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .. import schemas
from .pcap import BUFFER, MAGIC, ROWS, _batch, file_system, records
from .splits import walk

#: Packets of a batch.
PACKETS = 100_000


@dataclass
class _Range(InputPartition):
    feed: str
    path: str
    start: int
    stop: int


class LiveCaptures(DataSource):
    """Format 'live_captures'; options path, progress, feeds (names with commas between, all if empty), packets (of a batch)."""

    @classmethod
    def name(cls) -> str:
        return "live_captures"

    def schema(self) -> str:
        return schemas.PACKETS

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        feeds = [x for x in o.get("feeds", "").split(",") if x]
        return _LiveReader(o["path"], o["progress"], feeds, int(o.get("packets", PACKETS)))


class _LiveReader(DataSourceStreamReader):
    def __init__(self, path: str, progress: str, feeds: list[str], packets: int):
        self.path, self.progress, self.feeds, self.packets = path, progress, feeds, packets
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _saved(self) -> dict:
        from pyarrow import fs

        system, root = file_system(self.progress)
        if system.get_file_info(f"{root}/offset").type == fs.FileType.NotFound:
            return {}
        with system.open_input_stream(f"{root}/offset") as f:
            return json.loads(f.read())

    def _files(self) -> dict[str, list]:
        """Files of each wanted feed in the order of their names."""
        from pyarrow import fs

        system, root = file_system(self.path)
        out: dict[str, list] = {}
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(("_", ".")):
                continue
            feed = "" if x.is_file else x.base_name
            if self.feeds and feed not in self.feeds:  # other feeds' folders are not even listed
                continue
            held = [x] if x.is_file else [y for y in system.get_file_info(fs.FileSelector(x.path)) if y.is_file and not y.base_name.startswith(("_", "."))]
            out.setdefault(feed, []).extend(held)
        return {k: sorted(v, key=lambda x: x.base_name) for k, v in out.items()}

    def latestOffset(self) -> dict:
        """The last offset and at most so many packets more; the feed that is least ahead goes first in the next batch."""
        at = dict(self._saved() if self.at is None else self.at)
        system, _ = file_system(self.path)
        left = self.packets
        files = self._files()
        # feeds take turns, so one with a great deal does not keep others waiting
        for i, feed in enumerate(sorted(files)):
            share = max(1, left // (len(files) - i))
            taken = 0
            while taken < share:
                name, start = at.get(feed, ["", 0])
                here = [x for x in files[feed] if x.base_name >= name]
                if not here:
                    break
                x = here[0]
                start = start if x.base_name == name else 0
                stop, n, full = _ahead(system, x, start, share - taken)
                taken += n
                if [x.base_name, stop] != at.get(feed) and stop:
                    at[feed] = [x.base_name, stop]
                if full:
                    break
                if len(here) == 1:
                    break
                at[feed] = [here[1].base_name, 0]
            left = max(0, left - taken)
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for feed, held in self._files().items():
            first, last = start.get(feed, ["", 0]), end.get(feed, ["", 0])
            for x in held:
                if first[0] <= x.base_name <= last[0]:
                    a = first[1] if x.base_name == first[0] else 0
                    b = last[1] if x.base_name == last[0] else x.size
                    if a < b:
                        out.append(_Range(feed, x.path, a, b))
        system, root = file_system(self.progress)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/offset.new") as f:
            f.write(json.dumps(end).encode())
        system.move(f"{root}/offset.new", f"{root}/offset")
        self.at = end if self.at is None else self.at
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        kind, rows = pa.timestamp("us", "UTC"), []
        with system.open_input_file(partition.path) as file:
            head = file.read(24)
            file.seek(0)
            order, divide = MAGIC.get(head[:4], (None, 1))
            if head[:2] == b"\x1f\x8b":
                found: Iterator = records(_Opened(file))
            elif order is None:
                return
            else:
                found = walk(file, max(24, partition.start), partition.stop, partition.stop, order, divide, True)
            for r in found:
                rows.append(r)
                if len(rows) == ROWS:
                    yield _batch(rows, partition.feed, kind)
                    rows = []
        if rows:
            yield _batch(rows, partition.feed, kind)

    def commit(self, end: dict) -> None:
        pass


class _Opened:
    """What ``records`` needs of a stream."""

    def __init__(self, file):
        self.read = file.read


def _ahead(system, info, start: int, packets: int) -> tuple[int, int, bool]:
    """Where so many more packets of a file end, how many there are, and whether the batch is full with them."""
    with system.open_input_file(info.path) as file:
        head = file.read(24)
        if head[:2] == b"\x1f\x8b":
            return info.size, packets if start < info.size else 0, start < info.size
        order, divide = MAGIC.get(head[:4], (None, 1)) if len(head) == 24 else (None, 1)
        if order is None:
            return start, 0, False
        at, n, size = max(24, start), 0, file.size()
        file.seek(at)
        buffer, i = b"", 0
        while n < packets:
            if len(buffer) - i < 16:
                buffer, i = buffer[i:] + file.read(BUFFER), 0
                if len(buffer) < 16:
                    break
            length = int.from_bytes(buffer[i + 8 : i + 12], "little" if order == "<" else "big")
            if length > (1 << 16) or at + 16 + length > size:
                break  # damaged, or not whole yet
            if len(buffer) - i < 16 + length:
                buffer, i = buffer[i:] + file.read(max(BUFFER, 16 + length)), 0
                if len(buffer) < 16 + length:
                    break
            at, i, n = at + 16 + length, i + 16 + length, n + 1
        return at, n, n >= packets


def stream_captures(spark: SparkSession, path: str, progress: str, feeds: list[str] | None = None, packets: int = PACKETS) -> DataFrame:
    """Packets of the feeds below a path as they come, at most so many a batch; feed_id is the feed.

    progress: a folder of this stream's own, kept as long as its checkpoint is.
    """
    spark.dataSource.register(LiveCaptures)
    r = spark.readStream.format("live_captures").option("path", path).option("progress", progress)
    return r.option("feeds", ",".join(feeds or [])).option("packets", packets).load()
