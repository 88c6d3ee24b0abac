"""IP fragments put together again.

Fragments of one packet share (source, destination, protocol, identification); a packet is
given up ``timeout`` seconds after its first fragment, and later ones start anew.  Fragments
are dealt by that key, sorted by it and time, and read as a stream: a task holds one
packet's fragments at a time, at most 64 KiB, however often an identification recurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("src_addr", "dst_addr", "ip_proto", "frag_id")
LARGEST, SMALLEST_HOLE = 65_535, 8


class Buffer:
    """Fragments of one packet so far."""

    def __init__(self, start: float, parts: dict[int, bytes] | None = None, size: int = -1):
        self.start, self.parts, self.size = start, parts or {}, size

    def add(self, ofs: int, more: bool, data: bytes) -> bytes | None:
        """The packet's bytes once all are there; overlaps, and holes too small for a fragment, are not taken."""
        end = ofs + len(data)
        if not data or end > LARGEST or more and len(data) % 8 or self.size >= 0 and (not more or end > self.size):
            return None
        if not more and any(o + len(p) > end for o, p in self.parts.items()):
            return None
        for o, p in self.parts.items():
            if o < end and ofs < o + len(p):
                return None
            if 0 < ofs - (o + len(p)) < SMALLEST_HOLE or 0 < o - end < SMALLEST_HOLE:
                return None
        self.parts[ofs] = data
        if not more:
            self.size = end
        if self.size >= 0 and sum(map(len, self.parts.values())) == self.size:
            return b"".join(self.parts[o] for o in sorted(self.parts))
        return None


def reassemble(packets: DataFrame, timeout: float = 30) -> DataFrame:
    """Packets of operators.decode.internet with each run of fragments as one packet, marked is_reassembled.

    A reassembled packet has the columns of its last fragment; incomplete packets go.
    """
    packets = packets.withColumn("frag_id", F.coalesce(F.when(F.col("ip_type") == 4, F.col("ip_id").cast("long")).otherwise(F.col("ip6_id")), F.lit(-1)))
    order = packets.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, current = None, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in KEY))
            times = batch.column("ts").cast(pa.int64()).to_pylist()
            rows = zip(keys, times, *(batch.column(c).to_pylist() for c in ("fragment_ofs", "more_frags", "segment")))
            ends, found = [], []
            for i, (key, micros, ofs, more, segment) in enumerate(rows):
                now = micros / 1_000_000
                if key != current or buffer is None or now - buffer.start > timeout:
                    buffer, current = Buffer(now), key
                whole = buffer.add(int(ofs), bool(more), segment or b"")
                if whole is not None:
                    ends.append(i)
                    found.append(whole)
                    buffer = None
            if not ends:
                continue
            # the columns of each packet's last fragment
            out = batch.take(pa.array(ends, pa.int64()))
            new = {"segment": found, "fragment_ofs": [0] * len(ends), "more_frags": [False] * len(ends), "is_reassembled": [True] * len(ends)}
            columns = [pa.array(new[c], out.schema.field(c).type) if c in new else out.column(c) for c in order]
            yield pa.RecordBatch.from_arrays(columns, order)

    whole = packets.where(~F.coalesce("is_fragment", F.lit(False)))
    parts = packets.where("is_fragment").repartition(*KEY).sortWithinPartitions(*KEY, "ts", "fragment_ofs")
    return whole.unionByName(parts.mapInArrow(join, packets.schema)).drop("frag_id")
