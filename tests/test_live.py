"""Streams of captures in and out: each packet once, over stops, restarts and repeated batches."""

import gzip
import struct

import pytest

from spillway.sources import live, pcap

HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65536, 1)


def record(n):
    data = struct.pack(">I", n) * (5 + n % 7)
    return struct.pack("<4I", 1_700_000_000 + n, n % 1_000_000, len(data), len(data)) + data


def drain(stream, tmp_path, name="c"):
    """The packets' numbers of each batch until all is taken."""
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, n: seen.append([(r.feed_id, int.from_bytes(bytes(r.data)[:4], "big")) for r in df.collect()]))
    q = q.option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    return [x for x in seen if x]


def test_each_packet_once_over_restarts_and_growing_files(spark, tmp_path):
    a, b = tmp_path / "in/a", tmp_path / "in/b"
    a.mkdir(parents=True)
    b.mkdir()
    (a / "001.pcap").write_bytes(HEADER + b"".join(map(record, range(25))))
    (a / "002.pcap").write_bytes(HEADER + b"".join(map(record, range(25, 40))) + record(40)[:-3])
    (b / "x.pcap").write_bytes(HEADER + b"".join(map(record, range(1000, 1012))))
    (b / "y.gz").write_bytes(gzip.compress(HEADER + b"".join(map(record, range(1012, 1050)))))
    make = lambda **o: live.stream_captures(spark, str(tmp_path / "in"), str(tmp_path / "progress"), packets=10, **o)
    first = drain(make(), tmp_path)
    assert sorted(x for batch in first for x in batch) == [("a", n) for n in range(40)] + [("b", n) for n in range(1000, 1050)]
    # no batch above its limit but one with the gzip file, which is taken whole
    assert all(len([x for x in batch if x[1] not in range(1012, 1050)]) <= 10 for batch in first) and len(first) >= 6
    # a new query of the same checkpoint: what came since, the cut record too
    with open(a / "002.pcap", "ab") as f:
        f.write(record(40)[-3:] + b"".join(map(record, range(41, 50))))
    (a / "003.pcap").write_bytes(HEADER + b"".join(map(record, range(50, 55))))
    again = drain(make(), tmp_path)
    assert sorted(x for batch in again for x in batch) == [("a", n) for n in range(40, 55)]
    assert drain(make(), tmp_path) == []
    # one feed only, from its beginning, for a stream of its own
    one = live.stream_captures(spark, str(tmp_path / "in"), str(tmp_path / "other"), ["b"], packets=1000)
    assert sorted(x for batch in drain(one, tmp_path, "d") for x in batch) == [("b", n) for n in range(1000, 1050)]


def test_a_batch_that_fails_is_read_once_more(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.pcap").write_bytes(HEADER + b"".join(map(record, range(30))))
    seen, failed = [], []

    def sink(df, n):
        rows = [int.from_bytes(bytes(r.data)[:4], "big") for r in df.collect()]
        if n == 1 and not failed:
            failed.append(rows)
            raise RuntimeError("lost")
        seen.extend(rows)

    def start():
        s = live.stream_captures(spark, str(tmp_path / "in"), str(tmp_path / "progress"), packets=12)
        return s.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()

    q = start()
    with pytest.raises(Exception):
        q.processAllAvailable()
    q.stop()
    assert failed and len(seen) == 12
    q = start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == list(range(30))


def test_a_repeated_batch_leaves_the_same_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.pcap").write_bytes(HEADER + b"".join(map(record, range(300))))
    stream = lambda: live.stream_captures(spark, str(tmp_path / "in"), str(tmp_path / "progress"), packets=100)
    out = tmp_path / "out"
    pcap.stream_captures_out(stream(), str(out), str(tmp_path / "c"), interval=60, per_file=25, every="0 seconds").processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    held = {x.name: x.read_bytes() for x in out.iterdir() if x.is_file()}
    assert all(x.startswith("batch") and x.endswith(".pcap") for x in held) and len(held) >= 12
    for x in held.values():
        found = list(pcap.records(x))
        assert 0 < len(found) <= 25 and len({us // 60_000_000 for us, *_ in found}) == 1
    want = sorted((us, d) for x in held.values() for us, _, d in pcap.records(x))
    assert [int.from_bytes(d[:4], "big") for _, d in want] == list(range(300))
    # the last batch was written but not noted as done, neither by Spark nor here: it is written once more
    last = sorted((tmp_path / "c/commits").glob("[0-9]*"))[-1]
    for f in (last, last.parent / f".{last.name}.crc", out / f"_batches/{int(last.name):012d}"):
        f.unlink(missing_ok=True)
    pcap.stream_captures_out(stream(), str(out), str(tmp_path / "c"), interval=60, per_file=25, every="0 seconds").processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert {x.name: x.read_bytes() for x in out.iterdir() if x.is_file()} == held
    # noted here but not by Spark: its files stay as they are
    for f in (last, last.parent / f".{last.name}.crc"):
        f.unlink(missing_ok=True)
    pcap.stream_captures_out(stream(), str(out), str(tmp_path / "c"), interval=60, per_file=25, every="0 seconds").processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert {x.name: x.read_bytes() for x in out.iterdir() if x.is_file()} == held
    assert pcap.read_large(spark, str(out)).count() == 300
