"""Captures read by ranges and members, against a walk from the first byte."""

import gzip
import io
import random
import struct
import tarfile
import zipfile

import pytest

from spillway.sources import pcap, splits

HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65536, 1)


def record(us, data, order="<"):
    return struct.pack(order + "4I", us // 1_000_000, us % 1_000_000, len(data), len(data)) + data


def rows(df):
    return sorted((r.ts, r.caplen, bytes(r.data)) for r in df.collect())


def plain(spark, path):
    return rows(pcap.read_large(spark, str(path)))


def long_capture(seed, n, kinds=("text", "zeros", "jumbo", "inner", "crafted", "empty")):
    """Records whose payloads hold zeros, whole captures, and captures that end where the record ends."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(kinds) if rng.random() < 0.2 else "text"
        data = rng.randbytes(rng.randrange(40, 1500))
        if kind == "zeros":
            data = bytes(rng.randrange(10, 3000))
        elif kind == "jumbo":
            data = rng.randbytes(65_536)
        elif kind in ("inner", "crafted"):
            inner = b"".join(record(10**15 + k, rng.randbytes(rng.randrange(20, 90))) for k in range(400))
            data = inner[:65_536] if kind == "crafted" else (b"x" * rng.randrange(9) + inner)[:65_000] + b"tail"
            if kind == "crafted":
                data = data[: len(inner)]
        elif kind == "empty":
            data = b""
        out.append(record(10**15 + i * 1000, data))
    return HEADER + b"".join(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("splits")


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_hold_the_records_of_a_whole_walk(spark, folder, seed):
    path = folder / f"long{seed}.pcap"
    path.write_bytes(long_capture(seed, 900))
    found = splits.ranges(splits.extents(spark, [str(path)]), splits.LOOK)
    assert found.count() == path.stat().st_size // splits.LOOK > 5
    got = splits.read_split(spark, [str(path)], splits.LOOK)
    assert got.rdd.getNumPartitions() == found.count()
    assert rows(got) == plain(spark, path)


def test_a_damaged_middle_ends_the_capture_as_in_a_whole_walk(spark, folder):
    whole = long_capture(3, 700, ("text", "zeros"))
    for name, data in (
        ("over", whole[:1_000_000] + b"\xff" * 64 + whole[1_000_064:]), ("cut", whole[:-7]), ("zero", whole[:700_000] + bytes(200_000) + whole[900_000:]), ("noise", HEADER + random.Random(4).randbytes(1_500_000)),
        ("none", b"no capture at all " * 60_000), ("empty", b""), ("short", HEADER[:20]), ("big", struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65536, 1) + b"".join(record(10**15 + i, bytes([i % 251]) * 900, ">") for i in range(1500))),
    ):
        path = folder / f"{name}.pcap"
        path.write_bytes(data)
        assert rows(splits.read_split(spark, [str(path)], splits.LOOK)) == plain(spark, path), name
    both = splits.read_split(spark, splits.capture_files(spark, str(folder)), splits.LOOK)
    assert rows(both) == plain(spark, folder)


def test_a_chain_inside_a_payload_is_not_taken_for_the_capture(spark, folder):
    """A payload over the border that holds a sound chain of its own, up to the record's end."""
    inner = b"".join(record(10**15 + k, bytes([k % 251]) * 60) for k in range(860))
    assert len(inner) <= 65_536
    data = HEADER + b"".join(record(10**15 + i, inner) for i in range(30))
    path = folder / "nested.pcap"
    path.write_bytes(data)
    assert rows(splits.read_split(spark, [str(path)], splits.LOOK)) == plain(spark, path)


def test_members_of_archives_are_parts_of_their_own(spark, folder):
    a, b, c = long_capture(5, 300, ("text", "zeros")), long_capture(6, 40, ("text",)), long_capture(7, 30, ("text",))
    with zipfile.ZipFile(folder / "x.zip", "w") as z:
        z.writestr("sub/a", a)
        z.writestr("b", b, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("c.gz", gzip.compress(c))
        z.writestr("readme", "no capture")
    for name, mode in (("y.tar", "w"), ("z.tgz", "w:gz")):
        with tarfile.open(folder / name, mode) as t:
            for member, body in (("a", a), ("b.gz", gzip.compress(b)), ("c", c)):
                info = tarfile.TarInfo(member)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    (folder / "two.gz").write_bytes(gzip.compress(a) + gzip.compress(b[24:]))
    files = [folder / x for x in ("x.zip", "y.tar", "z.tgz", "two.gz")]
    kinds = {(r.path.rsplit("/", 1)[1], r.coding) for r in splits.extents(spark, [str(f) for f in files]).collect()}
    assert kinds == {("x.zip", "plain"), ("x.zip", "zip"), ("x.zip", "gzip"), ("y.tar", "plain"), ("y.tar", "gzip"), ("z.tgz", "tar.gz"), ("two.gz", "gzip")}
    parts = [sorted((us, n, d) for us, n, d in pcap.records(x)) for x in (a, b, c)]
    want = {"x.zip": sum(parts, []), "y.tar": sum(parts, []), "z.tgz": sum(parts, []), "two.gz": parts[0] + parts[1]}
    (folder / "list.txt").write_text("".join(f"{f}\n\n" for f in files))
    got = splits.read_archives(spark, str(folder / "list.txt"), splits.LOOK).selectExpr("unix_micros(ts) us", "feed_id", "caplen", "data").collect()
    for name, expected in want.items():
        assert sorted((r.us, r.caplen, bytes(r.data)) for r in got if r.feed_id.endswith(name)) == sorted(expected)
