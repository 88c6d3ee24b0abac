"""Decoders, capture files and reassembly on packets made by hand."""

import datetime as dt
import gzip
import io
import random
import struct
import tarfile
import zipfile

import pytest

from spillway import schemas
from spillway.operators import decode, reassembly
from spillway.sources import pcap

T0 = dt.datetime(2024, 1, 1, 12, 0, 0, 123456)


def name(text):
    return b"".join(bytes([len(x)]) + x.encode() for x in text.rstrip(".").split(".") if x) + b"\0"


def rr(owner, kind, ttl, rdata, klass=1):
    return owner + struct.pack(">HHIH", kind, klass, ttl, len(rdata)) + rdata


def message(questions=(), answers=(), authorities=(), additionals=(), flags=0x8400, id=7):
    head = struct.pack(">6H", id, flags, len(questions), len(answers), len(authorities), len(additionals))
    return head + b"".join(name(q) + struct.pack(">HH", t, c) for q, t, c in questions) + b"".join(answers) + b"".join(authorities) + b"".join(additionals)


def udp(payload, src=4000, dst=53):
    return struct.pack(">4H", src, dst, 8 + len(payload), 0) + payload


def tcp(payload, flags=0x18, src=4000, dst=53):
    return struct.pack(">HHIIBBHHH", src, dst, 1, 2, 5 << 4, flags, 1024, 0, 0) + payload


def ip4(segment, proto=17, id=9, ofs=0, more=False, src=b"\x0a\0\0\1", dst=b"\xc0\0\2\x35"):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(segment), id, ofs // 8 | (0x2000 if more else 0), 64, proto, 0) + src + dst + segment


def ip6(segment, next_header=17, src=b"\x20\1\x0d\xb8" + b"\0" * 11 + b"\1", dst=b"\x20\1\x0d\xb8" + b"\0" * 11 + b"\2"):
    return struct.pack(">IHBB", 0x60000000, len(segment), next_header, 60) + src + dst + segment


def ether(packet, kind=0x0800):
    return b"\xaa\xbb\xcc\0\1\2" + b"\x10\x20\x30\x40\x50\x60" + struct.pack(">H", kind) + packet


def packets(spark, frames, step=0.001):
    rows = [(T0 + dt.timedelta(seconds=i * step), "f", len(x), bytearray(x)) for i, x in enumerate(frames)]
    return spark.createDataFrame(rows, schemas.PACKETS)


def decoded(spark, frames):
    return decode.decode_packets(packets(spark, frames)).orderBy("ts").collect()


def dns(spark, payloads, **options):
    found = decode.decode_dns(decode.decode_packets(packets(spark, [ether(ip4(udp(p))) for p in payloads])), keep_malformed=True, **options)
    return found.orderBy("ts").collect()


def test_headers(spark):
    q = message([("a.example.", 1, 1)], flags=0x0100)
    option = bytes([17, 0]) + b"\0" * 6
    frag6 = bytes([17, 0]) + struct.pack(">HI", 8 | 1, 99)
    frames = [
        ether(ip4(udp(q))), ether(ip6(option + udp(q), 60), 0x86DD), ether(ip6(b"x" * 20, 50), 0x86DD), ether(ip4(tcp(struct.pack(">H", len(q)) + q), 6)), ether(ip4(bytes([11, 1]) + b"\0" * 6, 1)),
        ether(ip6(bytes([3, 1]) + b"\0" * 6, 58), 0x86DD), b"short", ether(ip6(frag6 + b"z" * 8, 44), 0x86DD), ether(b"\x65" + b"\0" * 30),
    ]
    r = decoded(spark, frames)
    assert len(r) == 8  # ESP is left out
    chain = lambda n: ether(ip6((bytes([60, 0]) + b"\0" * 6) * (n - 1) + bytes([17, 0]) + b"\0" * 6 + udp(q), 60), 0x86DD)
    long = decoded(spark, [chain(decode.CHAIN), chain(decode.CHAIN + 1)])
    assert [(x.ip_type, x.srcport) for x in long] == [(6, 4000), (None, None)]
    assert (r[0].eth_dst, r[0].eth_src, r[0].eth_type) == ("AA:BB:CC:00:01:02", "10:20:30:40:50:60", 0x0800)
    assert (r[0].ip_src, r[0].ip_dst, r[0].ttl, r[0].ip_id, r[0].srcport, r[0].dstport, r[0].udp_len) == ("10.0.0.1", "192.0.2.53", 64, 9, 4000, 53, 8 + len(q))
    assert (r[1].ip_type, r[1].ip_src, r[1].ip_proto, r[1].srcport, bytes(r[1].payload)) == (6, "2001:db8::1", 17, 4000, q)
    assert (r[2].tcp_flags, r[2].tcp_window, r[2].tcp_seq, r[2].dstport) == (0x18, 1024, 1, 53)
    assert [(x.ip_type, x.icmp_type, x.icmp_code) for x in r[3:5]] == [(4, 11, 1), (6, 3, 1)]
    assert r[5].ip_type is None and r[5].eth_type is None
    assert (r[6].is_fragment, r[6].fragment_ofs, r[6].more_frags, r[6].ip6_id, r[6].srcport) == (True, 8, True, 99, None)
    assert r[7].ip_type is None


def test_dns_records(spark):
    owner = b"\xc0\x0c"
    v6 = bytes(range(16))
    key = struct.pack(">HBB", 257, 3, 8) + b"\3\1\0\1" + b"\x99" * 128
    long_key = struct.pack(">HBB", 256, 3, 5) + b"\0\0\3\1\0\1" + b"\x77" * 64
    # a response: the address has the bytes of its own scope, not of the query's
    subnet = struct.pack(">HHHBB", 8, 6, 1, 24, 12) + b"\x0a\1"
    opt = rr(b"\0", 41, 1 << 15, subnet + struct.pack(">HH", 65001, 0), 1232)
    m = message(
        [("www.Example.com.", 1, 1)],
        [rr(owner, 1, 60, b"\1\2\3\4"), rr(owner, 28, 61, v6), rr(owner, 5, 62, b"\1x\xc0\x10"), rr(owner, 16, 63, b"\2ab\1c"), rr(owner, 48, 64, key), rr(owner, 48, 64, long_key), rr(owner, 99, 1, b"??")],
        [rr(b"\0", 2, 5, name("ns.example.com."))], [opt],
    )
    (r,) = dns(spark, [m])
    assert (r.qname, r.qtype, r.qclass, r.aa, r.qr, r.query_id, r.ans_count) == ("www.Example.com.", 1, 1, True, True, 7, 7)
    assert [a.rdata_txt for a in r.answers] == ["1.2.3.4", "1:203:405:607:809:a0b:c0d:e0f", "x.Example.com.", "ab\nc", "136 bytes unparsed RDATA", "74 bytes unparsed RDATA", "2 bytes unparsed RDATA"]
    assert r.answers[3].rdata_list == ["ab", "c"] and r.answers[0].name == "www.Example.com."
    assert r.authorities[0].name == "" and r.authorities[0].rdata_txt == "ns.example.com."
    assert (r.has_edns0, r.edns0_max_size, r.edns0_do, r.edns0_version) == (True, 1232, True, 0)
    assert (r.has_ecs, r.ecs_ip, r.ecs_src_scope, r.ecs_res_scope, r.has_exp_opt) == (True, "10.1.0.0", 24, 12, True)
    (low,) = dns(spark, [m], lower=True, sections=("edns0",))
    assert low.qname == "www.example.com." and low.answers == [] and low.has_edns0
    keys = decode.dnskeys(decode.decode_dns(decode.decode_packets(packets(spark, [ether(ip4(udp(m)))])))).collect()
    assert sorted((k.flags, k.algorithm, k.bitsize, k.e) for k in keys) == [(256, 5, 512, "010001"), (257, 8, 1024, "010001")]


def test_unsound_messages(spark):
    good = message([("a.", 1, 1)], [rr(b"\xc0\x0c", 1, 60, b"\1\2\3\4")])
    loop = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c" + b"\0\1\0\1"
    long_label = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + bytes([64]) + b"a" * 64 + b"\0\0\1\0\1"
    wrong = message([("a.", 1, 1)], [rr(b"\xc0\x0c", 1, 60, b"\1\2\3")])
    bad_subnet = message([("a.", 1, 1)], additionals=[rr(b"\0", 41, 0, struct.pack(">HHHBB", 8, 6, 1, 24, 0) + b"\x0a\1")], flags=0)
    root = message([(".", 2, 1)], flags=0)
    r = dns(spark, [good, good[:-2], good[:15], b"\0" * 5, loop, long_label, wrong, bad_subnet, root])
    assert [(x.is_valid, x.is_partial) for x in r] == [(True, False), (True, True), (True, True), (False, False), (False, False), (False, False), (False, False), (True, False), (True, False)]
    assert r[7].has_edns0 and not r[7].has_ecs
    assert r[8].qname == ""


def random_message(rng):
    """Mostly sound messages with pointers, texts, options and names that are not."""
    names = [name("a.Example.org."), name("x."), b"\0", b"\xc0\x0c", b"\3www\xc0\x0c", b"\1\xe9\0", name("y" * 63 + ".") * 1]
    if rng.random() < 0.1:
        names += [b"\xc0\xff", b"\x40" + b"z" * 64 + b"\0", (b"\x3f" + b"n" * 63) * 9 + b"\0", b"\xc0\x0c"]
    pick = lambda: rng.choice(names)
    ecs = lambda: struct.pack(">HHHBB", 8, 4 + (n := rng.randint(0, 5)), rng.choice([1, 2, 3]), 8 * n, rng.choice([0, 8, 16, 200])) + bytes(n)

    def record():
        kind = rng.choice([1, 2, 5, 16, 28, 41, 48, 6])
        data = {1: bytes(4 if rng.random() < 0.97 else 3), 28: bytes(range(16)), 2: pick(), 5: pick(), 16: rng.choice([b"\2ab\1c", b"", b"\0\0", b"\5ab"] if rng.random() < 0.1 else [b"\2ab\1\xe9"])}.get(kind, rng.randbytes(rng.randint(0, 9)))
        if kind == 41:
            data = rng.choice([b"", ecs(), ecs() + struct.pack(">HH", 65001, 0), struct.pack(">HHB", 3, 9, 1)])
        return rr(pick(), kind, rng.getrandbits(32), data, rng.choice([1, 4096]))

    questions = [(rng.choice(["a.b.", "Example.org.", "."]), rng.randint(0, 300), 1) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    m = message(questions, *([record() for _ in range(rng.choice([0, 0, 1, 2, 5]))] for _ in range(3)), flags=rng.choice([0, 0x8400]))
    if rng.random() < 0.3:
        m = m[: rng.randint(0, len(m))]
    if rng.random() < 0.2 and len(m) > 12:
        at = rng.randrange(12, len(m))
        m = m[:at] + rng.randbytes(1) + m[at + 1 :]
    return m if rng.random() < 0.98 else None


@pytest.mark.parametrize("wanted", [("answers", "authorities", "additionals", "edns0"), ("edns0",), ("answers",), (), ("authorities",)])
def test_batches_are_read_as_single_messages(wanted):
    import plain_dns
    import pyarrow as pa

    from spillway.operators import wire

    rng = random.Random(31)
    messages = [random_message(rng) for _ in range(4000)]
    got = wire.read(pa.array(messages, pa.binary()).slice(3), frozenset(wanted))
    plain = [plain_dns.read_message(m, frozenset(wanted)) for m in messages[3:]]
    for column in plain_dns.COLUMNS:
        values = got[column].to_pylist()
        assert values == [x[column] for x in plain], column
    assert "edns0" not in wanted or {x["parse_error"] for x in plain} >= {None, "short header", "pointer loop"}
    assert all(len(v) == 0 for v in wire.read(pa.array([], pa.binary()), frozenset(wanted)).values())


def test_dns_over_tcp(spark):
    q = message([("a.", 1, 1)], flags=0)
    right, wrong = struct.pack(">H", len(q)) + q, struct.pack(">H", len(q) + 1) + q
    frames = [ether(ip4(tcp(right), 6)), ether(ip4(tcp(wrong), 6)), ether(ip4(tcp(b"", 2), 6))]
    found = decode.decode_dns(decode.decode_packets(packets(spark, frames)), keep_malformed=True).orderBy("ts").collect()
    assert [(x.is_valid, x.is_tcp, x.udp_len) for x in found] == [(True, True, 0), (False, True, 0)]


def capture(frames, magic="<I", value=0xA1B2C3D4, divide=1):
    order = magic[0]
    out = struct.pack(order + "IHHiIII", value, 2, 4, 0, 0, 65535, 1)
    for i, x in enumerate(frames):
        out += struct.pack(order + "4I", 1_700_000_000 + i, 123456 * divide, len(x), len(x)) + x
    return out


@pytest.mark.parametrize("order,value,divide", [("<I", 0xA1B2C3D4, 1), (">I", 0xA1B2C3D4, 1), ("<I", 0xA1B23C4D, 1000), (">I", 0xA1B23C4D, 1000)])
def test_capture_records(order, value, divide):
    whole = capture([b"one", b"", b"two"], order, value, divide)
    expected = [(1_700_000_000_123456, 3, b"one"), (1_700_000_002_123456, 3, b"two")]
    assert list(pcap.records(whole)) == expected
    assert list(pcap.records(gzip.compress(whole))) == expected
    assert list(pcap.records(whole[:-1])) == expected[:1]
    assert list(pcap.records(b"")) == list(pcap.records(b"nonsense" * 10)) == []
    assert list(pcap.records(gzip.compress(whole)[:-12]))[:1] in ([], expected[:1])


def test_capture_files_and_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.pcap").write_bytes(capture([b"x" * 20, b"y" * 30]))
    (tmp_path / "in/a.gz.misnamed").write_bytes(gzip.compress(capture([b"z" * 10])))
    got = pcap.read_pcap(spark, str(tmp_path / "in")).orderBy("caplen").collect()
    assert [bytes(r.data) for r in got] == [b"z" * 10, b"x" * 20, b"y" * 30]
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("m1", capture([b"m1"]))
        z.writestr("m2", capture([b"m2m2"]))
    with tarfile.open(tmp_path / "two.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("m3")
        info.size = len(body := capture([b"m3m3m3"]))
        t.addfile(info, io.BytesIO(body))
    (tmp_path / "list.txt").write_text(f"{tmp_path}/one.zip\n{tmp_path}/two.tar.gz\n")
    got = pcap.read_pcap_archives(spark, str(tmp_path / "list.txt")).orderBy("caplen").collect()
    assert [bytes(r.data) for r in got] == [b"m1", b"m2m2", b"m3m3m3"]
    again = pcap.read_pcap(spark, str(tmp_path / "in"))
    pcap.write_pcap(again, str(tmp_path / "out"))
    assert sorted(map(str, pcap.read_packed(spark, str(tmp_path / "out")).select("ts", "data").collect())) == sorted(map(str, again.select("ts", "data").collect()))


def test_capture_files_of_any_size_and_rotation(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=i), "f", 20 + i % 5, bytearray(bytes([i % 251]) * (20 + i % 5))) for i in range(300)]
    p = spark.createDataFrame(rows, schemas.PACKETS)
    pcap.write_captures(p, str(tmp_path / "out"), interval=60, per_file=25)
    files = sorted(x.name for x in (tmp_path / "out").iterdir())
    assert all(x.endswith(".pcap") for x in files) and len(files) >= 12
    for x in files:
        held = list(pcap.records((tmp_path / "out" / x).read_bytes()))
        assert 0 < len(held) <= 25 and len({us // 60_000_000 for us, *_ in held}) == 1 and held == sorted(held)
    want = sorted((r.ts, bytes(r.data)) for r in p.collect())
    for back in (pcap.read_large(spark, str(tmp_path / "out")), pcap.read_pcap(spark, str(tmp_path / "out"))):
        assert sorted((r.ts, bytes(r.data)) for r in back.collect()) == want
    (tmp_path / "out/z.pcap").write_bytes(gzip.compress(capture([b"gz" * 8])))
    assert pcap.read_large(spark, str(tmp_path / "out")).count() == 301 and pcap.read_large(spark, str(tmp_path / "out/z.pcap")).count() == 1


def test_files_in_order_and_headers_by_protocol(spark, tmp_path):
    import os
    import time

    from spillway.operators import filters

    for i, (name_, mark) in enumerate((("b", b"first" * 4), ("a", b"second" * 4), ("c", b"third" * 4))):
        (tmp_path / name_).write_bytes(capture([mark]))
        os.utime(tmp_path / name_, (time.time() - 100 + 10 * i,) * 2)
    stream = pcap.stream_pcap(spark, str(tmp_path), files_per_trigger=1)
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, _: seen.extend(bytes(r.data)[:5] for r in df.collect())).option("checkpointLocation", str(tmp_path / "_c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == [b"first", b"secon", b"third"]
    frames = packets(spark, [ether(ip4(udp(b"x"))), ether(ip4(tcp(b"x"), 6)), ether(ip6(udp(b"x")), 0x86DD)])
    p = decode.decode_packets(frames)
    assert (filters.by_protocol(p, 0x0800).count(), filters.by_protocol(p, None, 17).count(), filters.by_protocol(p, 0x86DD, 17).count(), filters.by_protocol(p, 0x86DD, 6).count()) == (2, 2, 1, 0)


def test_capture_report(spark, tmp_path):
    whole = capture([b"one", b"two"])
    cases = {"a": whole, "b": whole[:-1], "c": b"nothing of the kind" * 3, "d": gzip.compress(whole)[:-12], "e": capture([b"x" * 70_000]), "f": whole + b"\0" * 5, "g": gzip.compress(whole)}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    got = {r.feed_id[-1]: (r.records, r.ending) for r in pcap.capture_report(spark, str(tmp_path)).collect()}
    assert got == {"a": (2, "end"), "b": (1, "cut short"), "c": (0, "no capture"), "d": (got["d"][0], "damaged gzip"), "e": (0, "overlong record"), "f": (2, "cut short"), "g": (2, "end")}


def fragments(payload, cuts, id=5, six=False):
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(payload)]):
        more = b < len(payload)
        if six:
            out.append(ether(ip6(bytes([17, 0]) + struct.pack(">HI", a | more, id) + payload[a:b], 44), 0x86DD))
        else:
            out.append(ether(ip4(payload[a:b], 17, id, a, more)))
    return out


@pytest.mark.parametrize("six", [False, True])
def test_reassembly_in_any_order(spark, six):
    payload = udp(message([("frag.example.", 1, 1)], flags=0) + b"." * 100)
    frames = fragments(payload, [16, 48, 64], six=six)
    random.Random(1).shuffle(frames)
    joined = reassembly.reassemble(decode.internet(decode.ethernet(packets(spark, [*frames, ether(ip4(udp(b"whole")))]))))
    r = decode.transport(joined).orderBy("is_reassembled").collect()
    assert [x.is_reassembled for x in r] == [False, True]
    assert (bytes(r[1].segment), r[1].srcport, r[1].fragment_ofs) == (payload, 4000, 0)


def test_reassembly_limits(spark):
    payload = bytes(range(200))
    a = fragments(payload, [80, 160])
    overlap = ether(ip4(payload[72:120], 17, 5, 72, True))
    assert reassembly.reassemble(decode.internet(decode.ethernet(packets(spark, [a[0], overlap, *a[1:]])))).count() == 1
    slow = packets(spark, [a[0], a[1], a[2]], step=31)
    assert reassembly.reassemble(decode.internet(decode.ethernet(slow))).count() == 0
    b = reassembly.Buffer(0.0)
    assert b.add(0, True, b"x" * 16) is None and b.add(32, False, b"z" * 5) is None and b.add(16, True, b"y" * 16) == b"x" * 16 + b"y" * 16 + b"z" * 5
    assert reassembly.Buffer(0.0).add(0, False, b"x" * 70_000) is None


def fields(raw):
    """Fields of a protobuf message by number."""

    def number(at):
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return n, at

    out, at = {}, 0
    while at < len(raw):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = (4, at) if tag & 7 == 5 else number(at)
            value, at = raw[at : at + size], at + size
        out[tag >> 3] = value
    return out


def test_logs_of_decoded_messages(spark, tmp_path):
    from pyspark.sql import functions as F

    from spillway import sinks
    from spillway.operators import filters

    subnet = rr(b"\0", 41, 0, struct.pack(">HHHBB", 8, 7, 1, 24, 0) + b"\x0a\1\2", 1232)
    q = message([("a.example.", 1, 1)], additionals=[subnet], flags=0x0100)
    r = message([("a.example.", 1, 1)], [rr(b"\xc0\x0c", 1, 60, b"\1\2\3\4"), rr(b"\xc0\x0c", 48, 64, struct.pack(">HBB", 257, 3, 8) + b"\3\1\0\1" + b"\x99" * 128)], [rr(b"\0", 2, 5, name("ns."))])
    frames = [ether(ip4(udp(q))), ether(ip4(udp(r, 53, 4000), src=b"\xc0\0\2\x35", dst=b"\x0a\0\0\1"))]
    packed = decode.dns_payload(decode.decode_packets(packets(spark, frames)))
    m = decode.decode_dns(decode.decode_packets(packets(spark, frames))).withColumn("seq", F.monotonically_increasing_id()).cache()
    log = sorted((x.part, x.client, x.type, x.name, x.rcode) for x in sinks.query_response_log(m).collect())
    assert [x[0] for x in log] == ["Q(Q)", "Q(R)", "R(ANS)", "R(ANS)", "R(AUT)"] and log[2] == ("R(ANS)", "10.0.0.1", "A", "1.2.3.4", "NOERROR")
    assert [x.name for x in sinks.answer_names(m).collect()] == ["a.example."] * 2
    assert [tuple(x) for x in sinks.membership_tuples(m).collect()] == [("10.0.0.1", "a.example.", 1, 1)]
    named = m.withColumns({c: F.lit("x") for c in ("as_short", "country", "ecs_as_short", "ecs_as_prefix", "ecs_country")} | {"cidr_desc": F.lit("d")})
    assert [(x.ecs_ip, x.ecs_scope, x.qname) for x in sinks.subnet_log(named).collect()] == [("10.1.2.0", 24, "a.example.")]
    assert sinks.no_subnet_log(named).count() == 0
    assert [x.bitsize for x in sinks.dnskey_log(m.withColumn("qtype", F.lit(48))).collect()] == [1024]
    tap = sinks.dnstap(decode.dns_header(packed), "me", "1").first()
    assert (tap.socket_family, tap.query_port, bytes(tap.query_message)) == ("INET", 4000, q)
    raw = bytes(sinks.dnstap_bytes(sinks.dnstap(decode.dns_header(packed), "me", "1")).first().value)
    outer = fields(raw)
    assert outer.keys() == {1, 2, 14, 15} and (outer[1], outer[2], outer[15]) == (b"me", b"1", 1)
    micros = m.where("not qr").selectExpr("unix_micros(ts)").first()[0]
    assert fields(outer[14]) == {1: 5, 2: 1, 3: 1, 4: b"\x0a\0\0\1", 6: 4000, 8: micros // 1_000_000, 9: struct.pack("<I", micros % 1_000_000 * 1000), 10: q}
    from spillway.sources import tables

    for log, port in ((sinks.denat_queries(m), "udp_srcport"), (sinks.denat_responses(m), "udp_dstport")):
        sinks.write_csv(log.drop("hour"), str(tmp_path / port))
        back = tables.read_denat_csv(spark, str(tmp_path / port)).collect()
        assert [(x.client_ip, x.ip_ttl, x[port], x.dns_qname) for x in back] == [("10.0.0.1", 64, 4000, "a.example.")]
    assert back[0].first_response_ttl == 60
    assert filters.first_packets(m, 1).count() == 1 and filters.first_packets(m, 0, 10).count() == 2
    sinks.write_parquet(m.select("ts", "qname"), str(tmp_path / "p"), "1 hour")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_report_lines(spark, sf_dir, tmp_path):
    from spillway import fixtures as fx
    from spillway import sinks
    from spillway.operators import darknet, popularity, traffic, unique
    from spillway.sources import tables

    m = fx.dns_messages(spark, sf_dir)
    assert " - " in sinks.top_lines(popularity.query_popularity(m, "30 days")).first().value
    assert sinks.unique_clients_line(unique.unique_clients(m)).first().value.count(";") == 7
    metrics = traffic.scoped_metrics(m.withColumnRenamed("feed_id", "scope"), "30 days")
    assert {r.label for r in sinks.summary(metrics, {"q_ctr": "Queries"}).collect()} == {"Queries"}
    records = darknet.interval_records(darknet.ports(m, "1 day"), darknet.identification(m, "1 day", "query_id"))
    sinks.write_hourly_json(records, str(tmp_path / "j"))
    back = tables.darknet_series(tables.read_darknet(spark, str(tmp_path / "j")), "ipid")
    assert back.groupBy().sum("n").first()[0] == m.count()
    exact = {(r.interval_start, r.proto, r.port): r.ips_prob_count for r in darknet.ports(m, "1 day", exact=True).collect()}
    assert all(abs(exact[r.interval_start, r.proto, r.port] - r.ips_prob_count) <= 1 for r in darknet.ports(m, "1 day").collect())


def test_dnstap_bytes_are_read_by_a_protobuf_library(spark):
    """Against the published message types, declared to the library itself."""
    from spillway import sinks

    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="tap.proto", package="t", syntax="proto2")
    message, outer = file.message_type.add(name="Message"), file.message_type.add(name="Dnstap")
    for name, number, kind in (
        ("type", 1, kinds.TYPE_INT32), ("socket_family", 2, kinds.TYPE_INT32), ("socket_protocol", 3, kinds.TYPE_INT32), ("query_address", 4, kinds.TYPE_BYTES), ("query_port", 6, kinds.TYPE_UINT32),
        ("query_time_sec", 8, kinds.TYPE_UINT64), ("query_time_nsec", 9, kinds.TYPE_FIXED32), ("query_message", 10, kinds.TYPE_BYTES),
    ):
        message.field.add(name=name, number=number, type=kind, label=kinds.LABEL_OPTIONAL)
    for name, number, kind in (("identity", 1, kinds.TYPE_BYTES), ("version", 2, kinds.TYPE_BYTES), ("message", 14, kinds.TYPE_MESSAGE), ("type", 15, kinds.TYPE_INT32)):
        outer.field.add(name=name, number=number, type=kind, label=kinds.LABEL_OPTIONAL, type_name=".t.Message" if name == "message" else None)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    tap = message_factory.GetMessageClass(pool.FindMessageTypeByName("t.Dnstap"))
    rows = [("INET", "UDP", bytearray(b"\x0a\x00\x00\x01"), 53_535, 1_700_000_000, 123_456_000, bytearray(b"q" * 300)), ("INET6", "TCP", bytearray(range(16)), 1, 0, 0, bytearray(b""))]
    schema = "socket_family string, socket_protocol string, query_address binary, query_port int, query_time_sec long, query_time_nsec long, query_message binary"
    df = spark.createDataFrame(rows, schema).selectExpr("'me' identity", "'1' version", "'CLIENT_QUERY' type", "*")
    for row, packed in zip(rows, sinks.dnstap_bytes(df).collect()):
        found = tap.FromString(bytes(packed.value))
        assert (found.identity, found.version, found.type) == (b"me", b"1", 1)
        m = found.message
        assert (m.type, m.socket_family, m.socket_protocol) == (5, 1 if row[0] == "INET" else 2, 1 if row[1] == "UDP" else 2)
        assert (m.query_address, m.query_port, m.query_time_sec, m.query_time_nsec, m.query_message) == (bytes(row[2]), *row[3:6], bytes(row[6]))
