"""Column functions and filters on small rows."""

import ipaddress
import random

import pytest

from pyspark.sql import functions as F

from spillway import sinks
from spillway.functions import net
from spillway.operators import enrich, filters, popularity, traffic


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_names(spark):
    lit = F.lit
    r = one(
        spark, sld=net.sld(lit("a.b.example.org.")), short=net.sld(lit("org.")), root=net.sld(lit("")), tld=net.tld(lit("a.org.")), up=net.parent_suffixes(lit("a.b.c.")), none=net.parent_suffixes(lit("")), unknown=net.qtype_name(lit(9999)),
        missing=net.qclass_name(lit(None).cast("int")), aaaa=net.qtype_name(lit(28)), any_=net.ends_with_any(lit("X.Example."), ["example."]), aligned=net.ends_with_any(lit("badexample."), ["example."], label_aligned=True), all_=net.ends_with_any(lit("x"), []),
    )
    assert (r.sld, r.short, r.root, r.tld) == ("example.org.", "org.", "", "org")
    assert r.up == ["a.b.c.", "b.c.", "c."] and r.none == []
    assert (r.unknown, r.missing, r.aaaa, r.any_, r.aligned, r.all_) == ("UNKNOWN", "UNSPECIFIED", "AAAA", True, False, True)


def test_addresses(spark):
    rng = random.Random(1)
    v4 = [rng.getrandbits(32) for _ in range(200)]
    v6 = [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(50)]
    rows = spark.createDataFrame([(n,) for n in v4], "n long").select("n", net.ip4_to_text("n").alias("t"), net.ip4_prefix_text("n", 20).alias("p"), net.ip4_from_bytes(net.ip4_to_bytes("n")).alias("back"))
    rows = rows.withColumn("again", net.ip4_from_text("t")).collect()
    assert all(r.t == str(ipaddress.IPv4Address(r.n)) and r.back == r.n == r.again for r in rows)
    assert all(r.p == str(ipaddress.ip_network((r.n, 20), strict=False)) for r in rows)
    six = spark.createDataFrame([(bytearray(a.packed), str(a)) for a in v6], "b binary, t string")
    high, low = net.ip6_halves("b")
    six = six.select("*", net.ip6_bytes(high, low).alias("back"), net.ip6_words_text("b").alias("w"), net.ip6_prefix64_text("t").alias("p")).collect()
    assert all(r.back == r.b and ipaddress.ip_address(r.w) == ipaddress.ip_address(r.t) for r in six)
    assert all(ipaddress.ip_network(r.p) == ipaddress.ip_network(r.t + "/64", strict=False) for r in six)
    assert one(spark, bad=net.ip4_from_text(F.lit("no"))).bad is None
    sparse = [ipaddress.IPv6Address(sum(rng.choice([0, 0, 0, 0x10, 0xA0B, 0xFFFF]) << 16 * i for i in range(8))) for _ in range(600)] + [ipaddress.IPv6Address(x) for x in ("::", "::1", "1::", "1:0:0:2::", "0:1::", "1:0:2:3:4:5:6:7")]
    short = spark.createDataFrame([(bytearray(a.packed), str(a)) for a in [*v6, *sparse]] + [(bytearray(b"abc"), None), (None, None)], "b binary, t string").select("t", net.ip6_text("b").alias("s")).collect()
    assert all(r.s == r.t for r in short)


def test_lookups_of_sixteen_bytes_against_brute_force(spark):
    rng = random.Random(2)
    base = 0x20010DB8 << 96
    ranges = []
    for i in range(60):
        bits = rng.choice([40, 56, 64, 90])
        start = base + (rng.getrandbits(32) << 64) >> bits << bits
        ranges.append((start, start + (1 << bits) - 1, 128 - bits, f"AS{i}", f"name {i}"))
    points = [rng.choice(ranges)[0] + rng.getrandbits(50) for _ in range(200)] + [base - 1]
    pack = lambda n: bytearray(n.to_bytes(16, "big"))
    table = spark.createDataFrame([(pack(a), pack(b), p, s, f) for a, b, p, s, f in ranges], "from_ip binary, to_ip binary, prefix int, as_single string, as_full string")
    asked = spark.createDataFrame([(i, pack(n)) for i, n in enumerate(points)], "i int, a binary")
    got = {r.i: r.as_short for r in enrich.with_asn(asked, "a", table).collect()}
    for i, n in enumerate(points):
        best = max(((a, p, s) for a, b, p, s, _ in ranges if a <= n <= b), default=(0, 0, None))
        assert got[i] == best[2]
    assert len(got) == len(points)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_sweeps_of_both_address_kinds_against_brute_force(spark, monkeypatch, wide, limit):
    """Sent to all tasks, and dealt by range with open ranges handed on."""
    monkeypatch.setattr(enrich, "RANGES", limit)
    rng = random.Random(5)
    top = (1 << 128) - 1 if wide else (1 << 32) - 1
    shift = 96 if wide else 0
    ranges = [(0, top, 0, "all", "everything")]
    for i in range(150):
        a = rng.randrange(1 << 32)
        b = min((1 << 32) - 1, a + rng.choice([0, 5, 1 << 16, 1 << 24, 1 << 29]))
        ranges.append((a << shift, (b << shift) + rng.randrange(1 << shift) if wide else b, rng.randrange(33), f"AS{i}", f"name {i}"))
    ranges.append((ranges[7][0], ranges[7][1] + 9, ranges[7][2] + 40, "ASX", "twin"))
    ends = [x for r in ranges for x in (r[0], r[0] - 1, r[1], r[1] + 1)]
    points = [x for x in ends if 0 <= x <= top] + [rng.randrange(top) for _ in range(200)] + [ranges[3][0]] * 300 + [0, top, None, None]
    pack = (lambda n: n if n is None else bytearray(n.to_bytes(16, "big"))) if wide else lambda n: n
    kind = "binary" if wide else "long"
    table = spark.createDataFrame([(pack(a), pack(b), p, s, f) for a, b, p, s, f in ranges], f"from_ip {kind}, to_ip {kind}, prefix int, as_single string, as_full string")
    asked = spark.createDataFrame([(i, pack(n)) for i, n in enumerate(points)], f"i int, a {kind}").repartition(3)
    got = {r.i: r.as_short for r in enrich.with_asn(asked, "a", table).collect()}
    nearest = {r.i: r.country for r in enrich.with_country(asked, "a", table.withColumnRenamed("as_single", "country")).collect()}
    assert len(got) == len(nearest) == len(points)
    for i, n in enumerate(points):
        best = max(((a, p, s) for a, b, p, s, _ in ranges if n is not None and a <= n <= b), default=(0, 0, None))
        assert got[i] == best[2]
        last = max(((a, b, s) for a, b, _, s, _ in ranges if n is not None and a <= n), default=None)
        assert nearest[i] == (last[2] if last and n <= last[1] else None)
    blocks = table.selectExpr("try_cast(substring(as_single, 3) as int) ord", "from_ip lo", "to_ip hi", "as_full descr").where("ord is not null")
    if wide:
        first = {r.i: r.cidr_desc for r in enrich.cidr_match(asked, "a", blocks).collect()}
        for i, n in enumerate(points):
            assert first[i] == min(((int(s[2:]), f) for a, b, _, s, f in ranges if s[2:].isdigit() and n is not None and a <= n <= b), default=(0, None))[1]
    assert enrich.with_asn(asked, "a", table.limit(0)).where("as_short is not null").count() == 0


def test_nearest_country_misses_wider_ranges(spark):
    table = spark.createDataFrame([(10, 100, "wide"), (20, 30, "near")], "from_ip long, to_ip long, country string")
    got = dict(enrich.with_country(spark.createDataFrame([(5,), (15,), (25,), (50,)], "a long"), "a", table).collect())
    assert got == {5: None, 15: "wide", 25: "near", 50: None}


def test_first_block_with_host_bits(spark):
    blocks = spark.createDataFrame([(0, 5, 20, "unsound"), (1, 0, 15, "low"), (2, 0, 255, "all")], "ord int, lo long, hi long, descr string")
    asked = spark.createDataFrame([(7,), (40,), (400,), (None,)], "a long")
    assert [r.cidr_desc for r in enrich.cidr_match(asked, "a", blocks).collect()] == ["low", "all", None, None]
    assert enrich.cidr_match(asked, "a", blocks.limit(0)).where("cidr_desc is not null").count() == 0


def test_filters(spark):
    m = spark.createDataFrame(
        [("1.1.1.1", "9.9.9.9", 1000, 53, False), ("9.9.9.9", "1.1.1.1", 53, 1000, True), ("2.2.2.2", "8.8.8.8", 1000, 53, False)], "ip_src string, ip_dst string, srcport int, dstport int, qr boolean"
    )
    assert filters.for_servers(m, ["9.9.9.9"]).count() == 2
    assert filters.for_servers(m, ["*"]).count() == filters.for_servers(m, []).count() == 3
    assert filters.for_servers(m, [f"9.9.9.{i}" for i in range(250)]).count() == 2
    assert filters.without(m, spark.createDataFrame([("1.1.1.1",)], "ip string")).count() == 1
    assert filters.by_ports(m, 0, 53).count() == 2 and filters.by_ports(m, 53).count() == 1 and filters.by_predicate(m, "qr").count() == 1


def test_lines(spark):
    stats = spark.createDataFrame([("t", 1, 2)], "at string, a long, b long")
    assert [r.value for r in sinks.key_value_lines(stats).collect()] == ["a:1 b:2"]
    assert sorted(r.value for r in sinks.key_value_lines(stats, "h").collect()) == ["h a 1", "h b 2"]
    rates = spark.createDataFrame([("t", 1, 2.5)], "at string, a long, b double")
    assert [r.value for r in sinks.key_value_lines(rates, keys={"b": "x.b", "a": "x.a", "none": "y"}).collect()] == ["x.b:2.50 x.a:1"]
    assert len(sinks.row_keys()) == len(set(sinks.row_keys().values())) == 167 and len(set(sinks.item_keys().values())) == len(sinks.item_keys())
    big = traffic.buckets(F.col("n"), (10, 20), "x", F.lit(True))
    row = spark.createDataFrame([(5,), (10,), (19,), (20,)], "n int").agg(*big).first()
    assert (row.x_below_10, row.x_from_10, row.x_from_20) == (1, 2, 1)


def test_ranks_of_all_rows_in_ranges(spark):
    rng = random.Random(3)
    rows = [(g, f"k{i}", rng.choice([1, 1, 1, 2, 3, 50])) for g in "ab" for i in range(500)]
    counts = spark.createDataFrame(rows, "g string, key string, n long")
    got = {(r.g, r.key): r["rank"] for r in popularity.ranked_all(counts, ["g"]).collect()}
    for g in "ab":
        order = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1]))
        assert all(got[g, k] == i + 1 for i, (_, k, _) in enumerate(order))
    assert popularity.ranked_all(counts.limit(0), ["g"]).count() == 0


def test_plan_of_top_names(spark, sf_dir):
    from spillway import fixtures as fx

    top = popularity.query_popularity(fx.dns_queries(spark, sf_dir), "1 day")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("FileScan") == 2  # the names and their bases


def test_statistics_of_messages_without_lists(spark):
    rows = [(False, True, 1, 1, "a.", 0), (False, True, 48, 1, "b.", 0), (False, False, 1, 1, "c.", 0), (True, True, 1, 1, "a.", 0), (False, True, None, None, None, 0), (False, True, 6, 1, "n.", 4)]
    m = spark.createDataFrame(rows, "qr boolean, is_valid boolean, qtype int, qclass int, qname string, opcode int").selectExpr(
        "*", "timestamp_seconds(1700000000) ts", "false is_partial", "4 ip_type", "'1.1.1.1' ip_src", "'2.2.2.2' ip_dst", "100 udp_len", "false is_tcp", "false has_edns0", "0 edns0_max_size", "false edns0_do", "false has_ecs", "false has_exp_opt", "0 rcode", "0 ans_count", "0 aut_count", "0 add_count",
        "false is_fragmented", "false aa", "false tc", "false rd", "false ra", "false ad", "false cd", "true has_soa", "false ns_first", "'s' scope",
    )
    r = traffic.with_percentages(traffic.dns_statistics(m)).first()
    assert (r.queries, r.responses, r.type_A, r.type_DNSKEY, r.type_SOA, r.type_UNKNOWN, r.answer_type_A, r.rcode_NODATA, r.response_mean_size) == (4, 1, 1, 1, 1, 0, 0, 1, 100)
    r = traffic.rates_by_version(m).first()
    assert (r.type_SOA, r.notify, r.pct_fragmented_v4, r.rcode_NODATA) == (0, 1, 0.0, 1)
    got = {x.metric: x.value for x in traffic.scoped_metrics(m).collect()}
    assert len(got) == 168 and got["q_malformed_ctr"] == 1 and got["notify_in_ctr"] == 1 and got["avg_qsize"] == 100 and got["r_rsize_le_512_ctr"] == 1


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1_700_000_000, "x"), (1_700_009_000, "y")], "timestamp long, v string")
    sinks.write_hourly_json(df, str(tmp_path / "j"))
    assert len(list((tmp_path / "j").glob("hour=*"))) == 2
    from spillway.sources import tables

    (tmp_path / "d.json").write_text('{"timestamp": 5, "udp": [{"port": 53, "seen_count": 2, "ips_prob_count": 1}], "tcp": []}\nnot json\n')
    got = tables.read_darknet(spark, str(tmp_path / "d.json")).cache()
    assert got.where("_corrupt_record is not null").count() == 1
    assert [tuple(r) for r in tables.darknet_series(got, "udp").collect()] == [(5, 53, 2)]
    head = "timestamp,client_ip,ip_ipid,ip_ttl,udp_srcport,dns_qid,dns_qtype,dns_qclass,dns_qname,dns_edns0,dns_edns0_do,dns_edns0_maxsize"
    (tmp_path / "q.csv").write_text(head + "\n1.5,10.0.0.1,1,64,4000,7,1,1,a.,1,0,1232\n1,2,3\n")
    assert [r.dns_qname for r in tables.read_denat_csv(spark, str(tmp_path / "q.csv")).collect()] == ["a."]
