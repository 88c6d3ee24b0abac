"""What the third round's findings were about: exact numbers of scans, messages decoded once, work that follows the rows."""

import ipaddress

from pyspark.sql import functions as F

from spillway import fixtures as fx
from spillway import sinks
from spillway.functions import net
from spillway.operators import darknet, decode, filters, membership, resolver
from spillway.plans import stream_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def asked(spark, n):
    return spark.range(n).selectExpr(
        "cast(timestamp_seconds(1700000000 + id) as timestamp_ntz) ts", "concat('n', cast(id % 3 as string), '.') qname", "167772160 + id dst_v4", "false qr", "4 ip_type", "1 qclass", "1 qtype", "false has_edns0"
    )


def test_a_saturated_scan_has_the_exact_number_of_its_addresses(spark):
    got = darknet.scans(asked(spark, 30_000), 0, 1 << 32, 2).collect()
    assert len(got) == 3 and {(r.ip_count, r.saturated, r.approx, r.seen) for r in got} == {(256, True, 10_000, 10_000)}


def test_scans_of_blocks_count_all_addresses_on_demand(spark):
    block = spark.sql("select 1 ord, 167772160L lo, 184549375L hi, 'ten' descr")
    got = darknet.scans_of_blocks(asked(spark, 3_000), [("dst_v4", block)], saturated=None).collect()
    assert {(r.ip_count, r.saturated, r.approx) for r in got} == {(1_000, False, 0)}
    got = darknet.scans_of_blocks(asked(spark, 3_000), [("dst_v4", block)]).collect()
    assert {(r.ip_count, r.saturated, r.approx) for r in got} == {(256, True, 1_000)}


def test_predicates(spark, sf_dir):
    m = fx.dns_messages(spark, sf_dir)
    got = filters.by_predicate(m, "srcport % 2 = 0 and udp_len > 50")
    some = {(r.srcport % 2, r.udp_len > 50) for r in got.select("srcport", "udp_len").collect()}
    assert some == {(0, True)} and 0 < got.count() < m.count()


def test_logs_decode_messages_once(spark, sf_dir):
    from spillway.plans import decode_queries

    m = decode.decode_dns(decode.decode_packets(fx.dns_frames(spark, sf_dir))).withColumn("seq", F.lit(0))
    for df in (sinks.query_response_log(m), decode_queries.decoded_records(spark, sf_dir)):
        assert plan(df).count("MapInArrow") == 1


def test_ports_keep_sketches_that_grow_with_their_addresses(spark, sf_dir):
    m = fx.dns_messages(spark, sf_dir)
    assert "approx_count_distinct" not in plan(darknet.ports(m, "1 day"))
    one, exact = ({(r.interval_start, r.proto, r.port): r.ips_prob_count for r in darknet.ports(m, "7 days", exact=e).collect()} for e in (False, True))
    assert one.keys() == exact.keys() and all(abs(one[k] - exact[k]) <= max(1, 0.03 * exact[k]) for k in exact)


def test_a_filter_is_met_in_one_row(spark):
    """Items are not dealt by word: as many rows are shuffled as there are items, for small filters and for ones of many words the same answers."""
    items = spark.range(300).selectExpr("timestamp_seconds(86400 * (id % 3)) interval_start", "concat('n', cast(id as string)) item")
    probes = items.unionByName(items.selectExpr("interval_start", "concat('x', item) item")).unionByName(spark.sql("select timestamp_seconds(0) interval_start, cast(null as string) item union all select timestamp_seconds(864000), 'n0'"))
    for bits in (1 << 10, 1000, membership.BITS):
        found = membership.contains(membership.build(items, bits), probes, bits)
        whole, membership.WHOLE = membership.WHOLE, 0
        try:
            dealt = membership.contains(membership.build(items, bits), probes, bits)
        finally:
            membership.WHOLE = whole
        got = sorted(map(str, found.collect()))
        assert got == sorted(map(str, dealt.collect())) and len(got) == 602
        assert "explode(array(pmod" not in plan(found).split("Join")[0] and "x" in str(got)


def test_shortest_text_of_addresses(spark):
    """Against the standard library, runs of zeros at all places and of all lengths."""
    values = [bytes(b for i in range(8) for b in (bytes(2) if mask >> i & 1 else (0x0A00 + i).to_bytes(2))) for mask in range(256)] + [bytes.fromhex("00010000000200000000000300000004"), bytes(10) + b"\xff\xff\x0a\x00\x00\x01"]
    rows = spark.createDataFrame([(v,) for v in values], "a binary").select("a", net.ip6_text("a").alias("t")).collect()
    for r in rows:
        full = ipaddress.IPv6Address(bytes(r.a))
        want = f"::ffff:{full.ipv4_mapped}" if full.ipv4_mapped else _shortest(full)
        assert r.t == want, (full.exploded, r.t)


def _shortest(address):
    words = [f"{int(w, 16):x}" for w in address.exploded.split(":")]
    best = max(((n, -at) for at in range(8) for n in range(2, 9 - at) if words[at : at + n] == ["0"] * n), default=None)
    if best is None:
        return ":".join(words)
    n, at = best[0], -best[1]
    return ":".join(words[:at]) + "::" + ":".join(words[at + n :])


def test_files_that_land_follow_the_rows(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id", "timestamp_seconds(id) ts")
    assert len(spark.read.parquet(stream_queries._landed(spark, rows)).inputFiles()) == 4
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    assert len(spark.read.parquet(stream_queries._landed(spark, rows)).inputFiles()) == 10


def test_a_frequent_address_is_dealt_into_parts(spark, monkeypatch):
    """Most messages have one server: they are joined in many tasks, with the same answers, listed or not, null or not."""
    ip = "case id % 10 when 8 then null when 9 then concat('c', cast(id % 7 as string)) else '{}' end"
    m = spark.range(4000).selectExpr("timestamp_seconds(id) ts", f"{ip.format('hot')} ip_src", f"{ip.format('warm')} ip_dst", "cast(id % 1000 as int) srcport", "53 dstport")
    table = spark.createDataFrame([("hot",), ("hot",), ("c3",), (None,), ("other",)], "ip string")
    monkeypatch.setattr(resolver, "PART_ROWS", 100, raising=False)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    was = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, ("-1", "false", "16")):
            spark.conf.set(k, v)
        got, src, dst = resolver.listed(m, table)
        rows = got.select("ts", "ip_src", "ip_dst", src.alias("s"), dst.alias("d"), F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(rows) == 4000 == len({r.ts for r in rows})
    assert all(r.s == (r.ip_src in ("hot", "c3")) and r.d == (r.ip_dst == "c3") for r in rows) and any(r.d for r in rows)
    for address in ("warm", None):
        assert len({r.task for r in rows if r.ip_dst == address}) > 3, address


def test_rows_of_one_time_land_in_several_files(spark):
    rows = spark.range(4000).selectExpr("id", "timestamp_seconds(1700000000) ts")
    path = stream_queries._landed(spark, rows)
    held = [r[1] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 4000 and len(held) == 4 and max(held) < 2000


def test_totals_of_files_that_land_in_any_order(spark, sf_dir, monkeypatch):
    """Files are written side by side, so the one with the last rows may be ready first."""

    def last_first(spark, rows):
        path = fx.folder(spark)
        day = F.to_date("ts")
        days = sorted(r[0] for r in rows.select(day).distinct().collect())
        for at in range(len(days) - 1, -1, -6):
            rows.where(day.isin(days[max(0, at - 5) : at + 1])).coalesce(1).write.mode("append").parquet(path)
        return path

    monkeypatch.setattr(stream_queries, "_landed", last_first)
    m = fx.dns_messages(spark, sf_dir).where("feed_id <> 'feed1'").groupBy(F.to_date("ts").alias("day"), "feed_id").count()
    want = {(r.day, r.feed_id): r["count"] for r in m.collect()}
    got = stream_queries.stream_feed_totals(spark, sf_dir).collect()
    assert {(r.interval_start.date(), r.feed_id): r.packets for r in got} == want and len(got) == len(want)
