"""Streams give the rows of batches."""

import json

from spillway import fixtures as fx
from spillway.operators import darknet, match, popularity, reassembly, traffic
from spillway.streaming import stateful, windows


def collect(spark, stream, tmp_path, mode="append"):
    out = []
    q = windows.run(stream, lambda df, _: out.extend(df.collect()), str(tmp_path / "checkpoint"), mode)
    q.awaitTermination(240)
    assert not q.isActive
    return out


def test_totals(spark, sf_dir, tmp_path):
    m = fx.dns_messages(spark, sf_dir).orderBy("ts")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("ts", stream["ts"].cast("timestamp"))
    got = {str(r.interval_start): r.packets for r in collect(spark, windows.on_stream(stream, traffic.totals, "1 day"), tmp_path)}
    batch = {str(r.interval_start): r.packets for r in traffic.totals(m, "1 day").collect()}
    assert got.items() <= batch.items() and len(got) >= len(batch) - 2  # the last interval stays open


def test_pairs(spark, sf_dir, tmp_path):
    m = fx.dns_messages(spark, sf_dir)
    m = m.withColumns({"ts": m["ts"].cast("timestamp"), "udp_len": m["udp_len"].cast("int"), "qtype": m["qtype"].cast("int"), "qclass": m["qclass"].cast("int"), "dstport": m["dstport"].cast("int"), "srcport": m["srcport"].cast("int")})
    m.write.parquet(str(tmp_path / "in"))
    got = collect(spark, stateful.stream_pairs(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))), tmp_path)
    batch = match.match_qr(m, 30).select(*match.KEY, "query_ts", "response_ts", "q_udp_len", "r_udp_len").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, batch))) and batch


def test_fragments(spark, tmp_path):
    from test_decode import decode, ether, fragments, ip4, packets, udp  # noqa: F401

    payload = udp(b"q" * 200)
    frames = fragments(payload, [80, 160])[::-1] + fragments(payload, [80], id=6)[:1]
    ip = decode.internet(decode.ethernet(packets(spark, frames)))
    f = ip.selectExpr("ts", "src_addr", "dst_addr", "ip_proto", "cast(ip_id as long) frag_id", "fragment_ofs", "more_frags", "segment")
    f.write.parquet(str(tmp_path / "in"))
    got = collect(spark, stateful.stream_reassembly(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))), tmp_path)
    assert [bytes(r.segment) for r in got] == [payload] and reassembly.reassemble(ip).count() == 1


def test_scans(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    m = fx.dns_queries(spark, sf_dir)
    # one name is asked of so many addresses that it is sketched
    many = F.when(F.col("seq") % 2 == 0, "all.example.").otherwise(F.col("qname"))
    m = m.withColumns({"ts": m["ts"].cast("timestamp"), "dst_v4": 1000 + F.col("seq"), "qname": many, "ip_type": F.lit(4), "qclass": F.lit(1), "qtype": F.lit(1), "has_edns0": F.lit(True)})
    m.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    rows = collect(spark, stateful.stream_scans(source, 0, 1 << 32, 2), tmp_path, "update")
    sketches = collect(spark, windows.on_stream(source, stateful.scan_sketches, 0, 1 << 32, "1 day"), tmp_path / "sketches", "update")
    found = spark.createDataFrame(rows, stateful._SCANS)
    held = spark.createDataFrame(sketches, "interval_start timestamp, key string, sketch binary")
    got = {r.key: r for r in stateful.with_estimates(found, held).collect()}
    batch = {r.key: r for r in darknet.scans(m, 0, 1 << 32, 2).collect()}
    assert got.keys() == batch.keys() and "all.example._00001_00001_1" in got
    for k, r in batch.items():
        assert (got[k].ip_count, got[k].saturated, got[k].seen, got[k].first_seen, got[k].last_seen) == (r.ip_count, r.saturated, r.seen, r.first_seen, r.last_seen)
        assert abs(got[k].approx - r.approx) <= 0.03 * r.approx
    assert got["all.example._00001_00001_1"].saturated


def test_scans_forget_what_was_asked_once(spark, tmp_path):
    schema = "second long, qname string, dst_v4 long"
    steps = [[(0, "a.", 1), (0, "b.", 1), (1, "b.", 2)], [(1000, "c.", 1)], [(1001, "a.", 2), (1001, "b.", 3)]]
    for rows in steps:
        df = spark.createDataFrame(rows, schema).selectExpr("timestamp_seconds(1700000000 + second) ts", "qname", "dst_v4", "false qr", "4 ip_type", "1 qclass", "1 qtype", "false has_edns0")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collect(spark, stateful.stream_scans(source, 0, 10), tmp_path, "update")
    # a. was forgotten between its two addresses; b. was above the threshold and stays
    assert [(r.key[0], r.ip_count, r.seen) for r in got] == [("b", 2, 2), ("b", 3, 3)]
    got = collect(spark, stateful.stream_scans(source, 0, 10, keep=600), tmp_path / "short", "update")
    assert [(r.key[0], r.ip_count, r.seen) for r in got] == [("b", 2, 2)]


def test_state_is_pruned_by_timers(spark, tmp_path):
    """Over ten batches far apart each key is forgotten in time, so what is kept does not grow with the stream."""
    schema = "second long, qname string, dst_v4 long"
    for n in range(10):
        rows = [(n * 2000 + k, f"n{n}k{k}.", a) for k in range(8) for a in range(1 + k % 3)]
        df = spark.createDataFrame(rows, schema).selectExpr("timestamp_seconds(1700000000 + second) ts", "second seq", "qname", "dst_v4", "false qr", "4 ip_type", "1 qclass", "1 qtype", "false has_edns0", "'c' ip_src", "'s' ip_dst", "1000 srcport", "53 dstport", "7 query_id", "50 udp_len")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, stream, mode in (("scans", stateful.stream_scans(source, 0, 10, 2, 600, 600), "update"), ("pairs", stateful.stream_pairs(source), "append")):
        q = windows.run(stream, lambda df, _: df.count(), str(tmp_path / name), mode)
        q.awaitTermination(240)
        rows_kept = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in (json.loads(x.json) if hasattr(x, "json") and isinstance(x.json, str) else x for x in q.recentProgress)]
        most = max(rows_kept)
        assert len(rows_kept) >= 10 and 0 < most <= 2 * max(rows_kept[:3]) and rows_kept[-1] <= most, (name, rows_kept)


def test_a_stream_of_pairs_goes_on_after_a_restart(spark, tmp_path):
    """Query and response in files of different runs of one checkpoint."""
    def message(qr, second, size):
        side = "'s' ip_src, 'c' ip_dst, 53 srcport, 1000 dstport" if qr else "'c' ip_src, 's' ip_dst, 1000 srcport, 53 dstport"
        return spark.range(1).selectExpr(f"timestamp_seconds(1700000000 + {second}) ts", f"cast({second} as long) seq", f"{str(qr).lower()} qr", "'a.' qname", "1 qclass", "1 qtype", "7 query_id", f"{size} udp_len", side.split(", ")[0], *side.split(", ")[1:])

    message(False, 0, 40).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: stateful.stream_pairs(spark.readStream.schema(message(False, 0, 40).schema).parquet(str(tmp_path / "in")))
    assert collect(spark, source(), tmp_path) == []
    message(True, 3, 90).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = collect(spark, source(), tmp_path)
    assert [(r.q_udp_len, r.r_udp_len, (r.response_ts - r.query_ts).seconds) for r in got] == [(40, 90, 3)]


def test_every_interval_at_the_end_of_a_stream(spark, sf_dir, tmp_path):
    m = fx.dns_message_lists(spark, sf_dir)
    m = m.withColumn("ts", m["ts"].cast("timestamp"))
    m.orderBy("ts").repartitionByRange(6, "ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for name, operator, args in (("totals", traffic.totals, ("1 day",)), ("feeds", traffic.by_feed, (["feed0"], "1 day")), ("stats", traffic.dns_statistics, ([], "1 day")), ("domain", popularity.domain_count, ("view.example.", "1 day"))):
        stream = windows.on_stream(source, operator, *args)
        windows.run_to_end(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination(240)
        keys = ["interval_start", "feed_id"] if name == "feeds" else ["interval_start"]
        got = windows.last_rows(spark, str(tmp_path / name), keys).select(stream.columns).collect()
        batch = operator(m, *args).collect()
        assert sorted(map(str, got)) == sorted(map(str, batch)) and batch, name


def test_running_totals_without_a_reset(spark, sf_dir, tmp_path):
    m = fx.dns_messages(spark, sf_dir)
    m = m.withColumn("ts", m["ts"].cast("timestamp"))
    m.repartitionByRange(5, "ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    windows.run(source.groupBy("ip_type").count(), lambda df, _: seen.append(dict(df.collect())), str(tmp_path / "c"), "complete").awaitTermination(240)
    assert len(seen) == 5 and seen[-1] == dict(m.groupBy("ip_type").count().collect())
    assert all(a[k] <= b[k] for a, b in zip(seen, seen[1:]) for k in a)


def test_feeds_and_tables(spark, tmp_path):
    from spillway.sources import tables

    rows = spark.createDataFrame([(f"f{i % 3}", i) for i in range(30)], "feed_id string, n int")
    rows.repartition(4).write.parquet(str(tmp_path / "feed"))
    got = collect(spark, tables.read_feed(spark, str(tmp_path / "feed"), rows.schema, ["f0", "f2"], files_per_trigger=1), tmp_path)
    assert sorted(r.n for r in got) == [i for i in range(30) if i % 3 != 1]
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert tables.load_prefix_table(spark, str(tmp_path / "t.csv"), "feed_id string, n int").count() == tables.load_prefix_table(spark, str(tmp_path / "feed")).count() == 30
