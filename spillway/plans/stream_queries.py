"""Registered queries that run streams to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import decode, enrich, traffic
from ..shared import written
from ..sources import live, pcap, splits, tables
from ..streaming import stateful, windows
from .lookup_queries import _PAIRS
from .sql import DAY, query

#: Rows of a file that lands, at most (about).
FILE_ROWS = 1_500_000
FEEDS = ("feed0", "feed1", "feed2")


def _landed(spark, rows):
    """A folder of rows in the order of time, as several files that a stream takes in turn; how many follows the number of rows."""
    path = fx.folder(spark)
    # many rows may have one time, so it is dealt further
    rows.repartitionByRange(max(4, -(-rows.count() // FILE_ROWS)), F.col("ts"), F.xxhash64(*rows.columns)).write.parquet(path)
    return path


def _span(spark, path):
    """From the first to the last row that landed: as late as a row can be, as files are written side by side and a stream takes the one that was ready first."""
    seconds = F.unix_seconds("ts")
    span = spark.read.parquet(path).agg(F.max(seconds) - F.min(seconds) + 1).first()[0]
    return windows.LATE if span is None else f"{span} seconds"


def _kept(spark, stream, mode="append"):
    """What a stream gives out until all is taken, each batch in a folder of its own."""
    out, at = fx.folder(spark), fx.folder(spark)
    windows.run(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), at, mode).awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch int").parquet(out)


@query("SELECT feed_id, ip_type, qr, count(*) AS packets FROM m WHERE feed_id <> 'feed1' GROUP BY ALL", "m")
def captures_streamed_through(spark, d):
    """Capture files of three feeds, two of them streamed with a bound on packets a batch into files by the day, which are read by range."""
    landed, out, own = fx.folder(spark), fx.folder(spark), fx.folder(spark)
    frames = written(fx.dns_frames(spark, d))
    for feed in FEEDS:
        pcap.write_captures(frames.where(F.col("feed_id") == feed), f"{landed}/{feed}", per_file=5000)
    started = []
    for feed in ("feed0", "feed2"):
        stream = live.stream_captures(spark, landed, f"{own}/progress-{feed}", [feed], packets=20_000)
        started.append(pcap.stream_captures_out(stream, f"{out}/{feed}", f"{own}/checkpoint-{feed}", interval=86_400, every="0 seconds"))
    # both feeds' streams run side by side
    for running in started:
        running.processAllAvailable()
        running.stop()
    m = decode.dns_header(decode.dns_payload(decode.decode_packets(splits.read_split(spark, splits.capture_files(spark, out)))))
    return m.groupBy(F.regexp_extract("feed_id", "/(feed[0-9])/", 1).alias("feed_id"), "ip_type", "qr").agg(F.count("*").alias("packets"))


@query(f"SELECT {DAY} AS interval_start, feed_id, count(*) AS packets FROM m WHERE feed_id <> 'feed1' GROUP BY ALL", "m")
def stream_feed_totals(spark, d):
    """Days of two feeds of a stream of Parquet files, the open last ones too."""
    m = fx.dns_messages(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    landed = _landed(spark, m)
    stream = tables.read_feed(spark, landed, m.schema, ["feed0", "feed2"], files_per_trigger=2)
    counted = windows.on_stream(stream, traffic.by_feed, ["feed0", "feed2"], "1 day", late=_span(spark, landed))
    path = fx.folder(spark)
    windows.run_to_end(counted, path, fx.folder(spark)).awaitTermination()
    last = windows.last_rows(spark, path, ["interval_start", "feed_id"])
    return last.select(F.col("interval_start").cast("timestamp_ntz").alias("interval_start"), "feed_id", "packets")


@query(f"WITH {_PAIRS} SELECT client, client_port, query_id, query_ts, response_ts, q_udp_len, r_udp_len FROM p", "m")
def stream_query_response_pairs(spark, d):
    """Pairs from a stream's state, of all files as one batch, so that no message is late."""
    kinds = {"ts": "timestamp", **dict.fromkeys(("udp_len", "qtype", "qclass", "dstport", "srcport"), "int")}
    m = fx.dns_messages(spark, d).withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    found = _kept(spark, stateful.stream_pairs(spark.readStream.schema(m.schema).parquet(_landed(spark, m))))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("query_ts", "response_ts")}
    return found.withColumns(times).select("client", "client_port", "query_id", "query_ts", "response_ts", "q_udp_len", "r_udp_len")


@query(
    """WITH x AS (SELECT printf('%s_%05d_%05d_%d', qname, qclass, qtype, CAST(has_edns0 AS INTEGER)) AS key, v, ts
  FROM (SELECT *, 167772160 + (seq * 7919) % 100000 AS v FROM q WHERE ip_type = 4) WHERE v BETWEEN 167772160 AND 167822160)
SELECT key, least(count(DISTINCT v), 256) AS ip_count, count(DISTINCT v) >= 256 AS saturated, count(*) AS seen FROM x GROUP BY 1 HAVING count(DISTINCT v) > 2""",
    "q",
)
def stream_darknet_scans(spark, d):
    """Scans from a stream's state, of all files as one batch."""
    q = fx.dns_queries(spark, d).withColumn("dst_v4", F.when(F.col("ip_type") == 4, 167772160 + (F.col("seq") * 7919) % 100000))
    q = q.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = stateful.stream_scans(spark.readStream.schema(q.schema).parquet(_landed(spark, q)), 167772160, 167822160, 2)
    return _kept(spark, stream, "update").select("key", "ip_count", "saturated", "seen")


@query("SELECT seq, (SELECT arg_max(as_single, (from_ip, prefix)) FROM asn WHERE src_v4 BETWEEN from_ip AND to_ip) AS as_short FROM q", "q", "asn")
def prefix_tables_read_back(spark, d):
    """A table of networks as CSV, loaded by its name and looked up."""
    path = fx.folder(spark) + ".csv"
    fx.ip4_to_as(spark, d).write.option("header", True).csv(path)
    table = tables.load_prefix_table(spark, path, "from_ip long, to_ip long, prefix int, as_single string, as_full string")
    return enrich.with_asn(fx.dns_queries(spark, d), "src_v4", table).select("seq", "as_short")
