"""Traffic to unused addresses: ports, identification values and scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from . import enrich

#: Addresses up to which a scan's destinations are counted exactly.
SATURATED = 256


def _distinct(column: str, exact: bool) -> Column:
    # sketches of few values are small, unlike registers of a fixed size, and most ports have few
    return F.count_distinct(column) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(14)))


def ports(packets: DataFrame, interval: str = "300 seconds", exact: bool = False) -> DataFrame:
    """interval_start, proto, port, seen_count, ips_prob_count of TCP and UDP destination ports."""
    p = packets.select(net.interval_start("ts", interval).alias("interval_start"), F.when(F.col("is_tcp"), "tcp").otherwise("udp").alias("proto"), F.col("dstport").alias("port"), "ip_dst")
    return p.groupBy("interval_start", "proto", "port").agg(F.count("*").alias("seen_count"), _distinct("ip_dst", exact).alias("ips_prob_count"))


def identification(packets: DataFrame, interval: str = "300 seconds", column: str = "ip_id", exact: bool = False) -> DataFrame:
    """interval_start, ipid, seen_count, ips_prob_count of identification values."""
    p = packets.select(net.interval_start("ts", interval).alias("interval_start"), F.col(column).alias("ipid"), "ip_dst")
    return p.groupBy("interval_start", "ipid").agg(F.count("*").alias("seen_count"), _distinct("ip_dst", exact).alias("ips_prob_count"))


def scan_queries_of_blocks(dns: DataFrame, blocks: DataFrame, address: str = "dst_addr") -> DataFrame:
    """key, dst (the address) and ts of queries with a question to any of the blocks (ord, lo, hi, descr) of the address's own kind."""
    q = dns.where(~F.col("qr") & F.col("qname").isNotNull() & F.col(address).isNotNull())
    q = enrich.cidr_match(q, address, blocks, "_block").where("_block is not null")
    return q.select(_key().alias("key"), F.col(address).alias("dst"), "ts")


def _key() -> Column:
    return F.format_string("%s_%05d_%05d_%d", "qname", "qclass", "qtype", F.col("has_edns0").cast("int"))


def scan_queries(dns: DataFrame, low: int, high: int) -> DataFrame:
    """key (name, class and type as five digits, 1 with EDNS0), dst_v4 and ts of queries with a question to [low, high]."""
    q = dns.where(~F.col("qr") & F.col("qname").isNotNull() & (F.col("ip_type") == 4) & F.col("dst_v4").between(low, high))
    return q.select(_key().alias("key"), "dst_v4", "ts")


def scans(dns: DataFrame, low: int, high: int, query_threshold: int = 1) -> DataFrame:
    """Questions asked of more than ``query_threshold`` addresses in [low, high] (IPv4): key, ip_count, saturated, approx, seen, first_seen, last_seen.

    ip_count goes up to SATURATED addresses; from there ``saturated`` is set and ``approx``
    has their number, else 0: exactly, as each question's addresses are told apart anyway.
    """
    return _scans(scan_queries(dns, low, high).withColumnRenamed("dst_v4", "dst"), query_threshold, SATURATED)


def scans_of_blocks(dns: DataFrame, blocks: list[tuple[str, DataFrame]], query_threshold: int = 1, saturated: int | None = SATURATED) -> DataFrame:
    """``scans`` over sets of blocks: (address column, blocks) of IPv4 numbers, of 16 bytes, or of both; a key's addresses of all count.

    ``saturated``: the number of addresses that ip_count goes up to; with None it is always their number.
    """
    parts = []
    for address, of in blocks:
        q = scan_queries_of_blocks(dns, of, address)
        parts.append(q.withColumn("dst", F.hex("dst")))
    return _scans(reduce(DataFrame.unionByName, parts), query_threshold, saturated)


def _scans(q: DataFrame, query_threshold: int, saturated: int | None) -> DataFrame:
    # one row for each question and address first, so the distinct count is a plain one
    one = q.groupBy("key", "dst").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    out = one.groupBy("key").agg(F.count("*").alias("exact"), F.sum("n").alias("seen"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    full = F.lit(False) if saturated is None else F.col("exact") >= saturated
    return out.where(F.col("exact") > query_threshold).select(
        "key", F.when(full, F.lit(saturated)).otherwise(F.col("exact")).cast("long").alias("ip_count"), full.alias("saturated"), F.when(full, F.col("exact")).otherwise(0).cast("long").alias("approx"), "seen", "first_seen", "last_seen"
    )


def interval_records(port_counts: DataFrame, id_counts: DataFrame) -> DataFrame:
    """timestamp and the arrays udp, tcp and ipid, one row for each interval, for a JSON sink."""
    one = F.struct(F.col("port").alias("port"), F.col("seen_count").alias("seen_count"), F.col("ips_prob_count").alias("ips_prob_count"))
    of = lambda p: F.array_sort(F.collect_list(F.when(F.col("proto") == p, one)))
    a = port_counts.groupBy("interval_start").agg(of("udp").alias("udp"), of("tcp").alias("tcp"))
    b = id_counts.groupBy("interval_start").agg(F.array_sort(F.collect_list(F.struct("ipid", "seen_count", "ips_prob_count"))).alias("ipid"))
    return a.join(b, "interval_start", "full").select(F.unix_seconds(F.col("interval_start").cast("timestamp")).alias("timestamp"), "udp", "tcp", "ipid")
