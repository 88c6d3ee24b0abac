"""Queries paired with their responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net

KEY = ("client", "qname", "qclass", "qtype", "client_port", "query_id")


def keyed(dns: DataFrame) -> DataFrame:
    """Adds the client's address and port: source of a query, destination of a response."""
    return dns.withColumns(
        {
            "client": F.when(F.col("qr"), F.col("ip_dst")).otherwise(F.col("ip_src")),
            "client_port": F.when(F.col("qr"), F.col("dstport")).otherwise(F.col("srcport")),
        }
    )


def match_qr(dns: DataFrame, timeout_seconds: float = 30, carry: tuple[str, ...] = ("udp_len",)) -> DataFrame:
    """One row for each response that answers a query: the key, query_ts, response_ts, and q_ and r_ forms of ``carry``.

    A repeated query takes the place of the stored one and a response uses it up, so a
    response has a partner exactly if the message before it, in its key, is a query.
    Messages at one time are taken in the order of ``seq``.
    """
    w = Window.partitionBy(*KEY).orderBy("ts", "seq")
    before = F.lag(F.struct("qr", "ts", *carry)).over(w)
    m = keyed(dns).select(*KEY, "qr", "ts", "seq", *carry).withColumn("_before", before)
    gap = F.col("ts").cast("timestamp").cast("double") - F.col("_before.ts").cast("timestamp").cast("double")
    m = m.where(F.col("qr") & ~F.col("_before.qr") & (gap <= timeout_seconds))
    return m.select(*KEY, F.col("_before.ts").alias("query_ts"), F.col("ts").alias("response_ts"), *(c for x in carry for c in (F.col(f"_before.{x}").alias(f"q_{x}"), F.col(x).alias(f"r_{x}"))))


def unmatched(dns: DataFrame) -> DataFrame:
    """kind and n: repeated queries, responses without a query, queries without a response."""
    w = Window.partitionBy(*KEY).orderBy("ts", "seq")
    m = keyed(dns).select(*KEY, "qr", F.lag("qr").over(w).alias("_before"), F.lead("qr").over(w).alias("_after"))
    kind: Column = F.when(~F.col("qr") & ~F.col("_before"), "repeated_query").when(F.col("qr") & (F.col("_before").isNull() | F.col("_before")), "response_alone")
    counted = m.select(F.explode(F.array_compact(F.array(kind, F.when(~F.col("qr") & F.coalesce(~F.col("_after"), F.lit(True)), "query_alone")))).alias("kind"))
    return counted.groupBy("kind").agg(F.count("*").alias("n"))


def size_distribution(pairs: DataFrame, interval: str = "1 hour", max_qsize: int = 1500, max_rsize: int = 4096) -> DataFrame:
    """interval_start, qsize, rsize, n of pairs within both limits (a sparse matrix)."""
    p = pairs.where(F.col("q_udp_len").between(1, max_qsize) & F.col("r_udp_len").between(1, max_rsize))
    return p.groupBy(net.interval_start("query_ts", interval).alias("interval_start"), F.col("q_udp_len").alias("qsize"), F.col("r_udp_len").alias("rsize")).agg(F.count("*").alias("n"))


def oversize(pairs: DataFrame, interval: str = "1 hour", max_qsize: int = 1500, max_rsize: int = 4096) -> DataFrame:
    """interval_start, pairs, oversize_queries, oversize_responses."""
    return pairs.groupBy(net.interval_start("query_ts", interval).alias("interval_start")).agg(
        F.count("*").alias("pairs"), F.count_if(F.col("q_udp_len") > max_qsize).alias("oversize_queries"), F.count_if(F.col("r_udp_len") > max_rsize).alias("oversize_responses")
    )
