"""Distinct names and clients: exact counts, and mergeable sketches of 2^14 registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from .filters import from_addresses, queries, to_addresses, usable

REGISTERS = 14


def hll_init_add(column: Column | str) -> Column:
    """Aggregate: a sketch of a column's distinct values."""
    return F.hll_sketch_agg(column, REGISTERS)


def hll_count(sketch: Column | str) -> Column:
    return F.hll_sketch_estimate(sketch)


def hll_merge(sketch: Column | str) -> Column:
    """Aggregate: the union of sketches."""
    return F.hll_union_agg(sketch)


def _prefixes() -> Column:
    v4 = F.array(*(net.ip4_prefix_text("src_v4", n) for n in (24, 20, 16)))
    return F.when(F.col("ip_type") == 4, v4).otherwise(F.array(net.ip6_prefix64_text("ip_src")))


def names_by_prefix(dns: DataFrame, destinations: list[str] | None = None, interval: str = "1 hour", exact: bool = False) -> DataFrame:
    """interval_start, prefix and distinct names of each client prefix (/24, /20, /16; v6 /64): ``names`` if exact, else ``sketch``."""
    q = to_addresses(usable(queries(dns)), destinations or [])
    each = q.select(net.interval_start("ts", interval).alias("interval_start"), F.explode(_prefixes()).alias("prefix"), "qname")
    agg = F.count_distinct("qname").alias("names") if exact else hll_init_add("qname").alias("sketch")
    return each.groupBy("interval_start", "prefix").agg(agg)


def merged_names(hourly: DataFrame, interval: str = "1 day") -> DataFrame:
    """Longer intervals' distinct names from the sketches of shorter ones."""
    return hourly.groupBy(net.interval_start("interval_start", interval).alias("interval_start"), "prefix").agg(hll_count(hll_merge("sketch")).alias("names"))


def global_names(dns: DataFrame, destinations: list[str] | None = None, interval: str = "1 hour", exact: bool = False) -> DataFrame:
    """One row for each interval: queries, distinct names, (prefix:name) pairs, and names with their parent suffixes."""
    q = to_addresses(usable(queries(dns)), destinations or []).withColumn("interval_start", net.interval_start("ts", interval))
    count = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, 0.0087)
    names = q.groupBy("interval_start").agg(F.count("*").alias("queries"), count(F.col("qname")).alias("names"))
    pairs = q.select("interval_start", F.explode(_prefixes()).alias("prefix"), "qname").groupBy("interval_start").agg(count(F.concat_ws(":", "prefix", "qname")).alias("prefix_names"))
    labels = q.select("interval_start", F.explode(net.parent_suffixes("qname")).alias("suffix")).groupBy("interval_start").agg(count(F.col("suffix")).alias("suffixes"))
    return names.join(pairs, "interval_start", "left").join(labels, "interval_start", "left")


def unique_clients(dns: DataFrame, server_ips: list[str] | None = None, measure_direction: int = 0) -> DataFrame:
    """period (hour, day, week from Monday), interval_start, distinct addresses and messages, in all and by IP version.

    Only queries count: measure_direction 0 takes the sources of those to the servers, 1 the
    destinations of those from them; without servers all.
    """
    inward = measure_direction == 0
    m = (to_addresses if inward else from_addresses)(queries(dns), server_ips)
    starts = F.array(
        *(F.struct(F.lit(p).alias("period"), F.date_trunc(p, "ts").cast(m.schema["ts"].dataType).alias("interval_start")) for p in ("hour", "day", "week"))
    )
    client = F.col("ip_src" if inward else "ip_dst")
    # one row for each client and period first: distinct counts become plain ones, and busy clients shrink before the shuffle
    per_client = m.select(starts.alias("s"), "ip_type", client.alias("client")).select(F.explode("s").alias("s"), "ip_type", "client")
    per_client = per_client.groupBy("s.period", "s.interval_start", "ip_type", "client").agg(F.count("*").alias("n"))
    v = lambda k: F.col("ip_type") == k
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return per_client.groupBy("period", "interval_start").agg(
        F.count("*").alias("clients"), F.sum("n").alias("messages"), F.count_if(v(4)).alias("clients_v4"), zero(F.sum(F.when(v(4), F.col("n")))).alias("messages_v4"),
        F.count_if(v(6)).alias("clients_v6"), zero(F.sum(F.when(v(6), F.col("n")))).alias("messages_v6"),
    )
