"""Most frequent clients, prefixes and names in each interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..shared import written
from .filters import each_question, queries, to_addresses, usable, valid
from .resolver import asked_first, directions, listed


def ranked(counts: DataFrame, group: list[str], top: int, key: str = "key") -> DataFrame:
    """Adds ``rank`` by falling count within the group, ties by key; keeps ranks up to ``top``.

    The limit is a literal, so tasks hand in no more than so many rows of a group.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("n"), key)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ranked_all(counts: DataFrame, group: list[str], key: str = "key") -> DataFrame:
    """Adds ``rank`` by falling count within the group, ties by key, to every row.

    Rows are dealt by ranges of the whole order, so a group of any size is spread; a range
    ranks its own rows, and the numbers of rows in the ranges before it are added.  The
    ranges are written, as they are read twice and must be the same even if a task is lost.
    """
    order = [*group, F.desc("n"), key]
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(counts.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_part", *group).orderBy(F.desc("n"), key))
    sizes = parts.groupBy("_part", *group).agg(F.count("*").alias("_size"))  # as many rows as ranges and groups
    ahead = F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", *group, ahead.cast("int").alias("_ahead"))
    return parts.withColumn("_own", own).join(sizes, ["_part", *group]).withColumn("rank", F.col("_own") + F.col("_ahead")).drop("_part", "_own", "_ahead")


def query_popularity(
    dns: DataFrame, interval: str = "60 seconds", v4_dst: list[str] | None = None, top_individual_ip4: int = 100, top_individual_ip6: int = 100,
    top_pfx24_ip4: int = 25, top_pfx64_ip6: int = 25, top_qnames: int = 100, top_slds: int = 25,
) -> DataFrame:
    """interval_start, kind, rank, key, n, percent of the interval's queries of that IP version (of all for names).

    One pass: each query is counted once under its six keys, which are summed before the shuffle.
    """
    q = to_addresses(usable(queries(dns)), v4_dst or []).withColumn("interval_start", net.interval_start("ts", interval))
    limits = {"ip4": top_individual_ip4, "ip6": top_individual_ip6, "pfx24": top_pfx24_ip4, "pfx64": top_pfx64_ip6, "qname": top_qnames, "sld": top_slds}
    v4, v6 = F.col("ip_type") == 4, F.col("ip_type") == 6
    keys = {
        "ip4": F.when(v4, F.col("ip_src")), "pfx24": F.when(v4, net.ip4_prefix_text("src_v4", 24)), "ip6": F.when(v6, F.col("ip_src")),
        "pfx64": F.when(v6, net.ip6_prefix64_text("ip_src")), "qname": F.col("qname"), "sld": net.sld("qname"),
    }
    each = q.select("interval_start", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()))).alias("e"))
    counts = each.where("e.key is not null").groupBy("interval_start", "e.kind", "e.key").agg(F.count("*").alias("n"))
    # every query has one key of a kind, so the base is a count of queries, not a sum over all keys
    base = q.groupBy("interval_start").agg(F.count_if(v4).alias("v4"), F.count_if(v6).alias("v6"), F.count("*").alias("all"))
    # one ranking up to the largest limit, so the messages are read once for all kinds
    limit = reduce(lambda c, k: F.when(F.col("kind") == k, limits[k]).otherwise(c), limits, F.lit(0))
    best = ranked(counts, ["interval_start", "kind"], max(limits.values())).where(F.col("rank") <= limit)
    of = F.when(F.col("kind").isin("ip4", "pfx24"), F.col("v4")).when(F.col("kind").isin("ip6", "pfx64"), F.col("v6")).otherwise(F.col("all"))
    return best.join(base, "interval_start").select("interval_start", "kind", "rank", "key", "n", F.round(100 * F.col("n") / of, 2).alias("percent"))


def name_popularity(dns: DataFrame, interval: str, resolver_ips: list[str] | DataFrame, top: int | None = None) -> DataFrame:
    """interval_start, direction, rank, key, n: names asked by clients, asked by the resolver, and answered to it; all, or the first ``top``.

    Every question of a valid message counts, partial messages too; messages between two servers do not.
    """
    m, src, dst = listed(each_question(valid(dns)), resolver_ips)
    names = {"query_in": "client_query", "query_out": "resolver_query", "response_in": "server_response"}
    ways = directions(src, dst, asked_first(resolver_ips))
    m = m.select(net.interval_start("ts", interval).alias("interval_start"), "qname", F.explode(ways).alias("_way")).where(F.col("_way").isin(list(names)))
    way = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("_way")]
    counts = m.groupBy("interval_start", way.alias("direction"), F.col("qname").alias("key")).agg(F.count("*").alias("n"))
    group = ["interval_start", "direction"]
    return (ranked_all(counts, group) if top is None else ranked(counts, group, top)).select(*group, "rank", "key", "n")


def domain_count(dns: DataFrame, domain: str, interval: str = "300 seconds") -> DataFrame:
    """interval_start and number of whole queries whose first question is under one domain."""
    q = usable(queries(dns)).where(net.ends_with_any("qname", [domain], ignore_case=False))
    return q.groupBy(F.window("ts", interval)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("interval_start"), "n")


def top_series(counts: DataFrame, top: int, at: str = "interval_start", key: str = "key", value: str = "n") -> DataFrame:
    """Series of the keys with the largest totals, zero where a key has none, and of all other keys as 'other'."""
    best = counts.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(top).collect()
    name = F.col(key).cast("string")
    chosen = [str(r[0]) for r in best if r[0] is not None]
    summed = counts.groupBy(at, F.when(name.isin(chosen), name).otherwise("other").alias("key")).agg(F.sum(value).alias("n"))
    # as many rows as intervals and chosen keys
    every = counts.select(at).distinct().select(at, F.explode(F.array(*(F.lit(k) for k in (*chosen, "other")))).alias("key"))
    return every.join(summed, [at, "key"], "left").select(at, "key", F.coalesce("n", F.lit(0)).alias("n"))
