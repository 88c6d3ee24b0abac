"""What a resolver asks and is asked: directions, cache hits, outcomes, times to live, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from .filters import valid, without


#: Messages of one address that are joined in one task (about); those of more frequent addresses are dealt into parts.
PART_ROWS = 1_000_000


def listed(df: DataFrame, resolver_ips: list[str] | DataFrame) -> tuple[DataFrame, Column, Column]:
    """The messages, and whether their source and destination are resolvers; '*' is any address.

    A DataFrame's first column lists addresses in any number and is joined; a list becomes
    part of the expression.  Most messages have the same few servers, so addresses are
    counted first: the join deals a frequent one's messages (null is one, too) by parts, of
    which each finds its own copy of the address.
    """
    if not isinstance(resolver_ips, DataFrame):
        return df, *(F.lit(True) if "*" in resolver_ips else F.col(c).isin(resolver_ips) for c in ("ip_src", "ip_dst"))
    one = resolver_ips.select(F.col(resolver_ips.columns[0]).alias("_ip")).where("_ip is not null").distinct()
    counts = df.select(F.explode(F.array("ip_src", "ip_dst")).alias("_often")).groupBy("_often").agg(F.count("*").alias("_n"))
    # at most two rows for PART_ROWS messages
    often = F.broadcast(counts.where(F.col("_n") > PART_ROWS).select("_often", F.ceil(F.col("_n") / PART_ROWS).alias("_parts")))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))
    # null-safe here too, so that all three joins share one table of frequent addresses
    one = one.join(often, F.col("_ip").eqNullSafe(F.col("_often")), "left").select("_ip", copies.alias("_copy"))
    part = F.coalesce(F.pmod(F.xxhash64("ts", "ip_src", "ip_dst", "srcport", "dstport"), "_parts"), F.lit(0).cast("long"))
    for side in ("src", "dst"):
        ip = F.col(f"ip_{side}")
        df = df.join(often, ip.eqNullSafe(F.col("_often")), "left").withColumn("_part", part).drop("_often", "_parts")
        copy = one.select(F.col("_ip").alias(f"_is_{side}"), "_copy")
        df = df.join(copy, (ip == F.col(f"_is_{side}")) & (F.col("_part") == F.col("_copy")), "left").drop("_part", "_copy")
    return df, F.col("_is_src").isNotNull(), F.col("_is_dst").isNotNull()


def asked_first(resolver_ips: list[str] | DataFrame) -> Column:
    """Whether a list has the source before the destination; a table has no order, so never there."""
    if isinstance(resolver_ips, DataFrame):
        return F.lit(False)
    place = lambda c: F.array_position(F.array(*map(F.lit, resolver_ips)), F.col(c)) if resolver_ips else F.lit(0)
    any_ = resolver_ips.index("*") + 1 if "*" in resolver_ips else None
    own = F.when(place("ip_dst") > 0, place("ip_dst"))
    return (place("ip_src") > 0) & (place("ip_src") < F.coalesce(F.least(own, F.lit(any_)), F.lit(0)))


def directions(src: Column, dst: Column, first: Column) -> Column:
    """An array of query_in, response_out (client side), query_out, response_in (server side); empty for other messages.

    A response from one listed address to another is both in and out.  A query is in, and
    also out only if the list has its source before its destination (``first``).  Messages
    between two servers (both ports 53) have no direction.
    """
    asks, answers = (F.col("dstport") == 53) & (F.col("srcport") != 53), (F.col("srcport") == 53) & (F.col("dstport") != 53)
    q, r = ~F.col("qr") & asks, F.col("qr") & answers
    ways = {"query_in": q & dst, "query_out": q & src & (~dst | first), "response_in": r & dst, "response_out": r & src}
    return F.array_compact(F.array(*(F.when(where, F.lit(way)) for way, where in ways.items())))


def resolver_counters(dns: DataFrame, resolver_ips: list[str] | DataFrame, ignore_ips: DataFrame | None = None, interval: str = "60 seconds") -> DataFrame:
    """One row for each interval over valid messages, with the cache hit ratio: 100 less the authoritative answers fetched for 100 client queries; null without queries."""
    m, src, dst = listed(valid(dns if ignore_ips is None else without(dns, ignore_ips)), resolver_ips)
    ways = directions(src, dst, asked_first(resolver_ips))
    m = m.withColumns({"_ways": ways, "interval_start": net.interval_start("ts", interval)}).where(F.size("_ways") > 0)
    is_ = lambda d: F.array_contains("_ways", d)
    out = m.groupBy("interval_start").agg(
        *(F.count_if(is_(d)).alias(name) for d, name in (("query_in", "queries_in"), ("query_out", "queries_out"), ("response_in", "responses_in"), ("response_out", "responses_out"))),
        F.count_if(is_("response_in") & F.col("aa")).alias("authoritative_in"), F.count_if(is_("response_in") & F.col("is_fragmented")).alias("fragments_in"), F.count_if(is_("response_in") & F.col("tc")).alias("truncated_in"),
    )
    return out.withColumn("cache_hit_ratio", F.round(100 - F.try_divide(100 * F.col("authoritative_in"), F.col("queries_in")), 2))


def message_flags(records: DataFrame) -> DataFrame:
    """One row for each message of ``records``: sections' counts, whether the authority section has SOA or NS, which stands first, and signatures."""
    sec = lambda s: F.col("section") == s
    auth = sec("authority") & F.col("rr_type").isin(net.SOA, net.NS)
    return records.groupBy("msg_id").agg(
        F.min("ts").alias("ts"), F.first("aa").alias("aa"), F.first("rcode").alias("rcode"), F.first("tc").alias("tc"),
        F.count_if(sec("answer")).alias("ans_count"), F.max(sec("authority") & (F.col("rr_type") == net.SOA)).alias("has_soa"), F.max(sec("authority") & (F.col("rr_type") == net.NS)).alias("has_ns"),
        F.coalesce(F.min(F.when(auth, F.struct("rr_pos", "rr_type")))["rr_type"] == net.NS, F.lit(False)).alias("ns_first"),
        *(F.count_if(sec(s) & (F.col("rr_type") == net.RRSIG)).alias(f"rrsig_{s}") for s in ("answer", "authority", "additional")),
    )


def outcomes(messages: DataFrame, dialect: str, interval: str = "60 seconds") -> DataFrame:
    """interval_start, label, n of responses with the columns of message_flags."""
    return messages.groupBy(net.interval_start("ts", interval).alias("interval_start"), net.rcode_label(dialect).alias("label")).agg(F.count("*").alias("n"))


def first_ttls(records: DataFrame, interval: str = "60 seconds", tags: bool = True) -> DataFrame:
    """interval_start, tag, rr_name, ttl: the time to live first seen for an owner name, by section and type and over all ('ALL')."""
    r = records.withColumn("interval_start", net.interval_start("ts", interval))
    tag = F.concat_ws("_", "section", net.qtype_name("rr_type"))
    first = F.min(F.struct("ts", "msg_id", "rr_pos", "ttl")).alias("first")
    ttl = F.col("first.ttl").alias("ttl")
    if not tags:
        return r.groupBy("interval_start", F.lit("ALL").alias("tag"), "rr_name").agg(first).select("interval_start", "tag", "rr_name", ttl)
    # the first over all tags is the first of the tags' firsts, so no record is counted twice before it is dealt
    by_tag = r.groupBy("interval_start", tag.alias("tag"), "rr_name").agg(first)
    over_all = by_tag.groupBy("interval_start", "rr_name").agg(F.min("first").alias("first")).select("interval_start", F.lit("ALL").alias("tag"), "rr_name", ttl)
    return by_tag.select("interval_start", "tag", "rr_name", ttl).unionByName(over_all)


def ttl_distribution(ttls: DataFrame) -> DataFrame:
    """interval_start, tag, ttl, n, cdf, with a row 0, 0, 0 in front of each table."""
    counts = ttls.groupBy("interval_start", "tag", F.col("ttl").cast("int").alias("ttl")).agg(F.count("*").alias("n"))
    own = F.struct("ttl", "n")
    zero = F.struct(F.lit(0).alias("ttl"), F.lit(0).cast("long").alias("n"))
    placed = counts.withColumn("_place", F.row_number().over(Window.partitionBy("interval_start", "tag").orderBy("ttl")))
    rows = F.when(F.col("_place") == 1, F.array(zero, own)).otherwise(F.array(own))
    both = placed.select("interval_start", "tag", F.explode(rows).alias("e")).select("interval_start", "tag", "e.ttl", "e.n")
    w = Window.partitionBy("interval_start", "tag")
    run = w.orderBy("ttl", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("cdf", F.round(F.sum("n").over(run) / F.sum("n").over(w), 6))


def signatures_per_response(messages: DataFrame, interval: str = "60 seconds") -> DataFrame:
    """interval_start, signatures, responses: how many responses have how many RRSIG records."""
    n = F.col("rrsig_answer") + F.col("rrsig_authority") + F.col("rrsig_additional")
    return messages.groupBy(net.interval_start("ts", interval).alias("interval_start"), n.alias("signatures")).agg(F.count("*").alias("responses"))


def signature_totals(messages: DataFrame, interval: str = "60 seconds") -> DataFrame:
    """Totals of RRSIG records by section, of authoritative messages, of signed and of truncated signed responses."""
    n = F.col("rrsig_answer") + F.col("rrsig_authority") + F.col("rrsig_additional")
    return messages.groupBy(net.interval_start("ts", interval).alias("interval_start")).agg(
        *(F.sum(f"rrsig_{s}").cast("long").alias(f"rrsig_{s}") for s in ("answer", "authority", "additional")), F.coalesce(F.sum(F.when(F.col("aa"), n)), F.lit(0)).cast("long").alias("rrsig_authoritative"),
        F.count_if(n > 0).alias("signed_responses"), F.count_if((n > 0) & F.col("tc")).alias("signed_truncated"),
    )
