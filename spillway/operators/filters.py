"""Row filters on packets and messages; all push down to the scan where the columns are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net

#: Lists up to this many values become an IN list, longer ones a join.
INLINE = 200


def by_protocol(df: DataFrame, eth_type: int | None = None, ip_proto: int | None = None) -> DataFrame:
    if eth_type is not None:
        df = df.where(F.col("eth_type") == eth_type)
    return df if ip_proto is None else df.where(F.col("ip_proto") == ip_proto)


def by_ports(df: DataFrame, source: int = 0, destination: int = 0) -> DataFrame:
    """0 is any port."""
    if source:
        df = df.where(F.col("srcport") == source)
    return df.where(F.col("dstport") == destination) if destination else df


def by_icmp(df: DataFrame, types: list[tuple[int, int, int]]) -> DataFrame:
    """Keeps the given (ip_type, icmp_type, icmp_code)."""
    keep = F.lit(False)
    for version, kind, code in types:
        keep = keep | ((F.col("ip_type") == version) & (F.col("icmp_type") == kind) & (F.col("icmp_code") == code))
    return df.where(keep)


def is_dns(port: int = 53) -> Column:
    return (F.col("srcport") == port) | (F.col("dstport") == port)


def dns_relevant(df: DataFrame) -> DataFrame:
    """All ICMP, TCP and UDP with a DNS port, and every later fragment."""
    return df.where(F.col("ip_proto").isin(1, 58) | (F.col("ip_proto").isin(6, 17) & is_dns()) | (F.col("fragment_ofs") > 0))


def queries(df: DataFrame) -> DataFrame:
    return df.where(~F.col("qr"))


def responses(df: DataFrame) -> DataFrame:
    return df.where(F.col("qr"))


def valid(df: DataFrame) -> DataFrame:
    """Messages that could be read, whole or partial."""
    return df.where("is_valid")


def usable(df: DataFrame) -> DataFrame:
    """Valid, complete messages with a question."""
    return df.where(F.col("is_valid") & ~F.col("is_partial") & F.col("qname").isNotNull())


def each_question(df: DataFrame) -> DataFrame:
    """A row for each question of a message, with its qname, qtype and qclass.

    Messages without a list of questions have their first one in these columns; those
    without a question give no row.
    """
    if "questions" in df.columns:
        own = ("questions", "qname", "qtype", "qclass")
        rest = [c for c in df.columns if c not in own]
        df = df.select(*rest, F.explode("questions").alias("_q")).select(*rest, *(F.col("_q")[c].alias(c) for c in own[1:]))
    return df.where(F.col("qname").isNotNull())


def server_column() -> Column:
    """The server's address: destination of a query, source of a response."""
    return F.when(F.col("qr"), F.col("ip_src")).otherwise(F.col("ip_dst"))


def for_servers(df: DataFrame, servers: list[str] | DataFrame | None = None) -> DataFrame:
    """Messages to or from the given servers; none given, or '*' among them: all."""
    return _listed(df, server_column(), servers)


def _listed(df: DataFrame, column: Column, values: list[str] | DataFrame | None) -> DataFrame:
    if values is None or isinstance(values, list) and (not values or "*" in values):
        return df
    if isinstance(values, list) and len(values) <= INLINE:
        return df.where(column.isin(values))
    spark = df.sparkSession
    other = values if isinstance(values, DataFrame) else spark.createDataFrame([(v,) for v in values], "ip string")
    return df.join(other.select(F.col(other.columns[0]).alias("_listed")).distinct(), column == F.col("_listed"), "left_semi")


def to_addresses(df: DataFrame, addresses: list[str] | DataFrame | None) -> DataFrame:
    return _listed(df, F.col("ip_dst"), addresses)


def from_addresses(df: DataFrame, addresses: list[str] | DataFrame | None) -> DataFrame:
    return _listed(df, F.col("ip_src"), addresses)


def without(df: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drops messages whose source or destination is listed in the first column of ``ignored``."""
    one = ignored.select(F.col(ignored.columns[0]).alias("_ignored")).distinct()
    return df.join(one, F.col("ip_src") == F.col("_ignored"), "left_anti").join(one, F.col("ip_dst") == F.col("_ignored"), "left_anti")


def under_domains(df: DataFrame, suffixes: list[str], label_aligned: bool = False, ignore_case: bool = True) -> DataFrame:
    return df.where(net.ends_with_any("qname", suffixes, label_aligned, ignore_case))


def with_client_subnet(df: DataFrame, present: bool = True) -> DataFrame:
    return df.where(F.col("has_ecs") if present else ~F.col("has_ecs"))


def authoritative_answers(df: DataFrame) -> DataFrame:
    return df.where(F.col("qr") & F.col("aa") & (F.col("ans_count") > 0))


def dnskey_answers(df: DataFrame) -> DataFrame:
    return authoritative_answers(df).where((F.col("qtype") == net.DNSKEY) & (F.col("rcode") == 0))


def udp_ipv4(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_tcp") & (F.col("ip_type") == 4))


def by_predicate(df: DataFrame, predicate: str) -> DataFrame:
    """A filter written in SQL."""
    return df.where(F.expr(predicate))


def first_packets(df: DataFrame, packets: int = 0, seconds: float = 0) -> DataFrame:
    """At most so many packets in time order, and none later than so many seconds after the first; 0: no limit."""
    if seconds:
        start = df.agg(F.min("ts")).first()[0]
        df = df.where(F.col("ts") < F.lit(start) + F.make_dt_interval(secs=F.lit(float(seconds)))) if start else df
    return df.orderBy("ts").limit(packets) if packets else df
