"""DNS-shaped tables made from the given tables by expressions that Spark and DuckDB share.

Every column is written once, as SQL text that means the same in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import folder  # noqa: F401  (queries that write files use it)

_DERIVED = {
    "k": "cast(regexp_extract(props, '([0-9]+)', 1) as int)",
    "h": "(user_id * 40503) % 16777216",
}
_V4 = "concat('10.', cast(cast(floor(h / 65536.0) as bigint) as string), '.', cast(cast(floor(h / 256.0) as bigint) % 256 as string), '.', cast(h % 256 as string))"
_CLIENT = f"case when user_id % 5 = 0 then concat('2001:db8:1:', cast(h % 64 as string), '::', cast(h % 9000 + 1 as string)) else {_V4} end"
_SERVER = "case when user_id % 5 = 0 then '2001:db8:ffff::53' when event_id % 4 = 0 then '192.0.2.54' else '192.0.2.53' end"
_SHARED = {
    "feed_id": "concat('feed', cast(user_id % 3 as string))",
    "is_valid": "(event_id % 97) <> 0",
    "is_partial": "(event_id % 89) = 0",
    "ip_type": "case when user_id % 5 = 0 then 6 else 4 end",
    "query_id": "cast(event_id % 65536 as int)",
    "qname": "concat('h', cast(k as string), '.', event_type, '.example.')",
    "qclass": "case k when 99 then 3 when 88 then 2 when 87 then 4 when 86 then 255 when 85 then 0 when 84 then 77 else 1 end",
    # one in three asks for a type by k: 0 to 59, and the higher numbers in use
    "qtype": "case when event_id % 3 = 1 then case k when 90 then 99 when 91 then 249 when 92 then 250 when 93 then 251 when 94 then 252 when 95 then 257 when 96 then 32768 when 97 then 32769 else k % 60 end "
    "when event_type = 'view' then 1 when event_type = 'click' then 28 when event_type = 'purchase' then 15 when event_type = 'signup' then 48 else 255 end",
    "n_questions": "case when event_id % 83 = 0 then 0 when event_id % 50 = 0 then 2 else 1 end",
    "qtype2": "case when k % 2 = 0 then 6 else 0 end",
    "ans_type": "case when event_id % 3 <> 1 and event_type = 'signup' then 48 else case k % 5 when 0 then 5 when 1 then 46 when 2 then 257 when 3 then 4711 else 1 end end",
    "ra": "event_id % 5 = 0", "ad": "k % 6 = 0", "cd": "k % 9 = 0", "has_soa": "event_id % 3 = 0", "ns_first": "event_id % 3 = 1",
    "opcode": "case when k = 98 then 4 else 0 end",
    "is_tcp": "k % 20 = 0",
    "rd": "event_id % 2 = 0",
    "has_edns0": "event_id % 3 <> 0",
    "edns0_max_size": "case when event_id % 3 = 0 then 0 else case k % 5 when 0 then 512 when 1 then 1232 when 2 then 1500 when 3 then 4096 else 4500 end end",
    "edns0_do": "event_id % 3 <> 0 and k % 2 = 0",
    "has_ecs": "event_id % 3 <> 0 and k % 10 = 0",
    "has_exp_opt": "event_id % 3 <> 0 and k % 50 = 7",
}
QUERIES = {
    "seq": "event_id", "ts": "ts", "qr": "false", "ip_src": _CLIENT, "ip_dst": _SERVER,
    "src_v4": "case when user_id % 5 = 0 then null else 167772160 + h end",
    "dst_v4": "case when user_id % 5 = 0 then null when event_id % 4 = 0 then 3221226038 else 3221226037 end",
    "srcport": "cast(1024 + h % 60000 as int)", "dstport": "53", **_SHARED,
    "udp_len": "case when k % 20 = 0 then 0 else 40 + k end", "rcode": "0", "aa": "false", "tc": "false", "is_fragmented": "false",
    "ans_count": "0", "aut_count": "0", "add_count": "case when event_id % 3 <> 0 then 1 else 0 end",
}
_SIZE = "cast(100 + floor(value * 10) as int)"
RESPONSES = {
    "seq": "event_id + 1099511627776", "ts": "ts + k * interval '1' second", "qr": "true", "ip_src": _SERVER, "ip_dst": _CLIENT,
    "src_v4": "case when user_id % 5 = 0 then null when event_id % 4 = 0 then 3221226038 else 3221226037 end",
    "dst_v4": "case when user_id % 5 = 0 then null else 167772160 + h end",
    "srcport": "53", "dstport": "cast(1024 + h % 60000 as int)", **_SHARED,
    "udp_len": f"case when k % 20 = 0 then 0 else {_SIZE} end",
    "rcode": "case when k < 80 then 0 when k < 90 then 3 when k < 95 then 2 else 5 end", "aa": "k % 3 = 0", "tc": "k % 25 = 0",
    "is_fragmented": f"k % 20 <> 0 and {_SIZE} > 1500",
    "ans_count": "case when k < 80 and k % 7 <> 0 then k % 4 + 1 else 0 end", "aut_count": "case when k % 2 = 0 then 1 else 0 end", "add_count": "cast(event_id % 3 as int)",
}
RECORDS = {
    "msg_id": "l_orderkey", "ts": "o_orderdate", "section": "case when l_linenumber <= 3 then 'answer' when l_linenumber <= 5 then 'authority' else 'additional' end",
    "rr_pos": "l_linenumber", "rr_name": "concat('p', cast(l_partkey % 200 as string), '.example.')",
    "rr_type": "case when l_linenumber in (4, 5) then case when l_linestatus = 'O' then 6 else 2 end when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 46 else 28 end",
    "rr_class": "1", "ttl": "cast(l_quantity as int) * 60", "aa": "o_orderstatus = 'F'", "rcode": "case when l_orderkey % 11 = 0 then 3 else 0 end", "tc": "l_orderkey % 17 = 0",
}
_RECORD_ROWS = "l_orderkey % 5 <> 0 or l_linenumber > 3"
BLOCKS = {  # the order of blocks matters where they overlap
    "ord": "n_nationkey", "lo": "cast(167772160 + n_nationkey * 655360 as bigint)", "hi": "cast(167772160 + n_nationkey * 655360 + 131071 as bigint)", "descr": "n_name",
}
PREFIXES = {  # every fourth range encloses the next three
    "from_ip": "cast(167772160 + s_suppkey * 40000 as bigint)",
    "to_ip": "cast(167772160 + s_suppkey * 40000 + case when s_suppkey % 4 = 1 then 150000 else 20000 end as bigint)",
    "prefix": "case when s_suppkey % 4 = 1 then 14 else 17 end", "as_single": "concat('AS', cast(s_suppkey as string))", "as_full": "s_name",
}
COUNTRIES = {
    "from_ip": "cast(167772160 + n_nationkey * 671088 as bigint)", "to_ip": "cast(167772160 + n_nationkey * 671088 + 500000 as bigint)", "country": "n_name",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", *_select(_DERIVED))


def dns_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*_select(QUERIES))


def dns_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_id % 7 <> 0").selectExpr(*_select(RESPONSES))


def dns_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dns_queries(spark, sf_dir).unionByName(dns_responses(spark, sf_dir))


def dns_message_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dns_messages with lists of questions (none, one or two) and of answer records."""
    question = "named_struct('qname', qname, 'qtype', {}, 'qclass', {})"
    asked = f"slice(array({question.format('qtype', 'qclass')}, {question.format('qtype2', '1')}), 1, n_questions)"
    return dns_messages(spark, sf_dir).selectExpr("*", f"{asked} AS questions", "array_repeat(named_struct('name', qname, 'type', ans_type, 'class', qclass), ans_count) AS answers")


def dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).where(_RECORD_ROWS).selectExpr(*_select(RECORDS))


def cidr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*_select(BLOCKS)).unionByName(
        spark.range(1).selectExpr("1000 AS ord", "cast(167772160 AS bigint) AS lo", "cast(184549375 AS bigint) AS hi", "'ten' AS descr")
    )


def ip4_to_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*_select(PREFIXES))


def ip4_to_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*_select(COUNTRIES))


def _cte(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(_select(columns))} FROM {source}"


_EV = f"(SELECT *, {', '.join(_select(_DERIVED))} FROM events)"
SQL = {
    "q": _cte(QUERIES, _EV),
    "r": _cte(RESPONSES, _EV) + " WHERE event_id % 7 <> 0",
    "m": "SELECT * FROM q UNION ALL BY NAME SELECT * FROM r",
    "rr": _cte(RECORDS, "lineitem JOIN orders ON l_orderkey = o_orderkey") + f" WHERE {_RECORD_ROWS}",
    "blocks": _cte(BLOCKS, "nation") + " UNION ALL BY NAME SELECT 1000 AS ord, cast(167772160 AS bigint) AS lo, cast(184549375 AS bigint) AS hi, 'ten' AS descr",
    "asn": _cte(PREFIXES, "supplier"),
    "geo": _cte(COUNTRIES, "nation"),
}


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL with the named tables in front."""
    need = ["q", "r", "m"] if "m" in names else []
    need += [n for n in names if n not in need]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in need) + (", " + sql[5:].lstrip() if sql.lstrip()[:5].upper() == "WITH " else " " + sql)


def dns_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dns_queries over IPv4 and UDP as captured bytes: (ts, feed_id, caplen, data)."""
    from pyspark.sql import functions as F

    def h(c, size: int):
        return F.lpad(F.hex(c), size, "0")

    q = dns_queries(spark, sf_dir).where("ip_type = 4 and not is_tcp")
    labels = F.transform(F.split(F.rtrim(F.col("qname"), F.lit(".")), r"\."), lambda x: F.concat(h(F.octet_length(x), 2), F.hex(x)))
    option = F.concat(F.lit("000029"), h(F.col("edns0_max_size"), 4), F.lit("0000"), F.when(F.col("edns0_do"), "8000").otherwise("0000"), F.lit("0000"))
    dns = F.concat(
        h(F.col("query_id"), 4), F.when(F.col("rd"), "0100").otherwise("0000"), F.lit("000100000000"), F.when(F.col("has_edns0"), "0001").otherwise("0000"), F.array_join(labels, ""), F.lit("00"), h(F.col("qtype"), 4), h(F.col("qclass"), 4),
        F.when(F.col("has_edns0"), option).otherwise(""),
    )
    q = q.withColumn("dns", dns).withColumn("n", F.octet_length("dns").cast("int") / 2)
    n = F.col("n").cast("int")
    ip = F.concat(F.lit("4500"), h(n + 28, 4), h(F.col("seq") % 65536, 4), F.lit("000040110000"), h(F.col("src_v4"), 8), h(F.col("dst_v4"), 8))
    udp = F.concat(h(F.col("srcport"), 4), h(F.col("dstport"), 4), h(n + 8, 4), F.lit("0000"))
    data = F.unhex(F.concat(F.lit("020000000001020000000002" + "0800"), ip, udp, F.col("dns")))
    return q.select("ts", "feed_id", F.octet_length(data).alias("caplen"), data.alias("data"))


def dns_frames(spark: SparkSession, sf_dir: str, seq: bool = False) -> DataFrame:
    """All of dns_messages as captured bytes: IPv4 and IPv6 (every fourth with two extension headers), UDP and TCP, with answers.

    Names are written in upper case in every second message, and once in a message; other
    places point to it.  With ``seq`` that column stays, to join by.
    """
    from pyspark.sql import functions as F

    def h(c, size: int):
        c = F.expr(c) if isinstance(c, str) else c
        return F.lpad(F.hex(c.cast("long")), size, "0")

    def settled(df):
        # keeps long expressions from being written out once more for each of their uses
        return df.withColumn("_s", F.monotonically_increasing_id()).where("_s >= 0").drop("_s")

    lit, when = F.lit, F.when
    m = dns_messages(spark, sf_dir).withColumn("k", F.regexp_extract("qname", "^h([0-9]+)", 1).cast("int"))
    written = when(F.col("seq") % 2 == 1, F.upper("qname")).otherwise(F.col("qname"))
    labels = F.array_join(F.transform(F.split(F.rtrim(written, lit(".")), r"\."), lambda x: F.concat(h(F.octet_length(x), 2), F.hex(x))), "")
    m = settled(m.withColumn("name", F.concat(labels, lit("00"))))
    m = m.withColumn("owner", when(F.col("n_questions") == 0, F.col("name")).otherwise("C00C"))
    name, owner = F.col("name"), F.col("owner")
    bit = lambda c, n: F.shiftleft(F.col(c).cast("int"), n)
    flags = bit("qr", 15) + bit("opcode", 11) + bit("aa", 10) + bit("tc", 9) + bit("rd", 8) + bit("ra", 7) + bit("ad", 5) + bit("cd", 4) + F.col("rcode")
    question = F.concat(name, h("qtype", 4), h("qclass", 4))
    second = F.concat(lit("C00C"), h("qtype2", 4), lit("0001"))
    asked = when(F.col("n_questions") == 0, "").when(F.col("n_questions") == 1, question).otherwise(F.concat(question, second))

    def record(own, kind, klass, ttl, rdata):
        return F.concat(own, kind, klass, h(ttl, 8), h(F.octet_length(rdata) / 2, 4), rdata)

    key = F.concat(  # flags, protocol, algorithm, exponent in the short or the long form, modulus
        h(when(F.col("k") % 3 == 0, 257).otherwise(256), 4), lit("03"), h("case k % 4 when 0 then 5 when 1 then 8 when 2 then 10 else 13 end", 2),
        when(F.col("k") % 2 == 0, "03").otherwise("000003"), lit("010001"), F.repeat(lit("C3" * 8), F.col("k") % 5 + 1),
    )
    m = m.withColumn("rdata", when(F.col("ans_type") == 5, F.concat(lit("0178"), owner)).when(F.col("ans_type") == 1, F.concat(lit("0A0000"), h("k", 2))).when(F.col("ans_type") == 48, key).otherwise("ABCD"))
    kind = when(F.col("has_soa"), 6).when(F.col("ns_first"), 2).otherwise(16)
    m = m.withColumn("held", when(F.col("has_soa"), "ABCD").when(F.col("ns_first"), F.concat(lit("026E73"), owner)).otherwise("0268690162"))
    subnet = when(F.col("qr"), F.concat(lit("00080006" + "00011810" + "0A"), h("k", 2))).otherwise(F.concat(lit("00080007" + "00011800" + "0A"), h("k", 2), lit("07")))
    m = settled(m.withColumn("options", F.concat(when(F.col("has_ecs"), subnet).otherwise(""), when(F.col("has_exp_opt"), "FDE90000").otherwise(""))))
    options = F.col("options")
    answers = F.repeat(record(owner, h("ans_type", 4), h("qclass", 4), "60 + k", F.col("rdata")), F.col("ans_count"))
    authority = F.repeat(record(owner, h(kind, 4), lit("0001"), "3600", F.col("held")), F.col("aut_count"))
    opt = when(F.col("has_edns0"), F.concat(lit("000029"), h("edns0_max_size", 4), when(F.col("edns0_do"), "00008000").otherwise("00000000"), h(F.octet_length(options) / 2, 4), options)).otherwise("")
    dns = F.concat(h("query_id", 4), h(flags, 4), h("n_questions", 4), h("ans_count", 4), h("aut_count", 4), when(F.col("has_edns0"), "0001").otherwise("0000"), asked, answers, authority, opt)
    m = settled(m.withColumn("dns", dns))
    size = (F.octet_length("dns") / 2).cast("int")
    ports = F.concat(h("srcport", 4), h("dstport", 4))
    tcp = F.concat(ports, h("seq % 65536", 8), lit("00000007" + "5018" + "0400" + "00000000"), h(size, 4), F.col("dns"))
    m = settled(m.withColumn("segment", when(F.col("is_tcp"), tcp).otherwise(F.concat(ports, h(size + 8, 4), lit("0000"), F.col("dns")))))
    size = (F.octet_length("segment") / 2).cast("int")
    proto = when(F.col("is_tcp"), "06").otherwise("11")

    def six(c: str):
        part = lambda n: F.lpad(F.regexp_extract(c, "^2001:db8:1:([0-9]+)::([0-9]+)$", n), 4, "0")
        return when(F.col(c) == "2001:db8:ffff::53", "20010DB8FFFF00000000000000000053").otherwise(F.concat(lit("20010DB80001"), part(1), lit("0000" * 3), part(2)))

    chained = F.col("seq") % 4 == 0
    v4 = F.concat(lit("0800" + "4500"), h(size + 20, 4), h("seq % 65536", 4), lit("000040"), proto, lit("0000"), h("src_v4", 8), h("dst_v4", 8), F.col("segment"))
    chain = when(chained, F.concat(lit("3C00" + "00" * 6), proto, lit("00" * 7))).otherwise("")
    v6 = F.concat(lit("86DD" + "60000000"), h(size + when(chained, 16).otherwise(0), 4), when(chained, "00").otherwise(proto), lit("40"), six("ip_src"), six("ip_dst"), chain, F.col("segment"))
    data = F.unhex(F.concat(lit("020000000001020000000002"), when(F.col("ip_type") == 4, v4).otherwise(v6)))
    out = settled(m.select("seq", "ts", "feed_id", data.alias("data"))).select("*", F.octet_length("data").alias("caplen"))
    return out if seq else out.select("ts", "feed_id", "caplen", "data")


def icmp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dns_queries as ICMP messages of their senders: time exceeded in reassembly in every tenth, echoes otherwise."""
    from pyspark.sql import functions as F

    q = dns_queries(spark, sf_dir).where("ip_type = 4")
    kind = F.when(F.col("seq") % 10 == 0, "0B01").when(F.col("seq") % 10 == 1, "0B00").otherwise("0800")
    data = F.unhex(F.concat(F.lit("020000000001020000000002" + "0800" + "4500001C0001000040010000"), F.lpad(F.hex("src_v4"), 8, "0"), F.lpad(F.hex("dst_v4"), 8, "0"), kind, F.lit("00" * 6)))
    return q.select("ts", "feed_id", F.octet_length(data).alias("caplen"), data.alias("data"))


def fragment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The IPv4 frames of dns_frames over UDP, those with more than 48 bytes behind the IP header in fragments of 48, last ones first; every seventh lacks one."""
    from pyspark.sql import functions as F

    f = dns_frames(spark, sf_dir, seq=True).where("hex(substring(data, 13, 2)) = '0800' and hex(substring(data, 24, 1)) = '11'")
    f = f.withColumn("n", F.octet_length("data") - 34)
    f = f.select("*", F.posexplode(F.expr("sequence(0, cast((n - 1) div 48 as int))")).alias("_", "at")).where("n <= 48 or seq % 7 <> 0 or at > 0")
    last = F.expr("at = (n - 1) div 48")
    part = F.expr("substring(data, 35 + at * 48, 48)")
    bits = F.col("at") * 6 + F.when(last, 0).otherwise(8192)
    data = F.concat(F.expr("substring(data, 1, 16)"), F.unhex(F.lpad(F.hex(F.octet_length(part) + 20), 4, "0")), F.expr("substring(data, 19, 2)"), F.unhex(F.lpad(F.hex(bits.cast("long")), 4, "0")), F.expr("substring(data, 23, 12)"), part)
    ts = F.expr("ts - make_dt_interval(0, 0, 0, at * 0.001)")
    return f.select(ts.alias("ts"), "feed_id", data.alias("data")).select("ts", "feed_id", F.octet_length("data").alias("caplen"), "data")
