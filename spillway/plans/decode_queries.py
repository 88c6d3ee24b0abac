"""Registered queries that take captured bytes apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import sinks
from ..functions import net
from ..operators import darknet, decode, enrich, filters, popularity, reassembly, traffic
from ..shared import written
from ..sources import pcap, splits, tables
from .sql import DAY, query

_PACKETS = "ip_type = 4 AND NOT is_tcp"


@query(
    f"SELECT ts, ip_src, ip_dst, srcport, dstport, query_id, rd, qname, qtype, qclass, has_edns0, CASE WHEN has_edns0 THEN edns0_max_size END AS edns0_max_size, edns0_do, CAST(seq % 65536 AS INTEGER) AS ip_id FROM q WHERE {_PACKETS}", "q"
)
def decoded_queries(spark, d):
    m = decode.decode_dns(decode.decode_packets(fx.dns_packets(spark, d)))
    return m.select("ts", "ip_src", "ip_dst", "srcport", "dstport", "query_id", "rd", "qname", "qtype", "qclass", "has_edns0", "edns0_max_size", "edns0_do", "ip_id")


@query(f"SELECT ip_src, count(*) AS packets, sum(42 + 12 + length(qname) + 1 + 4 + CASE WHEN has_edns0 THEN 11 ELSE 0 END)::BIGINT AS bytes FROM q WHERE {_PACKETS} GROUP BY 1", "q")
def decoded_packet_sizes(spark, d):
    p = filters.dns_relevant(decode.decode_packets(fx.dns_packets(spark, d)))
    return p.groupBy("ip_src").agg(F.count("*").alias("packets"), F.sum("caplen").cast("long").alias("bytes"))


@query(f"SELECT {DAY} AS interval_start, count(*) AS n FROM q WHERE {_PACKETS} AND qname LIKE '%error.example.' GROUP BY 1", "q")
def decoded_domain_count(spark, d):
    """Captured bytes to an interval report in one plan."""
    return popularity.domain_count(decode.decode_dns(decode.decode_packets(fx.dns_packets(spark, d)), sections=()), "error.example.", "1 day")


@query(
    f"""SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, epoch_us(ts) / 1000000 AS timestamp, ip_src AS client_ip, CAST(seq % 65536 AS INTEGER) AS ip_ipid, 64 AS ip_ttl, srcport AS udp_srcport, query_id AS dns_qid, qtype AS dns_qtype, qclass AS dns_qclass,
  qname AS dns_qname, CAST(has_edns0 AS INTEGER) AS dns_edns0, CAST(edns0_do AS INTEGER) AS dns_edns0_do, edns0_max_size AS dns_edns0_maxsize FROM q WHERE {_PACKETS}""",
    "q",
)
def decoded_denat_queries(spark, d):
    return sinks.denat_queries(decode.decode_dns(decode.decode_packets(fx.dns_packets(spark, d))))


# --- all messages: both IP versions, both transports, answers -------------------------------

# the shortest form of an address that is written with a zero group
_SHORT = "replace({}, ':1:0::', ':1::')"
_NAME = "CASE WHEN seq % 2 = 1 THEN upper(qname) ELSE qname END"
_TEXT = f"CASE WHEN n_questions = 0 THEN NULL ELSE {_NAME} END"


@query(f"SELECT ts, {_SHORT.format('ip_src')} AS ip_src, CASE WHEN is_tcp THEN 6 ELSE 17 END AS ip_proto FROM m WHERE ip_type = 6 AND seq % 4 <> 0 AND NOT is_tcp", "m")
def decoded_by_protocol(spark, d):
    """Only IPv6 packets that carry UDP."""
    p = filters.by_protocol(decode.decode_packets(fx.dns_frames(spark, d, seq=True)), eth_type=0x86DD, ip_proto=17)
    return p.where("seq % 4 <> 0").select("ts", "ip_src", "ip_proto")


def _messages(spark, d, **options):
    return decode.decode_dns(decode.decode_packets(fx.dns_frames(spark, d)), **options)


@query(
    f"""SELECT ts, {_SHORT.format('ip_src')} AS ip_src, {_SHORT.format('ip_dst')} AS ip_dst, ip_type, srcport, dstport, is_tcp, CASE WHEN is_tcp THEN 17 + 3 ELSE 0 END AS tcp_header, qr, opcode, aa, tc, rd, ra, ad, cd, rcode, query_id,
  {_TEXT} AS qname, CASE WHEN n_questions > 0 THEN qtype END AS qtype, CASE WHEN n_questions > 0 THEN qclass END AS qclass, n_questions, ans_count, aut_count, has_edns0, CASE WHEN has_edns0 THEN edns0_max_size END AS edns0_max_size, edns0_do, has_exp_opt, has_ecs,
  CASE WHEN has_ecs THEN 24 END AS ecs_src_scope, CASE WHEN has_ecs AND qr THEN 16 WHEN has_ecs THEN 0 END AS ecs_res_scope,
  CASE WHEN has_ecs AND qr THEN '10.' || CAST(regexp_extract(qname, '^h([0-9]+)', 1) AS INTEGER) || '.0.0' WHEN has_ecs THEN '10.' || CAST(regexp_extract(qname, '^h([0-9]+)', 1) AS INTEGER) || '.7.0' END AS ecs_ip FROM m""",
    "m",
)
def decoded_messages(spark, d):
    m = _messages(spark, d)
    return m.select(
        "ts", "ip_src", "ip_dst", "ip_type", "srcport", "dstport", "is_tcp", F.when(F.col("is_tcp"), F.lit(20)).otherwise(0).alias("tcp_header"), "qr", "opcode", "aa", "tc", "rd", "ra", "ad", "cd", "rcode", "query_id", "qname", "qtype", "qclass",
        F.size("questions").alias("n_questions"), F.size("answers").alias("ans_count"), F.size("authorities").alias("aut_count"), "has_edns0", "edns0_max_size", "edns0_do", "has_exp_opt", "has_ecs", "ecs_src_scope", "ecs_res_scope", "ecs_ip",
    )


@query(
    f"""SELECT ts, '02:00:00:00:00:01' AS eth_dst, '02:00:00:00:00:02' AS eth_src, CASE WHEN ip_type = 4 THEN 2048 ELSE 34525 END AS eth_type, 64 AS ttl, CASE WHEN is_tcp THEN 6 ELSE 17 END AS ip_proto,
  CASE WHEN ip_type = 4 THEN CAST(seq % 65536 AS INTEGER) END AS ip_id, CASE WHEN is_tcp THEN seq % 65536 END AS tcp_seq, CASE WHEN is_tcp THEN 7 END AS tcp_ack, CASE WHEN is_tcp THEN 24 END AS tcp_flags, CASE WHEN is_tcp THEN 1024 END AS tcp_window,
  CASE WHEN ip_type = 6 THEN concat('20010db8', CASE WHEN qr THEN 'ffff00000000000000000053' ELSE '0001' || lpad(regexp_extract(ip_src, '^2001:db8:1:([0-9]+)', 1), 4, '0') || '000000000000' || lpad(regexp_extract(ip_src, '::([0-9]+)$', 1), 4, '0') END)
    ELSE lower(printf('%08X', src_v4)) END AS src_hex FROM m""",
    "m",
)
def decoded_headers(spark, d):
    p = filters.by_protocol(decode.decode_packets(fx.dns_frames(spark, d)).where(F.col("ip_proto").isin(6, 17)))
    return p.select("ts", "eth_dst", "eth_src", "eth_type", "ttl", "ip_proto", "ip_id", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", net.hex_text("src_addr").alias("src_hex"))


_K = "CAST(regexp_extract(qname, '^h([0-9]+)', 1) AS INTEGER)"
_KEY_SIZE = f"CASE WHEN {_K} % 2 = 0 THEN 8 ELSE 10 END + 8 * ({_K} % 5 + 1)"
_RR = f"""rrs AS (
  SELECT seq, ts, qr, 'answer' AS section, CAST(p AS INTEGER) AS pos, {_NAME} AS name, ans_type AS type, qclass AS class, 60 + {_K} AS ttl,
    CASE ans_type WHEN 5 THEN 'x.' || {_NAME} WHEN 1 THEN '10.0.0.' || {_K} WHEN 48 THEN ({_KEY_SIZE}) || ' bytes unparsed RDATA' ELSE '2 bytes unparsed RDATA' END AS rdata_txt FROM m, unnest(range(ans_count)) AS t(p)
  UNION ALL SELECT seq, ts, qr, 'authority', 0, {_NAME}, CASE WHEN has_soa THEN 6 WHEN ns_first THEN 2 ELSE 16 END, 1, 3600,
    CASE WHEN has_soa THEN '2 bytes unparsed RDATA' WHEN ns_first THEN 'ns.' || {_NAME} ELSE 'hi' || chr(10) || 'b' END FROM m WHERE aut_count > 0)"""


@query(f"WITH {_RR} SELECT ts, qr, section, pos, name, type, class, ttl, rdata_txt FROM rrs", "m")
def decoded_records(spark, d):
    m = _messages(spark, d, sections=("answers", "authorities", "edns0"))

    def entries(column, section):
        return F.transform(column, lambda r, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), *(r[c].alias(c) for c in ("name", "type", "class", "ttl", "rdata_txt"))))

    # both lists as one, so that messages are decoded once
    return m.select("ts", "qr", F.explode(F.concat(entries("answers", "answer"), entries("authorities", "authority"))).alias("r")).select("ts", "qr", "r.*")


@query("SELECT ts, qr, qname, qtype FROM m WHERE n_questions > 0", "m")
def decoded_names_in_lower_case(spark, d):
    return _messages(spark, d, sections=(), lower=True).where("qname is not null").select("ts", "qr", "qname", "qtype")


@query(f"SELECT {DAY} AS interval_start, ip_src, count(*) AS n FROM q WHERE ip_type = 4 AND seq % 10 = 0 GROUP BY ALL", "q")
def decoded_reassembly_timeouts(spark, d):
    return traffic.reassembly_timeouts(decode.decode_packets(fx.icmp_frames(spark, d)), "1 day")


# lengths of whole messages in bytes, by hand: header, questions, answers, authority record, OPT
_OWN = "CASE WHEN n_questions = 0 THEN length(qname) + 1 ELSE 2 END"
_LENGTH = f"""(12 + CASE n_questions WHEN 0 THEN 0 WHEN 1 THEN length(qname) + 5 ELSE length(qname) + 11 END
  + ans_count * ({_OWN} + 10 + CASE ans_type WHEN 5 THEN 2 + {_OWN} WHEN 1 THEN 4 WHEN 48 THEN {_KEY_SIZE} ELSE 2 END)
  + aut_count * ({_OWN} + 10 + CASE WHEN has_soa THEN 2 WHEN ns_first THEN 3 + {_OWN} ELSE 5 END)
  + CASE WHEN has_edns0 THEN 11 + CASE WHEN has_ecs AND qr THEN 10 WHEN has_ecs THEN 11 ELSE 0 END + CASE WHEN has_exp_opt THEN 4 ELSE 0 END ELSE 0 END)"""


@query(f"SELECT ip_src, ip_dst, query_id, qr, {_TEXT} AS qname, ans_count, {_LENGTH} + 8 AS udp_len, {_LENGTH} + 8 > 48 AS is_reassembled FROM m WHERE ip_type = 4 AND NOT is_tcp AND ({_LENGTH} + 8 <= 48 OR seq % 7 <> 0)", "m")
def decoded_fragments(spark, d):
    """Fragments, last ones first, put together and decoded; packets with a fragment missing do not come out."""
    whole = reassembly.reassemble(decode.internet(decode.ethernet(fx.fragment_frames(spark, d))))
    m = decode.decode_dns(decode.transport(whole), sections=("answers", "edns0"))
    return m.select("ip_src", "ip_dst", "query_id", "qr", "qname", F.size("answers").alias("ans_count"), "udp_len", "is_reassembled")


@query(
    f"""WITH {_RR} SELECT CAST(rrs.ts AS DATE) AS date, name AS fqdn, CASE WHEN {_K} % 3 = 0 THEN 257 ELSE 256 END AS flags, 3 AS protocol, CASE {_K} % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 10 END AS algorithm, 64 * ({_K} % 5 + 1) AS bitsize,
  repeat('c3', 8 * ({_K} % 5 + 1)) AS n, '010001' AS e FROM rrs JOIN m USING (seq) WHERE section = 'answer' AND type = 48 AND m.qr AND m.aa AND m.qtype = 48 AND n_questions > 0 AND rcode = 0 AND {_K} % 4 <> 3""",
    "m",
)
def decoded_dnskeys(spark, d):
    return sinks.dnskey_log(_messages(spark, d))


_CLASS = "CASE {} WHEN 1 THEN 'IN' WHEN 2 THEN 'CS' WHEN 3 THEN 'CH' WHEN 4 THEN 'HS' WHEN 255 THEN 'ANY' WHEN 0 THEN 'UNSPECIFIED' ELSE 'UNKNOWN' END"
_KIND = (
    "CASE {} WHEN 0 THEN 'UNSPECIFIED' WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 5 THEN 'CNAME' WHEN 6 THEN 'SOA' WHEN 12 THEN 'PTR' WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT' WHEN 17 THEN 'RP' WHEN 18 THEN 'AFSDB' WHEN 24 THEN 'SIG' WHEN 25 THEN 'KEY' "
    "WHEN 28 THEN 'AAAA' WHEN 29 THEN 'LOC' WHEN 33 THEN 'SRV' WHEN 35 THEN 'NAPTR' WHEN 36 THEN 'KX' WHEN 37 THEN 'CERT' WHEN 39 THEN 'DNAME' WHEN 41 THEN 'OPT' WHEN 42 THEN 'APL' WHEN 43 THEN 'DS' WHEN 44 THEN 'SSHFP' WHEN 45 THEN 'IPSECKEY' "
    "WHEN 46 THEN 'RRSIG' WHEN 47 THEN 'NSEC' WHEN 48 THEN 'DNSKEY' WHEN 49 THEN 'DHCID' WHEN 50 THEN 'NSEC3' WHEN 51 THEN 'NSEC3PARAM' WHEN 52 THEN 'TLSA' WHEN 55 THEN 'HIP' WHEN 99 THEN 'SPF' WHEN 249 THEN 'TKEY' WHEN 250 THEN 'TSIG' "
    "WHEN 251 THEN 'IXFR' WHEN 252 THEN 'AXFR' WHEN 255 THEN 'ANY' WHEN 257 THEN 'CAA' WHEN 32768 THEN 'TA' WHEN 32769 THEN 'DLV' ELSE 'UNKNOWN' END"
)
_RCODE = "CASE rcode WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'NXDOMAIN' WHEN 4 THEN 'NOTIMPL' WHEN 5 THEN 'REFUSED' ELSE 'UNKNOWN' END"


@query(
    f"""WITH {_RR}, e AS (
  SELECT seq, CASE WHEN qr THEN 'Q(R)' ELSE 'Q(Q)' END AS part, 0 AS pos, qclass AS c, qtype AS t, {_NAME} AS name FROM m WHERE n_questions > 0
  UNION ALL SELECT seq, CASE WHEN qr THEN 'Q(R)' ELSE 'Q(Q)' END, 1, 1, qtype2, {_NAME} FROM m WHERE n_questions > 1
  UNION ALL SELECT seq, CASE section WHEN 'answer' THEN 'R(ANS)' ELSE 'R(AUT)' END, pos, class, type, rdata_txt FROM rrs WHERE qr
  UNION ALL SELECT seq, 'R(ADD)', 0, edns0_max_size, 41, 'EDNS version 0, advertised buffer size ' || edns0_max_size || ' bytes, extended RCODE 0, ' || (CASE WHEN has_ecs THEN 10 ELSE 0 END + CASE WHEN has_exp_opt THEN 4 ELSE 0 END) || ' bytes RDATA' FROM m WHERE qr AND has_edns0)
SELECT part, pos, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, {_SHORT.format('CASE WHEN qr THEN ip_dst ELSE ip_src END')} AS client, {_CLASS.format('c')} AS class, {_KIND.format('t')} AS type, name, {_RCODE} AS rcode FROM e JOIN m USING (seq)""",
    "m",
)
def log_queries_and_responses(spark, d):
    return sinks.query_response_log(_messages(spark, d).withColumn("seq", F.lit(0))).drop("seq")


_AS4 = "(SELECT arg_max({c}, (from_ip, prefix)) FROM asn WHERE {a} BETWEEN from_ip AND to_ip)"
_ECS4 = f"(167772160 + {_K} * 65536 + 7 * 256)"


@query(
    f"""WITH s AS (SELECT *, {_ECS4} AS ecs4 FROM q WHERE has_ecs AND ip_type = 4 AND n_questions > 0),
g AS (SELECT seq, max(a.from_ip) AS fa, max(b.from_ip) AS fb FROM s LEFT JOIN geo a ON a.from_ip <= src_v4 LEFT JOIN geo b ON b.from_ip <= ecs4 GROUP BY seq)
SELECT CAST(ts AS DATE) AS date, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, qtype, ip_src AS q_src, '10.' || {_K} || '.7.0' AS ecs_ip, 24 AS ecs_scope, {_AS4.format(c='as_single', a='src_v4')} AS q_as, CASE WHEN src_v4 <= a.to_ip THEN a.country END AS q_geoip,
  {_AS4.format(c='as_single', a='ecs4')} AS ecs_ip_as, {_AS4.format(c='prefix', a='ecs4')} AS ecs_ip_prefix, CASE WHEN ecs4 <= b.to_ip THEN b.country END AS ecs_ip_geoip, {_NAME} AS qname
FROM s JOIN g USING (seq) LEFT JOIN geo a ON a.from_ip = fa LEFT JOIN geo b ON b.from_ip = fb""",
    "q", "asn", "geo",
)
def log_client_subnets(spark, d):
    """Queries with a client subnet, with the AS and country of the sender and of the subnet."""
    q = filters.with_client_subnet(filters.queries(_messages(spark, d).where("ip_type = 4")))
    q = q.withColumns({"src_v4": net.ip4_from_bytes("src_addr"), "ecs_v4": net.ip4_from_bytes("ecs_addr")}).where("qname is not null")
    q = q.select("ts", "qr", "is_valid", "has_ecs", "qtype", "qname", "ip_src", "ecs_ip", "ecs_src_scope", "src_v4", "ecs_v4")
    table, places = fx.ip4_to_as(spark, d), fx.ip4_to_location(spark, d)
    q = enrich.with_country(enrich.with_asn(q, "src_v4", table), "src_v4", places)
    return sinks.subnet_log(enrich.with_country(enrich.with_asn(q, "ecs_v4", table, "ecs_"), "ecs_v4", places, "ecs_country"))


@query(f"WITH {_RR} SELECT name, count(*) AS n FROM rrs JOIN m USING (seq) WHERE section = 'answer' AND m.qr AND m.aa GROUP BY 1", "m")
def log_answer_names(spark, d):
    return sinks.answer_names(_messages(spark, d)).groupBy("name").agg(F.count("*").alias("n"))


@query(
    f"""SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, epoch_us(ts) / 1000000 AS timestamp, ip_dst AS client_ip, CAST(seq % 65536 AS INTEGER) AS ip_ipid, 64 AS ip_ttl, dstport AS udp_dstport, query_id AS dns_qid, CASE WHEN n_questions > 0 THEN qtype END AS dns_qtype,
  CASE WHEN n_questions > 0 THEN qclass END AS dns_qclass, {_TEXT} AS dns_qname, CASE WHEN ans_count > 0 THEN 60 + {_K} ELSE -1 END AS first_response_ttl, CAST(has_edns0 AS INTEGER) AS dns_edns0, CAST(edns0_do AS INTEGER) AS dns_edns0_do, edns0_max_size AS dns_edns0_maxsize
FROM m WHERE qr AND ip_type = 4 AND NOT is_tcp""",
    "m",
)
def decoded_denat_responses(spark, d):
    return sinks.denat_responses(_messages(spark, d, sections=("answers", "edns0")))


@query(
    f"""SELECT 'sensor' AS identity, '1' AS version, 'CLIENT_QUERY' AS type, CAST(floor(epoch(ts)) AS BIGINT) AS query_time_sec, epoch_us(ts) % 1000000 * 1000 AS query_time_nsec, CASE WHEN ip_type = 4 THEN 'INET' ELSE 'INET6' END AS socket_family,
  CASE WHEN is_tcp THEN 'TCP' ELSE 'UDP' END AS socket_protocol, srcport AS query_port, {_LENGTH} AS query_bytes FROM q""",
    "q",
)
def log_dnstap(spark, d):
    headers = decode.dns_header(decode.dns_payload(decode.decode_packets(fx.dns_frames(spark, d))))
    tap = sinks.dnstap(headers, "sensor", "1")
    return tap.select(*(c for c in tap.columns if c not in ("query_address", "query_message")), F.octet_length("query_message").alias("query_bytes"))


@query(
    f"""WITH c AS (SELECT *, {_LENGTH} AS size FROM m WHERE ip_type = 4 AND NOT is_tcp),
x AS (SELECT *, CASE seq % 5 WHEN 0 THEN 5 WHEN 1 THEN size - 1 WHEN 2 THEN 12 ELSE size END AS cut FROM c)
SELECT ts, qr, cut >= 12 AS is_valid, cut >= 12 AND cut < size AS is_partial, CASE WHEN cut < 12 THEN 'short header' END AS parse_error FROM x""",
    "m",
)
def decoded_cut_messages(spark, d):
    """Messages cut within their header, behind it, and before their last byte."""
    f = fx.dns_frames(spark, d, seq=True).where("hex(substring(data, 13, 2)) = '0800' and hex(substring(data, 24, 1)) = '11'")
    size = F.octet_length("data")
    cut = F.expr("case seq % 5 when 0 then 47 when 1 then octet_length(data) - 1 when 2 then 54 else octet_length(data) end")
    f = f.select("ts", "feed_id", F.least(size, cut).alias("caplen"), F.expr("data").alias("data")).withColumn("data", F.substring(F.col("data"), F.lit(1), F.col("caplen")))
    # no list is given out, but all records are walked: where a message ends too early is their matter
    return decode.decode_dns(decode.decode_packets(f), sections=("edns0",), keep_malformed=True).select("ts", "qr", "is_valid", "is_partial", "parse_error")


_HEX6 = "lpad(regexp_extract(ip_src, '^2001:db8:1:([0-9]+)', 1), 4, '0')"


@query(f"SELECT ts, CAST('0x20010db80001' || {_HEX6} AS BIGINT) AS high, CAST('0x' || lpad(regexp_extract(ip_src, '::([0-9]+)$', 1), 4, '0') AS BIGINT) AS low FROM q WHERE ip_type = 6", "q")
def address_halves(spark, d):
    p = decode.decode_packets(fx.dns_frames(spark, d)).where("ip_type = 6 and dstport = 53")
    high, low = net.ip6_halves("src_addr")
    return p.select("ts", high.alias("high"), low.alias("low"))


@query("SELECT seq, ts FROM q ORDER BY ts LIMIT 500", "q")
def first_queries(spark, d):
    return filters.first_packets(fx.dns_queries(spark, d), 500).select("seq", "ts")


@query("SELECT ts, ip_src, query_id FROM q WHERE ts < (SELECT min(ts) FROM q) + INTERVAL 2 DAY", "q")
def first_days(spark, d):
    return filters.first_packets(fx.dns_queries(spark, d), 0, 2 * 86_400).select("ts", "ip_src", "query_id")


@query(
    f"SELECT {DAY} AS interval_start, ip_type, is_tcp, qr, count(*) AS packets, sum({_LENGTH} + CASE WHEN is_tcp THEN 22 ELSE 8 END + CASE WHEN ip_type = 4 THEN 34 WHEN seq % 4 = 0 THEN 70 ELSE 54 END)::BIGINT AS bytes FROM m GROUP BY ALL", "m"
)
def captures_read_back(spark, d):
    """Packets written as capture files, another one each day, read again and decoded."""
    path = fx.folder(spark)
    pcap.write_captures(fx.dns_frames(spark, d), path, interval=86_400)
    m = decode.dns_header(decode.dns_payload(decode.decode_packets(pcap.read_pcap(spark, path))))
    day = net.interval_start("ts", "1 day").cast("timestamp_ntz").alias("interval_start")
    return m.groupBy(day, "ip_type", "is_tcp", "qr").agg(F.count("*").alias("packets"), F.sum("caplen").cast("long").alias("bytes"))


@query("SELECT ip_type, is_tcp, qr, count(*) AS packets FROM m GROUP BY ALL", "m")
def captures_read_in_ranges(spark, d):
    """Packets written as a few long capture files, which many tasks read by byte ranges."""
    path = fx.folder(spark)
    # a range partition's bounds need a first look at the rows, so they are worked out once before
    pcap.write_captures(written(fx.dns_frames(spark, d)), path)
    m = decode.dns_header(decode.dns_payload(decode.decode_packets(splits.read_split(spark, splits.capture_files(spark, path), split=splits.LOOK))))
    return m.groupBy("ip_type", "is_tcp", "qr").agg(F.count("*").alias("packets"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 day, ts)) AS BIGINT) AS interval_start, dstport AS key, count(*) AS n FROM m WHERE NOT is_tcp GROUP BY ALL", "m")
def darknet_read_back(spark, d):
    """Interval records written as JSON lines by the hour, and a series from them."""
    m, path = fx.dns_messages(spark, d), fx.folder(spark)
    sinks.write_hourly_json(darknet.interval_records(darknet.ports(m, "1 day"), darknet.identification(m, "1 day", "query_id")), path)
    return tables.darknet_series(tables.read_darknet(spark, path), "udp")


@query(
    f"SELECT ip_src AS client_ip, CAST(seq % 65536 AS INTEGER) AS ip_ipid, srcport AS udp_srcport, query_id AS dns_qid, CASE WHEN n_questions > 0 THEN qtype END AS dns_qtype, {_TEXT} AS dns_qname, CAST(has_edns0 AS INTEGER) AS dns_edns0 FROM q WHERE ip_type = 4 AND NOT is_tcp", "q"
)
def denat_read_back(spark, d):
    """De-NAT queries written as CSV by the hour, and read again."""
    path = fx.folder(spark)
    sinks.write_csv(sinks.denat_queries(_messages(spark, d)), path, by="hour")
    return tables.read_denat_csv(spark, path).select("client_ip", "ip_ipid", "udp_srcport", "dns_qid", "dns_qtype", "dns_qname", "dns_edns0")
