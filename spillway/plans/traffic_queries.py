"""Registered queries on traffic: counters, popularity, distinct counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import sinks
from ..functions import net
from ..operators import filters, popularity, resolver, rollups, traffic, unique
from .sql import DAY, HOUR, codes_sql, query

_USABLE = "is_valid AND NOT is_partial"
RESOLVERS = ["192.0.2.53", "2001:db8:ffff::53"]
_P24 = "concat(regexp_extract(ip_src, '^([0-9]+[.][0-9]+[.][0-9]+)', 1), '.0/24')"
_P64 = "concat(regexp_extract(ip_src, '^(.*)::', 1), '::/64')"


@query(
    f"""
WITH e AS (
  SELECT {DAY} AS interval_start, unnest([
    {{'kind': 'ip4', 'key': CASE WHEN ip_type = 4 THEN ip_src END}}, {{'kind': 'pfx24', 'key': CASE WHEN ip_type = 4 THEN {_P24} END}},
    {{'kind': 'ip6', 'key': CASE WHEN ip_type = 6 THEN ip_src END}}, {{'kind': 'pfx64', 'key': CASE WHEN ip_type = 6 THEN {_P64} END}},
    {{'kind': 'qname', 'key': qname}}]) AS e
  FROM q WHERE {_USABLE}
), s AS (SELECT interval_start, e.kind AS kind, e.key AS key FROM e WHERE e.key IS NOT NULL),
sl AS (
  SELECT {DAY} AS interval_start, 'sld' AS kind, array_to_string(list_slice(string_split(rtrim(qname, '.'), '.'), -2, -1), '.') || '.' AS key FROM q WHERE {_USABLE}
), a AS (SELECT * FROM s UNION ALL SELECT * FROM sl),
c AS (SELECT interval_start, kind, key, count(*) AS n FROM a GROUP BY ALL),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY interval_start, kind ORDER BY n DESC, key) AS INTEGER) AS rank,
         round(100 * n / sum(n) OVER (PARTITION BY interval_start, kind), 2) AS percent FROM c
)
SELECT interval_start, kind, rank, key, n, percent FROM r
WHERE rank <= CASE kind WHEN 'ip4' THEN 100 WHEN 'ip6' THEN 100 WHEN 'qname' THEN 100 ELSE 25 END
""",
    "q",
)
def querypop_top(spark, d):
    return popularity.query_popularity(fx.dns_queries(spark, d), "1 day")


@query(
    f"""SELECT {HOUR} AS interval_start, count(*) AS n FROM q WHERE {_USABLE} AND qname LIKE '%view.example.' GROUP BY 1""", "q"
)
def sldpop_count(spark, d):
    return popularity.domain_count(fx.dns_queries(spark, d), "view.example.", "1 hour")


@query(
    f"""
WITH x AS (
  SELECT {DAY} AS interval_start, qname AS key, CASE WHEN NOT qr AND ip_dst IN ('192.0.2.53', '2001:db8:ffff::53') THEN 'client_query'
    WHEN qr AND ip_dst IN ('192.0.2.53', '2001:db8:ffff::53') AND srcport = 53 THEN 'server_response' END AS direction FROM m WHERE is_valid
), c AS (SELECT interval_start, direction, key, count(*) AS n FROM x WHERE direction IS NOT NULL GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY interval_start, direction ORDER BY n DESC, key) AS INTEGER) AS rank FROM c
""",
    "m",
)
def distribution_names(spark, d):
    return popularity.name_popularity(fx.dns_messages(spark, d), "1 day", RESOLVERS)


@query(
    f"""
WITH x AS (
  SELECT {DAY} AS interval_start, qname AS key, unnest(CASE
    WHEN NOT qr AND dstport = 53 AND srcport <> 53 AND (ip_dst = '192.0.2.54' OR ip_dst LIKE '2001:%') THEN ['client_query']
    WHEN NOT qr AND dstport = 53 AND srcport <> 53 AND ip_src LIKE '2001:%' THEN ['resolver_query']
    WHEN qr AND srcport = 53 AND dstport <> 53 AND (ip_dst = '192.0.2.54' OR ip_dst LIKE '2001:%') THEN ['server_response'] ELSE [] END) AS direction,
    n_questions AS w
  FROM m WHERE is_valid AND n_questions > 0
), c AS (SELECT interval_start, direction, key, sum(w)::BIGINT AS n FROM x GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY interval_start, direction ORDER BY n DESC, key) AS INTEGER) AS rank FROM c
""",
    "m",
)
def distribution_names_all_questions(spark, d):
    """Both questions of a message count; IPv6 messages go between listed addresses of a table."""
    m = fx.dns_message_lists(spark, d)
    listed = m.where("ip_type = 6").select("ip_src").unionByName(spark.range(1).select(F.lit("192.0.2.54").alias("ip_src")))
    return popularity.name_popularity(m, "1 day", listed)


@query(
    f"""
WITH x AS (SELECT {DAY} AS interval_start, qname AS key, CASE WHEN NOT qr AND ip_src LIKE '10.1%' THEN 'resolver_query' WHEN qr AND ip_dst LIKE '10.1%' THEN 'server_response' END AS direction FROM m WHERE is_valid),
c AS (SELECT interval_start, direction, key, count(*) AS n FROM x WHERE direction IS NOT NULL GROUP BY ALL),
d AS (SELECT *, CAST(row_number() OVER (PARTITION BY interval_start, direction ORDER BY n DESC, key) AS INTEGER) AS rank FROM c)
SELECT * FROM d WHERE rank <= 20
""",
    "m",
)
def distribution_names_top(spark, d):
    """The first names of resolvers that are listed in a table, from queries out and responses in."""
    m = fx.dns_messages(spark, d)
    resolvers = m.where("not qr and ip_src like '10.1%'").select("ip_src")
    return popularity.name_popularity(m, "1 day", resolvers, top=20)


@query(
    f"""
WITH c AS (SELECT {DAY} AS interval_start, CAST(srcport AS VARCHAR) AS port, count(*) AS n FROM q GROUP BY ALL),
t AS (SELECT port FROM c GROUP BY port ORDER BY sum(n) DESC, CAST(port AS INTEGER) LIMIT 10),
k AS (SELECT port AS key FROM t UNION ALL SELECT 'other'),
g AS (SELECT interval_start, CASE WHEN port IN (SELECT port FROM t) THEN port ELSE 'other' END AS key, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL)
SELECT i.interval_start, k.key, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT interval_start FROM c) i, k LEFT JOIN g ON g.interval_start = i.interval_start AND g.key = k.key
""",
    "q",
)
def darknet_day_series(spark, d):
    q = fx.dns_queries(spark, d)
    counts = q.groupBy(net.interval_start("ts", "1 day").alias("interval_start"), "srcport").agg(F.count("*").alias("n"))
    return popularity.top_series(counts, 10, key="srcport")


# Counters by hand, so that no list is shared with the operators.
# Registered numbers of record types and classes.
_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 24: "SIG", 25: "KEY", 28: "AAAA", 29: "LOC",
    33: "SRV", 35: "NAPTR", 36: "KX", 37: "CERT", 39: "DNAME", 41: "OPT", 42: "APL", 43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC",
    48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 55: "HIP", 99: "SPF", 249: "TKEY", 250: "TSIG", 251: "IXFR", 252: "AXFR", 255: "ANY",
    32768: "TA", 32769: "DLV",
}
_MORE_TYPES = _TYPES | {52: "TLSA", 257: "CAA"}
_CLASSES = {1: "IN", 2: "CS", 3: "CH", 4: "HS", 255: "ANY"}
_RC = "CASE rcode WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'NXDOMAIN' WHEN 4 THEN 'NOTIMPL' WHEN 5 THEN 'REFUSED' ELSE 'UNKNOWN' END"


def _by_code(column, codes, prefix, where, weight, suffix="", unspecified=True):
    fits = [(name, f"{column} = {code}") for code, name in codes.items()] + ([("UNSPECIFIED", f"{column} = 0")] if unspecified else [])
    other = f"{column} NOT IN ({', '.join([*map(str, codes)] + (['0'] if unspecified else []))})"
    return [f"coalesce(sum(CASE WHEN {where} AND {f} THEN {weight} END), 0)::BIGINT AS {prefix}_{n}{suffix}" for n, f in (*fits, ("UNKNOWN", other))]


# one row for each question and for each response's answers, with their number
_ITEMS = f"""i AS (
  SELECT {DAY} AS interval_start, feed_id AS scope, qr, is_valid, opcode, CASE WHEN qr THEN ip_src ELSE ip_dst END AS server, qtype AS t, qclass AS c, 1 AS w FROM m WHERE NOT qr AND n_questions > 0
  UNION ALL SELECT {DAY}, feed_id, qr, is_valid, opcode, CASE WHEN qr THEN ip_src ELSE ip_dst END, qtype2, 1, 1 FROM m WHERE NOT qr AND n_questions > 1
  UNION ALL SELECT {DAY}, feed_id, qr, is_valid, opcode, CASE WHEN qr THEN ip_src ELSE ip_dst END, ans_type, qclass, ans_count FROM m WHERE qr)"""
# Classes of sizes.
_EDNS_SIZES = {
    "below_512": "<512", "from_512": "512-999", "from_1000": "1000-1499", "from_1500": "1500-1999", "from_2000": "2000-2499",
    "from_2500": "2500-2999", "from_3000": "3000-3499", "from_3500": "3500-3999", "from_4000": "4000-4499", "from_4500": ">4499",
}
_RESPONSE_SIZES = {
    "below_512": "<512", "from_512": "512-1023", "from_1024": "1024-1535", "from_1536": "1536-2047", "from_2048": "2048-2559",
    "from_2560": "2560-3071", "from_3072": "3072-3583", "from_3584": "3584-4095", "from_4096": ">4095",
}
_METRIC_SIZES = {"le_512": "<513", "le_1280": "513-1280", "le_1500": "1281-1500", "le_4096": "1501-4096", "gt_4096": ">4096"}


def _in_range(column, text):
    return f"{column} {text}" if text[0] in "<>" else f"{column} BETWEEN {text.replace('-', ' AND ')}"


def _sized(column, sizes, prefix, where, suffix=""):
    return [f"count_if({where} AND {_in_range(column, r)}) AS {prefix}_{n}{suffix}" for n, r in sizes.items()]


def _stats_sql(apart, where="is_valid"):
    """Wide row of a day; ``apart``: NOTIFY by itself, outcomes by what stands first in the authority section."""
    asked = "NOT qr AND opcode <> 4" if apart else "NOT qr"
    if apart:
        label = f"CASE WHEN rcode = 0 AND opcode = 4 THEN 'notify' WHEN rcode = 0 AND ans_count = 0 THEN CASE WHEN ns_first THEN 'REFERRAL' WHEN has_soa THEN 'NODATA' WHEN tc THEN 'none' ELSE 'UNKNOWN' END ELSE {_RC} END"
    else:
        label = f"CASE WHEN rcode = 0 AND ans_count = 0 THEN 'NODATA' ELSE {_RC} END"
    items = [
        *_by_code("c", _CLASSES, "class", asked, "w"), *_by_code("t", _TYPES, "type", asked, "w"), *_by_code("c", _CLASSES, "answer_class", "qr", "w"), *_by_code("t", _TYPES, "answer_type", "qr", "w"),
    ]
    messages = [
        "count_if(NOT qr) AS queries", "count_if(qr) AS responses", "count_if(NOT qr AND opcode = 4) AS notify", "count_if(qr AND opcode = 4 AND rcode = 0) AS notify_answers",
        "count_if(NOT qr AND ip_type = 4) AS queries_v4", "count_if(NOT qr AND ip_type = 6) AS queries_v6", "count_if(NOT qr AND is_tcp) AS queries_tcp", "count_if(NOT qr AND NOT is_tcp) AS queries_udp",
        "count_if(NOT qr AND NOT has_edns0) AS edns_absent", "count_if(NOT qr AND has_edns0) AS edns_present", "count_if(NOT qr AND has_edns0 AND edns0_do) AS edns_do", "count_if(NOT qr AND has_edns0 AND NOT edns0_do) AS edns_no_do",
        "count_if(NOT qr AND has_edns0 AND has_ecs) AS edns_subnet", "count_if(NOT qr AND has_edns0 AND NOT has_ecs) AS edns_no_subnet", "count_if(NOT qr AND has_edns0 AND has_exp_opt) AS edns_experimental",
        *_sized("edns0_max_size", _EDNS_SIZES, "edns_size", "NOT qr AND has_edns0"), *_sized("udp_len", _RESPONSE_SIZES, "response_size", "qr AND udp_len > 0"),
        "coalesce(sum(CASE WHEN qr AND udp_len > 0 THEN udp_len END), 0)::BIGINT AS response_bytes", "count_if(qr AND udp_len > 0) AS responses_sized", "count_if(qr AND udp_len > 0 AND ip_type = 4) AS responses_sized_v4",
        "count_if(qr AND udp_len > 0 AND ip_type = 6) AS responses_sized_v6", *(f"count_if(qr AND label = '{x}') AS rcode_{x}" for x in _LABELS),
        "count_if(qr AND is_fragmented) AS responses_fragmented", "count_if(qr AND NOT is_fragmented) AS responses_whole", "count_if(qr AND is_fragmented AND ip_type = 4) AS responses_fragmented_v4",
        "count_if(qr AND is_fragmented AND ip_type = 6) AS responses_fragmented_v6", "count_if(qr AND tc) AS responses_truncated",
    ]
    names = [x.rsplit(" AS ", 1)[1] for x in items]
    return f"""WITH {_ITEMS}, a AS (SELECT interval_start, {', '.join(items)} FROM i WHERE {where} GROUP BY 1),
b AS (SELECT {DAY} AS interval_start, {', '.join(messages)} FROM (SELECT *, {label} AS label, CASE WHEN qr THEN ip_src ELSE ip_dst END AS server FROM m) WHERE {where} GROUP BY 1),
s AS (SELECT b.*, {', '.join(f'coalesce(a.{n}, 0) AS {n}' for n in names)} FROM b LEFT JOIN a USING (interval_start))"""


_LABELS = ("NOERROR", "FORMERR", "SERVFAIL", "NXDOMAIN", "NOTIMPL", "REFUSED", "NODATA", "REFERRAL", "UNKNOWN")
_SHARES = {
    "v4": ("queries_v4", "queries"), "v6": ("queries_v6", "queries"), "tcp": ("queries_tcp", "queries"), "edns_on": ("edns_present", "queries"), "edns_off": ("edns_absent", "queries"), "edns_do": ("edns_do", "edns_present"),
    "edns_no_do": ("edns_no_do", "edns_present"), "edns_subnet": ("edns_subnet", "edns_present"), "edns_no_subnet": ("edns_no_subnet", "edns_present"), "fragmented": ("responses_fragmented", "responses"),
    "whole": ("responses_whole", "responses"), "truncated": ("responses_truncated", "responses"),
    **{f"edns_size_{x}": (f"edns_size_{x}", "edns_present") for x in _EDNS_SIZES},
    **{f"response_size_{x}": (f"response_size_{x}", "responses_sized") for x in _RESPONSE_SIZES}, **{x.lower(): (f"rcode_{x}", "responses") for x in _LABELS},
}


@query(
    f"""{_stats_sql(False)} SELECT *, {', '.join(f"CASE WHEN {b} = 0 THEN 0 ELSE {a} * 100 // {b} END AS pct_{k}" for k, (a, b) in _SHARES.items())},
  CASE WHEN responses_sized = 0 THEN 0 ELSE response_bytes // responses_sized END AS response_mean_size FROM s""",
    "m",
)
def dnsstats_wide(spark, d):
    return traffic.with_percentages(traffic.dns_statistics(fx.dns_message_lists(spark, d), [], "1 day"))


@query(f"{_stats_sql(False, 'is_valid AND server = ' + chr(39) + '192.0.2.54' + chr(39))} SELECT interval_start, queries, responses, type_A, type_AAAA, answer_type_RRSIG FROM s", "m")
def dnsstats_one_server(spark, d):
    return traffic.dns_statistics(fx.dns_message_lists(spark, d), ["192.0.2.54"], "1 day").select("interval_start", "queries", "responses", "type_A", "type_AAAA", "answer_type_RRSIG")


_FLAGS = """
f AS (SELECT msg_id, min(ts) AS ts, any_value(aa) AS aa, any_value(rcode) AS rcode, any_value(tc) AS tc, count_if(section = 'answer') AS ans_count,
  bool_or(section = 'authority' AND rr_type = 6) AS has_soa, bool_or(section = 'authority' AND rr_type = 2) AS has_ns,
  coalesce(arg_min(rr_type = 2, CASE WHEN section = 'authority' AND rr_type IN (2, 6) THEN (rr_pos, rr_type) END), false) AS ns_first,
  count_if(section = 'answer' AND rr_type = 46) AS rrsig_answer, count_if(section = 'authority' AND rr_type = 46) AS rrsig_authority, count_if(section = 'additional' AND rr_type = 46) AS rrsig_additional
  FROM rr GROUP BY msg_id)"""


@query(f"WITH {_FLAGS} SELECT * FROM f", "rr")
def message_flags(spark, d):
    return resolver.message_flags(fx.dns_records(spark, d))


def _outcome(dialect):
    empty = "rcode = 0 AND ans_count = 0"
    if dialect == "client":
        case = f"CASE WHEN {empty} AND ns_first THEN 'REFERRAL' WHEN {empty} AND has_soa THEN 'NODATA' ELSE {_RC} END"
    elif dialect == "truncated":
        case = f"CASE WHEN {empty} THEN CASE WHEN ns_first THEN 'REFERRAL' WHEN has_soa THEN 'NODATA' WHEN NOT tc THEN 'UNKNOWN' END ELSE {_RC} END"
    else:
        case = f"CASE WHEN {empty} AND has_soa THEN 'NODATA' WHEN {empty} AND has_ns THEN 'REFERRAL' ELSE {_RC} END"
    return f"WITH {_FLAGS} SELECT {DAY} AS interval_start, {case} AS label, count(*) AS n FROM f GROUP BY ALL"


@query(_outcome("resolver"), "rr")
def rcodes_resolver(spark, d):
    return resolver.outcomes(resolver.message_flags(fx.dns_records(spark, d)), "resolver", "1 day")


@query(_outcome("client"), "rr")
def rcodes_client(spark, d):
    return resolver.outcomes(resolver.message_flags(fx.dns_records(spark, d)), "client", "1 day")


@query(_outcome("truncated"), "rr")
def rcodes_truncation_aware(spark, d):
    return resolver.outcomes(resolver.message_flags(fx.dns_records(spark, d)), "truncated", "1 day")


_TTL = f"""t AS (
  SELECT {DAY} AS interval_start, unnest([section || '_' || {codes_sql('rr_type', net.QTYPES)}, 'ALL']) AS tag, rr_name, ttl, ts, msg_id, rr_pos FROM rr
), first AS (SELECT interval_start, tag, rr_name, arg_min(ttl, (ts, msg_id, rr_pos, ttl)) AS ttl FROM t GROUP BY ALL)"""


@query(f"WITH {_TTL} SELECT * FROM first", "rr")
def ttl_first_seen(spark, d):
    return resolver.first_ttls(fx.dns_records(spark, d), "1 day")


@query(
    f"""WITH {_TTL}, c AS (SELECT interval_start, tag, ttl, count(*) AS n FROM first GROUP BY ALL UNION ALL SELECT DISTINCT interval_start, tag, 0, 0 FROM first)
SELECT *, round(sum(n) OVER (PARTITION BY interval_start, tag ORDER BY ttl, n ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY interval_start, tag), 6) AS cdf FROM c""",
    "rr",
)
def ttl_cdf(spark, d):
    return resolver.ttl_distribution(resolver.first_ttls(fx.dns_records(spark, d), "1 day"))


@query(f"WITH {_FLAGS} SELECT {DAY} AS interval_start, rrsig_answer + rrsig_authority + rrsig_additional AS signatures, count(*) AS responses FROM f GROUP BY ALL", "rr")
def signature_histogram(spark, d):
    return resolver.signatures_per_response(resolver.message_flags(fx.dns_records(spark, d)), "1 day")


@query(
    f"""WITH {_FLAGS}, g AS (SELECT *, rrsig_answer + rrsig_authority + rrsig_additional AS n FROM f) SELECT {DAY} AS interval_start, sum(rrsig_answer)::BIGINT AS rrsig_answer, sum(rrsig_authority)::BIGINT AS rrsig_authority,
  sum(rrsig_additional)::BIGINT AS rrsig_additional, coalesce(sum(CASE WHEN aa THEN n END), 0)::BIGINT AS rrsig_authoritative, count_if(n > 0) AS signed_responses, count_if(n > 0 AND tc) AS signed_truncated FROM g GROUP BY 1""",
    "rr",
)
def signature_totals(spark, d):
    return resolver.signature_totals(resolver.message_flags(fx.dns_records(spark, d)), "1 day")


@query(
    f"""WITH x AS (SELECT {DAY} AS interval_start, *, CASE WHEN NOT qr AND ip_dst IN ('192.0.2.53', '2001:db8:ffff::53') THEN 'qi' WHEN qr AND ip_src IN ('192.0.2.53', '2001:db8:ffff::53') THEN 'ro' END AS dir
  FROM m WHERE is_valid AND ip_src <> '192.0.2.54' AND ip_dst <> '192.0.2.54')
SELECT interval_start, count_if(dir = 'qi') AS queries_in, CAST(0 AS BIGINT) AS queries_out, CAST(0 AS BIGINT) AS responses_in, count_if(dir = 'ro') AS responses_out, CAST(0 AS BIGINT) AS authoritative_in,
  CAST(0 AS BIGINT) AS fragments_in, CAST(0 AS BIGINT) AS truncated_in, CASE WHEN count_if(dir = 'qi') > 0 THEN 100.0::DOUBLE END AS cache_hit_ratio FROM x WHERE dir IS NOT NULL GROUP BY 1""",
    "m",
)
def resolver_counters(spark, d):
    ignored = spark.range(1).select(F.lit("192.0.2.54").alias("ip"))
    return resolver.resolver_counters(fx.dns_messages(spark, d), RESOLVERS, ignored, "1 day")


@query(
    f"""WITH x AS (SELECT {DAY} AS interval_start, *, CASE WHEN NOT qr AND ip_dst LIKE '10.1%' THEN 'qi' WHEN qr AND ip_dst LIKE '10.1%' THEN 'ri' WHEN qr AND ip_src LIKE '10.1%' THEN 'ro' WHEN NOT qr AND ip_src LIKE '10.1%' THEN 'qo' END AS dir
  FROM m WHERE is_valid AND (srcport = 53) <> (dstport = 53)),
  y AS (SELECT interval_start, count_if(dir = 'qi') AS queries_in, count_if(dir = 'qo') AS queries_out, count_if(dir = 'ri') AS responses_in, count_if(dir = 'ro') AS responses_out, count_if(dir = 'ri' AND aa) AS authoritative_in,
  count_if(dir = 'ri' AND is_fragmented) AS fragments_in, count_if(dir = 'ri' AND tc) AS truncated_in FROM x WHERE dir IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN queries_in > 0 THEN round(100 - 100.0 * authoritative_in / queries_in, 2) END AS cache_hit_ratio FROM y""",
    "m",
)
def resolver_counters_outgoing(spark, d):
    """Resolvers listed in a table."""
    m = fx.dns_messages(spark, d)
    return resolver.resolver_counters(m, m.where("not qr and ip_src like '10.1%'").select("ip_src"), None, "1 day")


@query(
    f"""WITH x AS (SELECT {DAY} AS interval_start, NOT qr AND dstport = 53 AND srcport <> 53 AS q, qr AND srcport = 53 AND dstport <> 53 AS r, aa, is_fragmented, tc FROM m WHERE is_valid),
y AS (SELECT interval_start, count_if(q) AS queries_in, CAST(0 AS BIGINT) AS queries_out, count_if(r) AS responses_in, count_if(r) AS responses_out, count_if(r AND aa) AS authoritative_in,
  count_if(r AND is_fragmented) AS fragments_in, count_if(r AND tc) AS truncated_in FROM x WHERE q OR r GROUP BY 1)
SELECT *, CASE WHEN queries_in > 0 THEN round(100 - 100.0 * authoritative_in / queries_in, 2) END AS cache_hit_ratio FROM y""",
    "m",
)
def resolver_counters_any(spark, d):
    """Any address is a resolver: each response is one to a resolver and one from it, each query one to it."""
    return resolver.resolver_counters(fx.dns_messages(spark, d), ["*"], None, "1 day")


@query(
    f"""WITH x AS (SELECT {DAY} AS interval_start, *, ip_src IN ('10.0.0.0', '192.0.2.53') OR ip_src = (SELECT min(ip_src) FROM q WHERE ip_type = 4) AS s FROM m WHERE is_valid AND (srcport = 53) <> (dstport = 53)),
y AS (SELECT *, ip_dst = '192.0.2.53' OR ip_dst = (SELECT min(ip_src) FROM q WHERE ip_type = 4) AS t, ip_src = (SELECT min(ip_src) FROM q WHERE ip_type = 4) AS early FROM x),
z AS (SELECT interval_start, count_if(NOT qr AND t) AS queries_in, count_if(NOT qr AND s AND (NOT t OR early)) AS queries_out, count_if(qr AND t) AS responses_in, count_if(qr AND s) AS responses_out,
  count_if(qr AND t AND aa) AS authoritative_in, count_if(qr AND t AND is_fragmented) AS fragments_in, count_if(qr AND t AND tc) AS truncated_in FROM y WHERE s OR t GROUP BY 1)
SELECT *, CASE WHEN queries_in > 0 THEN round(100 - 100.0 * authoritative_in / queries_in, 2) END AS cache_hit_ratio FROM z""",
    "m",
)
def resolver_counters_between(spark, d):
    """A client that is a resolver too, listed before the server that it asks: its queries are out and in, their responses as well."""
    m = fx.dns_messages(spark, d)
    client = m.where("not qr and ip_type = 4").agg(F.min("ip_src")).first()[0]
    return resolver.resolver_counters(m, [client, "192.0.2.53"], None, "1 day")


@query(
    f"""WITH t AS (SELECT ts, qr, is_valid, ip_src, ip_dst, srcport, dstport, aa, tc, is_fragmented FROM m UNION ALL
  SELECT ts, false, is_valid, ip_dst, ip_src, dstport, srcport, aa, tc, is_fragmented FROM m WHERE qr AND seq % 3 = 0),
x AS (SELECT {DAY} AS interval_start, *, CASE WHEN NOT qr AND ip_dst LIKE '10.%' AND dstport = 53 AND srcport <> 53 THEN 'qi' WHEN qr AND ip_dst LIKE '10.%' AND srcport = 53 AND dstport <> 53 THEN 'ri'
  WHEN NOT qr AND ip_src LIKE '10.%' AND dstport = 53 AND srcport <> 53 THEN 'qo' END AS dir FROM t WHERE is_valid)
SELECT interval_start, count_if(dir = 'qi') AS queries_in, count_if(dir = 'qo') AS queries_out, count_if(dir = 'ri') AS responses_in, CAST(0 AS BIGINT) AS responses_out, count_if(dir = 'ri' AND aa) AS authoritative_in,
  count_if(dir = 'ri' AND is_fragmented) AS fragments_in, count_if(dir = 'ri' AND tc) AS truncated_in, CASE WHEN count_if(dir = 'qi') > 0 THEN round(100 - 100.0 * count_if(dir = 'ri' AND aa) / count_if(dir = 'qi'), 2) END AS cache_hit_ratio
FROM x WHERE dir IS NOT NULL GROUP BY 1""",
    "m",
)
def resolver_cache_hits(spark, d):
    """Resolvers that ask and are asked: each third response comes back as a query to its receiver."""
    m = fx.dns_messages(spark, d)
    asked = m.where("qr and seq % 3 = 0").withColumns({"qr": F.lit(False), "ip_src": F.col("ip_dst"), "ip_dst": F.col("ip_src"), "srcport": F.col("dstport"), "dstport": F.col("srcport")})
    # queries to the clients' own port 53
    return resolver.resolver_counters(m.unionByName(asked), m.where("not qr and ip_type = 4").select("ip_src"), None, "1 day")


@query(
    f"""{_stats_sql(True)} SELECT *, {', '.join(f"CASE WHEN {b} = 0 THEN 0 ELSE round(100 * {a} / {b}, 2) END AS pct_{k}" for k, (a, b) in (_SHARES | {f"fragmented_v{v}": (f"responses_fragmented_v{v}", f"responses_sized_v{v}") for v in (4, 6)}).items())},
  CASE WHEN responses_sized = 0 THEN 0 ELSE round(response_bytes / responses_sized, 2) END AS response_mean_size FROM s""",
    "m",
)
def rates_by_version(spark, d):
    return traffic.rates_by_version(fx.dns_message_lists(spark, d), [], "1 day")


def _metric_sql(scope="feed_id", where="is_valid"):
    label = f"CASE WHEN rcode = 0 AND opcode = 4 THEN 'notify' WHEN rcode = 0 AND ans_count = 0 THEN CASE WHEN ns_first THEN 'REFERRAL' WHEN has_soa THEN 'NODATA' WHEN tc THEN 'none' ELSE 'UNKNOWN' END ELSE {_RC} END"
    items = [
        *_by_code("c", _CLASSES, "q_class", "NOT qr AND opcode <> 4", "w", "_ctr", False), *_by_code("t", _MORE_TYPES, "q_type", "NOT qr AND opcode <> 4", "w", "_ctr", False),
        *_by_code("c", _CLASSES, "r_class", "qr", "w", "_ctr", False), *_by_code("t", _MORE_TYPES, "r_type", "qr", "w", "_ctr", False),
    ]
    messages = [
        "count_if(NOT qr AND opcode <> 4 AND n_questions = 0) AS q_malformed_ctr", "count_if(NOT qr AND opcode = 4) AS notify_in_ctr", "count_if(qr AND opcode = 4 AND rcode = 0) AS notify_out_ctr",
        *_sized("edns0_max_size", _METRIC_SIZES, "q_edns0_maxsize", "NOT qr AND has_edns0", "_ctr"),
        *_sized("size", _METRIC_SIZES, "r_rsize", "qr", "_ctr"),
        "sum(CASE WHEN qr THEN ans_count + aut_count + add_count ELSE 0 END) AS r_total_rec_ctr", *(f"sum(CASE WHEN qr THEN {x}_count ELSE 0 END) AS r_total_{x}_rec_ctr" for x in ("ans", "aut", "add")),
        *(f"count_if(qr AND label = '{x}') AS r_rcode_{x.lower()}_ctr" for x in _LABELS),
    ]
    for v, w in (("", "true"), ("_v4", "ip_type = 4"), ("_v6", "ip_type = 6")):
        messages += [f"count_if(qr AND {w} AND is_fragmented) AS r_frag{v}_ctr", f"count_if(qr AND {w} AND NOT is_fragmented) AS r_unfrag{v}_ctr"]
    for side, w, name in (("q", "NOT qr", "dnstraf_inbound"), ("r", "qr", "dnstraf_outbound")):
        messages += [
            f"count_if({w}) AS {side}_ctr", f"sum(CASE WHEN {w} THEN udp_len ELSE 0 END) AS {name}", f"count_if({w} AND ip_type = 4) AS {side}_v4_ctr", f"count_if({w} AND ip_type = 6) AS {side}_v6_ctr",
            f"count_if({w} AND NOT is_tcp) AS {side}_udp_ctr", f"count_if({w} AND is_tcp) AS {side}_tcp_ctr", *(f"count_if({w} AND {f}) AS {side}_{f}_set_ctr" for f in ("aa", "tc", "rd", "ra", "ad", "cd")),
            f"count_if({w} AND has_edns0) AS {side}_has_edns0_ctr", f"count_if({w} AND NOT has_edns0) AS {side}_no_edns0_ctr", f"count_if({w} AND has_edns0 AND edns0_do) AS {side}_edns0_do_set_ctr",
            f"count_if({w} AND has_edns0 AND NOT edns0_do) AS {side}_edns0_do_unset_ctr", f"count_if({w} AND has_edns0 AND has_ecs) AS {side}_edns0_has_ecs_ctr", f"count_if({w} AND has_edns0 AND NOT has_ecs) AS {side}_edns0_has_no_ecs_ctr",
        ]
    averages = {
        "avg_qsize": "dnstraf_inbound / nullif(q_ctr, 0)", "avg_rsize": "dnstraf_outbound / nullif(r_ctr, 0)", "avg_recs_per_r": "r_total_rec_ctr / nullif(r_ctr, 0)", "avg_ans_per_r": "r_total_ans_rec_ctr / nullif(r_ctr, 0)",
        "avg_aut_per_r": "r_total_aut_rec_ctr / nullif(r_ctr, 0)", "avg_add_per_r": "r_total_add_rec_ctr / nullif(r_ctr, 0)",
    }
    name = lambda x: x.rsplit(" AS ", 1)[1]
    scoped = _ITEMS.replace("feed_id AS scope", f"{scope} AS scope").replace(", feed_id, qr", f", {scope}, qr")
    counters = [name(x) for x in (*items, *messages)]
    return f"""WITH {scoped}, a AS (SELECT interval_start, scope, {', '.join(items)} FROM i WHERE {where} GROUP BY ALL),
b AS (SELECT {DAY} AS interval_start, {scope} AS scope, {', '.join(messages)} FROM (SELECT *, {label} AS label, udp_len + CASE WHEN ip_type = 4 THEN 28 ELSE 48 END AS size FROM m) WHERE {where} GROUP BY ALL),
w AS (SELECT b.interval_start, b.scope, {', '.join(f"{name(x)}::DOUBLE AS {name(x)}" for x in messages)}, {', '.join(f"coalesce(a.{name(x)}, 0)::DOUBLE AS {name(x)}" for x in items)} FROM b LEFT JOIN a USING (interval_start, scope)),
w2 AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in averages.items())} FROM w),
long AS (SELECT interval_start, scope, unnest([{', '.join(f"{{'metric': '{k}', 'value': {k}}}" for k in (*counters, *averages))}]) AS e FROM w2)"""


@query(_metric_sql() + " SELECT interval_start, scope, e.metric AS metric, e.value AS value FROM long", "m")
def scoped_metrics(spark, d):
    return traffic.scoped_metrics(fx.dns_message_lists(spark, d).withColumn("scope", F.col("feed_id")), "1 day")


_SERVER_BLOCK = "CASE CASE WHEN qr THEN ip_src ELSE ip_dst END WHEN '192.0.2.53' THEN 'first' WHEN '192.0.2.54' THEN 'both' END"


@query(_metric_sql(_SERVER_BLOCK) + " SELECT interval_start, scope, e.metric AS metric, e.value AS value FROM long WHERE scope IS NOT NULL", "m")
def scoped_metrics_by_block(spark, d):
    """Messages of the servers in listed blocks; the first block in order counts."""
    blocks = spark.sql("SELECT 0 AS ord, 3221226037L AS lo, 3221226037L AS hi, 'first' AS descr UNION ALL SELECT 1, 3221226036L, 3221226039L, 'both'")
    return traffic.scoped_metrics(fx.dns_message_lists(spark, d), "1 day", blocks=blocks)


@query(_metric_sql() + " SELECT interval_start, scope, e.metric AS metric, CASE WHEN e.metric LIKE 'avg\\_%' ESCAPE '\\' OR e.metric = 'q_malformed_ctr' THEN e.value ELSE e.value / 86400 END AS value FROM long", "m")
def scoped_metric_rates(spark, d):
    return traffic.metric_rates(traffic.scoped_metrics(fx.dns_message_lists(spark, d).withColumn("scope", F.col("feed_id")), "1 day"), 86400, ("q_malformed_ctr",))


@query(
    "WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS today FROM q GROUP BY 1) SELECT a.day, a.today, coalesce(b.today, 0) AS yesterday FROM c a LEFT JOIN c b ON b.day = a.day - 1", "q"
)
def day_counters(spark, d):
    return traffic.day_counters(fx.dns_messages(spark, d))


@query(
    f"""SELECT {DAY} AS interval_start, 'class' AS kind, {codes_sql('rr_class', net.QCLASSES)} AS name, count(*) AS n FROM rr WHERE section = 'answer' GROUP BY ALL
UNION ALL SELECT {DAY}, 'type', {codes_sql('rr_type', net.QTYPES)}, count(*) FROM rr WHERE section = 'answer' GROUP BY ALL""",
    "rr",
)
def answer_counts(spark, d):
    return traffic.answer_counts(fx.dns_records(spark, d), "1 day")


_TOTAL = "count(*) AS packets, count_if(is_tcp) AS tcp, count_if(NOT is_tcp) AS udp, count_if(NOT qr) AS queries, count_if(qr) AS responses, count_if(is_valid) AS handled, sum(udp_len)::BIGINT AS bytes"


@query(f"SELECT {HOUR} AS interval_start, {_TOTAL} FROM m GROUP BY 1", "m")
def packet_totals(spark, d):
    return traffic.totals(fx.dns_messages(spark, d), "1 hour")


@query(f"SELECT {DAY} AS interval_start, feed_id, {_TOTAL} FROM m WHERE feed_id IN ('feed0', 'feed2') GROUP BY ALL", "m")
def feed_totals(spark, d):
    return traffic.by_feed(fx.dns_messages(spark, d), ["feed0", "feed2"], "1 day")


@query("SELECT ip_type, count(*) AS n FROM m WHERE ip_dst = '192.0.2.53' AND dstport = 53 GROUP BY 1", "m")
def sent_to_port(spark, d):
    return traffic.sent_to(fx.dns_messages(spark, d), "192.0.2.53", 53)


@query(
    "SELECT time_bucket(INTERVAL 1 day, ts) AS interval_start, ip_src, count(*) AS n FROM q WHERE (ip_type = 4 AND seq % 10 = 0) OR (ip_type = 6 AND seq % 10 = 1) GROUP BY ALL", "q"
)
def reassembly_timeouts(spark, d):
    icmp = fx.dns_queries(spark, d).withColumns({"icmp_type": F.expr("case seq % 10 when 0 then 11 when 1 then 3 else 8 end"), "icmp_code": F.lit(1)})
    return traffic.reassembly_timeouts(icmp, "1 day")


@query(
    f"""WITH c AS (SELECT *, {HOUR} AS hour, {DAY} AS day, date_trunc('week', ts)::TIMESTAMP AS week FROM q WHERE ip_dst <> '192.0.2.54'),
p AS (SELECT 'hour' AS period, hour AS interval_start, * FROM c UNION ALL SELECT 'day', day, * FROM c UNION ALL SELECT 'week', week, * FROM c)
SELECT period, interval_start, count(DISTINCT ip_src) AS clients, count(*) AS messages, count(DISTINCT CASE WHEN ip_type = 4 THEN ip_src END) AS clients_v4, count_if(ip_type = 4) AS messages_v4,
  count(DISTINCT CASE WHEN ip_type = 6 THEN ip_src END) AS clients_v6, count_if(ip_type = 6) AS messages_v6 FROM p GROUP BY ALL""",
    "q",
)
def unique_clients(spark, d):
    return unique.unique_clients(fx.dns_messages(spark, d), RESOLVERS)


@query(
    f"""WITH c AS (SELECT *, {HOUR} AS hour, {DAY} AS day, date_trunc('week', ts)::TIMESTAMP AS week FROM q WHERE ip_src LIKE '10.1%' OR ip_src LIKE '2001:%'),
p AS (SELECT 'hour' AS period, hour AS interval_start, * FROM c UNION ALL SELECT 'day', day, * FROM c UNION ALL SELECT 'week', week, * FROM c)
SELECT period, interval_start, count(DISTINCT ip_dst) AS clients, count(*) AS messages, count(DISTINCT CASE WHEN ip_type = 4 THEN ip_dst END) AS clients_v4, count_if(ip_type = 4) AS messages_v4,
  count(DISTINCT CASE WHEN ip_type = 6 THEN ip_dst END) AS clients_v6, count_if(ip_type = 6) AS messages_v6 FROM p GROUP BY ALL""",
    "q",
)
def unique_clients_outgoing(spark, d):
    """The addresses that listed resolvers ask."""
    m = fx.dns_messages(spark, d)
    listed = m.where("not qr and (ip_src like '10.1%' or ip_src like '2001:%')").select("ip_src")
    return unique.unique_clients(m, listed, measure_direction=1)


_V4P = ", ".join(f"concat(cast(v{n} // 16777216 AS string), '.', cast(v{n} // 65536 % 256 AS string), '.', cast(v{n} // 256 % 256 AS string), '.', cast(v{n} % 256 AS string), '/{n}')" for n in (24, 20, 16))
_PFX = f"""p AS (SELECT *, unnest(CASE WHEN ip_type = 4 THEN [{_V4P}] ELSE [{_P64}] END) AS prefix
  FROM (SELECT *, src_v4 - src_v4 % 256 AS v24, src_v4 - src_v4 % 4096 AS v20, src_v4 - src_v4 % 65536 AS v16 FROM q WHERE {_USABLE}))"""


@query(f"WITH {_PFX} SELECT {HOUR} AS interval_start, prefix, count(DISTINCT qname) AS names FROM p GROUP BY ALL", "q")
def names_by_prefix(spark, d):
    return unique.names_by_prefix(fx.dns_queries(spark, d), None, "1 hour", exact=True)


@query(f"WITH {_PFX} SELECT {DAY} AS interval_start, prefix, true AS within FROM p GROUP BY ALL", "q")
def names_by_prefix_sketched(spark, d):
    """Daily estimates from hourly sketches, and whether they are within 3 percent (or one) of the exact counts."""
    q = fx.dns_queries(spark, d)
    daily = unique.merged_names(unique.names_by_prefix(q), "1 day")
    exact = unique.names_by_prefix(q, None, "1 day", exact=True).withColumnRenamed("names", "exact")
    fine = F.abs(F.col("names") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))
    return daily.join(exact, ["interval_start", "prefix"]).select("interval_start", "prefix", fine.alias("within"))


@query(
    f"""WITH {_PFX}, a AS (SELECT {DAY} AS interval_start, count(*) AS queries, count(DISTINCT qname) AS names FROM q WHERE {_USABLE} GROUP BY 1),
b AS (SELECT {DAY} AS interval_start, count(DISTINCT prefix || ':' || qname) AS prefix_names FROM p GROUP BY 1),
c AS (SELECT {DAY} AS interval_start, count(DISTINCT s) AS suffixes FROM (SELECT ts, unnest([qname, substr(qname, strpos(qname, '.') + 1), 'example.']) AS s FROM q WHERE {_USABLE}) GROUP BY 1)
SELECT * FROM a JOIN b USING (interval_start) JOIN c USING (interval_start)""",
    "q",
)
def global_names(spark, d):
    return unique.global_names(fx.dns_queries(spark, d), None, "1 day", exact=True)


@query("SELECT seq, ts, ip_src, qname FROM m WHERE is_valid AND NOT is_partial AND NOT qr AND ip_dst IN ('192.0.2.53') AND NOT is_tcp AND ip_type = 4 AND qname LIKE '%click.example.' AND has_ecs AND NOT (qtype IN (43, 48))", "m")
def filtered_queries(spark, d):
    m = filters.usable(filters.queries(fx.dns_messages(spark, d)))
    m = filters.with_client_subnet(filters.under_domains(filters.udp_ipv4(filters.to_addresses(m, ["192.0.2.53"])), ["CLICK.example."]))
    return filters.by_predicate(filters.by_ports(m, 0, 53), "not (qtype in (43, 48))").select("seq", "ts", "ip_src", "qname")


# --- hours rolled up ---------------------------------------------------------

_ITEMS_SQL = f"""
WITH e AS (SELECT {{bucket}} AS interval_start, unnest([{{{{'kind': 'qname', 'key': qname}}}}, {{{{'kind': 'sld', 'key': array_to_string(list_slice(string_split(rtrim(qname, '.'), '.'), -2, -1), '.') || '.'}}}}]) AS e FROM q WHERE {_USABLE}),
c AS (SELECT interval_start, e.kind AS kind, e.key AS key, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY interval_start, kind ORDER BY n DESC, key) AS INTEGER) AS rank FROM c)
SELECT interval_start, kind, rank, key, n FROM r WHERE rank <= {{top}}"""


@query(_ITEMS_SQL.format(bucket=DAY, top=5), "q")
def top_names_rolled_up(spark, d):
    """Days from sketches of their hours, then exact numbers of the candidates only."""
    items = rollups.name_items(fx.dns_queries(spark, d))
    days = rollups.merged_frequent(rollups.frequent(items), "1 day")
    return rollups.exact_top(items, days, "1 day", 5)


@query(_ITEMS_SQL.format(bucket="time_bucket(INTERVAL 7 day, ts, TIMESTAMP '1970-01-01')", top=12), "q")
def top_names_of_small_sketches(spark, d):
    """Sketches that are too small for all names, so some lists cannot be told from them and are counted in full."""
    items = rollups.name_items(fx.dns_queries(spark, d))
    weeks = rollups.merged_frequent(rollups.frequent(items, tracked=96), "7 days", tracked=96)
    return rollups.exact_top(items, weeks, "7 days", 12, tracked=96)


def _rolled_clients(address, where):
    return f"""WITH c AS (SELECT *, {HOUR} AS hour, {DAY} AS day, date_trunc('week', ts)::TIMESTAMP AS week FROM q WHERE ip_type = 4 AND {where}),
p AS (SELECT 'hour' AS period, hour AS interval_start, * FROM c UNION ALL SELECT 'day', day, * FROM c UNION ALL SELECT 'week', week, * FROM c)
SELECT period, interval_start, count(DISTINCT {address})::BIGINT AS clients_v4, count(*) AS messages_v4 FROM p GROUP BY ALL"""


@query(_rolled_clients("src_v4", "ip_dst <> '192.0.2.54'"), "q")
def unique_clients_rolled_up(spark, d):
    return rollups.clients_of(rollups.client_bitmaps(fx.dns_messages(spark, d), RESOLVERS))


@query(_rolled_clients("dst_v4", "ip_src LIKE '10.1%'"), "q")
def unique_servers_rolled_up(spark, d):
    m = fx.dns_messages(spark, d)
    return rollups.clients_of(rollups.client_bitmaps(m, m.where("not qr and ip_src like '10.1%'").select("ip_src"), measure_direction=1))


_MARKS = [60, 120, 300, 600, 900, 1200, 1800, 2400, 2700, 2940, 3000]


@query(
    f"""WITH v AS (SELECT {DAY} AS interval_start, section, ttl FROM rr) SELECT interval_start, section, value, count_if(ttl <= value) AS n, true AS within FROM v, unnest({_MARKS}) AS t(value) GROUP BY ALL""",
    "rr",
)
def ttl_distribution_rolled_up(spark, d):
    """Days' distributions of times to live from their hours: no share is wrong by more than 1.5 percent."""
    values = fx.dns_records(spark, d).select("ts", "section", F.col("ttl").alias("value"))
    days = rollups.merged_distributions(rollups.distribution_sketches(values, by=("section",)), "1 day", ("section",))
    table = rollups.distribution_table(days, _MARKS, ("section",))
    day = net.interval_start("ts", "1 day").alias("interval_start")
    exact = values.groupBy(day, "section").agg(F.count("*").alias("all"), *(F.count_if(F.col("value") <= m).alias(f"m{m}") for m in _MARKS))
    exact = exact.select("interval_start", "section", "all", F.explode(F.create_map(*(x for m in _MARKS for x in (F.lit(m), F.col(f"m{m}"))))).alias("value", "n"))
    both = exact.join(table, ["interval_start", "section", "value"])
    return both.select("interval_start", "section", "value", "n", (F.abs(F.col("n") / F.col("all") - F.col("share")) <= 0.015).alias("within"))


# --- report lines -----------------------------------------------------------

@query(
    f"""{_stats_sql(False)} SELECT concat_ws(' ', 'qtype_ctr_A:' || type_A, 'qtype_ctr_DLV:' || type_DLV, 'rtype_ctr_RRSIG:' || answer_type_RRSIG, 'edns0_ctr_EDNS0_512_TO_999:' || edns_size_from_512, 'EDNS0_TOTAL:' || edns_present,
  'EDNS0_PCT_GT_4500:' || CASE WHEN edns_present = 0 THEN 0 ELSE edns_size_from_4500 * 100 // edns_present END, 'QUERY_TOTAL:' || queries, 'RSIZE_3584_TO_4095:' || response_size_from_3584, 'RCODE_NODATA:' || rcode_NODATA, 'RFLAGS_TC:' || responses_truncated) AS value FROM s""",
    "m",
)
def log_key_values(spark, d):
    """Ten of the keys of each line; the test of the names counts them all."""
    stats = traffic.with_percentages(traffic.dns_statistics(fx.dns_message_lists(spark, d), [], "1 day"))
    some = ("type_A", "type_DLV", "answer_type_RRSIG", "edns_size_from_512", "edns_present", "pct_edns_size_from_4500", "queries", "response_size_from_3584", "rcode_NODATA", "responses_truncated")
    return sinks.key_value_lines(stats, keys={c: k for c, k in sinks.row_keys().items() if c in some})


@query(
    f"""{_stats_sql(True)}, l AS (SELECT unnest(['qtype.ctr.MX ' || type_MX, 'rfrag.ctr.v6.frag ' || responses_fragmented_v6, 'rfrag.pct.v4.frag ' || printf('%.2f', CASE WHEN responses_sized_v4 = 0 THEN 0 ELSE round(100 * responses_fragmented_v4 / responses_sized_v4, 2) END),
  'notify.req.ctr ' || notify, 'rcode.ctr.REFERRAL ' || rcode_REFERRAL]) AS v FROM s) SELECT 'host ' || v AS value FROM l""",
    "m",
)
def log_host_key_values(spark, d):
    some = ("type_MX", "responses_fragmented_v6", "pct_fragmented_v4", "notify", "rcode_REFERRAL")
    return sinks.key_value_lines(traffic.rates_by_version(fx.dns_message_lists(spark, d), [], "1 day"), "host", {c: k for c, k in sinks.item_keys().items() if c in some})


@query(
    f"""WITH c AS (SELECT {DAY} AS interval_start, qname AS key, count(*) AS n FROM q WHERE {_USABLE} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY interval_start ORDER BY n DESC, key) AS rank, sum(n) OVER (PARTITION BY interval_start) AS t FROM c)
SELECT interval_start, 'qname' AS kind, CAST(rank AS INTEGER) AS rank, printf('%d - %s %d (%.2f%%)', rank, key, n, round(100 * n / t, 2)) AS value FROM r WHERE rank <= 5""".replace("r AS", "top AS").replace("FROM r ", "FROM top "),
    "q",
)
def log_top_names(spark, d):
    q = popularity.query_popularity(fx.dns_queries(spark, d), "1 day", None, 0, 0, 0, 0, 5, 0)
    return sinks.top_lines(q)


@query(
    f"""WITH {_PFX}, a AS (SELECT {DAY} AS interval_start, count(*) AS queries, count(DISTINCT qname) AS names FROM q WHERE {_USABLE} GROUP BY 1),
b AS (SELECT {DAY} AS interval_start, count(DISTINCT prefix || ':' || qname) AS prefix_names FROM p GROUP BY 1),
c AS (SELECT {DAY} AS interval_start, count(DISTINCT s) AS suffixes FROM (SELECT ts, unnest([qname, substr(qname, strpos(qname, '.') + 1), 'example.']) AS s FROM q WHERE {_USABLE}) GROUP BY 1),
t AS (SELECT * FROM a JOIN b USING (interval_start) JOIN c USING (interval_start))
SELECT interval_start, 0 AS place, 'Global count: ' || names AS value FROM t UNION ALL SELECT interval_start, 1, 'Global composite count: ' || prefix_names FROM t UNION ALL SELECT interval_start, 2, 'Global label count: ' || suffixes FROM t
UNION ALL SELECT interval_start, 3, 'Global query count: ' || queries FROM t UNION ALL SELECT interval_start, 4, '' FROM t UNION ALL SELECT interval_start, 5, 'prefix,uniqcount' FROM t
UNION ALL SELECT {DAY}, 6, prefix || ',' || count(DISTINCT qname) FROM p GROUP BY {DAY}, prefix""",
    "q",
)
def log_prefix_counts(spark, d):
    q = fx.dns_queries(spark, d)
    return sinks.prefix_lines(unique.names_by_prefix(q, None, "1 day", exact=True), unique.global_names(q, None, "1 day", exact=True))


@query(
    """WITH c AS (SELECT CAST(time_bucket(INTERVAL 1 day, ts) AS TIMESTAMP) AS i, * FROM q WHERE ip_dst <> '192.0.2.54')
SELECT strftime(i, '%Y-%m-%d %H:%M:%S') || ';' || CAST(epoch(i) AS BIGINT) || ';' || count(DISTINCT ip_src) || ';' || count(*) || ';' || count(DISTINCT CASE WHEN ip_type = 4 THEN ip_src END) || ';' || count_if(ip_type = 4) || ';'
  || count(DISTINCT CASE WHEN ip_type = 6 THEN ip_src END) || ';' || count_if(ip_type = 6) AS value FROM c GROUP BY i""",
    "q",
)
def log_unique_clients(spark, d):
    return sinks.unique_clients_line(unique.unique_clients(fx.dns_messages(spark, d), RESOLVERS).where("period = 'day'"))


@query(
    f"""WITH {_FLAGS}, g AS (SELECT *, rrsig_answer + rrsig_authority + rrsig_additional AS n FROM f),
s AS (SELECT {DAY} AS interval_start, sum(rrsig_answer)::BIGINT AS a, sum(rrsig_authority)::BIGINT AS b, sum(rrsig_additional)::BIGINT AS c, coalesce(sum(CASE WHEN aa THEN n END), 0)::BIGINT AS d, count_if(n > 0) AS e, count_if(n > 0 AND tc) AS h FROM g GROUP BY 1),
x AS (SELECT {DAY} AS interval_start, count_if(NOT qr) AS qi, count_if(qr) AS ro FROM m WHERE is_valid AND CASE WHEN qr THEN ip_src ELSE ip_dst END IN ('192.0.2.53', '2001:db8:ffff::53') GROUP BY 1)
SELECT interval_start, 0 AS place, concat_ws(chr(9), printf('%.3f', epoch(interval_start)), qi, 0, 0, ro, 0, coalesce(e, 0), 0, 0, coalesce(h, 0), coalesce(a + b + c, 0), coalesce(a, 0), coalesce(b, 0), coalesce(c, 0), coalesce(d, 0), CASE WHEN qi > 0 THEN '100.00' ELSE '0.00' END) AS value
FROM x LEFT JOIN s USING (interval_start)""",
    "m", "rr",
)
def log_resolver(spark, d):
    counters = resolver.resolver_counters(fx.dns_messages(spark, d), RESOLVERS, None, "1 day")
    return sinks.resolver_lines(counters, resolver.signature_totals(resolver.message_flags(fx.dns_records(spark, d)), "1 day"))


_SIDE = "concat_ws(chr(9), " + ", ".join(f"coalesce(sum(CASE WHEN {{0}} = '{x}' THEN 1 END), 0)::BIGINT" for x in ("NOERROR", "NODATA", "REFERRAL", "FORMERR", "SERVFAIL", "NXDOMAIN", "NOTIMPL", "REFUSED")) + ")"


@query(
    f"""WITH {_FLAGS}, o AS (SELECT {DAY} AS interval_start, CASE WHEN rcode = 0 AND ans_count = 0 AND has_soa THEN 'NODATA' WHEN rcode = 0 AND ans_count = 0 AND has_ns THEN 'REFERRAL' ELSE {_RC} END AS a,
  CASE WHEN rcode = 0 AND ans_count = 0 AND ns_first THEN 'REFERRAL' WHEN rcode = 0 AND ans_count = 0 AND has_soa THEN 'NODATA' ELSE {_RC} END AS b FROM f)
SELECT interval_start, 0 AS place, {_SIDE.format('a')} || chr(9) || chr(9) || {_SIDE.format('b')} AS value FROM o GROUP BY 1""",
    "rr",
)
def log_outcomes(spark, d):
    f = resolver.message_flags(fx.dns_records(spark, d))
    return sinks.outcome_lines(resolver.outcomes(f, "resolver", "1 day"), resolver.outcomes(f, "client", "1 day"))
