"""Result writers: projections to log rows, text lines, and files partitioned by day or hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import net
from .operators import filters


def _seconds(ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --- rows of logs ---------------------------------------------------------


def query_log(dns: DataFrame) -> DataFrame:
    """Compact query log; a missing question is (null), -1, -1 and missing EDNS0 zeros."""
    q = filters.queries(dns.where("is_valid"))
    return q.select(
        net.timestamp_text("ts").alias("timestamp"), F.col("ip_src").alias("src_ip"), F.coalesce("qname", F.lit("(null)")).alias("qname"), F.coalesce("qclass", F.lit(-1)).alias("qclass"), F.coalesce("qtype", F.lit(-1)).alias("qtype"),
        "has_edns0", F.when(F.col("has_edns0"), F.col("edns0_max_size")).otherwise(0).alias("edns0_bufsize"), (F.col("has_edns0") & F.col("edns0_do")).alias("edns0_do"), "is_tcp",
    )


def query_response_log(dns: DataFrame) -> DataFrame:
    """seq, part, pos, timestamp, client, class, type, name, rcode: a row for each question (Q(Q), Q(R)) and record (R(ANS), R(AUT), R(ADD)).

    Needs the arrays questions, answers, authorities and additionals of decoded messages.
    """
    client = F.when(F.col("qr"), F.col("ip_dst")).otherwise(F.col("ip_src"))

    def entries(column: str, kind: Column, klass: str, type_: str, name) -> Column:
        return F.transform(column, lambda e, i: F.struct(kind.alias("part"), i.alias("pos"), e[klass].alias("class"), e[type_].alias("type"), name(e).alias("name")))

    record = lambda e: F.coalesce(e["rdata_txt"], e["name"])
    asked = entries("questions", F.when(F.col("qr"), "Q(R)").otherwise("Q(Q)"), "qclass", "qtype", lambda e: e["qname"])
    held = [F.when(F.col("qr"), entries(column, F.lit(kind), "class", "type", record)) for kind, column in (("R(ANS)", "answers"), ("R(AUT)", "authorities"), ("R(ADD)", "additionals"))]
    # all lists as one, so that messages are decoded once
    each = F.explode(F.flatten(F.array_compact(F.array(asked, *held)))).alias("e")
    out = dns.where("qr is not null").select("seq", _seconds().alias("timestamp"), client.alias("client"), "rcode", each)
    return out.select(
        "seq", "e.part", "e.pos", "timestamp", "client", net.qclass_name("e.class").alias("class"), net.qtype_name("e.type").alias("type"), "e.name", net.rcode_name("rcode").alias("rcode")
    )


def _dated(dns: DataFrame, *columns: Column | str) -> DataFrame:
    return dns.select(F.to_date("ts").alias("date"), _seconds().alias("timestamp"), "qtype", F.col("ip_src").alias("q_src"), *columns)


def as_log(dns: DataFrame) -> DataFrame:
    return _dated(filters.queries(dns.where("is_valid")), F.col("as_short").alias("q_as"), "qname")


def subnet_log(dns: DataFrame) -> DataFrame:
    """Queries with a client subnet; needs the columns of the source's and the subnet's AS and country."""
    q = filters.with_client_subnet(filters.queries(dns.where("is_valid")))
    return _dated(
        q, "ecs_ip", F.col("ecs_src_scope").alias("ecs_scope"), F.col("as_short").alias("q_as"), F.col("country").alias("q_geoip"), F.col("ecs_as_short").alias("ecs_ip_as"), F.col("ecs_as_prefix").alias("ecs_ip_prefix"),
        F.col("ecs_country").alias("ecs_ip_geoip"), "qname",
    )


def no_subnet_log(dns: DataFrame) -> DataFrame:
    q = filters.with_client_subnet(filters.queries(dns.where("is_valid")), present=False)
    return _dated(q, F.col("cidr_desc").alias("q_cidr_desc"), "has_edns0", "qname")


def dnskey_log(dns: DataFrame) -> DataFrame:
    """date, fqdn, flags, protocol, algorithm, bitsize, n, e of DNSKEY answers."""
    from .operators.decode import dnskeys

    return dnskeys(filters.dnskey_answers(dns))


def denat_log(dns: DataFrame) -> DataFrame:
    """Queries and responses over UDP and IPv4, with the client's address and port."""
    u = filters.udp_ipv4(dns.where("is_valid"))
    side = lambda a, b: F.when(F.col("qr"), F.col(a)).otherwise(F.col(b))
    return u.select(
        _micros().alias("timestamp"), side("ip_dst", "ip_src").alias("client_ip"), side("dstport", "srcport").alias("client_port"), F.col("query_id").alias("dns_qid"), F.col("qtype").alias("dns_qtype"), F.col("qclass").alias("dns_qclass"),
        F.col("qname").alias("dns_qname"), F.col("has_edns0").alias("dns_edns0"), F.col("edns0_do").alias("dns_edns0_do"), F.col("edns0_max_size").alias("dns_edns0_maxsize"), F.col("qr").alias("is_response"),
    )


def _denat(u: DataFrame, client: str, port: Column, *more: Column) -> DataFrame:
    number = lambda c: F.col(c).cast("int")
    return u.select(
        F.date_format("ts", "yyyy-MM-dd-HH").alias("hour"), (_micros() / 1_000_000).alias("timestamp"), F.col(client).alias("client_ip"), number("ip_id").alias("ip_ipid"), number("ttl").alias("ip_ttl"), port,
        number("query_id").alias("dns_qid"), number("qtype").alias("dns_qtype"), number("qclass").alias("dns_qclass"), F.col("qname").alias("dns_qname"), *more,
        F.coalesce(number("has_edns0"), F.lit(0)).alias("dns_edns0"), F.coalesce(number("edns0_do"), F.lit(0)).alias("dns_edns0_do"), F.coalesce(number("edns0_max_size"), F.lit(0)).alias("dns_edns0_maxsize"),
    )


def denat_queries(dns: DataFrame) -> DataFrame:
    """hour and the columns of a de-NAT query file, of decoded queries over UDP and IPv4."""
    u = filters.queries(filters.udp_ipv4(dns.where("is_valid")))
    return _denat(u, "ip_src", F.col("srcport").cast("int").alias("udp_srcport"))


def denat_responses(dns: DataFrame) -> DataFrame:
    """hour and the columns of a de-NAT response file; first_response_ttl is -1 without answers."""
    u = filters.responses(filters.udp_ipv4(dns.where("is_valid")))
    first = F.coalesce(F.get("answers", F.lit(0)).getField("ttl"), F.lit(-1)).cast("int").alias("first_response_ttl")
    return _denat(u, "ip_dst", F.col("dstport").cast("int").alias("udp_dstport"), first)


def source_log(dns: DataFrame) -> DataFrame:
    return filters.queries(dns).select(_micros().alias("ts_us"), "ip_src")


def answer_names(dns: DataFrame) -> DataFrame:
    """Owner names of authoritative answers."""
    return filters.authoritative_answers(dns).select(F.explode("answers.name").alias("name"))


def role_log(roles: DataFrame) -> DataFrame:
    return roles.select("role", _seconds().alias("ts"), F.col("ip_src").alias("src"), F.col("ip_dst").alias("dst"), "qname")


def forwarded(dns: DataFrame, domains: list[str] | None = None, servers: list[str] | DataFrame | None = None) -> DataFrame:
    """Questions under the domains (none: all) of queries to the servers (none, or '*': all).

    A question that is taken takes those behind it in its message along.
    """
    q = filters.to_addresses(filters.queries(dns), servers)
    if not domains:
        q = filters.each_question(q)
    elif "questions" in dns.columns:
        under = lambda x: net.ends_with_any(x["qname"], domains)
        first = F.array_position(F.transform("questions", lambda x: F.coalesce(under(x), F.lit(False))), True).cast("int")
        some = q.where(first > 0)
        q = filters.each_question(some.withColumn("questions", F.slice("questions", first, F.size("questions"))))
    else:
        q = filters.under_domains(q, domains)
    return q.select("qclass", "qtype", "is_tcp", net.is_dnssec("qtype").alias("dnssec"), "qname", F.col("ip_src").alias("client"))


def membership_tuples(dns: DataFrame) -> DataFrame:
    """address, name, class, type of each question of each whole query, for a membership filter."""
    whole = filters.queries(dns).where("is_valid and not is_partial")
    return whole.select(F.col("ip_src").alias("address"), F.explode("questions").alias("q")).select("address", F.col("q.qname").alias("name"), F.col("q.qclass").alias("class"), F.col("q.qtype").alias("type"))


def dnstap(dns: DataFrame, identity: str, version: str) -> DataFrame:
    """Fields of a CLIENT_QUERY message; ``dnstap_bytes`` makes its bytes."""
    return filters.queries(dns).select(
        F.lit(identity).alias("identity"), F.lit(version).alias("version"), F.lit("CLIENT_QUERY").alias("type"), _seconds().alias("query_time_sec"), (F.pmod(_micros(), F.lit(1_000_000)) * 1000).alias("query_time_nsec"),
        F.when(F.col("ip_type") == 4, "INET").otherwise("INET6").alias("socket_family"), F.when(F.col("is_tcp"), "TCP").otherwise("UDP").alias("socket_protocol"), F.col("src_addr").alias("query_address"), F.col("srcport").alias("query_port"),
        F.col("payload").alias("query_message"),
    )


def _varint(n: Column, groups: int = 5) -> Column:
    """A whole number of at most 7 * ``groups`` bits, seven a byte, lowest first."""
    n = n.cast("long")
    cells = []
    for i in range(groups):
        here, more = F.shiftrightunsigned(n, 7 * i), F.shiftrightunsigned(n, 7 * (i + 1)) > 0
        cell = F.lpad(F.hex(here.bitwiseAND(F.lit(127)) + F.when(more, 128).otherwise(0)), 2, "0")
        cells.append(cell if i == 0 else F.when(here > 0, cell).otherwise(""))
    return F.unhex(F.concat(*cells))


def _tag(number: int, kind: int) -> Column:
    return F.unhex(F.lit(f"{number << 3 | kind:02x}"))


def _field(number: int, value: Column, kind: int = 2) -> Column:
    """A protobuf field: kind 0 a number, 2 bytes, 5 four bytes lowest first; nothing for null."""
    if kind == 0:
        body = _varint(value)
    elif kind == 5:
        h = F.lpad(F.hex(value.cast("long")), 8, "0")
        body = F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))
    else:
        value = value.cast("binary")
        body = F.concat(_varint(F.octet_length(value)), value)
    return F.coalesce(F.concat(_tag(number, kind), body), F.unhex(F.lit("")))


def dnstap_bytes(tap: DataFrame) -> DataFrame:
    """``value``: each row of ``dnstap`` as a serialised message, by its published field numbers."""
    # fixed values: message type 1 in 15, CLIENT_QUERY 5, INET 1, INET6 2, UDP 1, TCP 2
    message = F.concat(
        _field(1, F.lit(5), 0), _field(2, F.when(F.col("socket_family") == "INET", 1).otherwise(2), 0), _field(3, F.when(F.col("socket_protocol") == "UDP", 1).otherwise(2), 0), _field(4, F.col("query_address")),
        _field(6, F.col("query_port"), 0), _field(8, F.col("query_time_sec"), 0), _field(9, F.col("query_time_nsec"), 5), _field(10, F.col("query_message")),
    )
    held = tap.select("identity", "version", message.alias("message"))
    return held.select(F.concat(_field(1, F.col("identity")), _field(2, F.col("version")), _field(14, F.col("message")), _field(15, F.lit(1), 0)).alias("value"))


# --- text lines -----------------------------------------------------------


def line_protocol(metrics: DataFrame) -> DataFrame:
    """name,host=H value=V ns, one line for each metric row."""
    ns = _micros("interval_start") * 1000
    return metrics.select(F.concat(F.col("metric"), F.lit(",host="), F.col("host"), F.lit(" value="), F.col("value").cast("string"), F.lit(" "), ns.cast("string")).alias("value"))


def _ranges(bounds: tuple[int, ...], below: str, between: str, above: str) -> list[str]:
    """Names of size classes: below the first bound, between neighbours, from the last one on."""
    return [below.format(bounds[0]), *(between.format(a, b - 1) for a, b in zip(bounds, bounds[1:])), above.format(bounds[-1])]


def row_keys() -> dict[str, str]:
    """Key of each column of with_percentages(dns_statistics) in key:value lines; names are fixed, by their rule."""
    from .operators.traffic import EDNS_SIZES, RESPONSE_SIZES, ROW_TYPES

    keys = {}
    for side, name in (("", "q"), ("answer_", "r")):
        for what, codes in (("class", net.QCLASSES), ("type", ROW_TYPES)):
            keys |= {f"{side}{what}_{x}": f"{name}{what}_ctr_{x}" for x in ("UNSPECIFIED", *codes.values(), "UNKNOWN")}
    keys |= {"queries_v4": "iptype_ctr_V4", "queries_v6": "iptype_ctr_V6", "queries_tcp": "proto_ctr_TCP", "queries_udp": "proto_ctr_UDP", "edns_absent": "edns0_ctr_EDNS0_NO"}
    edns = [f"edns_size_below_{EDNS_SIZES[0]}", *(f"edns_size_from_{x}" for x in EDNS_SIZES)]
    keys |= dict(zip(edns, ("edns0_ctr_EDNS0_" + x for x in _ranges(EDNS_SIZES, "BELOW_{}", "{}_TO_{}", "ABOVE_{}"))))
    states = {"do": "DO_SET", "no_do": "DO_UNSET", "no_subnet": "WO_ECS", "subnet": "W_ECS"}
    keys |= {f"edns_{k}": f"edns0_ctr_EDNS0_{v}" for k, v in states.items()} | {"edns_experimental": "edns0_ctr_EDNS0_EXP_OPT", "edns_present": "EDNS0_TOTAL"}
    keys |= {"pct_edns_on": "EDNS0_PCT_ON", "pct_edns_off": "EDNS0_PCT_OFF"} | dict(zip((f"pct_{x}" for x in edns), ("EDNS0_PCT_" + x for x in _ranges(EDNS_SIZES, "LT_{}", "{}_{}", "GT_{}"))))
    keys |= {f"pct_edns_{k}": f"EDNS0_PCT_{v}" for k, v in states.items()} | {"queries": "QUERY_TOTAL"}
    sizes = [f"response_size_below_{RESPONSE_SIZES[0]}", *(f"response_size_from_{x}" for x in RESPONSE_SIZES)]
    keys |= dict(zip(sizes, ("RSIZE_" + x for x in _ranges(RESPONSE_SIZES, "BELOW_{}", "{}_TO_{}", "ABOVE_{}")))) | {"response_bytes": "RSIZE_TOTAL", "responses_sized": "RSIZE_COUNTED"}
    keys |= {f"rcode_{x}": f"RCODE_{x}" for x in ("NOERROR", "NODATA", *list(net.RCODES.values())[1:], "UNKNOWN")}
    keys |= {"responses_fragmented": "R_FRAG", "responses_whole": "R_UNFRAG", "pct_fragmented": "R_FRAG_PCT", "pct_whole": "R_UNFRAG_PCT", "responses": "R_FRAG_UNFRAG_TOTAL"}
    keys |= dict(zip((f"pct_{x}" for x in sizes), ("RSIZE_PCT_" + x for x in _ranges(RESPONSE_SIZES, "LT_{}", "{}_{}", "GT_{}"))))
    return keys | {"response_mean_size": "RSIZE_AVERAGE", "responses_truncated": "RFLAGS_TC"}


def item_keys() -> dict[str, str]:
    """Key of each column of rates_by_version in host-key-value lines; names are fixed, by their rule."""
    from .operators.traffic import EDNS_SIZES, RESPONSE_SIZES, ROW_TYPES

    keys = {}
    for side, name in (("", "q"), ("answer_", "r")):
        for what, codes in (("class", net.QCLASSES), ("type", ROW_TYPES)):
            keys |= {f"{side}{what}_{x}": f"{name}{what}.ctr.{x}" for x in ("UNSPECIFIED", *codes.values(), "UNKNOWN")}
    keys |= {"queries_v4": "iptype.ctr.V4", "queries_v6": "iptype.ctr.V6", "queries_tcp": "proto.ctr.TCP", "queries_udp": "proto.ctr.UDP", "edns_absent": "edns0.ctr.NO", "edns_experimental": "edns0.ctr.exp_opt", "edns_present": "edns0.ctr.total"}
    keys |= {"pct_edns_on": "edns0.pct.on", "pct_edns_off": "edns0.pct.off", "queries": "query.ctr.total"}
    states = {"do": "do_set", "no_do": "do_unset", "no_subnet": "wo_ecs", "subnet": "w_ecs"}
    for column, name, bounds in (("edns_size", "edns0", EDNS_SIZES), ("response_size", "rsize", RESPONSE_SIZES)):
        columns = [f"{column}_below_{bounds[0]}", *(f"{column}_from_{x}" for x in bounds)]
        for prefix, kind in (("", "ctr"), ("pct_", "pct")):
            keys |= dict(zip((prefix + c for c in columns), (f"{name}.{kind}.{x}" for x in _ranges(bounds, "below{}", "{}to{}", "above{}"))))
    for prefix, kind in (("", "ctr"), ("pct_", "pct")):
        keys |= {f"{prefix}edns_{k}": f"edns0.{kind}.{v}" for k, v in states.items()}
    keys |= {f"rcode_{x}": f"rcode.ctr.{x}" for x in ("NOERROR", "NODATA", "REFERRAL", *list(net.RCODES.values())[1:], "UNKNOWN")}
    keys |= {"responses_fragmented": "rfrag.ctr.frag", "responses_whole": "rfrag.ctr.unfrag", "responses_fragmented_v4": "rfrag.ctr.v4.frag", "responses_fragmented_v6": "rfrag.ctr.v6.frag", "responses": "rfrag.ctr.total"}
    keys |= {"pct_fragmented": "rfrag.pct.frag", "pct_whole": "rfrag.pct.unfrag", "pct_fragmented_v4": "rfrag.pct.v4.frag", "pct_fragmented_v6": "rfrag.pct.v6.frag"}
    keys |= {"response_bytes": "rsize.ctr.total", "responses_sized": "rsize.ctr.counted", "response_mean_size": "rsize.avg", "responses_truncated": "rflags.ctr.tc", "notify": "notify.req.ctr", "notify_answers": "notify.ans.ctr"}
    # one class is named by a rounded bound
    return {k: "rsize.ctr.512to1024" if v == "rsize.ctr.512to1023" else v for k, v in keys.items()}


def _named(stats: DataFrame, keys: dict[str, str] | None) -> dict[str, str]:
    return {c: c for c in stats.columns[1:]} if keys is None else {c: k for c, k in keys.items() if c in stats.columns}


def key_value_lines(stats: DataFrame, host: str | None = None, keys: dict[str, str] | None = None) -> DataFrame:
    """'key:value' pairs of each wide row in one line, or 'host key value' lines if a host is given.

    Keys are the columns behind the first one, or those that ``keys`` names, in its order
    (``row_keys``, ``item_keys``).  Counts are written as whole numbers, others with two decimals.
    """
    at, named = stats.columns[0], _named(stats, keys)
    kinds = dict(stats.dtypes)
    text = lambda c: F.format_string("%.2f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    if host is None:
        return stats.select(F.concat_ws(" ", *(F.concat(F.lit(f"{k}:"), text(c)) for c, k in named.items())).alias("value"))
    long = stats.select(at, *(text(c).alias(k) for c, k in named.items())).unpivot([at], None, "metric", "n")
    return long.select(F.concat_ws(" ", F.lit(host), "metric", "n").alias("value"))


def tab_lines(table: DataFrame, columns: dict[str, str], number: str = "place") -> DataFrame:
    """interval_start, place and value: the columns tab-separated, each with its format; place is the row's own column of that name."""
    cells = [F.format_string(form, F.col(c)) for c, form in columns.items()]
    return table.select("interval_start", F.col(number).cast("int").alias("place"), F.concat_ws("\t", *cells).alias("value"))


def resolver_lines(counters: DataFrame, signatures: DataFrame) -> DataFrame:
    """interval_start, place, value of resolver_counters and signature_totals, in the order time, queries in and out, responses in and out, authoritative and signed responses, fragments, truncated and truncated signed responses, signatures in all, by section and of authoritative messages, cache hit ratio."""
    both = counters.join(signatures, "interval_start", "left").withColumn("rrsig_all", F.col("rrsig_answer") + F.col("rrsig_authority") + F.col("rrsig_additional"))
    order = (
        "queries_in", "queries_out", "responses_in", "responses_out", "authoritative_in", "signed_responses", "fragments_in", "truncated_in", "signed_truncated", "rrsig_all", "rrsig_answer", "rrsig_authority", "rrsig_additional", "rrsig_authoritative"
    )
    both = both.select("interval_start", F.lit(0).alias("place"), (_micros("interval_start") / 1_000_000).alias("time"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in order), F.coalesce("cache_hit_ratio", F.lit(0.0)).alias("ratio"))
    return tab_lines(both, {"time": "%.3f"} | dict.fromkeys(order, "%d") | {"ratio": "%.2f"})


def name_lines(ranked: DataFrame) -> DataFrame:
    """interval_start, place, value: rank, count and name."""
    return tab_lines(ranked, {"rank": "%d", "n": "%d", "key": "%s"}, "rank")


def ttl_lines(distribution: DataFrame) -> DataFrame:
    """interval_start, place, value: time to live, count and share so far, with ten decimals."""
    return tab_lines(distribution, {"ttl": "%d", "n": "%d", "cdf": "%.10f"}, "ttl")


def signature_lines(histogram: DataFrame) -> DataFrame:
    return tab_lines(histogram, {"signatures": "%d", "responses": "%d"}, "signatures")


def outcome_lines(servers: DataFrame, clients: DataFrame) -> DataFrame:
    """interval_start, place, value: counts of outcomes of servers' responses, an empty cell, and those of responses to clients."""
    labels = ("NOERROR", "NODATA", "REFERRAL", *list(net.RCODES.values())[1:])
    both = servers.select("interval_start", F.lit("s").alias("side"), "label", "n").unionByName(clients.select("interval_start", F.lit("c").alias("side"), "label", "n"))
    cells = [F.coalesce(F.sum(F.when((F.col("side") == side) & (F.col("label") == x), F.col("n"))), F.lit(0)).cast("string").alias(f"{side}_{x}") for side in "sc" for x in labels]
    wide = both.groupBy("interval_start").agg(*cells)
    sides = [F.concat_ws("\t", *(F.col(f"{side}_{x}") for x in labels)) for side in "sc"]
    return wide.select("interval_start", F.lit(0).alias("place"), F.concat_ws("\t\t", *sides).alias("value"))


def prefix_lines(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """interval_start, place, value: four totals of global_names, an empty line, a header, and prefix,count lines of names_by_prefix."""
    labels = (("Global count: ", "names"), ("Global composite count: ", "prefix_names"), ("Global label count: ", "suffixes"), ("Global query count: ", "queries"))
    head = [F.struct(F.lit(i).alias("place"), F.concat(F.lit(text), F.col(c).cast("string")).alias("value")) for i, (text, c) in enumerate(labels)]
    head += [F.struct(F.lit(4).alias("place"), F.lit("").alias("value")), F.struct(F.lit(5).alias("place"), F.lit("prefix,uniqcount").alias("value"))]
    top = totals.select("interval_start", F.explode(F.array(*head)).alias("e")).select("interval_start", "e.place", "e.value")
    return top.unionByName(counts.select("interval_start", F.lit(6).alias("place"), F.concat_ws(",", "prefix", F.col("names").cast("string")).alias("value")))


def top_lines(ranked: DataFrame) -> DataFrame:
    """'rank - key count (percent%)'."""
    return ranked.select("interval_start", "kind", "rank", F.format_string("%d - %s %d (%.2f%%)", "rank", "key", "n", "percent").alias("value"))


def unique_clients_line(stats: DataFrame) -> DataFrame:
    """ts;epoch;ips;queries;v4 ips;v4 queries;v6 ips;v6 queries."""
    epoch = F.unix_seconds(F.col("interval_start").cast("timestamp"))
    cells = ("clients", "messages", "clients_v4", "messages_v4", "clients_v6", "messages_v6")
    return stats.select(F.concat_ws(";", F.date_format("interval_start", "yyyy-MM-dd HH:mm:ss"), epoch.cast("string"), *(F.col(c).cast("string") for c in cells)).alias("value"))


def summary(metrics: DataFrame, labels: dict[str, str]) -> DataFrame:
    """label and value of chosen metrics."""
    chosen = metrics.where(F.col("metric").isin(list(labels)))
    name = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return chosen.select(F.element_at(name, F.col("metric")).alias("label"), "value")


# --- files ----------------------------------------------------------------


def write_csv(df: DataFrame, path: str, by: str | None = None, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV with a header, in one folder for each value of ``by`` (a date or an hour)."""
    w = df.write.mode(mode).option("header", True).option("sep", sep)
    (w.partitionBy(by) if by else w).csv(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("value").write.mode(mode).text(path)


def write_hourly_json(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with a ``timestamp`` in seconds, one folder for each hour."""
    hour = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd-HH").alias("hour")
    records.select("*", hour).write.mode(mode).partitionBy("hour").json(path)


def write_parquet(df: DataFrame, path: str, interval: str, ts: str = "ts", mode: str = "overwrite") -> None:
    """Rows in one folder for each interval."""
    start = F.date_format(net.interval_start(ts, interval), "yyyy-MM-dd-HH-mm").alias("interval")
    df.select("*", start).write.mode(mode).partitionBy("interval").parquet(path)
