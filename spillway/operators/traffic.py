"""Counters of queries and responses in each interval, as one wide row or as named metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from .enrich import cidr_match
from .filters import for_servers, valid

#: Lower bounds of response size classes, and of advertised buffer sizes.
RESPONSE_SIZES = tuple(range(512, 4097, 512))
EDNS_SIZES = (512, *range(1000, 4501, 500))


def buckets(column: Column, bounds: tuple[int, ...], name: str, where: Column) -> list[Column]:
    """Counts below the first bound, between neighbouring bounds, and from the last one on."""
    cuts = [None, *bounds, None]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        fits = where
        if low is not None:
            fits = fits & (column >= low)
        if high is not None:
            fits = fits & (column < high)
        label = f"below_{high}" if low is None else f"from_{low}"
        out.append(F.count_if(fits).alias(f"{name}_{label}"))
    return out


#: Types that the wide row counts by name: all but those that its format lacks.
ROW_TYPES = {k: v for k, v in net.QTYPES.items() if v not in ("TLSA", "CAA")}
NOTIFY = 4


def _each_item(m: DataFrame) -> DataFrame:
    """A row for each question of a query and each record of a response's answer section, at least one for each message.

    Adds ``item`` (type and class, null without any) and ``first``, set in one row of each
    message, by which messages are counted.  Messages without a list of questions have
    their first one in qname, qtype and qclass; without a list of answers none is counted.
    """
    pair = lambda kind, klass: F.struct(kind.cast("int").alias("type"), klass.cast("int").alias("class"))
    none = F.array().cast("array<struct<type:int,class:int>>")
    if "questions" in m.columns:
        asked = F.transform("questions", lambda x: pair(x["qtype"], x["qclass"]))
    else:
        asked = F.when(F.col("qname").isNotNull(), F.array(pair(F.col("qtype"), F.col("qclass")))).otherwise(none)
    answered = F.transform("answers", lambda x: pair(x["type"], x["class"])) if "answers" in m.columns else none
    rest = [c for c in m.columns if c not in ("questions", "answers", "authorities", "additionals", "item", "first")]
    out = m.select(*rest, F.posexplode_outer(F.when(F.col("qr"), answered).otherwise(asked)).alias("_pos", "item"))
    return out.withColumn("first", F.coalesce(F.col("_pos"), F.lit(0)) == 0).drop("_pos")


def _codes(field: str, names: dict[int, str], prefix: str, where: Column, unspecified: bool = True, suffix: str = "") -> list[Column]:
    """Counts by name; code 0 has a counter of its own or is unknown."""
    c = F.col("item")[field]
    where = where & F.col("item").isNotNull()
    known = [F.count_if(where & (c == k)).alias(f"{prefix}_{v}{suffix}") for k, v in names.items()]
    if unspecified:
        known.append(F.count_if(where & (F.coalesce(c, F.lit(0)) == 0)).alias(f"{prefix}_UNSPECIFIED{suffix}"))
    listed = [*names, 0] if unspecified else list(names)
    return [*known, F.count_if(where & ~F.coalesce(c, F.lit(0)).isin(listed)).alias(f"{prefix}_UNKNOWN{suffix}")]


def dns_statistics(dns: DataFrame, listen_ips: list[str] | None = None, interval: str = "60 seconds", dialect: str = "simple", notify_apart: bool = False) -> DataFrame:
    """One row for each interval: counts of questions by class and type, of queries by IP version, transport and EDNS0, of answer records by class and type, and of responses by outcome, size and fragmentation.

    All counters are sums in one aggregation, so a message is read once and shuffled never.
    Valid messages count, partial ones too, and each question of a query.  ``notify_apart``:
    NOTIFY messages count in their own counters instead of a type or an outcome.
    ``dialect`` names outcomes as net.rcode_label does.
    """
    m = _each_item(for_servers(valid(dns), listen_ips))
    first, notify = F.col("first"), F.col("opcode") == NOTIFY
    q, r = ~F.col("qr") & first, F.col("qr") & first
    asked = ~F.col("qr") & ~notify if notify_apart else ~F.col("qr")
    sized = r & (F.col("udp_len") > 0)
    edns = q & F.col("has_edns0")
    answer_notify = r & notify & (F.col("rcode") == 0)
    label = net.rcode_label(dialect)
    outcome = r & ~answer_notify if notify_apart else r
    v4, v6 = F.col("ip_type") == 4, F.col("ip_type") == 6
    counters = [
        F.count_if(q).alias("queries"), F.count_if(r).alias("responses"), F.count_if(q & notify).alias("notify"), F.count_if(answer_notify).alias("notify_answers"),
        *_codes("class", net.QCLASSES, "class", asked), *_codes("type", ROW_TYPES, "type", asked),
        *_codes("class", net.QCLASSES, "answer_class", F.col("qr")), *_codes("type", ROW_TYPES, "answer_type", F.col("qr")),
        F.count_if(q & v4).alias("queries_v4"), F.count_if(q & v6).alias("queries_v6"), F.count_if(q & F.col("is_tcp")).alias("queries_tcp"), F.count_if(q & ~F.col("is_tcp")).alias("queries_udp"),
        F.count_if(q & ~F.col("has_edns0")).alias("edns_absent"), F.count_if(edns).alias("edns_present"), F.count_if(edns & F.col("edns0_do")).alias("edns_do"), F.count_if(edns & ~F.col("edns0_do")).alias("edns_no_do"),
        F.count_if(edns & F.col("has_ecs")).alias("edns_subnet"), F.count_if(edns & ~F.col("has_ecs")).alias("edns_no_subnet"), F.count_if(edns & F.col("has_exp_opt")).alias("edns_experimental"),
        *buckets(F.col("edns0_max_size"), EDNS_SIZES, "edns_size", edns), *buckets(F.col("udp_len"), RESPONSE_SIZES, "response_size", sized),
        F.coalesce(F.sum(F.when(sized, F.col("udp_len"))), F.lit(0)).cast("long").alias("response_bytes"), F.count_if(sized).alias("responses_sized"),
        F.count_if(sized & v4).alias("responses_sized_v4"), F.count_if(sized & v6).alias("responses_sized_v6"),
        *(F.count_if(outcome & (label == x)).alias(f"rcode_{x}") for x in (*net.RCODES.values(), "NODATA", "REFERRAL", "UNKNOWN")),
        F.count_if(r & F.col("is_fragmented")).alias("responses_fragmented"), F.count_if(r & ~F.col("is_fragmented")).alias("responses_whole"),
        F.count_if(r & F.col("is_fragmented") & v4).alias("responses_fragmented_v4"), F.count_if(r & F.col("is_fragmented") & v6).alias("responses_fragmented_v6"),
        F.count_if(r & F.col("tc")).alias("responses_truncated"),
    ]
    return _started(m.groupBy(F.window("ts", interval)).agg(*counters))


def _started(df: DataFrame) -> DataFrame:
    """The window's start in place of the window, by which streams must group."""
    return df.select(F.col("window.start").alias("interval_start"), *(c for c in df.columns if c != "window"))


def with_percentages(stats: DataFrame, decimals: bool = False) -> DataFrame:
    """Percents of dns_statistics, 0 of nothing, and the mean response size.

    Whole numbers, rounded down, or with ``decimals`` rounded to two places, then also the
    share of fragments among the responses of each IP version that have a size.
    """
    c = F.col
    queries = c("queries_v4") + c("queries_v6")
    fragments = c("responses_fragmented") + c("responses_whole")
    parts = {"v4": (c("queries_v4"), queries), "v6": (c("queries_v6"), queries), "tcp": (c("queries_tcp"), c("queries")), "edns_on": (c("edns_present"), queries), "edns_off": (queries - c("edns_present"), queries)}
    parts |= {x: (c(x), c("edns_present")) for x in ("edns_do", "edns_no_do", "edns_subnet", "edns_no_subnet", *(s for s in stats.columns if s.startswith("edns_size_")))}
    parts |= {"fragmented": (c("responses_fragmented"), fragments), "whole": (c("responses_whole"), fragments), "truncated": (c("responses_truncated"), c("responses"))}
    parts |= {x: (c(x), c("responses_sized")) for x in stats.columns if x.startswith("response_size_")}
    parts |= {f"{x.removeprefix('rcode_').lower()}": (c(x), c("responses")) for x in stats.columns if x.startswith("rcode_")}
    if decimals:
        parts |= {f"fragmented_v{v}": (c(f"responses_fragmented_v{v}"), c(f"responses_sized_v{v}")) for v in (4, 6)}
    percent = net.percent2 if decimals else net.int_percent
    mean = F.try_divide(c("response_bytes"), c("responses_sized"))
    mean = F.coalesce(F.round(mean, 2), F.lit(0.0)) if decimals else F.coalesce(F.floor(mean), F.lit(0)).cast("long")
    return stats.withColumns({f"pct_{k}": percent(*v) for k, v in parts.items()} | {"response_mean_size": mean})


def rates_by_version(dns: DataFrame, listen_ips: list[str] | None = None, interval: str = "60 seconds") -> DataFrame:
    """dns_statistics with NOTIFY apart and outcomes aware of truncation and referrals, and its percents with two decimals.

    Needs has_soa and ns_first (of the authority section) beside the message columns.
    """
    return with_percentages(dns_statistics(dns, listen_ips, interval, "truncated", True), True)


#: Upper bounds of the size classes of metrics.
METRIC_SIZES = (512, 1280, 1500, 4096)
#: Averages: name, counter, and counter that it is divided by.
AVERAGES = (
    ("avg_qsize", "dnstraf_inbound", "q_ctr"), ("avg_rsize", "dnstraf_outbound", "r_ctr"), ("avg_recs_per_r", "r_total_rec_ctr", "r_ctr"), ("avg_ans_per_r", "r_total_ans_rec_ctr", "r_ctr"),
    ("avg_aut_per_r", "r_total_aut_rec_ctr", "r_ctr"), ("avg_add_per_r", "r_total_add_rec_ctr", "r_ctr"),
)


def _classes(size: Column, name: str, where: Column) -> list[Column]:
    low, out = None, []
    for high in METRIC_SIZES:
        out.append(F.count_if(where & (size <= high) & (F.lit(True) if low is None else size > low)).alias(f"{name}_le_{high}_ctr"))
        low = high
    return [*out, F.count_if(where & (size > low)).alias(f"{name}_gt_{low}_ctr")]


def _edns(side: str, where: Column) -> list[Column]:
    e = where & F.col("has_edns0")
    return [
        F.count_if(e).alias(f"{side}_has_edns0_ctr"), F.count_if(where & ~F.col("has_edns0")).alias(f"{side}_no_edns0_ctr"),
        F.count_if(e & F.col("edns0_do")).alias(f"{side}_edns0_do_set_ctr"), F.count_if(e & ~F.col("edns0_do")).alias(f"{side}_edns0_do_unset_ctr"),
        F.count_if(e & F.col("has_ecs")).alias(f"{side}_edns0_has_ecs_ctr"), F.count_if(e & ~F.col("has_ecs")).alias(f"{side}_edns0_has_no_ecs_ctr"),
    ]


def metric_counters(exact: bool = False) -> list[Column]:
    """The counters of scoped_metrics over rows of _each_item; names are fixed, as dashboards ask for them."""
    first, notify = F.col("first"), F.col("opcode") == NOTIFY
    q, r = ~F.col("qr") & first, F.col("qr") & first
    v4, v6, cut = F.col("ip_type") == 4, F.col("ip_type") == 6, F.col("is_fragmented")
    asked = ~F.col("qr") & ~notify
    total = lambda c, where, name: F.coalesce(F.sum(F.when(where, c)), F.lit(0)).cast("long").alias(name)
    header = F.when(v4, 28).otherwise(48) - (8 if exact else 0)
    answer_notify = r & notify & (F.col("rcode") == 0)
    label = net.rcode_label("truncated")
    out = []
    for side, where, traffic_name in (("q", q, "dnstraf_inbound"), ("r", r, "dnstraf_outbound")):
        out += [
            F.count_if(where).alias(f"{side}_ctr"), total(F.col("udp_len"), where, traffic_name), F.count_if(where & v4).alias(f"{side}_v4_ctr"), F.count_if(where & v6).alias(f"{side}_v6_ctr"),
            F.count_if(where & ~F.col("is_tcp")).alias(f"{side}_udp_ctr"), F.count_if(where & F.col("is_tcp")).alias(f"{side}_tcp_ctr"),
            *(F.count_if(where & F.col(f)).alias(f"{side}_{f}_set_ctr") for f in ("aa", "tc", "rd", "ra", "ad", "cd")), *_edns(side, where),
        ]
    out += [F.count_if(q & ~notify & F.col("item").isNull()).alias("q_malformed_ctr"), F.count_if(q & notify).alias("notify_in_ctr"), F.count_if(answer_notify).alias("notify_out_ctr")]
    for name, where in (("", r), ("_v4", r & v4), ("_v6", r & v6)):
        out += [F.count_if(where & cut).alias(f"r_frag{name}_ctr"), F.count_if(where & ~cut).alias(f"r_unfrag{name}_ctr")]
    for side, where in (("q", asked), ("r", F.col("qr"))):
        out += [*_codes("class", net.QCLASSES, f"{side}_class", where, False, "_ctr"), *_codes("type", net.QTYPES, f"{side}_type", where, False, "_ctr")]
    out += _classes(F.col("edns0_max_size"), "q_edns0_maxsize", q & F.col("has_edns0")) + _classes(F.col("udp_len") + header, "r_rsize", r)
    records = {"ans": F.col("ans_count"), "aut": F.col("aut_count"), "add": F.col("add_count")}
    out += [total(sum(records.values()), r, "r_total_rec_ctr"), *(total(c, r, f"r_total_{k}_rec_ctr") for k, c in records.items())]
    return out + [F.count_if(r & ~answer_notify & (label == x)).alias(f"r_rcode_{x.lower()}_ctr") for x in (*net.RCODES.values(), "NODATA", "REFERRAL", "UNKNOWN")]


def scoped_metrics(dns: DataFrame, interval: str = "60 seconds", exact: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """interval_start, scope, metric, value: 162 counters and 6 averages in long form for each scope.

    The scope is column ``scope``, or with ``blocks`` (as in enrich.cidr_match) the
    description of the first block that has the server's address (a long, IPv4): destination
    of queries, source of responses; other messages go.  The size of a response is its
    UDP length with the IP and (again) the UDP header; ``exact`` counts the UDP header once.
    Traffic is the UDP length alone.  Valid messages count, partial ones too.
    """
    m = valid(dns)
    if blocks is not None:
        m = cidr_match(m.withColumn("_server", F.when(F.col("qr"), F.col("src_v4")).otherwise(F.col("dst_v4"))), "_server", blocks, "scope").where("scope is not null")
    m = _each_item(m.withColumn("interval_start", net.interval_start("ts", interval)))
    counts = m.groupBy("interval_start", "scope").agg(*metric_counters(exact))
    names = counts.columns[2:]
    wide = counts.select("interval_start", "scope", *(F.col(c).cast("double").alias(c) for c in names))
    wide = wide.withColumns({name: F.try_divide(F.col(a), F.col(b)) for name, a, b in AVERAGES})
    return wide.unpivot(["interval_start", "scope"], None, "metric", "value")


def metric_rates(metrics: DataFrame, seconds: int, absolute: tuple[str, ...] = ()) -> DataFrame:
    """Divides metrics by the interval's seconds, except averages (``avg_...``) and those named."""
    keep = F.col("metric").isin(list(absolute)) | F.col("metric").startswith("avg_")
    return metrics.withColumn("value", F.when(keep, F.col("value")).otherwise(F.col("value") / seconds))


def day_counters(dns: DataFrame) -> DataFrame:
    """day, today and yesterday: queries of each day and of the day before (0 where that has none)."""
    days = dns.where(~F.col("qr")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("today"))
    w = Window.orderBy("day")  # one row a day
    before = F.when(F.lag("day").over(w) == F.date_sub("day", 1), F.lag("today").over(w))
    return days.withColumn("yesterday", F.coalesce(before, F.lit(0)).cast("long"))


def answer_counts(records: DataFrame, interval: str = "60 seconds") -> DataFrame:
    """interval_start, kind (class or type), name, n over the records of answer sections."""
    a = records.where("section = 'answer'").withColumn("interval_start", net.interval_start("ts", interval))
    both = F.array(F.struct(F.lit("class").alias("kind"), net.qclass_name("rr_class").alias("name")), F.struct(F.lit("type").alias("kind"), net.qtype_name("rr_type").alias("name")))
    return a.select("interval_start", F.explode(both).alias("e")).groupBy("interval_start", "e.kind", "e.name").agg(F.count("*").alias("n"))


def totals(packets: DataFrame, interval: str = "60 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """Packets, TCP, UDP, queries and responses in each interval (and for each value of ``keys``)."""
    out = packets.groupBy(F.window("ts", interval), *keys).agg(
        F.count("*").alias("packets"), F.count_if("is_tcp").alias("tcp"), F.count_if(~F.col("is_tcp")).alias("udp"), F.count_if(~F.col("qr")).alias("queries"), F.count_if("qr").alias("responses"),
        F.count_if(F.col("is_valid")).alias("handled"), F.sum("udp_len").cast("long").alias("bytes"),
    )
    return _started(out)


def by_feed(packets: DataFrame, feeds: list[str] | None = None, interval: str = "60 seconds") -> DataFrame:
    """totals for each feed, of all or of the feeds subscribed to."""
    return totals(packets if not feeds else packets.where(F.col("feed_id").isin(feeds)), interval, ("feed_id",))


def sent_to(packets: DataFrame, destination: str, port: int) -> DataFrame:
    """ip_type and number of packets to one address and port."""
    return packets.where((F.col("ip_dst") == destination) & (F.col("dstport") == port)).groupBy("ip_type").agg(F.count("*").alias("n"))


def reassembly_timeouts(packets: DataFrame, interval: str = "60 seconds") -> DataFrame:
    """interval_start, ip_src, n: hosts that report fragments not reassembled in time."""
    from .filters import by_icmp

    late = by_icmp(packets, [(4, 11, 1), (6, 3, 1)])
    return late.groupBy(net.interval_start("ts", interval).alias("interval_start"), "ip_src").agg(F.count("*").alias("n"))
