"""From captured bytes to typed columns.

Ethernet, IP, UDP, TCP and ICMP headers, the chain of IPv6 extension headers and the DNS
header are built-in expressions on the binary column.  Only the DNS sections, whose names
point back into the message, are read in Arrow batches, all messages of a batch side by
side (``wire``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import net
from . import wire

IPV4, IPV6, TCP, UDP, ICMP, ICMP6 = 0x0800, 0x86DD, 6, 17, 1, 58
#: IPv6 extension headers that are stepped over: options, routing, mobility, HIP, shim6 and experiments.
STEPPED = (0, 43, 60, 135, 139, 140, 253, 254)
FRAGMENT, ENCRYPTED = 44, (50, 51)
#: Extension headers followed at most; a longer chain is no sound packet.
CHAIN = 16


def number(data: Column | str, at: Column | int, size: int) -> Column:
    """Big-endian number of ``size`` bytes at a 0-based place; null beyond the end."""
    data = F.col(data) if isinstance(data, str) else data
    at = F.lit(at) if isinstance(at, int) else at.cast("int")
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("long"))


def part(data: Column | str, at: Column | int, size: Column | int | None = None) -> Column:
    data = F.col(data) if isinstance(data, str) else data
    at = F.lit(at) if isinstance(at, int) else at.cast("int")
    size = F.octet_length(data) if size is None else F.lit(size) if isinstance(size, int) else size.cast("int")
    return F.substring(data, at + 1, size)


def _settled(df: DataFrame) -> DataFrame:
    """Keeps later filters from being pushed, with all they refer to written out, below the columns so far."""
    return df.withColumn("_settled", F.monotonically_increasing_id()).where("_settled >= 0").drop("_settled")


def ethernet(packets: DataFrame) -> DataFrame:
    """Adds eth_dst, eth_src, eth_type and ``ip``, the bytes behind the header; null where it is cut short."""
    whole = F.octet_length("data") >= 14
    out = packets.withColumns(
        {
            "eth_dst": F.when(whole, net.mac_text(part("data", 0, 6))), "eth_src": F.when(whole, net.mac_text(part("data", 6, 6))), "eth_type": number("data", 12, 2).cast("int"), "ip": F.when(whole, part("data", 14)),
        }
    )
    return _settled(out)


def _ipv6_chain() -> Column:
    """Next header, place of the payload and fragment fields behind all extension headers."""
    start = F.struct(number("ip", 6, 1).alias("nh"), F.lit(40).cast("long").alias("at"), F.lit(0).cast("long").alias("ofs"), F.lit(False).alias("more"), F.lit(None).cast("long").alias("id"), F.lit(False).alias("frag"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        is_frag = s["nh"] == FRAGMENT
        moves = is_frag | s["nh"].isin(*STEPPED)
        bits = number("ip", at + 2, 2)
        size = F.when(is_frag, F.lit(8).cast("long")).otherwise((number("ip", at + 1, 1) + 1) * 8)
        return F.struct(
            F.when(moves, number("ip", at, 1)).otherwise(s["nh"]).alias("nh"), F.when(moves, at + size).otherwise(at).alias("at"), F.when(is_frag, bits.bitwiseAND(F.lit(0xFFF8))).otherwise(s["ofs"]).alias("ofs"),
            F.when(is_frag, bits.bitwiseAND(F.lit(1)) == 1).otherwise(s["more"]).alias("more"), F.when(is_frag, number("ip", at + 4, 4)).otherwise(s["id"]).alias("id"), (s["frag"] | is_frag).alias("frag"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(CHAIN)), start, step)


def internet(df: DataFrame) -> DataFrame:
    """Adds the IP columns and ``segment``, the bytes behind the IP header; rows that are no sound IP have ip_type null."""
    # numbers that are used more than once are columns of their own, so that they are worked out once
    df = df.withColumns({"_first": number("ip", 0, 1), "_frag": number("ip", 6, 2)})
    ihl = F.col("_first").bitwiseAND(F.lit(15)) * 4
    version = F.shiftright(F.col("_first"), 4)
    is4 = (F.col("eth_type") == IPV4) & (version == 4) & (ihl >= 20) & (F.octet_length("ip") >= ihl)
    is6 = (F.col("eth_type") == IPV6) & (version == 6) & (F.octet_length("ip") >= 40)
    frag = F.col("_frag")
    df = _settled(df.withColumns({"ip_type": F.when(is4, 4).when(is6, 6), "_six": F.when(is6, _ipv6_chain())}))
    endless = (F.col("ip_type") == 6) & F.col("_six.nh").isin(FRAGMENT, *STEPPED)
    df = df.withColumn("ip_type", F.when(~F.coalesce(endless, F.lit(False)), F.col("ip_type")))
    six = F.col("_six")
    four, six_ = F.col("ip_type") == 4, F.col("ip_type") == 6
    ofs = F.when(four, frag.bitwiseAND(F.lit(0x1FFF)) * 8).otherwise(six["ofs"]).cast("int")
    more = F.when(four, frag.bitwiseAND(F.lit(0x2000)) != 0).otherwise(six["more"])
    total = F.when(four, number("ip", 2, 2)).otherwise(number("ip", 4, 2) + 40)
    head = F.when(four, ihl).otherwise(six["at"])
    df = df.withColumns(
        {
            "src_addr": F.when(four, part("ip", 12, 4)).when(six_, part("ip", 8, 16)), "dst_addr": F.when(four, part("ip", 16, 4)).when(six_, part("ip", 24, 16)), "ttl": F.when(four, number("ip", 8, 1)).when(six_, number("ip", 7, 1)).cast("smallint"),
            "ip_id": F.when(four, number("ip", 4, 2)).cast("int"), "ip6_id": six["id"], "fragment_ofs": ofs, "more_frags": more, "is_fragment": F.when(four, (ofs > 0) | more).otherwise(six["frag"]), "is_reassembled": F.lit(False),
            "ip_proto": F.when(four, number("ip", 9, 1)).otherwise(six["nh"]).cast("smallint"),
            # a frame may be padded beyond the packet
            "segment": F.when(F.col("ip_type").isNotNull(), part("ip", head, F.greatest(F.when(total > 0, total).otherwise(F.octet_length("ip")) - head, F.lit(0)))),
        }
    )
    return _settled(df).drop("_six", "ip", "_first", "_frag")


def with_text(df: DataFrame) -> DataFrame:
    """Adds ip_src and ip_dst, the addresses as text; a filter on other columns goes below."""
    four = F.col("ip_type") == 4
    df = df.withColumns({f"_{c}": F.when(four, net.ip4_from_bytes(f"{c}_addr")) for c in ("src", "dst")})
    text = lambda c: F.when(four, net.ip4_to_text(f"_{c}")).when(F.col("ip_type") == 6, net.ip6_text(f"{c}_addr"))
    return df.withColumns({f"ip_{c}": text(c) for c in ("src", "dst")}).drop("_src", "_dst")


def transport(df: DataFrame) -> DataFrame:
    """Adds ports, UDP length, TCP and ICMP fields and ``payload``, which first fragments and whole packets only have, and addresses as text."""
    s = F.octet_length("segment")
    first = F.coalesce(F.col("fragment_ofs") == 0, F.lit(False))
    udp = first & (F.col("ip_proto") == UDP) & (s >= 8)
    offset = F.shiftright(number("segment", 12, 1), 4) * 4
    tcp = first & (F.col("ip_proto") == TCP) & (s >= 20) & (offset >= 20) & (offset <= s)
    icmp = first & F.col("ip_proto").isin(ICMP, ICMP6) & (s >= 2)
    flags = number("segment", 13, 1)
    ports = udp | tcp
    out = {
        "srcport": F.when(ports, number("segment", 0, 2)).cast("int"), "dstport": F.when(ports, number("segment", 2, 2)).cast("int"), "udp_len": F.when(udp, number("segment", 4, 2)).cast("int"),
        "tcp_seq": F.when(tcp, number("segment", 4, 4)), "tcp_ack": F.when(tcp, number("segment", 8, 4)), "tcp_flags": F.when(tcp, flags).cast("int"), "tcp_window": F.when(tcp, number("segment", 14, 2)).cast("int"), "tcp_urgent": F.when(tcp, number("segment", 18, 2)).cast("int"),
        "icmp_type": F.when(icmp, number("segment", 0, 1)).cast("smallint"), "icmp_code": F.when(icmp, number("segment", 1, 1)).cast("smallint"),
        "payload": F.when(udp, part("segment", 8)).when(tcp, part("segment", offset)).when(icmp, part("segment", 4)),
    }
    return with_text(_settled(df.withColumns(out)))


def decode_packets(packets: DataFrame) -> DataFrame:
    """Packets (ts, feed_id, caplen, data) with all header columns; ESP and AH packets are left out, unsound ones kept with nulls."""
    out = transport(internet(ethernet(packets)))
    return out.where(~F.coalesce((F.col("ip_type") == 6) & F.col("ip_proto").isin(*ENCRYPTED), F.lit(False)))


# --- DNS --------------------------------------------------------------------


def dns_payload(df: DataFrame, port: int = 53) -> DataFrame:
    """DNS messages over UDP and TCP: a TCP segment without SYN, RST or FIN whose first two bytes are the length of the rest."""
    df = df.where((F.col("srcport") == port) | (F.col("dstport") == port))
    is_tcp = F.col("ip_proto") == TCP
    length = number("payload", 0, 2)
    sound = ~is_tcp | (length == F.octet_length("payload") - 2)
    df = df.where(~is_tcp | (F.col("tcp_flags").bitwiseAND(F.lit(7)) == 0)).withColumns({"is_tcp": is_tcp, "is_fragmented": ~is_tcp & F.col("is_fragment"), "_sound": F.coalesce(sound, F.lit(False))})
    return df.withColumn("payload", F.when(~is_tcp, F.col("payload")).when(F.col("_sound"), part("payload", 2))).withColumn("udp_len", F.when(is_tcp, 0).otherwise(F.col("udp_len"))).drop("_sound")


def dns_header(df: DataFrame) -> DataFrame:
    """Adds query_id, flags, opcode, rcode and the record counts."""
    df = df.withColumn("_flags", number("payload", 2, 2))
    f = F.col("_flags")
    bits = {"qr": 15, "aa": 10, "tc": 9, "rd": 8, "ra": 7, "ad": 5, "cd": 4}
    out = {"query_id": number("payload", 0, 2).cast("int")} | {k: net.flag(f, b) for k, b in bits.items()}
    out |= {"opcode": F.shiftright(f, 11).bitwiseAND(F.lit(15)).cast("tinyint"), "rcode": f.bitwiseAND(F.lit(15)).cast("tinyint")}
    out |= {c: number("payload", 6 + 2 * i, 2).cast("int") for i, c in enumerate(("ans_count", "aut_count", "add_count"))}
    return df.withColumns(out).drop("_flags")


def decode_dns(packets: DataFrame, sections: tuple[str, ...] = ("answers", "authorities", "additionals", "edns0"), lower: bool = False, keep_malformed: bool = False, port: int = 53) -> DataFrame:
    """Decoded packets with DNS columns; ``sections`` says which record lists are filled, ``lower`` puts question names in lower case.

    qname, qtype and qclass are those of the first question.  Malformed messages are left
    out unless asked for.
    """
    df = dns_payload(packets, port)
    wanted = frozenset(sections)
    # the header's numbers are read with the sections, in the same pass over a batch
    fields = StructType.fromDDL(f"{schemas.HEADER}, {schemas.SECTIONS}")
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = wire.read(batch.column(batch.num_columns - 1), wanted)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(found[c].cast(types[c]) for c in types)], [*batch.schema.names, *types])

    rest = [c for c in df.columns if c not in ("payload", "segment", "data")]
    rows = df.select(*rest, "payload")
    out = rows.mapInArrow(read, StructType([*rows.schema.fields, *fields.fields]))
    names = F.transform("questions", lambda q: q.withField("qname", F.lower(q["qname"]))) if lower else F.col("questions")
    out = out.withColumn("questions", names).withColumns({c: F.try_element_at("questions", F.lit(1))[c] for c in ("qname", "qtype", "qclass")})
    out = out.withColumn("ecs_ip", F.when(F.col("ecs_family") == 1, net.ip4_to_text(net.ip4_from_bytes("ecs_addr"))).when(F.col("ecs_family") == 2, net.ip6_text("ecs_addr")))
    return out if keep_malformed else out.where("is_valid")


def dnskeys(messages: DataFrame) -> DataFrame:
    """date, fqdn, flags, protocol, algorithm, bitsize, n, e of RSA keys in answers; keys that are too short are left out."""
    each = messages.select(F.to_date("ts").alias("date"), F.explode("answers").alias("r")).where(F.col("r.type") == net.DNSKEY).select("date", F.col("r.name").alias("fqdn"), F.col("r.rdata").alias("rdata"))
    short = number("rdata", 4, 1)
    long_form = short == 0
    size = F.when(long_form, number("rdata", 5, 2)).otherwise(short)
    at = F.when(long_form, F.lit(7)).otherwise(F.lit(5)).cast("long")
    out = each.select(
        "date", "fqdn", number("rdata", 0, 2).cast("int").alias("flags"), number("rdata", 2, 1).cast("int").alias("protocol"), number("rdata", 3, 1).cast("int").alias("algorithm"), part("rdata", at, size).alias("_e"),
        part("rdata", at + size).alias("_n"), size.alias("_size"),
    )
    out = out.where(F.col("algorithm").isin(1, 5, 7, 8, 10) & (F.octet_length("_e") == F.col("_size")) & (F.octet_length("_n") > 0))
    return out.select("date", "fqdn", "flags", "protocol", "algorithm", (F.octet_length("_n") * 8).alias("bitsize"), net.hex_text("_n").alias("n"), net.hex_text("_e").alias("e"))
