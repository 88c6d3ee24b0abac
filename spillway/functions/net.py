"""Column functions for addresses, names, codes and labels; all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registered DNS numbers, fixed values.
QTYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 24: "SIG", 25: "KEY", 28: "AAAA", 29: "LOC",
    33: "SRV", 35: "NAPTR", 36: "KX", 37: "CERT", 39: "DNAME", 41: "OPT", 42: "APL", 43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC",
    48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 55: "HIP", 99: "SPF", 249: "TKEY", 250: "TSIG", 251: "IXFR", 252: "AXFR",
    255: "ANY", 257: "CAA", 32768: "TA", 32769: "DLV",
}
QCLASSES = {1: "IN", 2: "CS", 3: "CH", 4: "HS", 255: "ANY"}
RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMPL", 5: "REFUSED"}
OPCODES = {0: "QUERY", 4: "NOTIFY"}
DS, DNSKEY, RRSIG, SOA, NS, OPT = 43, 48, 46, 6, 2, 41


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_name(code: Column | str, names: dict[int, str]) -> Column:
    """Name of a registered number; null and 0 without a name are UNSPECIFIED, another unregistered one UNKNOWN."""
    c = _col(code)
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items()))
    return F.coalesce(F.try_element_at(known, c.cast("int")), F.when(c.isNull() | (c == 0), "UNSPECIFIED").otherwise("UNKNOWN"))


def qtype_name(c: Column | str) -> Column:
    return code_name(c, QTYPES)


def qclass_name(c: Column | str) -> Column:
    return code_name(c, QCLASSES)


def rcode_name(c: Column | str) -> Column:
    return code_name(c, RCODES)


def is_dnssec(qtype: Column | str) -> Column:
    return _col(qtype).isin(DS, DNSKEY)


# --- addresses -------------------------------------------------------------


def ip4_to_text(c: Column | str) -> Column:
    """Dotted quad of an unsigned 32-bit number in a long."""
    c = _col(c)
    return F.concat_ws(".", *(F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def ip4_from_text(c: Column | str) -> Column:
    """Number of a dotted quad; null if it is none."""
    p = F.split(_col(c), r"\.")
    total = sum(F.try_element_at(p, F.lit(i + 1)).try_cast("long") * (1 << s) for i, s in enumerate((24, 16, 8, 0)))
    return F.when(_col(c).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), total)


def ip4_from_bytes(c: Column | str) -> Column:
    return F.conv(F.hex(_col(c)), 16, 10).cast("long")


def ip4_to_bytes(c: Column | str) -> Column:
    return F.unhex(F.lpad(F.hex(_col(c)), 8, "0"))


def ip4_prefix(c: Column | str, bits: int) -> Column:
    """The number with all but its first ``bits`` bits cleared."""
    return _col(c).bitwiseAND(F.lit((0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF))


def ip4_prefix_text(c: Column | str, bits: int) -> Column:
    return F.concat(ip4_to_text(ip4_prefix(c, bits)), F.lit(f"/{bits}"))


def ip6_prefix64_text(c: Column | str) -> Column:
    """The first four groups of an address in text form, with the groups before '::' counted from the left."""
    groups = F.split(_col(c), ":")
    left = F.split(F.substring_index(_col(c), "::", 1), ":")
    full = F.when(F.instr(_col(c), "::") > 0, F.concat(left, F.array_repeat(F.lit("0"), 4))).otherwise(groups)
    return F.concat(F.array_join(F.transform(F.slice(full, 1, 4), lambda g: F.when(g == "", "0").otherwise(g)), ":"), F.lit("::/64"))


def ip6_halves(c: Column | str) -> tuple[Column, Column]:
    """High and low 64 bits, as signed longs, of 16 bytes."""
    h = F.hex(_col(c))
    return tuple(F.conv(F.substring(h, i, 16), 16, -10).cast("long") for i in (1, 17))


def ip6_bytes(high: Column | str, low: Column | str) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(_col(high)), 16, "0"), F.lpad(F.hex(_col(low)), 16, "0")))


def ip6_words_text(c: Column | str) -> Column:
    """Eight groups of four hex digits, not shortened."""
    h = F.lower(F.hex(_col(c)))
    return F.concat_ws(":", *(F.substring(h, 1 + 4 * i, 4) for i in range(8)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it needs several times, worked out once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def ip6_text(c: Column | str) -> Column:
    """Shortest text form of 16 bytes: no leading zeros, '::' for the first longest run of two zero groups or more, and a mapped IPv4 address as a dotted quad."""
    def shortened(words: Column, zeros: Column) -> Column:
        """``zeros`` has a digit for each group, 0 for a zero one, so the longest run is found without looking at the groups again."""
        found = F.coalesce(*(F.when(F.instr(zeros, "0" * n) > 0, F.instr(zeros, "0" * n) * 10 + n) for n in range(8, 1, -1)), F.lit(0))

        def around(at: Column) -> Column:
            left, right = F.slice(words, 1, F.floor(at / 10).cast("int") - 1), F.slice(words, F.floor(at / 10).cast("int") + at % 10, 8)
            return F.when(at == 0, F.array_join(words, ":")).otherwise(F.concat(F.array_join(left, ":"), F.lit("::"), F.array_join(right, ":")))

        return _once(found, around)

    def of(digits: Column) -> Column:
        words = F.array(*(F.coalesce(F.nullif(F.ltrim(F.substring(digits, 1 + 4 * i, 4), F.lit("0")), F.lit("")), F.lit("0")) for i in range(8)))
        return _once(words, lambda w: shortened(w, F.array_join(F.transform(w, lambda x: F.when(x == "0", "0").otherwise("1")), "")))

    text = _once(F.lower(F.hex(_col(c))), of)
    mapped = F.substring(F.hex(_col(c)), 1, 24) == "00000000000000000000FFFF"
    text = F.when(mapped, F.concat(F.lit("::ffff:"), ip4_to_text(ip4_from_bytes(F.substring(_col(c), 13, 4))))).otherwise(text)
    return F.when(F.octet_length(_col(c)) == 16, text)


def mac_text(c: Column | str) -> Column:
    digits = F.hex(_col(c))
    return F.concat_ws(":", *(F.substring(digits, at, 2) for at in range(1, 12, 2)))


def hex_text(c: Column | str) -> Column:
    return F.lower(F.hex(_col(c)))


# --- names -------------------------------------------------------------


def tld(name: Column | str) -> Column:
    return F.substring_index(F.rtrim(_col(name), F.lit(".")), ".", -1)


def sld(name: Column | str) -> Column:
    """The last two labels with the final dot; a name of fewer labels as it is."""
    bare = F.rtrim(_col(name), F.lit("."))
    return F.when(F.instr(bare, ".") > 0, F.concat(F.substring_index(bare, ".", -2), F.lit("."))).otherwise(_col(name))


def parent_suffixes(name: Column | str) -> Column:
    """The name and all its parents, longest first, each with the final dot; none for the root."""
    labels = F.split(F.rtrim(_col(name), F.lit(".")), r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(labels, i, n), "."), F.lit(".")))
    return F.when(F.rtrim(_col(name), F.lit(".")) == "", F.array().cast("array<string>")).otherwise(every)


def ends_with_any(name: Column | str, suffixes: list[str], label_aligned: bool = False, ignore_case: bool = True) -> Column:
    """Suffix match; an empty list matches every name."""
    if not suffixes:
        return F.lit(True)
    n = F.lower(_col(name)) if ignore_case else _col(name)
    found = F.lit(False)
    for s in suffixes:
        s = s.lower() if ignore_case else s
        one = n.endswith(s)
        if label_aligned:
            one = (n == s) | n.endswith("." + s)
        found = found | one
    return found


# --- flags, labels, numbers ---------------------------------------------------


def flag(c: Column | str, bit: int) -> Column:
    return F.shiftright(_col(c), bit).bitwiseAND(F.lit(1)) == 1


def rcode_label(dialect: str = "simple", rcode="rcode", answers="ans_count", has_soa="has_soa", has_ns="has_ns", truncated="tc", ns_first="ns_first") -> Column:
    """Outcome of a response.

    simple: a NOERROR without answers is NODATA.  resolver: among such, an SOA in the
    authority section makes it NODATA, else an NS makes it REFERRAL.  client: as resolver,
    but what stands first counts.  truncated: as client; of those with neither, a truncated
    one has no label (null) and another is UNKNOWN.
    """
    r = _col(rcode)
    empty = (r == 0) & (_col(answers) == 0)
    label = code_name(rcode, RCODES)
    if dialect == "simple":
        return F.when(empty, "NODATA").otherwise(label)
    if dialect == "resolver":
        return F.when(empty & _col(has_soa), "NODATA").when(empty & _col(has_ns), "REFERRAL").otherwise(label)
    referred = F.when(empty & _col(ns_first), "REFERRAL").when(empty & _col(has_soa), "NODATA")
    if dialect == "client":
        return referred.otherwise(label)
    if dialect == "truncated":
        return referred.when(empty & _col(truncated), F.lit(None).cast("string")).when(empty, "UNKNOWN").otherwise(label)
    raise ValueError(dialect)


def int_percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.coalesce(F.floor(F.try_divide(part * 100, whole)), F.lit(0)).cast("long")


def percent2(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100, whole), 2), F.lit(0.0))


def pseudonym(salt: str, *parts: Column | str) -> Column:
    """Salted SHA-256; a name is hashed with its client, so equal names of two clients differ."""
    return F.sha2(F.concat(F.lit(salt), *(_col(p) for p in parts)), 256)


def interval_start(ts: Column | str, interval: str) -> Column:
    """Start of the interval that a time falls in."""
    return F.window(_col(ts), interval).getField("start")


def timestamp_text(ts: Column | str) -> Column:
    """Seconds since the epoch with six decimals."""
    micros = F.unix_micros(_col(ts).cast("timestamp"))
    return F.format_string("%d.%06d", F.floor(micros / 1000000), F.pmod(micros, F.lit(1000000)))
