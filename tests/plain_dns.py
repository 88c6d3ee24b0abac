"""DNS messages read one by one, as plainly as can be: what the reader of whole batches is tested against."""

import struct

COLUMNS = [
    "is_valid", "is_partial", "parse_error", "questions", "answers", "authorities", "additionals", "has_edns0", "edns0_version", "edns0_max_size", "edns0_do", "edns0_rcode", "has_ecs", "ecs_family", "ecs_src_scope", "ecs_res_scope", "ecs_addr", "has_exp_opt",
]


class Malformed(ValueError):
    pass


class Short(Exception):
    """The message ends too early."""


def read_name(m: bytes, at: int) -> tuple[str, int]:
    """A name with its final dot ('' for the root) and the place behind it."""
    labels, after, jumps = [], -1, 0
    while True:
        if at >= len(m):
            raise Short
        n = m[at]
        if n >= 0xC0:
            if at + 1 >= len(m):
                raise Short
            after = at + 2 if after < 0 else after
            at = (n & 0x3F) << 8 | m[at + 1]
            jumps += 1
            if jumps > 256:
                raise Malformed("pointer loop")
        elif n > 63:
            raise Malformed("label too long")
        elif n == 0:
            name = "".join(x + "." for x in labels)
            if len(name) > 512:
                raise Malformed("name too long")
            return name, at + 1 if after < 0 else after
        else:
            if at + 1 + n > len(m):
                raise Short
            labels.append(m[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n


def _strings(rdata: bytes) -> list[str]:
    out, at = [], 0
    while at < len(rdata):
        n = rdata[at]
        if at + 1 + n > len(rdata):
            raise Malformed("text beyond its record")
        out.append(rdata[at + 1 : at + 1 + n].decode("latin-1"))
        at += 1 + n
    return out


def read_record(m: bytes, at: int) -> tuple[dict, int]:
    name, at = read_name(m, at)
    if at + 10 > len(m):
        raise Short
    kind, klass, ttl, size = struct.unpack_from(">HHIH", m, at)
    at += 10
    if at + size > len(m):
        raise Short
    rdata, texts = m[at : at + size], None
    if kind == 1:
        if size != 4:
            raise Malformed("address of a wrong size")
        text = ".".join(map(str, rdata))
    elif kind == 28:
        if size != 16:
            raise Malformed("address of a wrong size")
        text = ":".join(f"{x:x}" for x in struct.unpack(">8H", rdata))
    elif kind in (2, 5):
        text = read_name(m, at)[0]
    elif kind == 16:
        texts = _strings(rdata)
        text = "\n".join(texts)
    elif kind == 41:
        text = f"EDNS version {ttl >> 16 & 255}, advertised buffer size {klass} bytes, extended RCODE {ttl >> 24}, {size} bytes RDATA"
    else:
        text = f"{size} byte{'s' * (size != 1)} unparsed RDATA"
    return {"name": name, "type": kind, "class": klass, "ttl": ttl, "rdata_len": size, "rdata": rdata, "rdata_txt": text, "rdata_list": texts}, at + size


def read_options(rdata: bytes, response: bool, out: dict) -> None:
    """Client subnet and experimental options; a wrong length ends the walk."""
    at = 0
    while at + 4 <= len(rdata):
        code, size = struct.unpack_from(">HH", rdata, at)
        body = rdata[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size:
            return
        if code > 65000:
            out["has_exp_opt"] = True
        if code == 8 and size >= 4:
            family, source, scope = struct.unpack_from(">HBB", body)
            width = {1: 32, 2: 128}.get(family)
            if width is None:
                continue
            # a response's address is as long as its own scope says
            bits = min(scope if response else source, width)
            if len(body) - 4 != (bits + 7) // 8:
                continue
            source, scope = min(source, width), min(scope, width)
            out |= {"has_ecs": True, "ecs_family": family, "ecs_src_scope": source, "ecs_res_scope": scope if response else 0, "ecs_addr": body[4:].ljust(width // 8, b"\0")}


def read_message(m: bytes | None, wanted: frozenset[str]) -> dict:
    """All section columns of one message; of the sections only the wanted ones are kept."""
    out: dict = dict.fromkeys(COLUMNS)
    out |= {"is_valid": False, "is_partial": False, "has_edns0": False, "edns0_do": False, "has_ecs": False, "has_exp_opt": False, "questions": [], "answers": [], "authorities": [], "additionals": []}
    if m is None or len(m) < 12:
        return out | {"parse_error": "short header"}
    counts = struct.unpack_from(">4H", m, 4)
    at = 12
    try:
        for _ in range(counts[0]):
            name, at = read_name(m, at)
            if at + 4 > len(m):
                raise Short
            qtype, qclass = struct.unpack_from(">HH", m, at)
            at += 4
            out["questions"].append({"qname": name, "qtype": qtype, "qclass": qclass})
        for section, n in zip(("answers", "authorities", "additionals"), counts[1:]):
            if section not in wanted and not {"additionals", "edns0"} & wanted:
                break
            for _ in range(n):
                record, at = read_record(m, at)
                if record["type"] == 41 and section == "additionals":
                    ttl = record["ttl"]
                    out |= {"has_edns0": True, "edns0_version": ttl >> 16 & 255, "edns0_max_size": record["class"], "edns0_do": bool(ttl >> 15 & 1), "edns0_rcode": ttl >> 24}
                    read_options(record["rdata"], bool(m[2] & 0x80), out)
                if section in wanted:
                    out[section].append(record)
        out["is_valid"] = True
    except Short:
        out |= {"is_valid": True, "is_partial": True}
    except Malformed as e:
        out["parse_error"] = str(e)
    return out
