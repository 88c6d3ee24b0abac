"""Descriptions, autonomous systems and countries of addresses.

Addresses are longs (IPv4) or 16 bytes (IPv6); both compare in numeric order.  A lookup is a
sweep: ranges are taken in the order of their first addresses with those that are still open,
best first, which cuts the line of addresses into stretches with one range (or none) each.
An address then looks for the stretch that it is in.

A table of up to ``BROADCAST`` bytes is swept once and its stretches are sent to all tasks:
the input is read once, rows stay where they are, and only the address goes to Python, in
Arrow batches.  A larger table is dealt by range together with the input's distinct addresses;
each part sweeps its own ranges and those still open where it begins, which it gets from
the parts before it, and what was found joins back by address.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..shared import written

#: Block lists up to this long become one CASE expression.
CASES = 64
#: Ranges of a table that are sent to all tasks, and their bytes, at most.
RANGES, BROADCAST = 1_000_000, 64 << 20
WIDE = "S16"


def stretches(low: list[int], high: list[int], rank: list, nested: bool) -> tuple[list[int], list[int]]:
    """Where each stretch of addresses begins, and the range that counts there (-1: none).

    Of the ranges that cover an address the one with the least rank counts; without
    ``nested`` a range ends where the next one begins.
    """
    order = sorted((i for i in range(len(low)) if low[i] <= high[i]), key=lambda i: (low[i], rank[i]))
    if not nested:
        order = [i for k, i in enumerate(order) if not k or low[order[k - 1]] != low[i]]
        high = list(high)
        for i, j in zip(order, order[1:]):
            high[i] = min(high[i], low[j] - 1)
    starts: list[int] = []
    which: list[int] = []

    def begin(at: int, i: int) -> None:
        if starts and starts[-1] == at:
            which[-1] = i
        elif not which or which[-1] != i:
            starts.append(at)
            which.append(i)

    open_: list[tuple] = []
    for i in (*order, None):
        while open_ and (i is None or high[open_[0][1]] < low[i]):
            end = high[heapq.heappop(open_)[1]] + 1
            while open_ and high[open_[0][1]] < end:
                heapq.heappop(open_)
            begin(end, open_[0][1] if open_ else -1)
        if i is not None:
            heapq.heappush(open_, (rank[i], i))
            begin(low[i], open_[0][1])
    return starts, which


def _ints(column: pa.ChunkedArray | pa.Array) -> list[int]:
    return [int.from_bytes(x, "big") if isinstance(x, bytes) else x for x in column.to_pylist()]


def _keys(values: list[int], wide: bool) -> np.ndarray:
    """Sorted keys to search in, without one behind the last address."""
    if wide:
        return np.array([x.to_bytes(16, "big") for x in values if x < 1 << 128], WIDE)
    return np.array(values, np.int64)


def _asked(addresses: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Addresses as keys, and which of them are some."""
    if isinstance(addresses, pa.ChunkedArray):
        addresses = addresses.combine_chunks()
    known = addresses.is_valid().to_numpy(zero_copy_only=False)
    if not wide:
        return addresses.fill_null(-1).to_numpy(zero_copy_only=False), known
    held = addresses.cast(pa.binary())
    known &= pc.fill_null(pc.equal(pc.binary_length(held), 16), False).to_numpy(zero_copy_only=False)
    held = pc.if_else(pa.array(known), held, pa.scalar(b"\0" * 16, pa.binary()))
    return np.array(held.to_pylist(), WIDE), known


def _find(addresses: pa.Array, starts: np.ndarray, which: np.ndarray, wide: bool) -> np.ndarray:
    """The range of each address, -1 for none."""
    values, known = _asked(addresses, wide)
    at = np.searchsorted(starts, values, "right") - 1
    return np.where(known & (at >= 0), np.append(which, -1)[at], -1)


def _looked_up(df: DataFrame, address: str, ranges: DataFrame, fields: dict[str, str], nested: bool) -> DataFrame:
    """Adds ``fields`` (new name: column of ranges) from the range that counts, by low, high and rank (least first)."""
    wide = df.schema[address].dataType.simpleString() == "binary"
    ranges = ranges.select("low", "high", "rank", *dict.fromkeys(fields.values())).where("low is not null and high is not null")
    few = ranges.limit(RANGES + 1).toArrow()
    if few.num_rows > RANGES or few.nbytes > BROADCAST:
        return _swept(df, address, ranges, fields, nested, wide)
    low, high, rank = _ints(few["low"]), _ints(few["high"]), few["rank"].to_pylist()
    starts, which = stretches(low, high, [tuple(r.values()) if isinstance(r, dict) else r for r in rank], nested)
    out = StructType([StructField(c, ranges.schema[c].dataType) for c in dict.fromkeys(fields.values())])
    held = pa.StructArray.from_arrays([few[c.name].combine_chunks() for c in out], names=out.names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("r", held.type)])) as writer:
        writer.write_batch(pa.record_batch([held], names=["r"]))
    sent = df.sparkSession.sparkContext.broadcast((_keys(starts, wide), np.array(which, np.int64), sink.getvalue().to_pybytes()))
    opened: dict = {}

    @F.arrow_udf(out)
    def look(addresses: pa.Array) -> pa.Array:
        if not opened:
            starts, which, packed = sent.value
            opened["all"] = starts, which, pa.ipc.open_stream(packed).read_all()["r"].combine_chunks()
        starts, which, held = opened["all"]
        found = _find(addresses, starts, which, wide)
        return held.take(pa.array(found, mask=found < 0))

    found = df.withColumn("_found", look(F.col(address)))
    return found.select(*df.columns, *(F.col("_found")[c].alias(name) for name, c in fields.items()))


def _swept(df: DataFrame, address: str, ranges: DataFrame, fields: dict[str, str], nested: bool, wide: bool) -> DataFrame:
    """_looked_up for tables of any size."""
    spark = df.sparkSession
    kind = "binary" if wide else "long"
    names = list(dict.fromkeys(fields.values()))
    held = ranges.select(F.col("low").alias("at"), F.col("high").alias("_high"), F.col("rank").alias("_rank"), *names)
    asked = df.select(F.col(address).cast(kind).alias("at")).where("at is not null").distinct()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = held.unionByName(asked, allowMissingColumns=True).repartitionByRange(n, "at")
    both = written(both.withColumn("_part", F.spark_partition_id()))  # the parts are read twice and must be the same
    bounds = both.groupBy("_part").agg(F.min("at").alias("_first"))  # a row for each part
    rank_kind, types = both.schema["_rank"].dataType.simpleString(), {c: both.schema[c].dataType.simpleString() for c in names}
    carried = ", ".join(["_part int", f"at {kind}", f"_high {kind}", f"_rank {rank_kind}", *(f"`{c}` {t}" for c, t in types.items())])

    def last_open(t: pa.Table) -> pa.Table:
        """The ranges of one part that can still count behind it, best first: those that a better one outlasts cannot."""
        high, rank = _ints(t["_high"]), [tuple(r.values()) if isinstance(r, dict) else r for r in t["_rank"].to_pylist()]
        kept, furthest = [], -1
        for i in sorted(range(len(high)), key=lambda i: rank[i]):
            if high[i] > furthest:
                furthest = high[i]
                kept.append(i)
        return t.select(["_part", "at", "_high", "_rank", *names]).take(pa.array(kept, pa.int64()))

    of_parts = both.where("_high is not null")
    later = bounds.select(F.col("_part").alias("_to"), "_first")
    if nested:
        # those that reach the next part
        after = bounds.select((F.col("_part") - 1).alias("_part"), F.col("_first").alias("_next"))
        reach = of_parts.join(F.broadcast(after), "_part").where(F.col("_high") >= F.col("_next"))
        last = written(reach.groupBy("_part").applyInArrow(last_open, carried)).withColumn("_until", F.lit(None).cast(kind))
    else:
        # the last one, up to where the next part's first one begins; a row for each part
        row = F.struct("at", "_high", "_rank", *names)
        ends = of_parts.groupBy("_part").agg(F.max_by(row, "at").alias("r"), F.min("at").alias("_low"))
        until = F.lead("_low").over(Window.orderBy("_part"))
        last = written(ends.withColumn("_until", until).select("_part", "r.*", "_until"))
    # each open range goes to the parts behind it that begin inside it
    met = (F.col("_to") > F.col("_part")) & (F.col("_high") >= F.col("_first")) & (F.col("_until").isNull() | (F.col("_until") >= F.col("_first")))
    handed = F.broadcast(last).join(later, met).select(F.col("_to").alias("_part"), "at", "_high", "_rank", *names)
    out_schema = ", ".join([f"_addr {kind}", *(f"`{c}` {t}" for c, t in types.items())])

    def sweep(t: pa.Table) -> pa.Table:
        own = t.filter(pc.is_valid(t["_high"]))
        low, high = _ints(own["at"]), _ints(own["_high"])
        rank = [tuple(r.values()) if isinstance(r, dict) else r for r in own["_rank"].to_pylist()]
        starts, which = stretches(low, high, rank, nested)
        addresses = t.filter(pc.is_null(t["_high"]))["at"]
        found = _find(addresses, _keys(starts, wide), np.array(which, np.int64), wide)
        hit = pa.array(np.flatnonzero(found >= 0))
        rows = own.select(names).take(pa.array(found[found >= 0]))
        return pa.table({"_addr": addresses.take(hit), **{c: rows[c] for c in names}})

    all_ = both.select("_part", "at", "_high", "_rank", *names).unionByName(handed)
    found = all_.groupBy("_part").applyInArrow(sweep, out_schema)
    return _back(df, address, found, fields)


def _back(df: DataFrame, address: str, found: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows with what was found for their address; rows without one get keys by their content, so they do not meet in one task."""
    key = F.coalesce(F.hex(address), F.concat(F.lit("-"), F.xxhash64(*df.columns).cast("string")))
    found = found.select(F.hex("_addr").alias("_found"), *(F.col(c).alias(f"_of_{name}") for name, c in fields.items()))
    met = df.withColumn("_key", key).join(found, F.col("_key") == F.col("_found"), "left")
    return met.select(*df.columns, *(F.col(f"_of_{name}").alias(name) for name in fields))


def cidr_match(df: DataFrame, address: str, blocks: DataFrame, column: str = "cidr_desc", normalize: bool = False) -> DataFrame:
    """Adds the description of the first block, in the order of ``ord``, that has the address; null for none.

    blocks: ord, lo, hi, descr.  A block whose address has bits beyond its mask matches
    nothing (its lo is not the first address of a range of its size) unless ``normalize``.
    """
    size = F.col("hi") - F.col("lo") + 1
    if df.schema[address].dataType.simpleString() == "bigint":
        if normalize:
            blocks = blocks.withColumns({"lo": F.col("lo") - F.pmod(F.col("lo"), size), "hi": F.col("lo") - F.pmod(F.col("lo"), size) + size - 1})
        else:
            blocks = blocks.where(F.pmod(F.col("lo"), size) == 0)
    few = blocks.orderBy("ord").limit(CASES + 1).collect()
    if len(few) <= CASES:
        chain = None
        for b in few:
            test = F.col(address).between(F.lit(b.lo), F.lit(b.hi))
            chain = F.when(test, b.descr) if chain is None else chain.when(test, b.descr)
        return df.withColumn(column, F.lit(None).cast("string") if chain is None else chain)
    ranges = blocks.select(F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("ord").cast("long").alias("rank"), "descr")
    return _looked_up(df, address, ranges, {column: "descr"}, nested=True)


def _latest(table: DataFrame, *more: str) -> DataFrame:
    """low, high and rank by which of nested ranges the one that begins last counts, then by ``more``, the greatest first."""
    begin = F.col("from_ip")
    if table.schema["from_ip"].dataType.simpleString() == "binary":
        # numbers of 64 bits in the order of unsigned ones
        words = [F.conv(F.substring(F.hex(begin), at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]
    else:
        words = [begin.cast("long")]
    last = [-F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in more]
    last.append(F.xxhash64(*table.columns))  # of equal ones always the same
    rank = F.struct(*((-w).alias(f"w{i}") for i, w in enumerate(words)), *(c.alias(f"m{i}") for i, c in enumerate(last)))
    return table.withColumns({"low": begin, "high": F.col("to_ip"), "rank": rank})


def with_asn(df: DataFrame, address: str, table: DataFrame, prefix: str = "") -> DataFrame:
    """Adds as_short, as_full and as_prefix of the most specific range that has the address.

    table: from_ip, to_ip, prefix, as_single, as_full; of nested ranges the one that begins
    last counts, then the longer prefix; of equal ones the same one each time.
    """
    fields = {f"{prefix}as_short": "as_single", f"{prefix}as_full": "as_full", f"{prefix}as_prefix": "prefix"}
    return _looked_up(df, address, _latest(table, "prefix"), fields, nested=True)


def with_country(df: DataFrame, address: str, table: DataFrame, column: str = "country") -> DataFrame:
    """Adds the country of the nearest range that begins at or below the address, if it reaches it.

    table: from_ip, to_ip, country.  A wider range further below is not looked at, so each
    range ends for us where the next one begins; of two that begin together the wider counts.
    """
    one = table.groupBy("from_ip").agg(F.max_by(F.struct("to_ip", "country"), F.struct("to_ip", "country")).alias("r"))
    one = one.select("from_ip", F.col("r.to_ip").alias("to_ip"), F.col("r.country").alias("country"))
    return _looked_up(df, address, _latest(one), {column: "country"}, nested=False)


def from_words(table: DataFrame, name: str = "from_i", to: str = "to_i") -> DataFrame:
    """A table of IPv6 ranges in four words of 32 bits (from_i4 the highest to from_i1, to_i4 to to_i1) with from_ip and to_ip of 16 bytes."""
    words = lambda n: F.unhex(F.concat(*(F.lpad(F.hex(F.col(f"{n}{i}").cast("long")), 8, "0") for i in (4, 3, 2, 1))))
    rest = [c for c in table.columns if c not in {f"{n}{i}" for n in (name, to) for i in (1, 2, 3, 4)}]
    return table.select(words(name).alias("from_ip"), words(to).alias("to_ip"), *rest)


def by_role(dns: DataFrame, name: str, resolvers: DataFrame) -> DataFrame:
    """Adds ``role`` to each question under a name: 'auth' from a listed resolver, else 'client'."""
    from ..functions import net
    from .filters import each_question, queries

    q = each_question(queries(dns)).where(net.ends_with_any("qname", [name], ignore_case=False))
    one = resolvers.select(F.col(resolvers.columns[0]).alias("_ip")).distinct().withColumn("_is", F.lit(True))
    return q.join(one, F.col("ip_src") == F.col("_ip"), "left").withColumn("role", F.when(F.col("_is"), "auth").otherwise("client")).drop("_ip", "_is")
