"""Pairing, reassembly and scans as streams, by transformWithState: typed state for each key, pruned by event-time timers.

What a key keeps is in states of its own kind: a map from offset to fragment, a map of
addresses.  A batch reads and writes the entries that it touches, so the cost of a batch
follows its rows and not what is kept.  Each key has at most one timer; when the watermark
passes it, the key's state goes, so what is kept is bounded by what came within the time
limit.  Keys of pairs are dealt into buckets, with one list and one timer each: a batch reads
and writes the lists of the buckets that it touches, which hold what came within the limit.

transformWithState needs Spark's RocksDB state store; each function here chooses it for the
session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import darknet, match, reassembly

_PAIRS = "client string, qname string, qclass int, qtype int, client_port int, query_id int, query_ts timestamp, response_ts timestamp, q_udp_len int, r_udp_len int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _choose_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _rows(rows: list[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """One frame of some rows, none of none; texts and bytes as plain objects."""
    if rows:
        kinds = dict(c.split() for c in schema.split(", "))
        columns = zip(*rows)
        yield pd.DataFrame({c: pd.Series(list(v), dtype=object if k in ("string", "binary") else None) for (c, k), v in zip(kinds.items(), columns)})


class _Timed(StatefulProcessor):
    """A key with one timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def set_timer(self, at_ms: int, now_ms: int) -> None:
        """The only timer of this key; not in the past, as it would never be called."""
        self.clear_timer()
        self.handle.registerTimer(max(at_ms, now_ms + 1))

    def clear_timer(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)


_HELD = "client string, qname string, qclass int, qtype int, client_port int, query_id int, at long, size long"
#: Groups that the keys of pairs are dealt into; the cost of a batch follows its rows, not its keys.
BUCKETS = 1024


def _values(column: pd.Series) -> list:
    """Plain values, None for what is missing; whole numbers stay whole where a missing one made them fractions."""
    if column.dtype == object:
        return column.where(column.notna(), None).tolist()
    return [None if x is pd.NA else x for x in column.astype("Int64").tolist()]


class _Pairs(_Timed):
    """Pairs of the keys of a bucket, all side by side; a bucket keeps one list, of the last query of each key that has no response yet."""

    def __init__(self, timeout_seconds: int):
        self.timeout = timeout_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", _HELD)

    def keep(self, held: pd.DataFrame, now_ms: int) -> None:
        """Keeps the queries whose time is not over, and wakes up when the first one's is."""
        held = held[held["at"] // 1000 + self.timeout // 1000 > now_ms]
        if len(held):
            self.held.put(list(zip(*(_values(held[c]) for c in (*match.KEY, "at", "size")))))
            self.set_timer(int(held["at"].min()) // 1000 + self.timeout // 1000, now_ms)
        else:
            self.held.clear()
            self.clear_timer()

    def kept(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.held.get()), columns=[*match.KEY, "at", "size"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m = pd.concat(list(rows), ignore_index=True)
        m = m.assign(at=m["ts"].astype("datetime64[us]").astype("int64"), size=m["udp_len"].astype("int64"), qr=m["qr"].astype(bool), new=1)
        m = m[[*match.KEY, "at", "size", "qr", "seq", "new"]]
        if self.held.exists():
            m = pd.concat([self.kept().assign(qr=False, seq=0, new=0), m], ignore_index=True)
        m["_key"] = m.groupby(list(match.KEY), dropna=False, sort=False).ngroup()
        m = m.sort_values(["_key", "new", "at", "seq"], ignore_index=True)
        # each message with the one before it in its key; the first with what is kept
        asked = (m["_key"].shift() == m["_key"]) & ~m["qr"].shift(fill_value=True)
        at, size = m["at"].shift(fill_value=0), m["size"].shift(fill_value=0)
        met = m["qr"] & asked & (m["at"] - at <= self.timeout)
        self.keep(m[(m["_key"].shift(-1) != m["_key"]) & ~m["qr"]], timerValues.getCurrentWatermarkInMs())
        if met.any():
            found = m[met]
            out = {c: pd.Series(_values(found[c]), dtype=object if k == "string" else "Int64") for c, k in (x.split() for x in _PAIRS.split(", ")[: len(match.KEY)])}
            out |= {c: pd.to_datetime(x[met].to_numpy(), unit="us") for c, x in (("query_ts", at), ("response_ts", m["at"]))}
            yield pd.DataFrame(out | {"q_udp_len": size[met].to_numpy(), "r_udp_len": found["size"].to_numpy()})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.keep(self.kept(), timerValues.getCurrentWatermarkInMs())
        yield from ()


def stream_pairs(messages: DataFrame, timeout_seconds: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """operators.match.match_qr on a stream: a key keeps its last query's time and size, for so long.

    Keys are dealt into buckets by their hash, as a key has hardly more than two messages;
    how many there are must stay the same for a checkpoint.
    """
    _choose_store(messages.sparkSession)
    m = match.keyed(messages).select(*match.KEY, "qr", F.col("ts").cast("timestamp").alias("ts"), "seq", "udp_len")
    m = m.withWatermark("ts", f"{timeout_seconds} seconds").withColumn("_bucket", F.pmod(F.xxhash64(*match.KEY), F.lit(buckets)))
    return m.groupBy("_bucket").transformWithStateInPandas(_Pairs(timeout_seconds), _PAIRS, "append", "eventTime")


_PACKETS = "src_addr binary, dst_addr binary, ip_proto smallint, frag_id long, ts timestamp, segment binary"


class _Reassembly(_Timed):
    def __init__(self, timeout_seconds: int):
        self.timeout = timeout_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.packet = handle.getValueState("packet", "start double, size long")
        self.parts = handle.getMapState("parts", "ofs long", "segment binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, held = None, set()
        if self.packet.exists():
            start, size = self.packet.get()
            buffer = reassembly.Buffer(start, {k[0]: bytes(v[0]) for k, v in self.parts.iterator()}, size)
            held = set(buffer.parts)
        f = pd.concat(list(rows)).sort_values(["ts", "fragment_ofs"], kind="stable")
        out = []
        # as many steps as one packet has fragments
        for ts, ofs, more, segment in zip(f["ts"], f["fragment_ofs"].tolist(), f["more_frags"].tolist(), f["segment"].tolist()):
            now = ts.timestamp()
            if buffer is None or now - buffer.start > self.timeout:
                buffer = reassembly.Buffer(now)
                self._forget(held)
            whole = buffer.add(int(ofs), bool(more), bytes(segment))
            if whole is not None:
                out.append((*key, ts, whole))
                buffer = None
                self._forget(held)
        if buffer is None:
            self.packet.clear()
            self.clear_timer()
        else:
            self.packet.update((buffer.start, buffer.size))
            for ofs in buffer.parts.keys() - held:  # fragments that are kept already are not written again
                self.parts.updateValue((ofs,), (buffer.parts[ofs],))
            self.set_timer(int((buffer.start + self.timeout) * 1000), timerValues.getCurrentWatermarkInMs())
        yield from _rows(out, _PACKETS)

    def _forget(self, held: set) -> None:
        if held:
            self.parts.clear()
            held.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.packet.clear()
        self.parts.clear()
        yield from ()


def stream_reassembly(fragments: DataFrame, timeout_seconds: int = 30) -> DataFrame:
    """Fragments (ts, src_addr, dst_addr, ip_proto, frag_id, fragment_ofs, more_frags, segment) as whole packets (key, ts, segment)."""
    _choose_store(fragments.sparkSession)
    grouped = fragments.withWatermark("ts", f"{timeout_seconds} seconds").groupBy(*reassembly.KEY)
    return grouped.transformWithStateInPandas(_Reassembly(timeout_seconds), _PACKETS, "append", "eventTime")


_SCANS = "key string, ip_count long, saturated boolean, seen long, first_seen timestamp, last_seen timestamp"


class _Scans(_Timed):
    def __init__(self, threshold: int, prune_seconds: int, keep_seconds: int):
        self.threshold, self.prune, self.keep = threshold, prune_seconds, keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", "count long, seen long, first long, last long")
        self.addresses = handle.getMapState("addresses", "address long", "seen boolean")

    def limit_ms(self, count: int, first: int, last: int) -> int:
        if count > self.threshold:
            return last // 1000 + 1000 * self.keep
        return first // 1000 + 1000 * (60 if count == 1 else self.prune)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        count, seen, first, last = self.totals.get() if self.totals.exists() else (0, 0, None, None)
        if first is not None and self.limit_ms(count, first, last) <= now:
            self.addresses.clear()
            count, seen, first, last = 0, 0, None, None
        for part in rows:
            seen += len(part)
            at = part["ts"].astype("datetime64[us]").astype("int64")
            a, b = int(at.min()), int(at.max())
            first, last = (a, b) if first is None else (min(first, a), max(last, b))
            for address in part["dst_v4"].unique().tolist():
                if count >= darknet.SATURATED:
                    break
                if not self.addresses.containsKey((address,)):
                    self.addresses.updateValue((address,), (True,))
                    count += 1
        full = count >= darknet.SATURATED
        if full:
            self.addresses.clear()
        self.totals.update((count, seen, first, last))
        self.set_timer(self.limit_ms(count, first, last), now)
        out = [(*key, count, full, seen, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"))] if count > self.threshold else []
        yield from _rows(out, _SCANS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        self.addresses.clear()
        yield from ()


def stream_scans(dns: DataFrame, low: int, high: int, query_threshold: int = 1, prune_interval: int = 600, keep: int = 86_400, late: str = "30 seconds") -> DataFrame:
    """operators.darknet.scans on an endless stream, in update mode: a key's row each time it is asked beyond the threshold.

    A key below the threshold is forgotten 60 seconds after it was first seen if it has one
    address, else after ``prune_interval`` seconds; a key above it ``keep`` seconds after it
    was last seen.  A key keeps at most SATURATED addresses, and none from there on: how many
    there are beyond comes from ``scan_sketches``.
    """
    _choose_store(dns.sparkSession)
    q = darknet.scan_queries(dns, low, high).select("key", F.col("dst_v4").cast("long").alias("dst_v4"), F.col("ts").cast("timestamp").alias("ts"))
    q = q.withWatermark("ts", late).groupBy("key")
    return q.transformWithStateInPandas(_Scans(query_threshold, prune_interval, keep), _SCANS, "update", "eventTime")


def scan_sketches(dns: DataFrame, low: int, high: int, interval: str = "1 hour") -> DataFrame:
    """interval_start, key, sketch of the addresses asked: a windowed aggregation, for a stream with a watermark or a batch."""
    q = darknet.scan_queries(dns, low, high)
    out = q.groupBy(F.window("ts", interval), "key").agg(F.hll_sketch_agg(F.col("dst_v4").cast("long"), F.lit(14)).alias("sketch"))
    return out.select(F.col("window.start").alias("interval_start"), "key", "sketch")


def with_estimates(scans: DataFrame, sketches: DataFrame) -> DataFrame:
    """Adds ``approx``, the estimated number of addresses of each saturated key over all of its sketches, else 0."""
    total = sketches.groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("_n"))
    return scans.join(total, "key", "left").withColumn("approx", F.when(F.col("saturated"), F.col("_n")).otherwise(0).cast("long")).drop("_n")
