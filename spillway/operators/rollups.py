"""Hours rolled up to days and weeks without reading messages again: frequent names, clients, distributions.

Each kind is kept by hour as a table of Spark's own mergeable states and turned into a report
of any period:

* frequent items (``approx_top_k_accumulate``): candidates of a period from its hours, then
  their exact numbers, as only candidates are counted;
* addresses as bitmaps (``bitmap_construct_agg``): exact numbers of distinct clients;
* KLL sketches (``kll_sketch_agg_bigint``): distributions within a known error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from .filters import from_addresses, queries, to_addresses, usable
from .popularity import ranked

#: Items that a sketch of frequent ones tracks, and accuracy (log of the size) of KLL sketches.
TRACKED, KLL = 4096, 400
#: Values whose hours an address bitmap has.
PERIODS = ("hour", "day", "week")


# --- frequent items ---------------------------------------------------------


def error_share(tracked: int) -> float:
    """Of all items counted, the share by which a sketch of frequent items is wrong at most: 3.5 by its table's size."""
    return 3.5 / 2 ** math.ceil(math.log2(tracked / 0.75))


def frequent(items: DataFrame, interval: str = "1 hour", tracked: int = TRACKED) -> DataFrame:
    """interval_start, kind, sketch and n (items in all) of rows (ts, kind, key)."""
    start = net.interval_start("ts", interval).alias("interval_start")
    return items.where("key is not null").groupBy(start, "kind").agg(F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("sketch"), F.count("*").alias("n"))


def merged_frequent(sketches: DataFrame, interval: str = "1 day", tracked: int = TRACKED) -> DataFrame:
    """Longer intervals from shorter ones."""
    start = net.interval_start("interval_start", interval).alias("interval_start")
    return sketches.groupBy(start, "kind").agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.sum("n").alias("n"))


def exact_top(items: DataFrame, sketches: DataFrame, interval: str, top: int, tracked: int = TRACKED) -> DataFrame:
    """interval_start, kind, rank, key, n: the ``top`` most frequent keys, exactly, from sketches of the same intervals.

    Items (ts, kind, key) are counted only where the sketch names their key as a candidate,
    so all others stay where they are.  No other key has more than the sketch's error or its
    last candidate's estimate, whichever is greater; where the last listed number is not
    above that, the interval and kind are counted in full.
    """
    n_candidates = min(tracked, 4 * top)
    found = sketches.select("interval_start", "kind", "n", F.expr(f"approx_top_k_estimate(sketch, {n_candidates})").alias("e"))
    # as many rows as intervals, kinds and candidates; a sketch may have given up keys however many it still has
    last = F.when(F.size("e") == n_candidates, F.element_at("e", -1)["count"]).otherwise(0)
    bound = F.greatest(last, F.ceil(F.col("n") * error_share(tracked))).cast("long")
    limits = found.select("interval_start", "kind", bound.alias("bound"))
    candidates = found.select("interval_start", "kind", F.explode("e").alias("c")).select("interval_start", "kind", F.col("c.item").alias("key"))
    keyed = items.where("key is not null").select(net.interval_start("ts", interval).alias("interval_start"), "kind", "key")
    counts = keyed.join(candidates, ["interval_start", "kind", "key"], "left_semi").groupBy("interval_start", "kind", "key").agg(F.count("*").alias("n"))
    best = ranked(counts, ["interval_start", "kind"], top)
    sure = best.groupBy("interval_start", "kind").agg(F.min("n").alias("least"), F.count("*").alias("listed")).join(limits, ["interval_start", "kind"])
    sure = sure.where((F.col("least") > F.col("bound")) & (F.col("listed") == top)).select("interval_start", "kind")
    rest = keyed.join(sure, ["interval_start", "kind"], "left_anti").groupBy("interval_start", "kind", "key").agg(F.count("*").alias("n"))
    again = ranked(rest, ["interval_start", "kind"], top)
    out = best.join(sure, ["interval_start", "kind"], "left_semi").unionByName(again)
    return out.select("interval_start", "kind", "rank", "key", "n")


def name_items(dns: DataFrame) -> DataFrame:
    """(ts, kind, key) of usable queries: names and second-level domains."""
    q = usable(queries(dns))
    kinds = {"qname": F.col("qname"), "sld": net.sld("qname")}
    return q.select("ts", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds.items()))).alias("e")).select("ts", "e.kind", "e.key")


# --- clients ----------------------------------------------------------------


def client_bitmaps(dns: DataFrame, server_ips: list[str] | DataFrame | None = None, measure_direction: int = 0) -> DataFrame:
    """interval_start (hour), bucket, bitmap and n of the IPv4 clients (or of the servers asked) of queries.

    A bitmap has a bit for each of 32,768 neighbouring addresses (4 KB), so a table is at
    most 131,072 rows an hour however many messages there are; partial ones meet in the shuffle.
    """
    inward = measure_direction == 0
    m = (to_addresses if inward else from_addresses)(queries(dns), server_ips).where("ip_type = 4")
    address = F.col("src_v4" if inward else "dst_v4")
    hour = F.date_trunc("hour", "ts").cast(dns.schema["ts"].dataType).alias("interval_start")
    return m.where(address.isNotNull()).groupBy(hour, F.bitmap_bucket_number(address).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(address)).alias("bitmap"), F.count("*").alias("n")
    )


def clients_of(bitmaps: DataFrame, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """period, interval_start, clients_v4, messages_v4 of each hour, day and week (from Monday), from bitmaps by hour."""
    kind = bitmaps.schema["interval_start"].dataType
    starts = F.array(*(F.struct(F.lit(p).alias("period"), F.date_trunc(p, "interval_start").cast(kind).alias("start")) for p in periods))
    each = bitmaps.select(F.explode(starts).alias("p"), "bucket", "bitmap", "n")
    merged = each.groupBy("p.period", F.col("p.start").alias("interval_start"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("n").alias("n"))
    return merged.groupBy("period", "interval_start").agg(F.sum(F.bitmap_count("bitmap")).alias("clients_v4"), F.sum("n").alias("messages_v4"))


# --- distributions ----------------------------------------------------------


def distribution_sketches(values: DataFrame, interval: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """interval_start, the columns of ``by``, sketch of rows (ts, value)."""
    start = net.interval_start("ts", interval).alias("interval_start")
    return values.groupBy(start, *by).agg(F.kll_sketch_agg_bigint(F.col("value").cast("long"), F.lit(KLL)).alias("sketch"))


def merged_distributions(sketches: DataFrame, interval: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    start = net.interval_start("interval_start", interval).alias("interval_start")
    return sketches.groupBy(start, *by).agg(F.kll_merge_agg_bigint("sketch", F.lit(KLL)).alias("sketch"))


def shares_up_to(sketch: Column | str, marks: list[int]) -> Column:
    """For each mark the share of the values that are at most that, within about 1 percent: array<double>."""
    return F.kll_sketch_get_rank_bigint(sketch, F.array(*(F.lit(m).cast("long") for m in marks)))


def distribution_table(sketches: DataFrame, marks: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """interval_start, the columns of ``by``, value, share: a CDF at the marks, from sketches of any intervals."""
    at = F.arrays_zip(F.array(*map(F.lit, marks)).alias("value"), shares_up_to("sketch", marks).alias("share"))
    return sketches.select("interval_start", *by, F.explode(at).alias("e")).select("interval_start", *by, "e.value", "e.share")
