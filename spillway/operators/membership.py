"""Membership filters: whether something was asked in an interval, kept as bits and not as names.

A filter is a table of 32-bit words (interval_start, word, bits), so building one is a plain
aggregation and filters of any number of intervals stay distributed.  A filter's size
depends on its parameters alone, not on how often or how much was asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter and positions of an item: about one wrong answer in 100 at 100,000 items.
BITS, HASHES = 1 << 20, 7
WIDTH = 32
#: Words up to which an interval's filter is joined as one row.
WHOLE = 1 << 15


def positions(item: Column | str, bits: int = BITS, hashes: int = HASHES) -> Column:
    """The bits of an item, by double hashing of its MD5; none for null."""
    digest = F.md5(F.col(item) if isinstance(item, str) else item)
    start, step = (F.conv(F.substring(digest, at, 12), 16, 10).cast("long") for at in (1, 13))
    return F.when(digest.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(*(F.pmod(start + step * i, F.lit(bits)) for i in range(hashes))))


def build(items: DataFrame, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(interval_start, word, bits) from rows (interval_start, item); repeated items change nothing."""
    at = items.select("interval_start", F.explode(positions("item", bits, hashes)).alias("at"))
    word = F.floor(F.col("at") / WIDTH).cast("long").alias("word")
    bit = F.expr(f"shiftleft(1L, cast(at % {WIDTH} as int))").alias("bit")
    return at.select("interval_start", word, bit).groupBy("interval_start", "word").agg(F.bit_or("bit").alias("bits"))


def merge(filters: DataFrame, interval: str = "1 day") -> DataFrame:
    """Longer intervals' filters from those of shorter ones, of the same parameters."""
    start = F.window("interval_start", interval).getField("start").alias("interval_start")
    return filters.groupBy(start, "word").agg(F.bit_or("bits").alias("bits"))


def _whole(filters: DataFrame, words: int) -> DataFrame:
    """interval_start and _words, all words of its filter in their order."""
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(words - 1).cast("long"))).alias("word")
    bits = F.shiftright(F.shiftleft("bits", 64 - WIDTH), 64 - WIDTH).cast("int")  # the sign is the highest bit
    every = filters.select("interval_start").distinct().select("interval_start", number)
    full = every.join(filters, ["interval_start", "word"], "left").groupBy("interval_start").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce(bits, F.lit(0)).alias("bits")))).alias("_w"))
    return full.select("interval_start", F.col("_w.bits").alias("_words"))


def contains(filters: DataFrame, asked: DataFrame, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(interval_start, item, found) for each distinct row of ``asked``: false for certain, true very likely."""
    each = asked.select("interval_start", "item").distinct()
    if bits <= WHOLE * WIDTH:
        # items meet their interval's words in one row, so neither they nor their bits are dealt by word
        held = each.join(_whole(filters, -(-bits // WIDTH)), "interval_start", "left")
        hit = F.forall(positions("item", bits, hashes), lambda at: F.call_function("shiftright", F.get("_words", F.floor(at / WIDTH).cast("int")), (at % WIDTH).cast("int")).bitwiseAND(F.lit(1)) == 1)
        nothing = F.col("item").isNull() | F.col("_words").isNull()
        return held.select("interval_start", "item", F.when(nothing, False).otherwise(hit).alias("found"))
    probes = each.select("interval_start", "item", F.explode_outer(F.array_distinct(positions("item", bits, hashes))).alias("at"))
    probes = probes.withColumn("word", F.floor(F.col("at") / WIDTH).cast("long"))
    hit = F.expr(f"coalesce(shiftright(bits, cast(at % {WIDTH} as int)) & 1, 0)") == 1
    return probes.join(filters, ["interval_start", "word"], "left").groupBy("interval_start", "item").agg(F.min(hit).alias("found"))
