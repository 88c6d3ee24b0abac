"""Document fingerprints (operator 8): SimHash, in DataFrame operations only.

Terms are neighbouring words (the last word also alone).  A term's 64-bit hash votes on
each bit with the term's weight, the code points of its words up to ``HEAVIEST``; a bit of
the fingerprint is set where the votes for it are more than half of all.  Two bits' votes
share one long, so a text's votes are 32 sums, built up in the aggregation's map side; each
row votes by itself, so copies never add up, and copies' equal results are then one row.

``near`` finds all fingerprints within a Hamming radius: the bits are cut into blocks, and
each table holds every fingerprint under a permutation that puts some of the blocks in
front; two fingerprints within the radius agree in front in at least one table.  Whole
distances are verified in the same join.

The next document of the edited text is the one with the next smaller id, found without a
single sort: ids are dealt by range, each range orders its own, and only the ranges' first
ids are put in one row order.

Cases: a null or empty text has fingerprint zero; rows that share an id share a next
document, and of several rows with the next id the one whose text hashes lowest counts; a
null id comes after all others; a lone document is its own next; repeated rows each give a
row; an empty table gives no rows; a bit with exactly half of the votes is not set; a very
long text is hashed whole (2 GB, more than a string holds, make fewer than 2 ** 32 votes);
extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, store, table, with_row_key
from .components import join_by_key

HEAVIEST = 32
RADIUS = 3
#: Blocks of the permuted tables: two numbers, first bit and width.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
SPACES = " \t\n\x0b\f\r"
#: What a null id counts as in the order.
LOWEST = -(1 << 63)


def votes(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys and fp, the SimHash of ``text``, for each distinct value of the keys, which tell texts apart; ``row`` tells rows apart.

    Each row votes by itself, so that equal ones cannot overflow the packed sums.
    """
    out, keys = keys, [*keys, "row"]
    words = rows.select(*keys, F.split(F.trim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+").alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))
    each = words.select(*keys, F.explode_outer(pairs).alias("term"))
    a, b = F.col("term.a"), F.col("term.b")
    each = each.select(
        *keys,
        F.xxhash64(a, b).alias("term_hash"),
        F.least(F.coalesce(F.char_length(a), F.lit(0)) + F.coalesce(F.char_length(b), F.lit(0)), F.lit(HEAVIEST)).cast("long").alias("weight"),
    )
    lanes = [F.sum(F.shiftrightunsigned("term_hash", j).bitwiseAND(F.lit(0x100000001)) * F.col("weight")).alias(f"v{j}") for j in range(32)]
    sums = each.groupBy(*keys).agg(F.sum("weight").alias("all"), *lanes)
    bits = []
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{j}", 32)
        for bit, n in ((j, low), (j + 32, high)):
            value = 1 << bit if bit < 63 else -(1 << 63)
            bits.append(F.when(n * 2 > F.col("all"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:  # a flat tree: deep nesting is slow to plan
        bits = [reduce(Column.bitwiseOR, bits[i : i + 8]) for i in range(0, len(bits), 8)]
    return sums.select(*out, bits[0].alias("fp")).distinct()


def followers(keys: DataFrame) -> DataFrame:
    """(key, following) for each distinct key: the next smaller one, for the smallest the largest."""
    ranged = keys.select("key").repartitionByRange(F.desc("key")).select("key", F.spark_partition_id().alias("part")).distinct()
    ranged = cut(ranged)
    tops = ranged.groupBy("part").agg(F.max("key").alias("top"))
    # as many rows as ranges
    order = Window.orderBy("part")
    first = F.first("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = tops.select("part", F.coalesce(F.lead("top").over(order), first).alias("next_top"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key")))
    found = ranged.withColumn("inside", inside).join(F.broadcast(after), "part")
    return found.select("key", F.coalesce("inside", "next_top").alias("following"))


def near(stored: DataFrame, asked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(asked, found): every fingerprint fp of ``stored`` within ``radius`` bits of one of ``asked``; both distinct."""
    if radius >= len(BLOCKS):
        raise ValueError("the radius must be below the number of blocks")

    def tables(fp: Column) -> Column:
        keys = []
        for t, front in enumerate(combinations(BLOCKS, len(BLOCKS) - radius)):
            mask = sum(((1 << width) - 1) << at for at, width in front)
            mask = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("front")))
        return F.array(*keys)

    s = stored.select(F.col("fp").alias("found"), F.explode(tables(F.col("fp"))).alias("s"))
    a = asked.select(F.col("fp").alias("asked"), F.explode(tables(F.col("fp"))).alias("a"))
    close = F.bit_count(F.col("asked").bitwiseXOR(F.col("found"))) <= radius
    # an exploded side is many times what its input was estimated at: never broadcast it
    return a.join(s.hint("merge"), (F.col("a.t") == F.col("s.t")) & (F.col("a.front") == F.col("s.front")) & close).select("asked", "found").distinct()


def _hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, fp): fingerprint of each distinct id and text; h is the text's hash."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = with_row_key(docs.select(id, text), "row").select("row", F.coalesce(F.col(id), F.lit(LOWEST)).cast("long").alias("key"), t.alias("t"), F.xxhash64(t).alias("h"))
    return votes(rows, ["key", "h"], F.col("t"))


def fingerprint_report(docs: DataFrame, id: str = "doc_id", text: str = "text", every: int = 20, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: fingerprints of the text and of its edited text, and what they are like.

    near_docs: documents (itself included) within ``radius`` bits, for ids divisible by ``every``, else null.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = with_row_key(docs.select(id, text), "row")
    rows = docs.select("row", F.col(id).alias("id"), F.coalesce(F.col(id), F.lit(LOWEST)).cast("long").alias("key"), t.alias("t"))
    fps = store(votes(rows.select("row", "key", "t", F.xxhash64("t").alias("h")), ["key", "h"], F.col("t")))
    light = rows.select("id", "key", F.char_length("t").cast("long").alias("n"), F.xxhash64("t").alias("h"))
    links = cut(followers(light))
    needs = light.groupBy("key").agg(F.max(F.expr("n div 3")).cast("int").alias("need"), F.count("*").alias("n"))
    of_key = cut(links.join(needs, "key").select("key", "following", "need", "n"))
    sizes = of_key.select("key", "n")
    n_rows = of_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asks = of_key.select(F.col("key").alias("taker"), F.col("following").alias("key"), "need").join(sizes, "key")
    # ids that very many rows share, as missing ones do, stay where they are in both joins; both take the same
    # columns of the texts, so the other texts are dealt once
    texts = rows.select("row", "key", "t")
    head = F.substring(F.col("t"), F.lit(1), F.col("need")).alias("head")
    lent = join_by_key(texts, asks, "key", n_rows).select("taker", F.struct(F.xxhash64("t").alias("h"), head, "key", "row").alias("lent"))
    lent = lent.groupBy("taker").agg(F.min("lent").alias("lent"))
    lent = lent.withColumnRenamed("taker", "key").join(sizes, "key").select("key", F.col("lent").alias("of"), "n")
    edited = join_by_key(texts, lent, "key", n_rows).select(
        "row", "key", F.xxhash64("t").alias("h"), F.char_length("t").alias("n"), "t", "of.head", F.col("of.key").alias("next_key"), F.col("of.h").alias("next_h")
    )
    replaced = F.expr("concat(substring(t, 1, n - cast(n div 3 as int)), substring(head, 1, cast(n div 3 as int)))")
    edited = edited.select("row", "key", "h", replaced.alias("e"), "next_key", "next_h")
    edited = edited.withColumn("edited_sha256", F.sha2("e", 256))
    keys = ["key", "h", "next_key", "next_h", "edited_sha256"]
    edited = votes(edited, keys, F.col("e")).withColumnRenamed("fp", "edited_fp")
    following = fps.select(F.col("key").alias("next_key"), F.col("h").alias("next_h"), F.col("fp").alias("next_fp"))
    out = light.join(edited, ["key", "h"]).join(fps, ["key", "h"]).join(following, ["next_key", "next_h"])
    counted = fps.join(light.groupBy("key", "h").count(), ["key", "h"]).groupBy("fp").agg(F.sum("count").alias("docs"))
    counted = cut(counted)
    asked = fps.where((F.col("key") % every == 0) & (F.col("key") != LOWEST)).select("fp").distinct()
    found = near(counted.select("fp"), asked, radius).join(counted, F.col("found") == F.col("fp"))
    found = cut(found.groupBy(F.col("asked").alias("fp")).agg(F.sum("docs").alias("near_docs")))
    out = out.join(found, "fp", "left")
    return out.select(
        F.col("id").alias(id), F.col("n").alias("n_chars"), "edited_sha256", _hex("fp").alias("fingerprint"), _hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        F.when(F.col("id") % every == 0, F.col("near_docs")).alias("near_docs"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))
