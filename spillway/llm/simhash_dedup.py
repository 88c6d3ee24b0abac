"""SimHash near-duplicates (operator 3) by multi-index hashing.

A document's fingerprint is the majority, bit by bit, of the XXH64 of its shingles.  Only
distinct fingerprints are compared.  Each is stored in one table for each segment of its
bits.  At most four differing bits over segments of radius 1, 1 and 0 leave at least one
segment within its radius (four errors cannot give 2 + 2 + 1), so every link is found by
looking up, in each table, the small Hamming ball around the segment's value; of two values
that differ in some bits one has the lowest of these set, and only that one asks.  From
``MANY`` fingerprints on, two segments of 32 bits with radius 2 and 1 keep the tables' cells
small (four errors cannot give 3 + 2); both layouts find every link.  The lookup joins on
segment and value and verifies the whole distance in the same step.  Components of the
links are found on fingerprints and given the smallest document id.

Cases: a null, empty or blank text has fingerprint zero and links like any other; fewer
words than a shingle make one shingle of them all; a very long text is hashed whole, as a
run of its own; a bit set in exactly half of the hashes is not set; repeated rows each give a
row; a null id is never a component's name unless all its ids are null; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, cut, hash_spans, store, table, texts_of
from .components import connected_components, join_by_key

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Shift, width and radius of each segment, for fewer and for more than MANY fingerprints: radii and number of segments add up to DISTANCE + 1.
FEW_SEGMENTS, MANY_SEGMENTS, MANY = ((0, 22, 1), (22, 22, 1), (44, 20, 0)), ((0, 32, 2), (32, 32, 1)), 1 << 25


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits set in more than half of them."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
        most = 2 * ones > np.diff(first)[some][:, None]
        out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_block(texts: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    w = Words(texts, lower=True)
    data, start, end = w.joined()
    shingles = np.where(w.count >= size, w.count - size + 1, np.minimum(w.count, 1))
    first = np.concatenate([[0], np.cumsum(shingles)])
    doc = np.repeat(np.arange(len(texts)), shingles)
    head = w.first[doc] + np.arange(first[-1]) - first[doc]
    tail = np.minimum(head + size, w.first[doc + 1]) - 1
    return _majority(hash_spans(data, start[head], end[tail], seed), first)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            found = [fingerprint_block(texts.slice(a, b - a)) for a, b in blocks(texts)]
            fp = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({id: batch.column(0), "fp": pa.array(fp, pa.int64())})

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{id}` {kind}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _ball(shift: int, width: int, radius: int) -> list[tuple[int, int]]:
    """Bits to flip, and the lowest of them, for every value within the radius but the centre itself."""
    out = []
    for r in range(1, radius + 1):
        for bits in combinations(range(shift, shift + width), r):
            out.append((_signed(sum(1 << b for b in bits)), _signed(1 << bits[0])))
    return out


def links(distinct: DataFrame, distance: int = DISTANCE, segments: tuple | None = None) -> DataFrame:
    """(a, b), a < b: every two fingerprints of column fp at most ``distance`` bits apart."""
    segments = segments or (FEW_SEGMENTS if distinct.count() < MANY else MANY_SEGMENTS)
    if distance > sum(r for *_, r in segments) + len(segments) - 1:
        raise ValueError("the segments' radii do not cover this distance")
    # each row becomes many: dealt first, or the few tasks that hold the small table would make them all
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.select("fp").repartition(parts, "fp")

    def key(value, segment: int):
        shift, width, _ = segments[segment]
        return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseXOR(F.lit(segment << 32))

    entries = F.array(*(key(F.col("fp"), s) for s in range(len(segments))))
    stored = distinct.select(F.col("fp").alias("b"), F.explode(entries).alias("key"))
    probes = []
    for s, segment in enumerate(segments):
        probes.append(distinct.select(F.col("fp").alias("a"), key(F.col("fp"), s).alias("key"), F.lit(True).alias("same")))
        ball = _ball(*segment)
        if ball:
            flips = F.array(*(F.struct(F.lit(f).alias("bits"), F.lit(low).alias("low")) for f, low in ball))
            around = distinct.select(F.col("fp").alias("a"), F.explode(flips).alias("flip")).where("(a & flip.low) <> 0")
            probes.append(around.select("a", key(F.col("a").bitwiseXOR(F.col("flip.bits")), s).alias("key"), F.lit(False).alias("same")))
    probes = reduce(DataFrame.union, probes)
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (~F.col("same") | (F.col("a") < F.col("b")))
    # an exploded side is many times what its input was estimated at: never broadcast it
    found = probes.join(stored.hint("merge"), (probes["key"] == stored["key"]) & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def components(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, least, label) from (fp, least): label is the smallest fingerprint reachable, whatever the ids are."""
    label = connected_components(links(distinct.select("fp"), distance), "a", "b")
    return distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), distance: int = DISTANCE) -> DataFrame:
    """id, text and the columns of ``carry`` of one row for each component.

    That is the row with the smallest id, nulls last; of several rows with that id the one
    with the smallest hash of its text, then of the carried columns.  Ids need not be there
    or be unique: only rows of one component are weighed against each other.
    """

    def hashed(*columns: str):
        # xxhash64 passes over nulls, so what is null is hashed too
        return F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))

    order = F.struct(F.col(id).isNull().alias("missing"), F.col(id).alias("id"), hashed(text).alias("text"), (hashed(*carry) if carry else F.lit(0)).alias("rest"))
    keyed = docs.select(id, text, *carry, order.alias("order"))
    rows = fingerprints(keyed, "order", text)
    distinct = cut(rows.groupBy("fp").agg(F.min("order").alias("least")))
    first = components(distinct, distance).groupBy("label").agg(F.min("least").alias("least")).select("least")
    parts = ("missing", "id", "text", "rest")
    same = [keyed["order"][p].eqNullSafe(first["least"][p]) if p == "id" else keyed["order"][p] == first["least"][p] for p in parts]
    kept = keyed.join(first, same, "left_semi")
    # rows alike in all of the order are copies
    return kept.groupBy("order").agg(*(F.first(c).alias(c) for c in (id, text, *carry))).select(id, text, *carry)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """id, fingerprint (hex) and component_id (the smallest id reachable) for each row."""
    rows = store(fingerprints(docs, id, text))
    distinct = cut(rows.groupBy("fp").agg(F.min(id).alias("least")))
    named = cut(components(distinct, distance))
    smallest = cut(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    component = join_by_key(named, smallest, "label", named.count()).select("fp", "component_id")
    copies = rows.groupBy("fp").agg(F.count("*").alias("n"))
    component = cut(component.join(copies, "fp"))
    return join_by_key(rows, component, "fp", rows.count()).select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
