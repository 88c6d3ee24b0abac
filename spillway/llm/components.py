"""Connected components by alternating stars, on edges that never leave Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Keys with more than one in so many of all rows, and more rows than the second number, are hubs.
SHARE, LEAST = 1000, 1000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def join_by_key(rows: DataFrame, of_key: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``of_key``, one row for each key with ``n``, the key's rows among ``rows`` (about).

    Hubs, at most ``SHARE`` of them whatever the input, are broadcast, so their rows stay
    where they are and meet in no task; the other keys are joined by shuffle.
    """
    mark = F.col("n") > max(LEAST, n_rows // SHARE)
    hubs, others = of_key.where(mark).drop("n"), of_key.where(~mark).drop("n")
    if hubs.isEmpty():
        return rows.join(others, key)
    near = rows.join(F.broadcast(hubs), key)
    return near.unionByName(rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node that has an edge; label is the component's smallest node.

    Every round links each node's larger neighbours to its smallest one (large star), then
    its smaller neighbours likewise (small star); the number of rounds grows with the
    logarithm of the longest path.  A node's edges meet in minima, which are combined before
    they are dealt, and in joins that deal no hub's edges (``join_by_key``), so a node with
    very many edges is no single task's group.  An empty table gives no rows; loops and
    repeated edges change nothing; null nodes are in no edge.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = cut(known.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct())
    state = _state(e)
    while state[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo"), F.col("hi")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = cut(join_by_key(both.where("v > u"), least, "u", 2 * state[0]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        small = join_by_key(large, least, "hi", state[0])
        e = cut(small.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", "m")).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(e.select("lo", "lo").distinct())
