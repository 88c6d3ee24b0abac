"""Periodic runs (operator 11): stretches of words that repeat with one period, found by multi-scale minimizers.

A run is a maximal stretch with smallest period q and a length of at least ``LEAST`` words and
``TIMES`` periods.  Each document is searched by itself, many side by side as arrays of word numbers:

* Periods below ``LEAST`` are found by direct lag scans: all words are compared with those q further on.
* For longer ones the scales are tau = LEAST, 2 LEAST, 4 LEAST, ...  Scale tau finds periods from tau up
  to 2 tau.  The tau-gram of a position is named by a hash, and those that are least in some window
  of tau positions are its minimizers.  A window in a run looks like the one a period further on, so
  both have the same minimizer: pairs of equal minimizers at a distance from tau up to 2 tau seed an
  extension in both directions, word by word, which decides.
* tau-grams with a period of tau / 3 or less are no minimizers.  All of them lie in runs that the
  scales before have found, every longer period has others, and equal ones of the others are more
  than tau / 3 apart: so a minimizer has a handful of partners, and the work of a scale follows the
  number of words, whatever the text repeats.
* Hashes choose seeds only: words are numbered by their bytes and compared by number.  A stretch that
  shorter periods explain has the same ends as their run, and is dropped for it.

Memory follows a run of documents of about 2 MB, or one longer document; nothing is shuffled.

Cases: a null, empty or short text has no runs, and what is kept of it are its words; a very long
text is searched whole, by itself; rows are judged each by itself, so ids may be null or shared; an
empty table gives no rows; of runs with equal exponents the one that starts first, then the one of
the shorter period is the greatest; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P1, P4, Words, blocks, mixed, table, texts_of

#: A run has this many words and periods at least.
LEAST, TIMES = 24, 3
#: Words that one step of an extension compares.
STEP = 32
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = np.uint64((1 << 64) - 1)


def numbered(w: Words) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    data, start, _ = w.joined()
    offsets = np.append(start, len(data))
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), buffers)
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(a * P1 + (b ^ P4))


def gram_names(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each position on; nothing where there are fewer."""
    have, names = 1, mixed(words.astype(np.uint64) + np.uint64(1))
    bits = bin(size)[3:]
    one = names
    for bit in bits:
        names, have = _pair(names[: len(names) - have], names[have:]), 2 * have
        if bit == "1":
            names, have = _pair(names[: len(names) - 1], one[have:]), have + 1
    return names


def _sliding(values: np.ndarray, size: int, best: np.ufunc, none: np.uint64) -> np.ndarray:
    """best of each ``size`` neighbours, from the first whole window on."""
    n = len(values)
    padded = np.full(-(-n // size) * size, none, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, size)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = np.ascontiguousarray(best.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return best(back[: n - size + 1], ahead[size - 1 : n])


def minimizers(names: np.ndarray, size: int) -> np.ndarray:
    """Positions whose name is the least of some ``size`` neighbours; ``NOTHING`` is no name."""
    none = np.full(size - 1, NOTHING, np.uint64)
    least = _sliding(np.concatenate([none, names, none]), size, np.minimum, NOTHING)
    # of the windows with a position, the greatest minimum is its own name where one has no lesser
    return np.flatnonzero((_sliding(least, size, np.maximum, np.uint64(0)) == names) & (names != NOTHING))


def _reach(words: np.ndarray, at: np.ndarray, lag: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on (step 1) or before it (step -1) equal those ``lag`` further on, at most ``limit``."""
    done = np.zeros(len(at), np.int64)
    live = np.flatnonzero(limit > 0)
    width = STEP
    span = np.arange(width)
    first = 0 if step > 0 else -1
    while len(live):
        k = done[live, None] + span
        inside = k < limit[live, None]
        here = np.where(inside, at[live, None] + first + step * k, 0)
        same = inside & (words[here] == words[np.where(inside, here + lag[live, None], 0)])
        good = np.where(same.all(1), width, same.argmin(1))
        done[live] += good
        live = live[(good == width) & (done[live] < limit[live])]
        if width < 4096 and len(live) * width < 1 << 16:
            width *= 2
            span = np.arange(width)
    return done


def _lag_scan(words: np.ndarray, doc: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches whose words equal those ``lag`` further on, long enough for a run."""
    same = np.zeros(len(words) - lag + 2, bool)
    same[1:-1] = (words[:-lag] == words[lag:]) & (doc[:-lag] == doc[lag:])
    turns = np.flatnonzero(same[1:] != same[:-1])
    start, end = turns[::2], turns[1::2] + lag
    long = end - start >= max(LEAST, TIMES * lag)
    return start[long], end[long]


def _scale(words: np.ndarray, first: np.ndarray, tau: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of stretches with a period from tau up to 2 tau, from equal minimizers."""
    n = len(words)
    names = gram_names(words, tau)
    # grams that go beyond their document, and those that a run of a short period has whole
    out = np.zeros(len(names) + 1, np.int32)
    ends = first[1:]
    np.add.at(out, np.minimum(np.maximum(ends - tau + 1, first[:-1]), len(names)), 1)
    np.add.at(out, np.minimum(ends, len(names)), -1)
    some = runs[(TIMES * runs[:, 2] <= tau) & (runs[:, 1] - runs[:, 0] >= tau)]
    np.add.at(out, some[:, 0], 1)
    np.add.at(out, np.minimum(some[:, 1] - tau + 1, len(names)), -1)
    names[np.cumsum(out[:-1]) > 0] = NOTHING
    at = minimizers(names, tau)
    at = at[np.lexsort((at, names[at]))]
    name = names[at]
    doc = np.searchsorted(first, at, "right")
    seeds, lags, shift, more = [], [], 1, True
    while more and shift < len(at):
        gap = at[shift:] - at[:-shift]
        kin = (name[shift:] == name[:-shift]) & (doc[shift:] == doc[:-shift]) & (gap < 2 * tau)
        good = kin & (gap >= tau)
        seeds.append(at[:-shift][good])
        lags.append(gap[good])
        more, shift = bool(kin.any()), shift + 1
    if not seeds or not sum(map(len, seeds)):
        none = np.zeros(0, np.int64)
        return none, none, none
    seed, lag = np.concatenate(seeds), np.concatenate(lags)
    order = np.lexsort((seed, lag))
    seed, lag = seed[order], lag[order]
    doc = np.searchsorted(first, seed, "right") - 1
    # each seed extends up to the next one of its lag; one that reaches it is of the same stretch
    stop = first[doc + 1] - lag
    chain = (lag[1:] == lag[:-1]) & (doc[1:] == doc[:-1])
    limit = stop - seed
    limit[:-1][chain] = (seed[1:] - seed[:-1])[chain]
    right = seed + _reach(words, seed, lag, limit, 1)
    joined = np.append(False, chain & (right[:-1] == seed[1:]))
    head = np.flatnonzero(~joined)
    left = seed[head] - _reach(words, seed[head], lag[head], seed[head] - first[doc[head]], -1)
    tail = np.append(head[1:] - 1, len(seed) - 1)
    start, end, period = left, right[tail] + lag[head], lag[head]
    long = end - start >= TIMES * period
    return start[long], end[long], period[long]


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period; positions count through all documents.

    words: numbers of the words of all documents; first: where each document begins, and their number.
    """
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    found = [np.zeros((0, 3), np.int64)]
    for lag in range(1, min(LEAST, len(words))):
        start, end = _lag_scan(words, doc, lag)
        found.append(np.stack([start, end, np.full(len(start), lag)], 1))
    del doc
    runs = _smallest(np.concatenate(found))
    tau = LEAST
    size = np.diff(first)
    while (size >= TIMES * tau).any():
        # only documents that can have a run of this scale
        long = size >= TIMES * tau
        own = np.repeat(long, size)
        some = np.zeros(int(long.sum()) + 1, np.int64)
        np.cumsum(size[long], out=some[1:])
        away = (first[:-1][long] - some[:-1])[:, None]
        of = np.searchsorted(first, runs[:, 0], "right") - 1
        inner = runs[long[of]]
        inner[:, :2] -= away[np.cumsum(long)[of[long[of]]] - 1]
        new = np.stack(_scale(words[own], some, tau, inner), 1)
        new[:, :2] += away[np.searchsorted(some, new[:, 0], "right") - 1]
        runs = _smallest(np.concatenate([runs, new]))
        tau *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of stretches with the same ends the one of the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = (runs[1:, :2] == runs[:-1, :2]).all(1)
    return runs[np.append(True, ~same)] if len(runs) else runs


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether some run has each word after the run's first period."""
    turn = np.zeros(n + 1, np.int32)
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 1], -1)
    return np.cumsum(turn[:-1]) > 0


def _order(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Greater length / period first, then smaller start, then smaller period."""
    return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]


def collapse_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_runs, the greatest run's start, length, period and exponent_milli,
    runs array<struct<start, length, period>> and collapsed_text, without what repeats; with ``digest`` the
    hashes of both instead."""
    kind = docs.schema[id].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in blocks(texts):
                w = Words(texts.slice(a, b - a))
                runs = find_runs(numbered(w), w.first)
                keep = ~dropped(runs, len(w))
                data, start, end = w.joined()
                del w.data
                turn = np.zeros(len(data) + 1, np.int8)
                turn[start[keep]] += 1
                turn[end[keep] + 1] -= 1
                inside = np.cumsum(turn[:-1], dtype=np.int8).astype(bool)
                data = data[inside]
                size = np.where(keep, end - start + 1, 0)
                stop = np.append(0, np.cumsum(size))[w.first]
                kept = [data[x : max(x, y - 1)].tobytes() for x, y in zip(stop[:-1].tolist(), stop[1:].tolist())]
                cuts = np.searchsorted(runs[:, 0], w.first).tolist()
                rows = runs.copy()
                rows[:, 1] -= rows[:, 0]
                rows[:, 0] -= w.first[np.searchsorted(w.first, rows[:, 0], "right") - 1]
                own = [list(map(tuple, rows[x:y].tolist())) for x, y in zip(cuts, cuts[1:])]
                best = [min(x, key=cmp_to_key(_order)) if x else None for x in own]
                out = {
                    id: batch.column(0).slice(a, b - a),
                    "n_runs": pa.array(map(len, own), pa.int64()),
                    "start": pa.array([x and x[0] for x in best], pa.int64()),
                    "length": pa.array([x and x[1] for x in best], pa.int64()),
                    "period": pa.array([x and x[2] for x in best], pa.int64()),
                    "exponent_milli": pa.array([x and 1000 * x[1] // x[2] for x in best], pa.int64()),
                }
                if digest:
                    lines = ("".join(f"{s},{n},{q}\n" for s, n, q in x) for x in own)
                    out["runs_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines], pa.string())
                    out["collapsed_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                else:
                    out["runs"] = pa.array([[dict(zip(run_type.names, r)) for r in x] for x in own], pa.list_(run_type))
                    out["collapsed_text"] = pa.array([x.decode() for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"))
    more = "runs_sha256 string, collapsed_sha256 string" if digest else (
        "runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    )
    return rows.mapInArrow(run, f"`{id}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, {more}")


def with_planted_runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): in texts whose id hashes to a multiple of 10 the words from one place on repeat a stretch of the text.

    A null id hashes to nothing: its text stays.
    """
    h = F.crc32(F.col(id).cast("string"))
    g = F.expr("h div 10")
    n = F.size("words")
    step = (F.lit(3) + g % 8).cast("long")
    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"), h.alias("h"))
    # only texts that change are cut into words
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("step", step)
    rows = rows.withColumn("p", F.expr("cast(1 + (size(words) - a) div step as int)"))
    planted = F.expr("array_join(transform(sequence(0, size(words) - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')")
    return rows.select(F.col(id), F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return collapse_runs(with_planted_runs(docs), digest=True)
