"""Substring dedup (operator 4) by recompression.

Words become symbols; words of a run (equal neighbours) are named as such, however long the
run is.  In each of a few rounds neighbouring symbols pair up where the left one is of the
round's left half of the alphabet and the right one of its right half, and a pair is named
anew.  Which half a symbol is of and what a pair is called depend on the symbols alone (64-bit
hashes), so the names agree over the whole corpus without an exchange in each round, and
the symbols of a run, which never pair among themselves, are one name.  A symbol's width is
bounded by its round, so equal windows of words have equal symbols but for a margin at
either end.

1. Each block of documents gives its names, at most two of a kind; Spark deals them by name.
2. A name that two documents share goes back to the blocks that have it.
3. A window is a candidate where every symbol of its interior is shared.  Candidates get
   two hashes of all their words; Spark deals these by the first.
4. A window in two documents goes back to its blocks with the smallest document that has it.
5. Words covered by a window of a smaller document are removed.

Names and windows travel as packed arrays, one row for each block and range of hashes; a
block hands in a hash once however many documents share it, so no range is a hot group.
Names only choose candidates, so equal names of different symbols cost time and nothing
else.  Windows are held equal if 128 bits of them are: two hashes from words hashed with
two seeds.

Cases: a null, empty or short text (fewer words than a window) loses nothing; a very long
text is a run of its own in its block; rows that share an id are judged alike, neither
removing from the other; a row with a null id loses what any numbered document has, and
removes from none; an empty table gives no rows; extra columns travel with their row if named
in ``carry``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P1, P4, Words, blocks, mixed, table, texts_of, total_bytes, with_row_key

WINDOW = 50
#: Bytes of text in a block, and names in a range of hashes, about.
BLOCK, RANGE = 4 << 20, 1 << 20
ROUNDS = 5
#: The order of a null id: after every other.
LAST = np.iinfo(np.int64).max
_ODD, _RUN = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def rounds_for(window: int) -> int:
    """Rounds whose margins leave at least half of the longest symbol inside a window."""
    return max(0, min(ROUNDS, math.isqrt(window) - 1))


def margin_of(rounds: int) -> int:
    """Words at either end of a window whose symbols depend on what lies outside: one for runs, and each round's width."""
    return rounds * (rounds + 1) // 2 + (rounds > 0)


def symbols(hashes: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and widths (in words) after all rounds; symbols never leave their document."""
    name, width = hashes, np.ones(len(hashes), np.int64)
    if rounds:
        same = np.zeros(len(name) + 1, bool)
        same[1:-1] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
        name = np.where(same[1:] | same[:-1], mixed(name ^ _RUN), name)
    with np.errstate(over="ignore"):
        for r in range(1, rounds + 1):
            right = mixed(name ^ np.uint64(r * _ODD & (1 << 64) - 1)) & np.uint64(1) == 1
            pair = np.zeros(len(name), bool)
            pair[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:]) & (width[:-1] + width[1:] <= r + 1)
            second = np.zeros(len(name), bool)
            second[1:] = pair[:-1]
            i = np.flatnonzero(pair)
            name, width = name.copy(), width.copy()
            name[i] = mixed(name[i] * P1 + (name[i + 1] ^ P4))
            width[i] += width[i + 1]
            name, width, doc = name[~second], width[~second], doc[~second]
    return mixed(name), width


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` consecutive words, whole arrays at a time."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, step = np.zeros(n, np.uint64), 1
        # doubling: sums over 1, 2, 4 ... words, added up along the window's binary digits
        part, done, left = mixed(hashes), 0, window
        while left:
            if left & 1:
                out = out * (P1 ** np.uint64(step)) + part[done : done + n] if done else part[:n].copy()
                done += step
            left >>= 1
            if left:
                part = part[:-step] * (P1 ** np.uint64(step)) + part[step:]
                step *= 2
        return mixed(out)


def _ranges(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Range number of each sorted hash's top bits, and where ranges begin."""
    top = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    return top, np.flatnonzero(np.diff(top, prepend=-1))


def _pieces(texts: pa.Array, ids: np.ndarray):
    for a, b in blocks(texts):
        w = Words(texts.slice(a, b - a))
        yield w, w.hashes(), ids[a:b]


def _columns(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    return texts_of(t.column("text")), pc.fill_null(t.column("id"), LAST).to_numpy()


def _low(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below the range number: what tells names of a range apart."""
    return (hashes >> np.uint64(32 - bits)).astype(np.uint32)


def _sorted(h: np.ndarray, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The three arrays in the order of all, and which entries are the first with their two hashes."""
    order = np.lexsort((d, g, h))
    h, g, d = h[order], g[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h, g, d, new


def _find(h: np.ndarray, g: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """d of the entry with both hashes x and y, LAST where there is none; h, g sorted and distinct."""
    out = np.full(len(x), LAST)
    at, end = np.searchsorted(h, x), np.searchsorted(h, x, "right")
    while (left := at < end).any():  # a second turn only where two windows share a first hash
        here = np.flatnonzero(left)
        here = here[g[at[here]] == y[here]]
        out[here] = d[at[here]]
        at = at + 1
    return out


def _removed(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words covered by the windows that start where ``starts`` is set."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:n]) > 0


def dedup_substrings(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), digest: bool = False
) -> DataFrame:
    """id, n_words, n_removed, kept_text and the columns of ``carry``; with ``digest`` kept_sha256 instead of the text.

    kept_text is the text itself where nothing is removed, else the kept words joined by a space.
    """
    size = total_bytes(docs, text)
    n_blocks = max(1, math.ceil(size / BLOCK))
    bits = max(0, min(31, math.ceil(math.log2(max(1.0, size / 20 / RANGE)))))
    rounds = rounds_for(window)
    margin = margin_of(rounds)
    rows = with_row_key(docs, "_row").select(
        # rows with the same id and text are dealt apart
        F.pmod(F.xxhash64(F.col(id), F.col(text), F.col("_row")), F.lit(n_blocks)).cast("int").alias("block"),
        F.col(id).cast("long").alias("id"),
        F.col(text).cast("string").alias("text"),
        *([F.struct(*carry).alias("carry")] if carry else []),
    )
    some = rows.select("block", "id", "text") if carry else rows

    def names(t: pa.Table) -> pa.Table:
        found = []
        for w, hashes, ids in _pieces(*_columns(t)):
            name, width = symbols(hashes, w.doc, rounds)
            doc = w.doc[np.cumsum(width) - 1] if len(width) else w.doc
            order = np.argsort(name, kind="stable")
            name, doc = name[order], doc[order]
            first = np.ones(len(name), bool)
            first[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            found.append(name[first])
        name = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        twice = np.ones(len(name), bool)
        twice[2:] = name[2:] != name[:-2]
        name = name[twice]
        top, at = _ranges(name, bits)
        low = _low(name, bits).astype("<u4")
        ends = [*at[1:].tolist(), len(name)]
        return pa.table(
            {
                "range": pa.array(top[at], pa.int32()),
                "block": pa.array(np.full(len(at), t.column("block")[0].as_py()), pa.int32()),
                "names": pa.array([low[a:b].tobytes() for a, b in zip(at.tolist(), ends)], pa.binary()),
            }
        )

    def shared(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in t.column("names").to_pylist()]
        every = np.sort(np.concatenate(parts))
        both = np.unique(every[1:][every[1:] == every[:-1]])
        kept = []
        for x in parts:
            at = np.minimum(np.searchsorted(both, x), max(0, len(both) - 1))
            kept.append(np.unique(x[both[at] == x]).tobytes() if len(both) else b"")
        out = pa.table({"block": t.column("block"), "range": t.column("range"), "names": pa.array(kept, pa.binary())})
        return out.filter(pa.array([bool(x) for x in kept], pa.bool_()))

    def candidates(t: pa.Table, flags: pa.Table) -> pa.Table:
        keys = [
            np.uint64(r) << np.uint64(32) | np.frombuffer(x, "<u4").astype(np.uint64)
            for r, x in zip(flags.column("range").to_pylist(), flags.column("names").to_pylist())
        ]
        known = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        hash_parts, more_parts, id_parts = [], [], []
        for w, hashes, ids in _pieces(*_columns(t)) if len(t) and len(known) else ():
            if len(w) < window:
                continue
            name, width = symbols(hashes, w.doc, rounds)
            key = name >> np.uint64(64 - bits) << np.uint64(32) if bits else np.zeros(len(name), np.uint64)
            key = key | _low(name, bits).astype(np.uint64)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            good = np.concatenate([[0], np.cumsum(np.repeat(known[at] == key, width))])
            s = np.arange(len(w) - window + 1)
            inner = window - 2 * margin
            fits = (good[s + margin + inner] - good[s + margin] == inner) & (w.doc[s] == w.doc[s + window - 1])
            s = s[fits]
            if len(s):
                hash_parts.append(window_hashes(hashes, window)[s])
                more_parts.append(window_hashes(w.hashes(1), window)[s])
                id_parts.append(ids[w.doc[s]])
        h, g = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hash_parts, more_parts))
        d = np.concatenate(id_parts) if id_parts else np.zeros(0, np.int64)
        h, g, d, new = _sorted(h, g, d)
        at = np.flatnonzero(new)
        most = d[np.append(at[1:], len(h)) - 1] if len(h) else d
        h, g, d = h[at], g[at], d[at]
        top, at = _ranges(h, bits)
        ends = [*at[1:].tolist(), len(h)]
        cuts = list(zip(at.tolist(), ends))
        return pa.table(
            {
                "range": pa.array(top[at], pa.int32()),
                "block": pa.array(np.full(len(at), t.column("block")[0].as_py() if len(t) else 0), pa.int32()),
                "hashes": pa.array([h[a:b].astype("<u8").tobytes() for a, b in cuts], pa.binary()),
                "seconds": pa.array([g[a:b].astype("<u8").tobytes() for a, b in cuts], pa.binary()),
                "least": pa.array([d[a:b].astype("<i8").tobytes() for a, b in cuts], pa.binary()),
                "more": pa.array([(most[a:b] > d[a:b]).tobytes() for a, b in cuts], pa.binary()),
            }
        )

    def firsts(t: pa.Table) -> pa.Table:
        hs, gs = ([np.frombuffer(x, "<u8") for x in t.column(c).to_pylist()] for c in ("hashes", "seconds"))
        ds = [np.frombuffer(x, "<i8") for x in t.column("least").to_pylist()]
        more = [np.frombuffer(x, bool) for x in t.column("more").to_pylist()]
        h, g, d, new = _sorted(np.concatenate(hs), np.concatenate(gs), np.concatenate(ds))
        h, g, d = h[new], g[new], d[new]
        out = []
        for x, y, own, several in zip(hs, gs, ds, more):
            least = _find(h, g, d, x, y)
            need = several | (own > least)
            out.append([v[need].tobytes() for v in (x, y, least)])
        columns = {c: pa.array([x[k] for x in out], pa.binary()) for k, c in enumerate(("hashes", "seconds", "least"))}
        return pa.table({"block": t.column("block")} | columns).filter(pa.array([bool(x[0]) for x in out], pa.bool_()))

    def remove(t: pa.Table, hits: pa.Table) -> pa.Table:
        h, g, d = (np.frombuffer(b"".join(hits.column(c).to_pylist()), k) for c, k in (("hashes", "<u8"), ("seconds", "<u8"), ("least", "<i8")))
        h, g, d, _ = _sorted(h, g, d)
        texts, all_ids = _columns(t)
        counts, lost, kept = [], [], []
        for w, hashes, ids in _pieces(texts, all_ids):
            gone = np.zeros(len(w), bool)
            if len(h) and len(w) >= window:
                x = window_hashes(hashes, window)
                at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                s = np.flatnonzero((h[at] == x) & (w.doc[: len(x)] == w.doc[window - 1 :]))
                if len(s):
                    hit = np.zeros(len(x), bool)
                    hit[s] = _find(h, g, d, x[s], window_hashes(w.hashes(1), window)[s]) < ids[w.doc[s]]
                    gone = _removed(hit, len(w), window)
            data, start, _ = w.joined()
            ends = np.append(start, len(data))
            n_gone = np.concatenate([[0], np.cumsum(gone)])
            n_gone = n_gone[w.first[1:]] - n_gone[w.first[:-1]]
            counts.append(w.count)
            lost.append(n_gone)
            raw = data.tobytes()
            at = ends[w.first]
            for i in range(len(ids)):
                a, b = at[i], at[i + 1]
                if not n_gone[i]:
                    kept.append(raw[a : max(a, b - 1)])
                elif n_gone[i] == w.count[i]:
                    kept.append(b"")
                else:
                    k = slice(w.first[i], w.first[i + 1])
                    mask = np.repeat(~gone[k], np.diff(ends[w.first[i] : w.first[i + 1] + 1]))
                    kept.append(data[a:b][mask].tobytes()[:-1])
        out = {
            "id": t.column("id"),
            "n_words": pa.array(np.concatenate(counts) if counts else [], pa.int64()),
            "n_removed": pa.array(np.concatenate(lost) if lost else [], pa.int64()),
        }
        if digest:
            out["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        else:
            whole = out["n_removed"].to_numpy() == 0
            text = [x if same else y for x, y, same in zip(t.column("text").to_pylist(), (k.decode() for k in kept), whole)]
            out["kept_text"] = pa.array(text, pa.string())
        if carry:
            out["carry"] = t.column("carry")
        return pa.table(out)

    by_block = some.groupBy("block")
    named = by_block.applyInArrow(names, "range int, block int, names binary")
    flags = named.groupBy("range").applyInArrow(shared, "block int, range int, names binary")
    found = by_block.cogroup(flags.groupBy("block")).applyInArrow(
        candidates, "range int, block int, hashes binary, seconds binary, least binary, more binary"
    )
    hits = found.groupBy("range").applyInArrow(firsts, "block int, hashes binary, seconds binary, least binary")
    carried = f", carry {rows.schema['carry'].dataType.simpleString()}" if carry else ""
    result = (
        rows.groupBy("block")
        .cogroup(hits.groupBy("block"))
        .applyInArrow(remove, f"id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string{carried}")
    )
    own = [F.col("id").cast(docs.schema[id].dataType).alias(id), "n_words", "n_removed", "kept_sha256" if digest else "kept_text"]
    return result.select(*own, *(F.col("carry")[c].alias(c) for c in carry))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


#: DuckDB SQL for the rows of op4_substring_dedup.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, s, list_aggregate(list_slice(words, s, s + 49), 'string_agg', ' ') AS win
  FROM w, unnest(range(1, len(words) - 48)) AS t(s)
), firsts AS (
  SELECT win, min(doc_id) AS least FROM starts GROUP BY win HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT DISTINCT doc_id, p FROM starts JOIN firsts USING (win), unnest(range(s, s + 50)) AS t(p) WHERE least < doc_id
), flat AS (
  SELECT doc_id, p, words[p] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM flat ANTI JOIN hits USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
