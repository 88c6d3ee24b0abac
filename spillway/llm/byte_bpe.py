"""Byte-level BPE (operator 2): merges replayed over the words of a whole block of the corpus.

Every task cuts its texts into words (matches of the vocabulary's pattern), numbers the
distinct ones and lays those that it has not encoded yet side by side, one position for
each byte.  An inverted index leads from a token pair, named by the rank of the token that
it makes, to the positions of all words at which the pair stands.  Ranks are then taken in
rising order; all positions of a rank are merged at once (of overlapping ones every second,
from the left), and only the pairs left and right of a merged position are looked up and
enter the index anew.  A text's ids are its words' ids in a row.  Decoding looks up the
bytes of each id.

A block is a run of texts of about ``BLOCK`` characters, not the whole corpus: one index over
all words would need them dealt by word and their ids sent back to every text that has
them.  Encoded words stay known to the worker, up to ``KNOWN`` of them, for its next blocks.
Taking ranks in order over many words equals merging each word by itself unless a merge
brings forth a pair of the same or a lower rank; words in which that happens are found and
redone alone.

Cases: a null, empty text or empty table has no ids; both hashes are then those of no bytes;
a very long text is a block of its own, whose words are taken in runs of ``NEW`` new ones; each
input row gives one row; a null id stays null; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table, texts_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words that a worker knows, at most, before it forgets them between two blocks.
KNOWN = 200_000
#: Characters of text whose new words are replayed together, and new words at which a replay begins earlier.
BLOCK, NEW = 8 << 20, 300_000
#: Above every rank.
NONE = np.int32((1 << 31) - 1)

_worker: dict = {}


# White space as Unicode's White_Space.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_wide_pattern = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{_WS}").replace(r"\s", f"[{_WS}]").replace(r"\S", f"[^{_WS}]"))
_wide = _wide_pattern.findall
#: Texts of ASCII and Latin letters alone are cut by the standard library's faster module.
_plain = re.compile(r"[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]*").fullmatch
_fast = re.compile(rf" ?[{_LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+").findall


def split_words(text: str) -> Iterable[str]:
    """The matches of the public pattern."""
    if len(text) > BLOCK:  # one by one, so that not all of them are held
        return (m.group() for m in _wide_pattern.finditer(text))
    return _fast(text) if _plain(text) else _wide(text)


class Vocabulary:
    """Ranks of tokens and of all pairs that make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        found = [
            (self.rank[t[:k]] << 20 | self.rank[t[k:]], r)
            for t, r in self.rank.items()
            for k in range(1, len(t))
            if t[:k] in self.rank and t[k:] in self.rank
        ]
        found.sort()
        self.pair_key = np.array([k for k, _ in found], np.int64)
        self.pair_rank = np.array([r for _, r in found], np.int32)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make, NONE where a pair makes none; negative tokens are in no pair."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)


def alone(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """One word: merge the leftmost pair of the lowest rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        ranks = [vocabulary.rank.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        best = min(ranks)
        if best == NONE:
            break
        i = ranks.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [vocabulary.rank[x] for x in parts]


def replay(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids of each word as little-endian 32-bit integers."""
    if not words:
        return []
    size = np.fromiter(map(len, words), np.int64, len(words))
    # a position for each byte, and one before, between and after words that is in no pair
    begin = np.cumsum(size + 1) - size
    raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
    token = vocabulary.single[raw]
    token[0] = token[begin + size] = -1
    n = len(token)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    pair = np.full(n, NONE, np.int32)  # rank of the pair that begins here
    pair[:-1] = vocabulary.merged(token[:-1], token[1:])
    # the index: positions by rank, those of the beginning in one sorted array, later ones in lists
    first = np.flatnonzero(pair != NONE).astype(np.int32)
    first = first[np.argsort(pair[first], kind="stable")]
    ends = np.searchsorted(pair[first], np.arange(len(vocabulary.bytes) + 1)).tolist()
    later: dict[int, list[np.ndarray]] = {}
    alive = np.ones(n, bool)
    again: list[np.ndarray] = []
    for rank in range(len(vocabulary.bytes)):
        low, high = ends[rank], ends[rank + 1]
        new = later.pop(rank, None)
        if new is None:
            if low == high:
                continue
            i = first[low:high]
        else:
            i = np.unique(np.concatenate([first[low:high], *new]))
        i = i[pair[i] == rank]  # a neighbour may have been merged away since
        if len(i) > 1:
            chained = i[1:] == after[i[:-1]]
            if chained.any():
                place = np.arange(len(i))
                start = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), place, 0))
                i = i[(place - start) % 2 == 0]
        elif not len(i):
            continue
        j = after[i]
        k = after[j]
        token[i], after[i], before[k] = rank, k, i
        alive[j], pair[j] = False, NONE
        touched = np.concatenate([before[i], i])
        now = vocabulary.merged(token[touched], token[after[touched]])
        pair[touched] = now
        known = now != NONE
        if known.any():
            touched, now = touched[known], now[known]
            order = now.argsort(kind="stable")
            touched, now = touched[order], now[order]
            cuts = [0, *(np.flatnonzero(now[1:] != now[:-1]) + 1).tolist(), len(now)]
            for a, b, r in zip(cuts, cuts[1:], now[cuts[:-1]].tolist()):
                if r > rank:
                    later.setdefault(r, []).append(touched[a:b])
                else:
                    again.append(touched[a:b])
    alive[0] = alive[begin + size] = False
    ids = token[alive].astype("<u4").tobytes()
    n_ids = np.add.reduceat(alive, begin, dtype=np.int64)
    stop = (np.cumsum(n_ids) * 4).tolist()
    out = [ids[a:b] for a, b in zip([0, *stop], stop)]
    if again:
        for w in np.unique(np.searchsorted(begin, np.concatenate(again), "right") - 1).tolist():
            out[w] = np.array(alone(vocabulary, words[w]), "<u4").tobytes()
    return out


class Encoder:
    """A worker's vocabulary and the words that it knows."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids: list[bytes] = []

    def learn(self) -> None:
        """Replays the words numbered since the last time."""
        new = [w.encode() for w in list(self.number)[len(self.ids) :]]
        self.ids += replay(self.vocabulary, new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.number) > KNOWN:
            self.forget()
        numbered = []
        for text in texts:
            words = split_words(text)
            if isinstance(words, list):
                numbered.append(array("I", map(self.number.__getitem__, words)))
                continue
            some = array("I")
            for w in words:
                some.append(self.number[w])
                if len(self.number) - len(self.ids) > NEW:
                    self.learn()
            numbered.append(some)
        self.learn()
        return [b"".join(map(self.ids.__getitem__, x)) for x in numbered]


def _encoder(path: str) -> Encoder:
    if path not in _worker:
        _worker[path] = Encoder(path)
    return _worker[path]


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, digest: bool = False) -> DataFrame:
    """id, ids array<int>, decoded binary for each row; with ``digest`` n_tokens and the hashes of both instead."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        get = encoder.vocabulary.bytes.__getitem__
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in blocks(texts, BLOCK):
                ids = encoder.encode(texts.slice(a, b - a).to_pylist())
                numbers = [array("I", x) for x in ids]
                if sys.byteorder == "big":
                    for x in numbers:
                        x.byteswap()
                decoded = (b"".join(map(get, x)) for x in numbers)
                out = {id: batch.column(0).slice(a, b - a)}
                if digest:
                    out["n_tokens"] = pa.array([len(x) for x in numbers], pa.int64())
                    out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                    out["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())
                else:
                    ends = np.cumsum([0, *map(len, numbers)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                    out["decoded"] = pa.array(list(decoded), pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"))
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return rows.mapInArrow(run, f"`{id}` {kind}, {more}")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)
