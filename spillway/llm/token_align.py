"""Cross-tokenizer alignment (operator 13): which tokens of two tokenizers cover the same bytes, by pointer jumping.

Space and text are cut by tokenizer A (byte-level BPE) and B (pieces with byte fallback).  Both
tile the same bytes.  Every token points to the token that reaches farthest to the right of
those that overlap it; of two that end at the same byte B's is taken, and points to itself.  Then
all pointers double at once (the successor of the successor) until none moves: each token
points to the terminal token of its group, the tokens between two bytes at which A and B
both end.  A link is a pair of overlapping tokens; where the ends of both are merged, each
stretch between two neighbouring ends is one.

A pair of ids counts by its links in the whole corpus.  Texts are aligned in chunks of about
``BLOCK`` bytes.  A chunk is written with a dictionary of its distinct pairs and their links,
and a document keeps its own distinct pairs as places in it, with their numbers.  Spark
sums the dictionaries by pair, finds each B id's highest count and sends both back to the
dictionaries, where the chunk's documents meet them: a pair travels once for a chunk however
often it occurs, so no pair is a hot key, and no table of the corpus is broadcast but the
highest counts, one for each B id.  Chunks are written once, so a lost executor's work is
done again on the same chunks.

Words are encoded once by each worker (up to ``KNOWN`` are kept): A's are the matches of its
pattern, B's begin with spaces, as no piece goes on with a space after another character.

Cases: null and empty texts and those that B's bytes do not give back (it writes a space for
U+2581) have no tokens, all numbers zero and '' for the hash; a very long text is a chunk of its
own; each input row gives one row, so repeated rows and ids stay and count; a null id stays
null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import VOCABULARY, Encoder
from .common import blocks, cut, store, table, texts_of

PIECES = "piece_bpe_32k.model"
#: Bytes of text in a chunk, and B words that a worker knows, at most, before it forgets them between two chunks.
BLOCK, KNOWN = 4 << 20, 400_000
#: Bits of a pair's name that the B id takes.
B_BITS = 20
SPACE = "▁"

_worker: dict = {}


class PieceEncoder:
    """Pieces of texts, each word encoded by the library once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.space = self.model.piece_to_id(SPACE)
        # words may be encoded alone where no piece holds the beginning of another word
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names)
        self.cut = re.compile(" +[^ ]*" if apart else "(?s).+").findall
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids: list[bytes] = []
        self.wrong: set[int] = set()

    def learn(self) -> None:
        new = list(self.number)[len(self.ids) :]
        # the library puts the first space in front itself, but for an empty text
        found = [x if w != " " else [self.space] for w, x in zip(new, self.model.encode([w[1:] for w in new], num_threads=1), strict=True)]
        get = self.bytes.__getitem__
        if b"".join(map(get, (i for x in found for i in x))) != "".join(new).encode():
            at = len(self.ids)
            self.wrong.update(at + k for k, (w, x) in enumerate(zip(new, found, strict=True)) if b"".join(map(get, x)) != w.encode())
        self.ids += [array("i", x).tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, which begins with a space, as 32-bit integers; none where its bytes are not given back."""
        if len(self.number) > KNOWN:
            self.forget()
        words = [array("I", map(self.number.__getitem__, self.cut(x))) for x in texts]
        self.learn()
        lost = self.wrong
        return [b"" if lost and not lost.isdisjoint(x) else b"".join(map(self.ids.__getitem__, x)) for x in words]


class Aligner:
    """A worker's two tokenizers and the tables of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a), PieceEncoder(path_b)
        self.size_a = np.array(list(map(len, self.a.vocabulary.bytes)), np.int32)
        self.size_b = np.array(list(map(len, self.b.bytes)), np.int32)
        # each id with what follows it, within its side of a group and at that side's end
        ids = [f"{i}{x}" for i in range(len(self.size_a)) for x in ",|"] + [f"{i}{x}" for i in range(len(self.size_b)) for x in ",;"]
        self.shown = pa.array(ids, pa.large_string())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B in all texts, and how many each text has."""
        spaced = [" " + x if x else "" for x in texts]
        b = self.b.encode(spaced)
        # a text without pieces has no tokens at all
        a = self.a.encode([x if y else "" for x, y in zip(spaced, b, strict=True)])
        number = [np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in (a, b)]
        return np.frombuffer(b"".join(a), "<u4").astype(np.int32), np.frombuffer(b"".join(b), np.int32), *number


def terminals(end_a: np.ndarray, end_b: np.ndarray, a_before: np.ndarray, b_before: np.ndarray) -> np.ndarray:
    """For each token, A's first, the terminal token of its group; ..._before: how many ends of A or B lie before a byte."""
    n = len(end_a)
    over_a = n + b_before[end_a]  # of B, holds the last byte
    over_b = a_before[end_b]  # of A, holds the last byte
    own = np.arange(n, n + len(end_b))
    reach = np.concatenate([over_a, np.where(end_a[over_b] > end_b, over_b, own)])
    while True:
        further = reach[reach]
        if np.array_equal(further, reach):
            return reach
        reach = further


def align(w: Aligner, texts: list[str]) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """Columns of each text's row, with its distinct pairs as places in the chunk's dictionary; that and its numbers of links."""
    a, b, n_a, n_b = w.encode(texts)
    docs = len(texts)
    if not len(a):
        zero, none = pa.array(np.zeros(docs, np.int64)), pa.array([[]] * docs, pa.list_(pa.int32()))
        numbers = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), zero)
        return numbers | {"groups_sha256": pa.array([""] * docs), "pairs": none, "times": none}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    end_a, end_b = np.cumsum(w.size_a[a]), np.cumsum(w.size_b[b])
    n = int(end_a[-1]) + 1
    is_a, is_b = np.zeros(n, bool), np.zeros(n, bool)
    is_a[end_a] = is_b[end_b] = True
    a_before, b_before = np.cumsum(is_a, dtype=np.int32) - is_a, np.cumsum(is_b, dtype=np.int32) - is_b
    label = terminals(end_a, end_b, a_before, b_before)
    last_b = np.zeros(len(b), bool)
    last_b[label - len(a)] = True
    group_of = np.cumsum(last_b) - last_b
    group_a, group_b = group_of[label[: len(a)] - len(a)], group_of[label[len(a) :] - len(a)]
    done_b = np.flatnonzero(last_b)
    done_a = a_before[end_b[done_b]]  # the token of A that ends there
    # in writing, a group's tokens of A, then those of B
    place_a = np.arange(len(a)) + np.append(0, done_b + 1)[group_a]
    place_b = np.arange(len(b)) + (done_a + 1)[group_b]
    shown = np.empty(len(a) + len(b), np.int32)
    last_a = np.zeros(len(a), np.int32)
    last_a[done_a] = 1
    shown[place_a] = 2 * a + last_a
    shown[place_b] = 2 * (len(w.size_a) + b) + last_b
    del label, place_a, place_b
    said = w.shown.take(pa.array(shown))
    cuts = np.frombuffer(said.buffers()[1], np.int64)[np.append(0, np.cumsum(n_a + n_b))].tolist()
    data = memoryview(said.buffers()[2])
    hashes = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]
    del said, data, shown
    # links: stretches between neighbouring ends
    ends = np.flatnonzero(is_a | is_b)
    name = a[a_before[ends]].astype(np.int64) << B_BITS | b[b_before[ends]]
    found = pa.array(name).dictionary_encode()
    pair = found.indices.to_numpy(zero_copy_only=False)
    keys = found.dictionary.to_numpy()
    doc_end = np.append(0, end_a)[np.cumsum(n_a)]
    of = np.searchsorted(ends, doc_end, "right")
    n_links = np.diff(np.append(0, of))
    own = np.sort(np.repeat(np.arange(docs, dtype=np.int64), n_links) << 32 | pair)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    own_doc = own[first] >> 32
    offsets = pa.array(np.searchsorted(own_doc, np.arange(docs + 1)).astype(np.int32))
    groups = np.diff(np.append(0, np.append(0, np.cumsum(last_b))[np.cumsum(n_b)]))
    rows = {
        "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(groups.astype(np.int64)), "n_links": pa.array(n_links.astype(np.int64)),
        "groups_sha256": pa.array(hashes, pa.string()),
        "pairs": pa.ListArray.from_arrays(offsets, pa.array((own[first] & 0xFFFFFFFF).astype(np.int32))),
        "times": pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(first, len(own))).astype(np.int32))),
    }
    return rows, keys, np.bincount(pair, minlength=len(keys))


NUMBERS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = path_a or public_tokenizers.path(VOCABULARY), path_b or public_tokenizers.path(PIECES)
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _worker:
            _worker[paths] = Aligner(*paths)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for x, y in blocks(texts, BLOCK):
                rows, keys, links = align(_worker[paths], texts.slice(x, y - x).to_pylist())
                chunk, n = uuid.uuid4().hex, y - x
                out = {"chunk": pa.array([chunk] * n), "id": batch.column(0).slice(x, n), **rows}
                out |= {c: pa.nulls(n, pa.list_(pa.int64())) for c in ("keys", "links")}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
                if len(keys):
                    own = {c: pa.nulls(1, v.type) for c, v in out.items()}
                    own |= {"chunk": pa.array([chunk]), "keys": pa.array([keys], pa.list_(pa.int64())), "links": pa.array([links], pa.list_(pa.int64()))}
                    yield pa.RecordBatch.from_arrays(list(own.values()), list(own))

    def counted(rows: pa.Table, seen: pa.Table) -> pa.Table:
        place = seen.column("at").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = seen.column("n").to_numpy(), seen.column("best").to_numpy(zero_copy_only=False)
        pairs, times = (rows.column(c).combine_chunks() for c in ("pairs", "times"))
        offsets = pairs.offsets.to_numpy()
        offsets = offsets - offsets[0]
        p, t = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = {k: np.diff(np.append(0, np.cumsum(v[p] * t))[offsets]) for k, v in (("n_best", best), ("count_sum", n))}
        out = {c: rows.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")} | sums | {"groups_sha256": rows.column("groups_sha256")}
        return pa.table(out)

    key = kind.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    chunks = store(rows.mapInArrow(run, f"chunk string, id {key}, {NUMBERS}, pairs array<int>, times array<int>, keys array<long>, links array<long>"))
    names = chunks.where("keys is not null").select("chunk", F.posexplode(F.arrays_zip("keys", "links")).alias("at", "pair"))
    names = names.select("chunk", "at", F.col("pair.keys").alias("key"), F.col("pair.links").alias("links"))
    of_pair = cut(names.groupBy("key").agg(F.sum("links").alias("n")).withColumn("b", F.col("key").bitwiseAND((1 << B_BITS) - 1)))
    highest = of_pair.groupBy("b").agg(F.max("n").alias("most"))  # at most one row for each id of B
    of_pair = of_pair.join(F.broadcast(highest), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    seen = names.join(of_pair, "key").select(F.col("chunk").alias("of"), "at", "n", "best")
    own = chunks.where("keys is null").drop("keys", "links")
    result = own.groupBy("chunk").cogroup(seen.groupBy("of")).applyInArrow(
        counted, f"id {key}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return result.withColumnRenamed("id", id)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
