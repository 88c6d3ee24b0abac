"""Language identification (operator 7): scripts, word scores and Viterbi.

A word's script, from code point ranges, leaves only languages that are written in it; its
n-grams of one to four letters and the word itself score each of these (log odds, smoothed,
from labelled rows).  Viterbi over a document's words, with a penalty for each change of
language, labels spans; the language with most letters in its spans is the document's.

Viterbi runs over all words of a run of documents at once: documents are joined, changing
language between documents is free, the joined sequence is cut into equal pieces, each
piece's best paths from every language to every language are found side by side, the pieces
are chained, and the paths inside all pieces are read back side by side.

Cases: a null text or one without a letter is 'und' with score 0; a word in a script that
no learned language uses fits all alike, also one with letters beyond the first plane;
languages with equally many letters give way to the first by name; a very long text is
labelled whole, as a run of its own; no labelled rows make every text 'und'; an empty table
gives no rows; repeated rows each give a row, and are learned from once for each id; a null
id is labelled and not held out; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Letters, blocks, first_of_each, held_out, mixed, per_doc, table, texts_of

#: Labelled rows to learn from, at most.
SAMPLE = 12_000
FOLD, HELD = 3, 1
#: Hashed n-grams of each order, and the penalty (in log odds) of a change of language.
BUCKETS, GRAMS, SWITCH, SMOOTH = 1 << 14, (1, 2, 3, 4), 6.0, 0.5
#: Share of a language's learning words in a script that makes it one of its scripts.
WRITTEN = 0.01
PIECE = 128
UNKNOWN = "und"
# First and last code points of scripts, fixed values.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))
_SCRIPT = np.zeros(1 << 16, np.int64)
for _name, _low, _high in SCRIPTS:
    _SCRIPT[_low : _high + 1] = SCRIPT_NAMES.index(_name)


def grams(w: Letters, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of the words at ``at``, and where each word's begin."""
    size = w.end[at] - w.start[at]
    # each word between two spaces
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    of = np.repeat(np.arange(len(at)), size + 2)
    place = np.arange(begin[-1]) - begin[of]
    inner = (place > 0) & (place <= size[of])
    points = np.full(begin[-1], 0x20, np.uint64)
    points[inner] = w.points[(w.start[at][of] + place - 1)[inner]]
    out, owner = [], []
    with np.errstate(over="ignore"):
        for k, n in enumerate(GRAMS):
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, np.uint64)
            for i in range(n):
                h = mixed(h * np.uint64(31) + points[i : len(points) - n + 1 + i])
            fine = of[: len(h)] == of[n - 1 :]
            out.append((h[fine] % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS)
            owner.append(of[: len(h)][fine])
        whole = w.hashes()[at] if len(at) < len(w) else w.hashes()
        out.append((whole % np.uint64(BUCKETS)).astype(np.int64) + len(GRAMS) * BUCKETS)
        owner.append(np.arange(len(at)))
    feature, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.searchsorted(owner[order], np.arange(len(at) + 1))


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # by feature and language
    allowed: np.ndarray  # by script and language: 0, or a large loss

    def word_scores(self, w: Letters) -> np.ndarray:
        """Scores by word and language."""
        _, at, which = w.distinct()
        feature, first = grams(w, at)
        total = np.stack([per_doc(self.weight[feature, k], first) for k in range(len(self.languages))], 1)
        total = total / np.sqrt(np.maximum(np.diff(first), 1))[:, None]
        script = _SCRIPT[np.minimum(w.points[w.start[at]], 0xFFFF)]
        return (total + self.allowed[script])[which]


def viterbi(score: np.ndarray, free: np.ndarray, switch: float = SWITCH, piece: int = PIECE) -> np.ndarray:
    """The best state of each row; ``free`` marks rows before which a change costs nothing."""
    n, k = score.shape
    if not n:
        return np.zeros(0, np.int64)
    m = -(-n // piece)
    # filled up with rows that change nothing
    s = np.zeros((m * piece, k))
    s[:n] = score
    cost = np.full(m * piece, float(switch))
    cost[:n][free] = 0.0
    s, cost = s.reshape(m, piece, k).transpose(1, 0, 2), cost.reshape(m, piece).T
    # best sums of each piece from every state before it to every state at its end
    best = np.full((m, k, k), -np.inf)
    best[:, np.arange(k), np.arange(k)] = 0.0
    for t in range(piece):
        best = np.maximum(best, best.max(2, keepdims=True) - cost[t][:, None, None]) + s[t][:, None, :]
    start = np.zeros((m, k))
    at = np.zeros(k)
    for i in range(m):
        start[i] = at
        at = (at[:, None] + best[i]).max(0)
        at = at - at.max()
    # the same steps from known starts, with the state before each row
    came = np.empty((piece, m, k), np.int16)
    now = start
    own = np.arange(k)
    for t in range(piece):
        top = now.argmax(1)
        other = now[np.arange(m), top] - cost[t]
        stay = now >= other[:, None]
        came[t] = np.where(stay, own[None, :], top[:, None])
        now = np.where(stay, now, other[:, None]) + s[t]
    # ends of the pieces, from the last one back
    path = np.empty((piece, m), np.int64)
    state = int(now[m - 1].argmax())
    ends = np.empty(m, np.int64)
    leaps = np.tile(own, (m, 1))
    for t in range(piece - 1, -1, -1):
        leaps = came[t][np.arange(m)[:, None], leaps]
    for i in range(m - 1, -1, -1):
        ends[i] = state
        state = int(leaps[i, state])
    state = ends
    for t in range(piece - 1, -1, -1):
        path[t] = state
        state = came[t][np.arange(m), state]
    return path.T.reshape(-1)[:n]


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    known = docs.select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang")).where("id is not null and lang is not null")
    known = known.where(~held_out("id", FOLD, HELD)).groupBy("id").agg(F.min("lang").alias("lang"))
    rows = first_of_each(docs, known.orderBy(F.xxhash64("id"), "id").limit(sample), id, text).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of features (kind 0) and words of scripts (kind 1) by language."""
        for batch in batches:
            texts, langs = texts_of(batch.column(0)), np.array(batch.column(1).to_pylist())
            for name in np.unique(langs):
                mine = texts.filter(pa.array(langs == name))
                for a, b in blocks(mine):
                    w = Letters(mine.slice(a, b - a))
                    if not len(w):
                        continue
                    _, at, which = w.distinct()
                    feature, first = grams(w, at)
                    times = np.repeat(np.bincount(which, minlength=len(at)), np.diff(first))
                    n = np.bincount(feature, times, minlength=(len(GRAMS) + 1) * BUCKETS).astype(np.int64)
                    script = np.bincount(_SCRIPT[np.minimum(w.points[w.start], 0xFFFF)], minlength=len(SCRIPT_NAMES))
                    key = np.concatenate([np.flatnonzero(n), np.flatnonzero(script)])
                    kind = np.repeat([0, 1], [np.count_nonzero(n), np.count_nonzero(script)])
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([name] * len(key), pa.string()), "kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int64()), "n": pa.array(np.concatenate([n[n > 0], script[script > 0]]), pa.int64())}
                    )

    counted = rows.mapInArrow(count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    table_ = np.zeros((len(names), (len(GRAMS) + 1) * BUCKETS))
    written = np.zeros((len(names), len(SCRIPT_NAMES)))
    row = np.array([names.index(x) for x in counted.column("lang").to_pylist()], np.int64)
    kind, key, n = (counted.column(c).to_numpy() for c in ("kind", "key", "n"))
    table_[row[kind == 0], key[kind == 0]] = n[kind == 0]
    written[row[kind == 1], key[kind == 1]] = n[kind == 1]
    weight = np.zeros(table_.shape[::-1])
    for k in range(len(GRAMS) + 1):
        part = table_[:, k * BUCKETS : (k + 1) * BUCKETS] + SMOOTH
        log = np.log(part / part.sum(1, keepdims=True))
        weight[k * BUCKETS : (k + 1) * BUCKETS] = (log - log.mean(0)).T if names else 0
    share = written / np.maximum(written.sum(1, keepdims=True), 1)
    fits = (share >= WRITTEN).T
    fits[~fits.any(1)] = True
    return Model(names, weight, np.where(fits, 0.0, -50.0))


def _labelled_words(model: Model, texts: pa.Array) -> tuple[Letters, np.ndarray, np.ndarray]:
    w = Letters(texts)
    score = model.word_scores(w) if len(w) else np.zeros((0, len(model.languages)))
    free = np.zeros(len(w), bool)
    free[w.first[:-1][w.count > 0]] = True
    return w, viterbi(score, free), score


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language number (-1: none) and score of each document: the share of letters in the language's spans."""
    if not model.languages:
        return np.full(len(texts), -1), np.zeros(len(texts))
    w, state, _ = _labelled_words(model, texts)
    size = w.end - w.start
    letters = np.stack([per_doc(size * (state == k), w.first) for k in range(len(model.languages))], 1)
    total = letters.sum(1)
    return np.where(total > 0, letters.argmax(1), -1), letters.max(1) / np.maximum(total, 1)


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            texts = texts_of(batch.column(1))
            found = [predict(shared.value, texts.slice(a, b - a)) for a, b in blocks(texts)]
            lang = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            score = np.concatenate([x for _, x in found]) if found else np.zeros(0)
            yield pa.RecordBatch.from_pydict({id: batch.column(0), "lang_pred": pa.array(names[lang], pa.string()), "score": pa.array(score, pa.float64())})

    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each span: id, begin and finish (code points) and lang."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in blocks(texts):
                w, state, _ = _labelled_words(shared.value, texts.slice(a, b - a))
                head = np.ones(len(w), bool)
                head[1:] = (state[1:] != state[:-1]) | (w.doc[1:] != w.doc[:-1])
                first = np.flatnonzero(head)
                last = np.append(first[1:], len(w)) - 1 if len(w) else first
                doc = w.doc[first]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(0).take(pa.array(doc + a)), "begin": pa.array(w.start[first] - w.bounds[doc], pa.int64()),
                        "finish": pa.array(w.end[last] - w.bounds[doc], pa.int64()), "lang": pa.array(names[state[first]] if len(first) else [], pa.string()),
                    }
                )

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, begin long, finish long, lang string").withColumnRenamed("id", id)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out("doc_id", FOLD, HELD).alias("held_out"), "lang_pred", "score")
