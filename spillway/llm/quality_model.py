"""Quality classifier (operator 6): attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, every one of them encoded; only the
document has a label.  What a passage is encoded from is its words and neighbouring words,
hashed with a sign into ``GRAMS`` sums, and statistics of its form (kinds of bytes, word
shapes, repetition, frequent words); both go through a learned encoder.  Gated attention (a
tanh branch times a sigmoid branch) weighs the passages, and a logistic layer scores their
weighted mean.

The model learns from at most ``SAMPLE`` labelled rows outside the held-out fold, none above
``LEARNED_BYTES``: executors reduce each document to its passages' input, and the driver fits
the small network on these.  Scoring runs over whole texts, as whole arrays for a run of
documents.

Cases: a null, empty or blank text is one passage of zeros; a last passage of fewer than
half the words joins the one before; a very long text is scored whole, as a run of its own;
with one class or no labels everyone gets that class's share as score (0.5 without labels);
among equally frequent words the smaller hash counts as frequent; repeated rows each give a
row, and are learned from once for each id; an empty table gives no rows; a null id is
scored and not held out; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, blocks, held_out, labelled, mixed, per_doc, sigmoid, table, texts_of

#: Labelled rows to learn from, at most.
SAMPLE = 4_000
PASSAGE = 64
FOLD, HELD, THRESHOLD = 5, 0, 0.3
HIDDEN, GATE, EPOCHS, RATE, DECAY, SEED = 16, 8, 120, 0.03, 1e-3, 11
#: Words of the learning rows that count as frequent.
FREQUENT = 400
#: Signed sums that words and pairs of words are hashed into.
GRAMS = 96


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Kinds of bytes whose share of a passage is a statistic.
KINDS = (
    _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"0123456789"), _set(b".,;:"), _set(b"!?"), _set(b"|"), _set(b"#*$%&<>@^~=+\\/{}[]_"), _set(b"\n"),
    _set(bytes(range(128, 256))), _set(b"\"'()-"),
)
SHAPE = len(KINDS) + 11
FEATURES = SHAPE + GRAMS


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of all passages (one more entry: the end), and each document's first passage likewise."""
    n = np.maximum(1, (w.count + PASSAGE // 2) // PASSAGE)
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    return np.append(w.first[doc] + (np.arange(first[-1]) - first[doc]) * PASSAGE, len(w)), first


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(texts: pa.Array, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES numbers for each passage, and where each document's passages begin."""
    w = Words(texts)
    begin, first = passages(w)
    n_words = np.diff(begin).astype(float)
    # a passage's bytes: from its first word to the next passage's first; empty for a text without words
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    at = np.append(w.start, len(w.data))
    low = np.where(n_words > 0, at[begin[:-1]], 0)
    last = np.append(w.end, 0)[begin[1:] - 1]
    is_last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    high = np.where(is_last, last, at[begin[1:]])
    high = np.where(n_words > 0, high, 0)
    out = np.zeros((len(n_words), SHAPE))
    for k, kind in enumerate(KINDS):
        sums = np.concatenate([[0], np.cumsum(kind[w.data])])
        out[:, k] = _ratio(sums[high] - sums[low], high - low)
    size = (w.end - w.start).astype(float)
    h = w.hashes()
    of = np.repeat(np.arange(len(n_words)), np.diff(begin))
    _, index = np.unique(mixed(h + mixed(of.astype(np.uint64))), return_index=True)
    distinct = np.zeros(len(h))
    distinct[index] = 1
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    head = w.data[w.start]
    tail = w.data[w.end - 1]
    common = np.zeros(len(h))
    if len(frequent) and len(h):
        common = (frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h).astype(float)
    is_letter = (KINDS[0] | KINDS[1] | KINDS[8])[w.data]
    per_word = np.concatenate([[0], np.cumsum(is_letter)])
    wordy = (per_word[w.end] - per_word[w.start] > 0).astype(float)
    columns = np.column_stack([size, size**2, distinct, same, KINDS[0][head], KINDS[3][tail], 1 - (is_letter | SPACE[w.data])[np.maximum(w.end - 1, 0)], common, wordy, (size == 1)])
    sums = per_doc(columns.astype(float), begin)
    mean = _ratio(sums, n_words[:, None])
    mean[:, 1] = np.sqrt(np.maximum(mean[:, 1] - mean[:, 0] ** 2, 0))
    mean[:, :2] = np.log1p(mean[:, :2])
    out[:, len(KINDS) : len(KINDS) + 10] = mean
    out[:, -1] = np.log1p(n_words)
    return np.hstack([out, grams(h, of, n_words)]), first


def grams(h: np.ndarray, of: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For each passage the signed sums of its words and of its pairs of neighbours, by the root of their number."""
    pair = np.flatnonzero(of[1:] == of[:-1])
    with np.errstate(over="ignore"):
        keys = np.concatenate([mixed(h), mixed(h[pair] * np.uint64(31) + mixed(h[pair + 1]))])
    at = np.concatenate([of, of[pair]]) * GRAMS + (keys % np.uint64(GRAMS)).astype(np.int64)
    sign = np.where(keys >> np.uint64(63) == 1, 1.0, -1.0)
    sums = np.bincount(at, sign, minlength=len(n_words) * GRAMS).reshape(len(n_words), GRAMS)
    return sums / np.sqrt(np.maximum(n_words, 1))[:, None]


@dataclass
class Model:
    frequent: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    parts: dict | None
    base: float

    def forward(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of the documents whose passages x holds."""
        if self.parts is None:
            return np.full(len(first) - 1, self.base)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return sigmoid(_network(self.parts, z, first)[0])


def _network(p: dict, x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ p["enc"] + p["enc0"])
    t, g = np.tanh(h @ p["att"] + p["att0"]), sigmoid(h @ p["gate"] + p["gate0"])
    e = np.clip((t * g) @ p["pool"], -30, 30)
    a = np.exp(e)
    n = np.diff(first)
    a = a / np.repeat(np.add.reduceat(a, first[:-1]), n)
    bag = np.add.reduceat(h * a[:, None], first[:-1], axis=0)
    return bag @ p["out"] + p["out0"], h, t, g, a, bag


def gradients(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss of all bags, by each parameter."""
    n = np.diff(first)
    score, h, t, g, a, bag = _network(p, x, first)
    d_score = (sigmoid(score) - y) / len(y)
    d_bag = d_score[:, None] * p["out"]
    of = np.repeat(d_bag, n, axis=0)
    d_a = (of * h).sum(1)
    d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first[:-1]), n))
    d_tg = d_e[:, None] * p["pool"]
    d_t, d_g = d_tg * g * (1 - t**2), d_tg * t * g * (1 - g)
    d_h = (of * a[:, None] + d_t @ p["att"].T + d_g @ p["gate"].T) * (1 - h**2)
    return {
        "enc": x.T @ d_h, "enc0": d_h.sum(0), "att": h.T @ d_t, "att0": d_t.sum(0), "gate": h.T @ d_g, "gate0": d_g.sum(0),
        "pool": (t * g).T @ d_e, "out": bag.T @ d_score, "out0": d_score.sum(),
    }


def start(d: int) -> dict:
    rng = np.random.default_rng(SEED)
    return {
        "enc": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "enc0": np.zeros(HIDDEN), "att": rng.normal(0, 0.3, (HIDDEN, GATE)), "att0": np.zeros(GATE),
        "gate": rng.normal(0, 0.3, (HIDDEN, GATE)), "gate0": np.zeros(GATE), "pool": rng.normal(0, 0.3, GATE), "out": rng.normal(0, 0.3, HIDDEN), "out0": np.zeros(()),
    }


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    """Adam on the log loss of all bags at once."""
    x = x.astype(np.float32)
    p = {k: w.astype(np.float32) for k, w in start(x.shape[1]).items()}
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        grad = gradients(p, x, first, y.astype(np.float32))
        for k, w in p.items():
            dk = grad[k] + DECAY * w
            m[k] = 0.9 * m[k] + 0.1 * dk
            v[k] = 0.999 * v[k] + 0.001 * dk * dk
            p[k] = (w - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, "quality", FOLD, HELD, sample, id, text).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in blocks(texts):
                w = Words(texts.slice(a, b - a))
                h, n = np.unique(w.hashes(), return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())})

    counted = rows.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = counted.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r.word for r in words], np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            at = 0
            for a, b in blocks(texts):
                x, first = statistics(texts.slice(a, b - a), shared.value)
                rows = [x[i:j].astype(np.float16).tobytes() for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_pydict({"label": batch.column(1).slice(at, b - a), "x": pa.array(rows, pa.binary())})
                at = b

    got = rows.mapInArrow(measure, "label int, x binary").orderBy("label", "x").toArrow()
    if not len(got):
        return Model(frequent, np.zeros(FEATURES), np.ones(FEATURES), None, 0.5)
    bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b in got.column("x").to_pylist()]
    y = got.column("label").to_numpy().astype(float)
    x, first = np.concatenate(bags).astype(np.float32), np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    if y.min() == y.max():
        return Model(frequent, mean, scale, None, float(y[0]))
    return Model(frequent, mean, scale, fit(np.clip((x - mean) / scale, -8, 8), first, y), float(y.mean()))


def score_quality(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = texts_of(batch.column(1))
            found = [m.forward(*statistics(texts.slice(a, b - a), m.frequent)) for a, b in blocks(texts)]
            yield pa.RecordBatch.from_pydict({id: batch.column(0), "score": pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())})

    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, score double")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", held_out("doc_id", FOLD, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
