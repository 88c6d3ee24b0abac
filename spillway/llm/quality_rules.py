"""Quality rules (operator 9): robust multivariate outliers among documents of a kind.

Each document's counts become a vector of transformed statistics.  For each language and
source, location and scatter are estimated by minimum covariance determinant.  Several
starts (quartiles, correlations of bounded scores, correlations of directions, and small
random subsets) each take ``TRIALS`` concentration steps: keep the ``SUBSET`` share of
documents nearest by Mahalanobis distance and estimate anew from them.  The start whose
subset has the least determinant goes on until its determinant falls no more, and the
documents near its estimate give the final one.  All variances are the estimate's own: text
varies in each statistic, as rates of a short text are drawn to an ordinary one's by ``PRIOR`` words.  A step is one quantile of the distances
and one set of sums by group over all documents, so no group is ever gathered; a group of
fewer than ``LEAST`` documents is judged by its language, a small language by the corpus
(``judged_by`` says which).  Documents whose squared distance is above ``LIMIT`` are rejected.

Only documents that pass the base rules (at least ``WORDS`` words, no more than
``REPEAT_PERCENT`` percent of them in repeated windows) shape the estimates.

Cases: a null, empty or blank text has zero counts and fails the base rules; a very long
text is counted whole; a null language or source is a kind of its own ('?'); a direction in which
a group does not vary at all gets a small share (``FLOOR``) of the corpus's own spread as its least,
so that the scatter can be inverted; starts with equal determinants give way to the first; repeated rows each give a row, and
weigh in the estimates; a null id stays null; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, P1, Words, blocks, cut, hash_spans, mixed, per_doc, store, table, texts_of
from .substring_dedup import window_hashes

WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Share of the documents that an estimate rests on: just over half, so that just under half may be outliers.
SUBSET, LEAST = 0.52, 200
#: Squared distance: the estimates describe the middle half closely and texts have long tails, so far more than normal data would have.
LIMIT = 200.0
#: Documents within this share of the chi-square distribution make the final estimate.
NEAR = 0.975
#: Concentration steps of each start, and of the best one after that, at most.
TRIALS, STEPS = 2, 8
#: Random starts, and documents in each, about.
RANDOM, POINTS = 3, 12
#: Words of ordinary text (of five letters, a sign to 20 letters) that weigh in each rate.
PRIOR = 12.0
#: Share of the corpus's spread that a direction's has at least, and least spread of the corpus.
FLOOR, FLAT = 0.01, 0.01
#: Logarithms of words, of letters a word, of signs a letter, of distinct words a word.
SIZE = 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the statistics take besides: distinct words, and ASCII characters of words that are no letters.
MORE = ("n_distinct", "n_signs")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SIGN = np.array([c < 128 and not chr(c).isalpha() and not SPACE[c] for c in range(256)])
#: Groups up to this many are broadcast.
SMALL = 100_000


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys stand more than once, and which are not the first of theirs."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    many, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    many[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return many, later


def _of_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(hashes + mixed(doc.astype(np.uint64) + P1))


def counts_of(texts: pa.Array) -> np.ndarray:
    """COUNTS and MORE of each document."""
    w = Words(texts)
    data, bounds = w.data, w.bounds
    n = len(texts)
    chars = per_doc((~SPACE[data] & ((data & 0xC0) != 0x80)).astype(np.int64), bounds)
    symbols = per_doc(_SYMBOL[data].astype(np.int64), bounds)
    # lines with a word, by document
    breaks = np.flatnonzero(data == 0x0A)
    starts, ends = np.sort(np.concatenate([bounds[:-1], breaks + 1])), np.sort(np.concatenate([bounds[1:], breaks]))
    line_doc = np.searchsorted(bounds, starts, "right") - 1
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[has_word], ends[has_word], line_doc[has_word]
    _, later = _repeated(_of_doc(hash_spans(data, starts, ends), line_doc))
    dup_lines = np.bincount(line_doc[later], minlength=n) if n else np.zeros(0, np.int64)
    repeat = np.zeros(n, np.int64)
    hashes = w.hashes()
    _, again = _repeated(_of_doc(hashes, w.doc))
    distinct = w.count - per_doc(again.astype(np.int64), w.first)
    signs = per_doc(_SIGN[data].astype(np.int64), bounds)
    if len(w) >= WINDOW:
        h = window_hashes(hashes, WINDOW)
        s = np.flatnonzero(w.doc[: len(h)] == w.doc[WINDOW - 1 :])
        many, _ = _repeated(_of_doc(h[s], w.doc[s]))
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, s[many], 1)
        np.add.at(edge, s[many] + WINDOW, -1)
        repeat = per_doc((np.cumsum(edge[:-1]) > 0).astype(np.int64), w.first)
    return np.column_stack([w.count, chars, symbols, dup_lines, repeat, distinct, signs]).astype(np.int64)


def counts(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """id, language, origin, COUNTS and MORE for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(3))
            x = np.concatenate([counts_of(texts.slice(a, b - a)) for a, b in blocks(texts)] or [np.zeros((0, len(COUNTS + MORE)), np.int64)])
            out = {"id": batch.column(0), "language": batch.column(1), "origin": batch.column(2)}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array(x[:, k], pa.int64()) for k, c in enumerate(COUNTS + MORE)})

    rows = docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("?")).alias("language"),
        F.coalesce(F.col(source).cast("string"), F.lit("?")).alias("origin"), F.col(text).cast("string").alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, language string, origin string, " + ", ".join(f"{c} long" for c in COUNTS + MORE))


#: The transformed statistics, and the parts of an estimate: centre, and the precision's upper triangle with what lies off the diagonal doubled.
X = [f"x{i}" for i in range(SIZE)]
CENTRE = [f"c{i}" for i in range(SIZE)]
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
PRECISION = [f"p{i}{j}" for i, j in PAIRS]


def _vector() -> dict[str, Column]:
    words, chars, distinct, signs = (F.col(c).cast("double") for c in ("n_words", "word_chars", "n_distinct", "n_signs"))
    rates = (
        words + PRIOR, (chars + 5 * PRIOR) / (words + PRIOR), (signs + PRIOR / 4) / (chars + 5 * PRIOR), (distinct + PRIOR) / (words + PRIOR)
    )
    return dict(zip(X, map(F.log, rates), strict=True))


def chi_square_cdf(x: float, k: int) -> float:
    """Series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """The scatter of this share of the documents is too small by this factor where the data are normal."""
    return share / chi_square_cdf(chi_square_quantile(share, SIZE), SIZE + 2)


_PARAMETERS = "kind string, start int, det double, " + ", ".join(f"{c} double" for c in CENTRE + PRECISION)


def floored(cov: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """In units of the corpus's ``spread`` no direction's variance is below the square of FLOOR."""
    unit = np.outer(spread, spread)
    size, axes = np.linalg.eigh(cov / unit)
    return cov if size[0] >= FLOOR**2 else (axes * np.maximum(size, FLOOR**2)) @ axes.T * unit


def _invert(factor: float, spread: np.ndarray):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Centre, precision and log determinant of each kind and start from its sums; of scores, with the kind's own scale."""
        for p in parts:
            rows = []
            for k in range(len(p)):
                r = p.iloc[k]
                mean = r[[f"s_{c}" for c in X]].to_numpy(float) / r["n"]
                cov = np.zeros((SIZE, SIZE))
                cov[np.triu_indices(SIZE)] = r[[f"s_{c}" for c in PRECISION]].to_numpy(float) / r["n"]
                cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
                scale = r[[f"scale{i}" for i in range(SIZE)]].to_numpy(float)
                if not np.isnan(scale).any():
                    sd = np.sqrt(np.maximum(np.diag(cov), 0))
                    flat = sd < 1e-9
                    cov = np.where(flat[:, None] | flat, 0.0, cov / np.maximum(np.outer(sd, sd), 1e-18))
                    np.fill_diagonal(cov, 1.0)
                    cov, mean = cov * np.outer(scale, scale), r[[f"median{i}" for i in range(SIZE)]].to_numpy(float)
                cov = floored(cov, spread)
                inverse = np.linalg.inv(cov * factor)
                rows.append((r["kind"], r["start"], np.linalg.slogdet(cov)[1], *mean, *(inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS)))
            yield pd.DataFrame(rows, columns=["kind", "start", "det", *CENTRE, *PRECISION])

    return run


def _distance() -> Column:
    d = [F.col(X[i]) - F.col(CENTRE[i]) for i in range(SIZE)]
    return reduce(Column.__add__, (d[i] * reduce(Column.__add__, (d[j] * F.col(f"p{i}{j}") for j in range(i, SIZE))) for i in range(SIZE)))


def _with(rows: DataFrame, parameters: DataFrame, n: int, on: tuple[str, ...] = ("kind",)) -> DataFrame:
    return rows.join(F.broadcast(parameters) if n <= SMALL else parameters, list(on))


def _estimate(rows: DataFrame, factor: float, spread: np.ndarray, scale: DataFrame | None = None) -> DataFrame:
    """_PARAMETERS from rows (kind, start, X), which are scores of the kind's ``scale`` where that is given."""
    sums = [F.sum(c).alias(f"s_{c}") for c in X] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s_p{i}{j}") for i, j in PAIRS]
    moments = rows.groupBy("kind", "start").agg(F.count("*").alias("n"), *sums)
    if scale is None:
        moments = moments.withColumns({f"{c}{i}": F.lit(None).cast("double") for c in ("median", "scale") for i in range(SIZE)})
    else:
        moments = moments.join(scale.drop("n"), "kind")
    return moments.mapInPandas(_invert(factor, spread), _PARAMETERS)


def starts(rows: DataFrame, marks: DataFrame, n_kinds: int, spread: np.ndarray) -> DataFrame:
    """_PARAMETERS of the starts of each kind: 0 quartiles, 1 bounded scores, 2 directions, from 3 on random subsets."""
    zero = F.lit(0.0)
    own = marks.select(
        "kind", F.lit(0).alias("start"), zero.alias("det"), *(F.col(f"median{i}").alias(c) for i, c in enumerate(CENTRE)),
        *((1 / (F.col(f"scale{i}") * F.col(f"scale{i}")) if i == j else zero).alias(f"p{i}{j}") for i, j in PAIRS),
    )
    both = _with(rows, marks, n_kinds)
    z = both.select("kind", *(((F.col(c) - F.col(f"median{i}")) / F.col(f"scale{i}")).alias(c) for i, c in enumerate(X)))
    bounded = z.select("kind", F.lit(1).alias("start"), *(F.tanh(c).alias(c) for c in X))
    length = F.greatest(F.sqrt(reduce(Column.__add__, (F.col(c) * F.col(c) for c in X))), F.lit(1e-9))
    turned = z.select("kind", F.lit(2).alias("start"), *((F.col(c) / length).alias(c) for c in X))
    number = F.pmod(F.xxhash64("key", *X), F.col("n") * RANDOM)
    drawn = both.where(number < POINTS * RANDOM).select("kind", (number % RANDOM + 3).cast("int").alias("start"), *X)
    return own.unionByName(_estimate(bounded.union(turned), 1.0, spread, marks)).unionByName(_estimate(drawn, 1.0, spread))


def _concentrate(rows: DataFrame, found: DataFrame, n_found: int, spread: np.ndarray) -> DataFrame:
    """One step from ``found``, _PARAMETERS of so many kinds and starts."""
    near = _with(rows, found, n_found).select("kind", "start", *X, _distance().alias("d"))
    edge = near.groupBy("kind", "start").agg(F.percentile_approx("d", SUBSET).alias("edge"))
    return cut(_estimate(_with(near, edge, n_found, ("kind", "start")).where("d <= edge"), consistency(SUBSET), spread))


def estimates(rows: DataFrame) -> DataFrame:
    """kind, n, CENTRE and PRECISION of each kind from rows (kind, key, X); key tells rows apart in random subsets."""
    marks = rows.groupBy("kind").agg(F.count("*").alias("n"), *(F.percentile_approx(c, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, c in enumerate(X)))
    own = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLAT * FLOOR)) for i in range(SIZE)]
    marks = cut(marks.select("kind", "n", *(F.col(f"q{i}")[1].alias(f"median{i}") for i in range(SIZE)), *(c.alias(f"scale{i}") for i, c in enumerate(own))))
    n_kinds = marks.count()
    # the widest kind's spread: the corpus's, where it is one of them
    widest = marks.agg(*(F.max(F.struct(F.col("kind") == "c", f"scale{i}"))[f"scale{i}"] for i in range(SIZE))).first()
    spread = np.array([max(x or 0.0, FLAT) for x in widest])
    found = cut(starts(rows, marks, n_kinds, spread))
    for _ in range(TRIALS):
        found = _concentrate(rows, found, n_kinds * (3 + RANDOM), spread)
    best = F.min_by(F.struct("start", *CENTRE, *PRECISION, "det"), F.struct("det", "start")).alias("best")
    found = cut(found.groupBy("kind").agg(best).select("kind", "best.*"))
    det = found.agg(F.sum("det")).first()[0]
    for _ in range(STEPS):
        found = _concentrate(rows, found, n_kinds, spread)
        before, det = det, found.agg(F.sum("det")).first()[0]
        if det is None or before - det < 1e-6 * max(1, n_kinds):
            break
    inner = _with(rows, found, n_kinds).where(_distance() <= chi_square_quantile(NEAR, SIZE)).select("kind", "start", *X)
    final = _estimate(inner, consistency(NEAR), spread).drop("start", "det")
    return cut(final.join(marks.select("kind", "n"), "kind"))


def _kinds() -> Column:
    return F.array(F.concat_ws("\x1f", F.lit("s"), "language", "origin"), F.concat_ws("\x1f", F.lit("l"), "language"), F.lit("c"))


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """id, COUNTS, base_failed, distance (null where the base rules fail), judged_by and kept for each row.

    judged_by: 'source', 'language' or 'corpus', whose estimate gave the distance.
    """
    failed = (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = store(counts(docs, id, text, lang, source).withColumn("base_failed", failed).withColumns(_vector()))
    good = rows.where("not base_failed").select(F.explode(_kinds()).alias("kind"), F.xxhash64("id").alias("key"), *X)
    found = estimates(good)
    n_kinds = found.count()
    sized = found.where((F.col("n") >= LEAST) | (F.col("kind") == "c")).select("kind")
    sized = F.broadcast(sized) if n_kinds <= SMALL else sized
    # the finest kind that is large enough, looked up once for each language and source
    pairs = rows.select("language", "origin").distinct().select("language", "origin", F.posexplode(_kinds()).alias("level", "kind"))
    chosen = pairs.join(sized, "kind").groupBy("language", "origin").agg(F.min_by("kind", "level").alias("kind"))
    chosen = cut(chosen.join(found, "kind"))
    chosen = F.broadcast(chosen) if chosen.count() <= SMALL else chosen
    out = rows.join(chosen, ["language", "origin"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    level = F.substring("kind", 1, 1)
    judged_by = F.when(~F.col("base_failed"), F.when(level == "s", "source").when(level == "l", "language").when(level == "c", "corpus")).alias("judged_by")
    return out.select(F.col("id").alias(id), *COUNTS, "base_failed", "distance", judged_by, (~F.col("base_failed") & F.coalesce(F.col("distance") <= LIMIT, F.lit(True))).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
