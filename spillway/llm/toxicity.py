"""Toxicity (operator 10): a learned lexicon matched with spelling errors, judged in context.

Terms are learned from labelled rows: whole words, and stems (words that begin so), which
stand in far more toxic than other documents.  The words of the lexicon, and the words that
its stems stand for, make a trie; a Levenshtein automaton of one error (for words of at least ``FUZZY`` letters) runs over all
paths of the trie at once, and the reached sets of trie nodes and errors become the states
of one table.  Texts run through the table a letter of all distinct words at a time; a word
leaves as soon as its state is dead.  A word one error off a term is no misspelling if its own log
odds in the learning rows are too low for a term.

A context score separates quotation from abuse: around each hit a window of ``NEAR`` words
gives cues (an open quotation, a reporting verb near, words that the learning rows show
around hits of toxic and of other documents), and a logistic model of the cues says how
likely the hit is abuse.  It is fitted to the hits of the learning rows, drawn towards
``PRIOR``, so that it tells quotations apart before it has seen one and learns from those
it sees.  A hit counts as abuse by that share; below one half it is quoted.  A logistic
regression over a document's hits gives its score.

Half of the learning rows make the lexicon, the other half the regressions, so the lexicon
is not trusted on the rows it came from.

Cases: null and empty texts are scored as texts without hits; a very long text is scored
whole; a document without labels is scored only; where a half of the learning rows has no
toxic one, or no other, everyone's score is the share of toxic rows, 0 without any rows; of
terms that accept a word with equally few errors the first counts; repeated rows each give a
row, and are learned from once for each id; an empty table gives no rows; a null id is held
out of nothing and scored; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Letters, blocks, fit_logistic, held_out, labelled, per_doc, sigmoid, table, texts_of

#: Labelled rows to learn from, at most.
SAMPLE = 16_000
#: Terms of the lexicon, at most, and their least log odds.
TERMS, ODDS = 400, 2.3
#: The least toxic documents of a term: this share of those learned from, but within these bounds.
SUPPORT, LEAST_SUPPORT, MOST_SUPPORT = 1 / 3, 2, 5
#: Letters of stems, and the least letters of a word that may be misspelled.
STEMS, FUZZY = range(4, 11), 5
FOLD, HELD, THRESHOLD = 4, 2, 0.3
#: Words around a hit that are its context, and code points in which a quotation is looked for.
NEAR, QUOTE = 4, 80
QUOTES = "\"'“”„«»‹›‘’「」"
# Verbs of reporting in the languages of the corpus.
REPORTING = ("said", "says", "wrote", "quoted", "quote", "called", "according", "sagte", "schrieb", "zitiert", "dit", "écrit", "selon", "dijo", "escribió", "según")
FEATURES = 7
#: Weights that the context model is drawn to, by the squared distance times PULL: of its constant,
#: an open quotation, reporting verbs (the nearer the more), and the learned neighbours.  The constant stays,
#: or hits that all stand in toxic rows would teach that no context matters.
PRIOR, PULL = np.array([2.0, -4.0, -4.5, 1.0]), np.array([1e6, 4.0, 4.0, 1.0])
#: Weight of a misspelled term against the same spelled right.
MISSPELLED = 0.7


@dataclass
class Automaton:
    """Transitions by state and letter class, and what each state accepts."""

    classes: dict[str, int]
    step: np.ndarray
    term: np.ndarray
    errors: np.ndarray
    table: np.ndarray = field(default=None, repr=False)

    def class_of(self) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(max(map(ord, self.classes), default=0) + 2, np.int32)
            for c, k in self.classes.items():
                self.table[ord(c)] = k
        return self.table

    def run(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term (or -1) and errors of each word, a letter of all live words at a time."""
        classes = self.class_of()
        state = np.ones(len(start), np.int32)
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            more = at[live] < end[live]
            live = live[more]
            state[live] = self.step[state[live], classes[np.minimum(points[at[live]], len(classes) - 1)]]
            at[live] += 1
            live = live[state[live] > 0]
        return self.term[state], self.errors[state]


def build(words: list[str], stems: list[str], fuzzy: int = FUZZY, forms: dict[str, str] | None = None) -> Automaton:
    """One error is allowed in words of ``fuzzy`` letters or more, none in stems or in a stem's rest.

    Terms are numbered in the order words, stems; a stem accepts every word that begins so.
    ``forms`` are words that a stem covers, with their stem: they may be misspelled like
    other words, and count as that stem's term.
    Where several terms accept a word, the one with fewer errors counts, then the first.
    """
    child: list[dict[str, int]] = [{}]
    ends: list[list[int]] = [[]]
    loose = [False]  # a fuzzy word lies below
    stem_end: list[int] = [-1]

    def add(term: str, number: int, stem: bool) -> None:
        node = 0
        for c in term:
            loose[node] |= not stem and len(term) >= fuzzy
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({})
                ends.append([])
                loose.append(False)
                stem_end.append(-1)
            node = child[node][c]
        loose[node] |= not stem and len(term) >= fuzzy
        if stem:
            stem_end[node] = number
        else:
            ends[node].append(number)

    for i, w in enumerate(words):
        add(w, i, False)
    for i, w in enumerate(stems):
        add(w, len(words) + i, True)
    place = {w: len(words) + i for i, w in enumerate(stems)}
    for w, stem in sorted((forms or {}).items()):
        if len(w) >= fuzzy:
            add(w, place[stem], False)
    letters = sorted({c for t in (*words, *stems, *(forms or {})) for c in t})
    classes = {c: k + 1 for k, c in enumerate(letters)}

    def closed(nodes: set[tuple[int, int]]) -> frozenset:
        """A letter of the term may be missing in the word."""
        out = set(nodes)
        out |= {(n, 1) for x, e in nodes if e == 0 for n in child[x].values() if loose[n]}
        return frozenset((x, e) for x, e in out if e == 0 or (x, 0) not in out)

    def after(state: frozenset, c: str | None) -> frozenset:
        out: set[tuple[int, int]] = set()
        for x, e in state:
            if x < 0:  # inside the rest of a stem
                out.add((x, 0))
                continue
            n = child[x].get(c)
            if n is not None and (e == 0 or loose[n]):
                out.add((-2 - stem_end[n], 0) if e == 0 and stem_end[n] >= 0 else (n, e))
                if e == 0 and stem_end[n] >= 0:
                    out.add((n, 0))
            if e == 0:
                if loose[x]:
                    out.add((x, 1))  # a letter too many
                out.update((m, 1) for d, m in child[x].items() if d != c and loose[m])  # another letter
        return closed(out)

    def accepts(state: frozenset) -> tuple[int, int]:
        best = (9, -1)
        for x, e in state:
            if x < 0:
                best = min(best, (0, -2 - x))
            else:
                best = min([best, *((e, t) for t in ends[x] if e == 0 or t >= len(words) or len(words[t]) >= fuzzy)])
        return best

    first = closed({(0, 0)})
    number, todo, rows, accepted = {frozenset(): 0, first: 1}, deque([first]), {0: [0] * (len(letters) + 1)}, {0: (9, -1)}
    while todo:
        state = todo.popleft()
        row = []
        for c in (None, *letters):
            following = after(state, c)
            if following not in number:
                number[following] = len(number)
                todo.append(following)
            row.append(number[following])
        rows[number[state]] = row
        accepted[number[state]] = accepts(state)
    n = len(number)
    return Automaton(
        classes,
        np.array([rows[i] for i in range(n)], np.int32),
        np.array([accepted[i][1] for i in range(n)], np.int32),
        np.array([accepted[i][0] for i in range(n)], np.int32),
    )


def log_odds(a: int, b: int, n_toxic: int, n_clean: int) -> float:
    return math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))


def support(n_toxic: int) -> int:
    return int(min(MOST_SUPPORT, max(LEAST_SUPPORT, round(SUPPORT * n_toxic))))


def choose_terms(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> tuple[list[str], list[str], np.ndarray, dict[str, str]]:
    """Words, stems and their weights from the documents with a word ('word') or a stem ('stem*').

    Last, the words left out because a stem covers them, with that stem.
    """
    scored = []
    for term, a in toxic.items():
        if a >= support(n_toxic):
            odds = log_odds(a, clean.get(term, 0), n_toxic, n_clean)
            if odds >= ODDS:
                scored.append((odds, a, term))
    # shorter stems first: what a stem says, its longer forms need not say again
    scored.sort(key=lambda x: (not x[2].endswith("*"), len(x[2]), x[2]))
    kept: dict[str, tuple[float, int]] = {}
    for odds, a, term in scored:
        word = term.rstrip("*")
        covers = [kept[word[:k] + "*"] for k in STEMS if word[:k] + "*" in kept and word[:k] + "*" != term]
        # a stem that stands in hardly more documents than one word is that word, which may be misspelled
        if not any(o >= odds - 1.0 and (n > 1.05 * a or term.endswith("*")) for o, n in covers):
            kept[term] = (odds, a)
    for term in [t for t in kept if not t.endswith("*")]:
        for k in STEMS:
            stem = term[:k] + "*"
            if stem in kept and kept[stem][1] <= toxic[term] * 1.05:
                del kept[stem]
    for odds, a, word in scored:
        # covered only by stems that have gone since
        if not word.endswith("*") and not any(word[:k] + "*" in kept for k in STEMS):
            kept[word] = (odds, a)
    best = sorted(kept, key=lambda t: (-kept[t][0] * math.sqrt(kept[t][1]), t))[:TERMS]
    words = sorted(t for t in best if not t.endswith("*"))
    stems = sorted(t[:-1] for t in best if t.endswith("*"))
    forms = {}
    for _, _, term in scored:
        held = [term[:k] for k in STEMS if term[:k] in stems]
        if not term.endswith("*") and term not in kept and held:
            forms[term] = held[-1]
    return words, stems, np.array([kept[t][0] for t in words] + [kept[t + "*"][0] for t in stems]), forms


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray
    known: np.ndarray  # hashes of words that are no misspelling of a term: by their own odds they are not toxic
    reporting: np.ndarray
    context: np.ndarray  # score by hash of a neighbour
    cues: np.ndarray  # weights of the context model
    fit: tuple | None
    base: float = 0.0


CONTEXT = 1 << 12


def hits(model: Model, texts: pa.Array) -> tuple[Letters, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and of each hit: its word, term, errors, and the cues of its context."""
    w = Letters(texts)
    hashes, at, which = w.distinct()
    term, errors = model.automaton.run(w.points, w.start[at], w.end[at])
    if len(model.known) and len(hashes):
        k = np.minimum(np.searchsorted(model.known, hashes), len(model.known) - 1)
        term = np.where((errors > 0) & (model.known[k] == hashes), -1, term)
    found = np.flatnonzero(term[which] >= 0) if len(w) else np.zeros(0, np.int64)
    term, errors = term[which[found]], errors[which[found]]
    doc = w.doc[found]
    # quotation: a quotation mark shortly before and shortly after, in the same document
    marks = np.flatnonzero(np.isin(w.raw, [ord(c) for c in QUOTES]))
    # a mark between two letters is an apostrophe
    if len(marks):
        letter = np.zeros(len(w.raw) + 2, bool)
        letter[1:-1] = w.letter
        marks = marks[~(letter[marks] & letter[marks + 2])]
    quoted = np.zeros(len(found), bool)
    if len(marks) and len(found):
        k = np.searchsorted(marks, w.start[found])
        left = np.where(k > 0, marks[np.maximum(k - 1, 0)], -(1 << 60))
        right = np.where(k < len(marks), marks[np.minimum(k, len(marks) - 1)], 1 << 60)
        before = (k - np.searchsorted(marks, w.bounds[doc])) % 2 == 1  # an odd number of marks opens
        quoted = before & (w.start[found] - left <= QUOTE) & (right - w.end[found] <= QUOTE) & (left >= w.bounds[doc]) & (right < w.bounds[doc + 1])
    score, reported = np.zeros(len(found)), np.zeros(len(found))
    word_hash = hashes[which] if len(found) else hashes
    for step in (*range(-NEAR, 0), *range(1, NEAR + 1)):
        at = found + step
        fine = (at >= w.first[doc]) & (at < w.first[doc + 1])
        h = word_hash[np.clip(at, 0, max(0, len(w) - 1))] if len(found) else word_hash[:0]
        score += np.where(fine, model.context[h % np.uint64(CONTEXT)] if len(h) else 0.0, 0.0) / abs(step)
        reported += (fine & np.isin(h, model.reporting)) / abs(step)
    return w, found, term, errors, np.column_stack([np.ones(len(found)), quoted, np.minimum(reported, 1.0), np.tanh(score / 4)])


def fit_context(cues: np.ndarray, toxic: np.ndarray, times: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights of the cues: log loss of the hits' labels, each as many times, drawn towards PRIOR."""
    w = PRIOR.copy()
    for _ in range(steps):
        p = sigmoid(cues @ w)
        grad = cues.T @ (times * (p - toxic)) + PULL * (w - PRIOR)
        hess = (cues * (times * p * (1 - p))[:, None]).T @ cues + np.diag(PULL)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(model: Model, texts: pa.Array) -> np.ndarray:
    """FEATURES numbers for each document."""
    w, found, term, errors, cues = hits(model, texts)
    abuse, score = sigmoid(cues @ model.cues), cues[:, 3]
    first = np.searchsorted(w.doc[found], np.arange(len(texts) + 1))
    weight = model.weights[term] if len(found) else np.zeros(0)
    # different terms count; the same one again counts less
    order = np.lexsort((errors, term, w.doc[found]))
    again = np.zeros(len(found), bool)
    if len(found) > 1:
        d, t = w.doc[found][order], term[order]
        again[order[1:]] = (d[1:] == d[:-1]) & (t[1:] == t[:-1])
    fresh = np.where(again, 0.3, 1.0)
    weight = weight * np.where(errors > 0, MISSPELLED, 1.0)
    sums = np.stack([weight * fresh * abuse, weight * (abuse < 0.5), score * abuse, abuse], 1)
    total = per_doc(sums, first)
    top = np.zeros(len(texts))
    np.maximum.at(top, w.doc[found], weight * abuse)
    size = np.log1p(w.count)
    return np.column_stack([np.log1p(total[:, 0]), np.log1p(total[:, 1]), top, total[:, 2] / np.maximum(total[:, 3], 1.0), np.log1p(total[:, 3]), total[:, 3] / np.sqrt(w.count + 10.0), size])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch with each word and stem, by label."""
    for batch in batches:
        label = batch.column(1).to_pylist()
        texts = texts_of(batch.column(0))
        counts = (Counter(), Counter())
        for a, b in blocks(texts):
            w = Letters(texts.slice(a, b - a))
            _, at, which = w.distinct()
            names = [w.word(i) if w.end[i] - w.start[i] <= 40 else "" for i in at.tolist()]
            for d in range(b - a):
                words = {names[k] for k in np.unique(which[w.first[d] : w.first[d + 1]]).tolist()}
                terms = {x for x in words if len(x) >= 3} | {x[:k] + "*" for x in words for k in STEMS if len(x) > k}
                counts[label[a + d]].update(terms)
        for y in (0, 1):
            yield pa.RecordBatch.from_pydict(
                {"term": pa.array(list(counts[y]), pa.string()), "toxic": pa.array([y] * len(counts[y]), pa.int32()), "n": pa.array(list(counts[y].values()), pa.int64())}
            )


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, "toxic", FOLD, HELD, sample, id, text).withColumn("half", F.xxhash64("id", F.lit(1)) % 2 == 0)
    of_half = {bool(r.half): dict(n=r.n, toxic=r.toxic) for r in rows.groupBy("half").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).collect()}
    learn, other = of_half.get(True), of_half.get(False)
    if not learn or not other or not 0 < learn["toxic"] < learn["n"] or not 0 < other["toxic"] < other["n"]:
        both = [h for h in (learn, other) if h]
        base = sum(h["toxic"] for h in both) / max(1, sum(h["n"] for h in both))
        return Model(build([], []), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(CONTEXT), PRIOR, None, base)
    counts = rows.where("half").select("text", "label").mapInArrow(_term_counts, "term string, toxic int, n long")
    counts = counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    n_toxic, n_clean = learn["toxic"], learn["n"] - learn["toxic"]
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))
    # bounded by the sample's size
    found = counts.where((F.col("a") >= support(n_toxic)) & (odds >= ODDS)).orderBy(F.desc(odds * F.sqrt("a")), "term").limit(20 * TERMS).collect()
    words, stems, weights, forms = choose_terms(Counter({r.term: r.a for r in found}), Counter({r.term: r.b for r in found}), n_toxic, n_clean)
    automaton = build(words, stems, forms=forms)
    base = Model(automaton, weights, np.zeros(0, np.uint64), _hash_words(REPORTING), np.zeros(CONTEXT), PRIOR, None)
    shared = rows.sparkSession.sparkContext.broadcast(base)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words one error off a term, once for each document, by its label; neighbours of hits, by label."""
        for batch in batches:
            label, texts = np.array(batch.column(1).to_pylist()), texts_of(batch.column(0))
            for a, b in blocks(texts):
                w, at, _, errors, _ = hits(shared.value, texts.slice(a, b - a))
                h, y = w.hashes(), label[a:b][w.doc]
                off = at[errors > 0]
                off = off[np.unique(np.stack([w.doc[off].astype(np.int64), h[off].view(np.int64)]), axis=1, return_index=True)[1]]
                kind, keys, ys = [np.zeros(len(off), int)], [h[off].view(np.int64)], [y[off]]
                for step in (*range(-NEAR, 0), *range(1, NEAR + 1)):
                    n = at[errors == 0] + step
                    fine = (n >= 0) & (n < len(w))
                    n = n[fine][w.doc[n[fine]] == w.doc[at[errors == 0][fine]]]
                    kind.append(np.ones(len(n), int))
                    keys.append((h[n] % np.uint64(CONTEXT)).astype(np.int64))
                    ys.append(y[n])
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.concatenate(kind), pa.int32()), "key": pa.array(np.concatenate(keys), pa.int64()), "toxic": pa.array(np.concatenate(ys), pa.int32())})

    near = rows.where("half").select("text", "label").mapInArrow(known, "kind int, key long, toxic int").groupBy("kind", "key").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).collect()
    base.known = np.sort(np.array([r.key for r in near if r.kind == 0 and r.n > r.a and (not r.a or log_odds(r.a, r.n - r.a, n_toxic, n_clean) < ODDS)], np.int64).view(np.uint64))
    context = np.zeros(CONTEXT)
    own = [r for r in near if r.kind == 1]
    rate = (sum(r.a for r in own) + 1) / (sum(r.n for r in own) + 2)
    for r in own:
        p = (r.a + 8 * rate) / (r.n + 8)
        context[r.key] = math.log(p / (1 - p)) - math.log(rate / (1 - rate))
    base.context = context
    shared = rows.sparkSession.sparkContext.broadcast(base)

    def context_cues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits by their cues, rounded, and label."""
        for batch in batches:
            label, texts = np.array(batch.column(1).to_pylist(), float), texts_of(batch.column(0))
            for a, b in blocks(texts):
                w, found, _, _, cues = hits(shared.value, texts.slice(a, b - a))
                x = np.column_stack([np.round(cues[:, 1:], 1) + 0.0, label[a:b][w.doc[found]]])
                yield pa.RecordBatch.from_pydict({c: pa.array(x[:, k]) for k, c in enumerate(("open", "reported", "near", "toxic"))})

    # cues are rounded, so the table has at most 2 x 11 x 21 x 2 rows
    seen = rows.where("not half").select("text", "label").mapInArrow(context_cues, "open double, reported double, near double, toxic double")
    seen = seen.groupBy("open", "reported", "near", "toxic").agg(F.count("*").alias("n")).toPandas()
    x = np.column_stack([np.ones(len(seen)), seen[["open", "reported", "near"]].to_numpy()])
    base.cues = fit_context(x, seen["toxic"].to_numpy(float), seen["n"].to_numpy(float))
    shared = rows.sparkSession.sparkContext.broadcast(base)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            x = np.concatenate([features(shared.value, texts.slice(a, b - a)) for a, b in blocks(texts)] or [np.zeros((0, FEATURES))])
            yield pa.RecordBatch.from_pydict({"label": batch.column(1), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    got = rows.where("not half").select("text", "label").mapInArrow(measure, "label int, x array<double>").toPandas()
    base.fit = fit_logistic(np.array(got["x"].tolist()), got["label"].to_numpy(float))
    return base


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    w = Letters(pa.array(list(words), pa.large_string()))
    return np.sort(w.hashes())


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    if model.fit is None:
        return np.full(len(texts), model.base)
    mean, scale, w = model.fit
    found = [features(model, texts.slice(a, b - a)) for a, b in blocks(texts)]
    x = np.concatenate(found) if found else np.zeros((0, FEATURES))
    return sigmoid((x - mean) / scale @ w[:-1] + w[-1])


def score_toxicity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, score and the columns of ``carry`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(shared.value, texts_of(batch.column(1)))
            out = {"id": batch.column(0), "score": pa.array(found, pa.float64())}
            if carry:
                out["carry"] = batch.column(2)
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), *([F.struct(*carry).alias("carry")] if carry else []))
    more = f", carry {rows.schema['carry'].dataType.simpleString()}" if carry else ""
    done = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double{more}")
    return done.select(F.col("id").alias(id), "score", *(F.col("carry")[c].alias(c) for c in carry))


def spans(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each hit: id, begin and finish (code points), errors, abuse (0 to 1) and quoted (abuse below one half)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in blocks(texts):
                w, found, _, errors, cues = hits(shared.value, texts.slice(a, b - a))
                abuse = sigmoid(cues @ shared.value.cues)
                doc = w.doc[found]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(0).take(pa.array(doc + a)),
                        "begin": pa.array(w.start[found] - w.bounds[doc], pa.int64()),
                        "finish": pa.array(w.end[found] - w.bounds[doc], pa.int64()),
                        "errors": pa.array(errors, pa.int32()),
                        "abuse": pa.array(abuse, pa.float64()),
                        "quoted": pa.array(abuse < 0.5, pa.bool_()),
                    }
                )

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, begin long, finish long, errors int, abuse double, quoted boolean").withColumnRenamed("id", id)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out("doc_id", FOLD, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
