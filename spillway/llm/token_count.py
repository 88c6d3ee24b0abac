"""Token counts (operator 1): a two-tier lookup on the map side.

Tier one is a broadcast table from frequent pre-tokens to their number of tokens.  The
pre-tokens come from a pass over all documents in which every task keeps a bounded count
(frequent items survive, rare ones are given up) and emits at most ``PER_TASK`` of them;
only these summaries are merged, no pre-token is shuffled.  Tier two is a bounded cache in
each worker, filled by encoding what the table lacks.  A text that the pre-token rule
cannot split exactly as the library does (not NFC, a special string in it, letters whose
lower case depends on the neighbours) is encoded whole by the library.

Texts are taken in runs of about 2 MB, so what a task holds does not follow the batch.

Cases: a null or empty text has 0 bytes and 0 tokens; a very long text is a run of its own; an
empty table gives no rows; every input row gives one row, so repeated rows and ids stay;
among equally frequent pre-tokens the smaller string enters the table, which changes no
count; a null id stays null; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table, texts_of

VOCABULARY = "word_bpe_49k.json"
#: Entries of the broadcast table, entries a task hands in, entries a task counts at once.
FREQUENT, PER_TASK, COUNTED = 1 << 15, 1 << 11, 1 << 17
#: Pre-tokens above this length are never in the table, which bounds its bytes.
LONGEST = 48
#: Entries of a worker's cache.
CACHED = 600_000
OVER = 2048
# White space as the tokenizer's own patterns take it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The pre-tokens of the vocabulary file.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+"
# The special strings of the vocabulary file.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

#: Texts of ASCII and Latin letters alone are cut by the standard library's faster module.
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_plain = re.compile(r"[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]*").fullmatch
_fast = re.compile(rf"[{LATIN}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s{LATIN}0-9]+").findall
_wide = regex.compile(PRE_TOKEN).findall
_worker: dict = {}


def _tokenizer(path: str):
    if path not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _worker[path] = Tokenizer.from_file(path)
    return _worker[path]


def lowered(text: str) -> str | None:
    """The text as its pre-tokens are cut, or None where only the library can do it."""
    if "<|" in text and any(x in text for x in SPECIAL):
        return None
    if text.isascii():
        return text.lower()
    if "İ" in text or "Σ" in text or not unicodedata.is_normalized("NFC", text):
        return None
    low = text.lower()
    return low if unicodedata.is_normalized("NFC", low) else None


def pre_tokens(low: str) -> list[str]:
    return _fast(low) if _plain(low) else _wide(low)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        texts = texts_of(batch.column(0))
        for a, b in blocks(texts):
            for text in texts.slice(a, b - a).to_pylist():
                if text and (low := lowered(text)) is not None:
                    counts.update(pre_tokens(low))
        if len(counts) > COUNTED:
            counts = Counter(dict(counts.most_common(COUNTED // 2)))
    top = [(w, n) for w, n in counts.most_common(PER_TASK) if len(w) <= LONGEST]
    yield pa.RecordBatch.from_pydict({"pre": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})


def frequent(docs: DataFrame, text: str = "text", size: int = FREQUENT) -> list[str]:
    """At most ``size`` frequent pre-tokens of the corpus."""
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_summaries, "pre string, n long")
    top = found.groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(size)
    return [r.pre for r in top.collect()]


def _lengths(path: str, pre: list[str]) -> dict[str, int]:
    return dict(zip(pre, map(len, _tokenizer(path).encode_batch(pre, add_special_tokens=False)), strict=True))


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, over: int = OVER) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > over)."""
    path = path or public_tokenizers.path(VOCABULARY)
    known = docs.sparkSession.sparkContext.broadcast(_lengths(path, frequent(docs, text)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, encode = known.value, _tokenizer(path).encode_batch
        cache = _worker.setdefault((path, "cache"), {})
        for batch in batches:
            texts = texts_of(batch.column(1))
            for at, end in blocks(texts):
                some = texts.slice(at, end - at).to_pylist()
                split = [None if (low := lowered(x)) is None else pre_tokens(low) for x in some]
                seen: set[str] = set()
                for pre in split:
                    seen.update(pre or ())
                missing = [x for x in seen if x not in table and x not in cache]
                if len(cache) + len(missing) > CACHED:
                    cache.clear()
                    missing = [x for x in seen if x not in table]
                cache.update(zip(missing, map(len, encode(missing, add_special_tokens=False)), strict=True))
                here = {x: table[x] if x in table else cache[x] for x in seen}
                whole = iter(encode([x for x, pre in zip(some, split, strict=True) if pre is None], add_special_tokens=False))
                yield pa.RecordBatch.from_pydict(
                    {
                        id: batch.column(0).slice(at, len(some)),
                        "n_bytes": pa.array([len(x.encode()) for x in some], pa.int64()),
                        "n_tokens": pa.array([len(next(whole)) if pre is None else sum(map(here.__getitem__, pre)) for pre in split], pa.int64()),
                    }
                )

    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > over)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
