"""From raw documents to token ids: five stages over the whole table.

Each stage takes all rows that the one before kept; run() writes what a stage returns to
the shared folder and hands the written table on.

In every stage rows without an id, rows that share one and repeated rows are documents of
their own, null and blank texts are texts without words, texts of any length are taken
whole, an empty table gives no rows, and columns beyond those of documents are not passed
on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm import byte_bpe, mixture, simhash_dedup, substring_dedup, toxicity
from spillway.llm.common import store, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mixture is larger than its input: light kinds are repeated, few documents of heavy ones left out.
SHARE_PERCENT = 140
WEIGHTS = {
    "domains": {"d0": 45, "d1": 20, "d2": 18, "d3": 17},
    "langs": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "sources": {"src0": 100},
}


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; null and blank texts have no hits and stay.

    Labels count by id, so rows that share a labelled id are learned from once.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, carry=COLUMNS[1:])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, nulls last, then the smallest hash of the text.

    Groups are told apart by fingerprint, so documents without an id, or that share one,
    each stay for their own group.
    """
    return simhash_dedup.representatives(docs, carry=COLUMNS[2:]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has; a text that is nothing else goes.

    A row without an id loses what any numbered document has; texts without words stay.
    """
    found = substring_dedup.dedup_substrings(docs, carry=COLUMNS[2:])
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text")).alias("n_chars")
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, once for each pass that takes them; null languages and sources are kinds of their own."""
    return mixture.mix(docs, share=SHARE_PERCENT, **WEIGHTS).select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the hash of the bytes they decode to; none for null and empty texts."""
    return byte_bpe.encode(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixture", mixed),
    ("byte_bpe", encoded),
]

#: Scores and fingerprints are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
