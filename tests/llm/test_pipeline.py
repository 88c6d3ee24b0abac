"""The pipeline's stages against plain versions of their decisions."""

import base64
import collections
import hashlib
import random
import re

import corpus_pipeline as cp
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from spillway.llm import common, mixture, toxicity

from test_operators import WORD, plain_components, plain_dedup, plain_fingerprint, plain_mix, plain_toxicity


def test_stages_keep_what_they_should(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.score >= toxicity.THRESHOLD}
    clean = common.store(cp.toxic(spark, docs, sf))
    left = {r.doc_id: r.text for r in clean.collect()}
    assert left == {i: t for i, t in texts.items() if i not in bad}
    assert tuple(clean.columns) == cp.COLUMNS

    single = common.store(cp.near_duplicates(spark, clean, sf))
    fps = [(i, plain_fingerprint(t)) for i, t in sorted(left.items())]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(plain_components(fps, 4)))

    cut = common.store(cp.repeated_passages(spark, single, sf))
    rows = [(r.doc_id, r.text) for r in single.collect()]
    expected = {i: kept for i, n, gone, kept in plain_dedup(rows, 50) if gone == 0 or gone < n}
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: " ".join(re.findall("[^\x20\x09-\x0d]+", r.text)) for i, r in got.items()} == expected
    assert all(r.n_chars == len(r.text) for r in got.values())

    mix = common.store(cp.mixed(spark, cut, sf))
    times = collections.Counter(r.doc_id for r in mix.collect())
    assert set(times) <= set(got) and max(times.values()) <= mixture.EPOCHS
    assert len(times) > 0.85 * len(got)

    ids = cp.encoded(spark, mix, sf)
    assert ids.count() == mix.count()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixture", "byte_bpe"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, score string, fp string, n_tokens string, carry int"


@pytest.fixture(scope="module")
def odd(spark):
    """Real documents beside null, shared and repeated ids, null, blank, long and repeated texts, and columns named as those inside the stages."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").limit(120).collect()
    rows = [tuple(r) for r in base]
    passage = " ".join(f"w{i}" for i in range(70))
    rows += [(None, rows[0][1], "en", "src0"), (None, "no id one two three", None, None), (None, "no id one two three", None, None), (None, None, None, "src1"), (7_000, None, "en", None), (7_001, "", "de", "src0"), (7_001, " \n", "de", "src0")]
    rows += [(7_002, "same id first text", "en", "src0"), (7_002, "same id second text here", "en", "src0"), (7_003, "long " * 30_000, "fr", "src2"), (7_004, passage + " tail", "en", "src1"), (7_005, "head " + passage, "en", "src1"), (7_006, passage, "es", "x")]
    rows += [rows[-1], (7_007, "\u0130stanbul \U00020000 \U0001f600 it's", "tr", "src3")]
    full = [(i, t, a, b, None if t is None else len(t), "x", "y", "z", "n", 1) for i, t, a, b in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def rows_of(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_toxic_stage_with_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (3, None), (7_002, 0)], "doc_id long, toxic int")
    bad = F.concat(F.col("text"), F.lit(" wretched villain"))
    docs = odd.withColumn("text", F.when((F.col("doc_id") < 120) & (F.col("doc_id") % 4 == 0), bad).otherwise(F.col("text")))
    folder = common.shared_dir(spark) + "/labels-of-a-test"
    labels.write.mode("overwrite").parquet(folder + "/labels.parquet")
    model = toxicity.train(docs, labels)
    assert model.fit is not None
    got = cp.toxic(spark, docs, folder)
    assert tuple(got.columns) == cp.COLUMNS
    expected = [r for r in rows_of(docs) if plain_toxicity(model, r[1] or "") < toxicity.THRESHOLD]
    assert collections.Counter(rows_of(got)) == collections.Counter(expected) and 0 < len(expected) < docs.count()
    assert cp.toxic(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates_stage_with_odd_rows(spark, odd):
    rows = rows_of(odd)
    fps = [plain_fingerprint(r[1]) for r in rows]
    group = plain_components(list(zip(range(len(rows)), fps)), 4)
    least = {}
    for g, r in zip(group, rows):
        key = (r[0] is None, r[0] or 0)
        least[g] = min(least.get(g, key), key)
    got = rows_of(cp.near_duplicates(spark, odd, ""))
    assert len(got) == len(set(group)) and set(got) <= set(rows)
    of = {r: g for g, r in zip(group, rows)}
    assert {of[r] for r in got} == set(group) and all((r[0] is None, r[0] or 0) == least[of[r]] for r in got)
    assert cp.near_duplicates(spark, odd.limit(0), "").count() == 0


def test_repeated_passages_stage_with_odd_rows(spark, odd):
    rows = rows_of(odd)
    found = plain_dedup([r[:2] for r in rows], 50)
    expected = collections.Counter((i, kept, *r[2:4]) for (i, n, gone, kept), r in zip(found, rows) if gone == 0 or gone < n)
    got = rows_of(cp.repeated_passages(spark, odd, ""))
    assert collections.Counter((i, " ".join(WORD.findall(t or "")), a, b) for i, t, a, b, _ in got) == expected
    assert all(n == (None if t is None else len(t)) for _, t, _, _, n in got)
    assert cp.repeated_passages(spark, odd.limit(0), "").count() == 0


@pytest.mark.parametrize("half", [False, True])
def test_mixed_stage_with_odd_rows(spark, odd, half):
    if half:  # half of the ids are missing
        odd = odd.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    got = collections.Counter((i, b or "?", a or "?") for i, _, a, b, _ in rows_of(cp.mixed(spark, odd, "")))
    plain = plain_mix([r[:4] for r in rows_of(odd)], cp.SHARE_PERCENT, mixture.EPOCHS, mixture.SEED, **cp.WEIGHTS)
    expected = collections.Counter()
    for (i, src, lang, _), n in plain.items():
        expected[i, src, lang] += n
    assert got == +expected
    assert cp.mixed(spark, odd.limit(0), "").count() == 0


def test_encoded_stage_with_odd_rows(spark, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in cp.encoded(spark, odd, "").collect())
    expected = collections.Counter()
    for i, t, *_ in rows_of(odd):
        ids = enc.encode_ordinary(t or "")
        expected[i, len(ids), tuple(ids), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == expected
    assert cp.encoded(spark, odd.limit(0), "").count() == 0


def test_run_on_the_smallest_tables(spark, sf_dir):
    assert cp.run(spark, sf_dir).where("n_tokens > 0").count() > 100


def test_near_duplicates_with_missing_and_shared_ids(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 999)) for _ in range(60)) for _ in range(6)]
    rows = [
        (None, texts[0], "en", "src0"), (None, texts[1], "en", "src0"), (None, texts[2], "en", "src0"), (1, texts[2], "en", "src0"), (2, texts[2], "de", "src0"),
        (3, texts[3], "en", "src0"), (3, texts[4], "en", "src0"), (3, texts[5], "en", None), (3, texts[5], None, "en"), (None, texts[5], "fr", "src0"), (None, texts[0], "en", "src0"),
    ]
    docs = spark.createDataFrame([(i, t, lang, src, len(t)) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = common.store(cp.near_duplicates(spark, docs, "")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(zip((None, None, 1, 3, 3, 3), texts))
    assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}
    again = cp.near_duplicates(spark, docs.orderBy(F.desc("lang")).repartition(3), "").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
