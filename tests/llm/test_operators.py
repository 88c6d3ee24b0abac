"""Each operator against a plain version of itself, with odd rows: nulls, empty and long texts, copies, clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash

from spillway.llm import (
    byte_bpe,
    common,
    components,
    fingerprint,
    language,
    mixture,
    quality_model,
    quality_rules,
    queries,
    simhash_dedup,
    substring_dedup,
    token_count,
    toxicity,
)

WORD = re.compile("[^\x20\x09-\x0d]+")
ALPHABET = "abcdeABC  \n\t'éß́中İΣ \x85\x1c12²Ⅷ!?#\U0001f600ẞs 　×ā|"


def odd_texts(n, seed=1, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def documents(spark, rows):
    """Rows (doc_id, text); lang, source and a column named like a result."""
    full = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 5}" if (i or 0) % 4 else None, "clash", 7) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_tokens string, score int")


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


ODD = [(None, "a b c d e"), (None, None), (5, None), (6, ""), (7, " \n\t"), (8, "one"), (8, "one"), (9, "x " * 3000), (10, "!" * 500)]


def test_hashes_match_the_library():
    texts = [x.encode() for x in odd_texts(300)] + [b"", b"q" * 5000]
    ends = np.cumsum([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = common.hash_spans(data, ends - [len(x) for x in texts], ends, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(x, 42) for x in texts]


def test_letters_are_those_of_the_string_methods():
    texts = odd_texts(300, seed=8) + ["", "a", "\U00020000b \U00010400\U00010428", "\U0001f600", "x\U0001d4d0y"]
    w = common.Letters(pa.array(texts, pa.large_string()))
    got = [[w.word(k) for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    lower = lambda x: x.lower() if len(x.lower()) == 1 else x
    assert got == [[x for x in "".join(lower(c) if c.isalpha() else "\0" for c in t).split("\0") if x] for t in texts]


def test_learning_rows_are_bounded_and_the_same_each_time(spark):
    rows = [(i % 7, f"text {i}") for i in range(200)] + [(9, "y" * (common.LEARNED_BYTES + 1)), (None, "none")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    found = common.labelled(documents(spark, rows), labels, "toxic", 4, 2, 4)
    got = found.collect()
    assert len(got) == len({r.id for r in got}) <= 4
    all_ = {r.id: (r.label, r.text) for r in common.labelled(documents(spark, rows).repartition(5), labels, "toxic", 4, 2, 100).collect()}
    assert {r.id: (r.label, r.text) for r in got}.items() <= all_.items()
    assert 9 not in all_ and None not in all_ and all_.get(3, (1,))[0] == 1
    held = spark.createDataFrame([(None,), (1,)], "doc_id long").select(common.held_out("doc_id", 1, 0).alias("h")).collect()
    assert [r.h for r in held] == [False, True]


def test_words_are_those_of_the_pattern():
    texts = odd_texts(400) + ["", " ", "a"]
    w = common.Words(pa.array(texts, pa.large_string()))
    got = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(x) for x in texts]


def test_token_counts(spark, real):
    from tokenizers import Tokenizer

    rows = [*real[:60], *ODD, *((100_000 + i, t) for i, t in enumerate([*odd_texts(300), "<|endoftext|> a <|STARTOFTEXT|>", "it's we'll 12 don't"]))]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = collections.Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    got = token_count.count_tokens(documents(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == expected
    assert token_count.count_tokens(documents(spark, [])).collect() == []
    assert simhash_dedup.near_duplicates(documents(spark, [])).collect() == []


def test_a_text_longer_than_any_run(spark):
    """Above 2 MB a text is a run of its own, in each operator that reads runs."""
    from tokenizers import Tokenizer

    word = " ".join(f"w{i % 977} ord{i % 31}, and" for i in range(140_000))
    assert len(word) > common.BLOCK_BYTES
    docs = documents(spark, [(1, "a b c d e f"), (2, word), (3, None), (4, word[:100])])
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs).collect()}
    assert got[2] == len(tok.encode(word, add_special_tokens=False).ids) and got[3] == 0
    fps = {r.doc_id: r.fp for r in simhash_dedup.fingerprints(docs).collect()}
    assert fps[2] % (1 << 64) == plain_fingerprint(word)
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert kept[2] == (len(WORD.findall(word)), 0)
    counts = {r.id: r.n_words for r in quality_rules.counts(docs).collect()}
    assert counts[2] == len(WORD.findall(word))


def test_byte_bpe_is_the_library_and_round_trips(spark, real):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*real[:60], *ODD, *((100_000 + i, t) for i, t in enumerate([*odd_texts(300), "ab" * 400, "aaaa " * 5, "Ab3" * 200]))]
    got = byte_bpe.encode(documents(spark, rows)).collect()
    expected = collections.Counter((i, tuple(enc.encode_ordinary(t or "")), t or "") for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded).decode()) for r in got) == expected
    digest = byte_bpe.encode(documents(spark, rows), digest=True).collect()
    packed = collections.Counter((i, hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (i, x, t), n in expected.items() for _ in range(n))
    assert collections.Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in digest) == packed


def test_replay_equals_merging_each_word_alone(real, monkeypatch):
    v = byte_bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken"))
    words = [x.encode() for x in odd_texts(500, seed=3, longest=30) + [w for _, t in real[:100] for w in t.split()] if x]
    words += [b"a" * n for n in range(1, 40)] + [b"ab" * 31 + b"a", b"\x00", b"\xff\xfe\x00\xff", b" " * 17]
    packed = [np.array(byte_bpe.alone(v, w), "<u4").tobytes() for w in words]
    assert byte_bpe.replay(v, words) == packed
    assert byte_bpe.replay(v, []) == []
    # texts above BLOCK, replays in the middle of a text, words forgotten between blocks
    texts = [" ".join(w.decode("latin-1") for w in words)] * 2 + ["", "one"]
    plain = [[x for w in byte_bpe.split_words(t) for x in byte_bpe.alone(v, w.encode())] for t in texts]
    for name, value in (("BLOCK", 50), ("NEW", 7), ("KNOWN", 5)):
        monkeypatch.setattr(byte_bpe, name, value)
    e = byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"))
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == plain


def plain_fingerprint(text, size=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, distance):
    """Smallest id reachable, for (id, fingerprint) pairs."""
    group = list(range(len(values)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a][1] ^ values[b][1]).bit_count() <= distance:
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(values):
        r = find(k)
        least[r] = min(least.get(r, i), i) if i is not None and least.get(r) is not None else (least.get(r) if i is None else i)
    return [least[find(k)] for k in range(len(values))]


def test_simhash_dedup(spark, real):
    rng = random.Random(4)
    rows = [*real[:80], *ODD]
    for k in range(40):  # near copies in chains
        words = rows[k % 20][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((50_000 + k, " ".join(words)))
    fps = [plain_fingerprint(t) for _, t in rows]
    expected = collections.Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([(i, f) for (i, _), f in zip(rows, fps)], 4)))
    got = simhash_dedup.near_duplicates(documents(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == expected


@pytest.mark.parametrize("segments", [simhash_dedup.FEW_SEGMENTS, simhash_dedup.MANY_SEGMENTS])
def test_simhash_links_find_every_pair(spark, segments):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = {tuple(sorted(x & (1 << 64) - 1 for x in r)) for r in simhash_dedup.links(spark.createDataFrame(signed, "fp long"), segments=segments).collect()}
    assert got == {(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 4}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 3)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST", 5)
    rng = random.Random(14)
    edges = [(1000, i) for i in range(300)] + [(2000, 2001 + i) for i in range(300)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(220)] + [(None, 1), (7, 7)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(400):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def plain_dedup(rows, window):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            least = first.get(tuple(w[s : s + window]))
            if least is not None and (i is None or least < i):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [50, 8, 3, 1])
def test_substring_dedup(spark, real, window):
    rng = random.Random(window)
    rows = [*real[:80], *ODD, (11, "x " * 200), (12, "y " * 60 + "x " * 70), (None, real[3][1])]
    for k in range(60):  # passages placed elsewhere, runs and periods among them
        a = real[rng.randrange(80)][1].split()
        s = rng.randrange(max(1, len(a) - 5))
        piece = a[s : s + rng.choice([window - 1, window, window + 1, 3 * window])]
        rows.append((rng.randrange(60_000), " ".join(odd_texts(3, k)[0].split() + piece + ["p", "q"] * rng.randint(0, 40) + piece[:3])))
    found = substring_dedup.dedup_substrings(documents(spark, rows), window=window, carry=("lang", "score")).collect()
    # an untouched text stays as it is, white space included
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.kept_text or ""))) for r in found)
    assert got == collections.Counter(plain_dedup(rows, window))
    assert {r.score for r in found} == {7}


def test_windows_that_share_a_first_hash_are_told_apart():
    h, g, d, new = substring_dedup._sorted(np.array([5, 5, 9, 5], np.uint64), np.array([2, 1, 7, 2], np.uint64), np.array([30, 20, 40, 10]))
    assert h[new].tolist() == [5, 5, 9] and g[new].tolist() == [1, 2, 7] and d[new].tolist() == [20, 10, 40]
    x, y = np.array([5, 5, 5, 9, 8], np.uint64), np.array([2, 1, 3, 7, 7], np.uint64)
    last = substring_dedup.LAST
    assert substring_dedup._find(h[new], g[new], d[new], x, y).tolist() == [10, 20, last, 40, last]


def test_equal_windows_have_equal_symbols_inside():
    rng = np.random.default_rng(4)
    rounds, margin = substring_dedup.rounds_for(50), substring_dedup.margin_of(substring_dedup.rounds_for(50))
    for k in range(60):
        window = rng.integers(0, 4 if k % 2 else 40, 50)
        window[10:30] = window[10] if k % 3 == 0 else window[10:30]
        cuts = []
        for _ in range(2):
            words = np.concatenate([rng.integers(0, 4, rng.integers(0, 30)), window, rng.integers(0, 4, 20)])
            at = len(words) - 70
            name, width = substring_dedup.symbols(common.mixed(words.astype(np.uint64)), np.zeros(len(words), int), rounds)
            starts = np.cumsum(width) - width - at
            inner = (starts >= margin) & (starts + width <= 50 - margin)
            cuts.append(list(zip(starts[inner].tolist(), name[inner].tolist())))
        assert cuts[0] == cuts[1] and cuts[0]


def test_substring_dedup_of_no_rows(spark):
    assert substring_dedup.dedup_substrings(documents(spark, []), carry=("lang",)).count() == 0


def test_mixture_budgets(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 1000), ("d0", "de", "c", 50), ("d1", "en", "d", 400), ("d1", "fr", "e", 5)]
    rows = spark.createDataFrame([(*x, 2 * x[3]) for x in leaves], "domain string, language string, origin string, tokens long, capacity long")
    from pyspark.sql import functions as F

    got = {r.origin: r.given for r in mixture.budgets(rows, F.lit(1000).cast("long"), {"d0": 3, "d1": 1}, {"en": 1, "de": 1}, {"a": 1, "b": 1}).collect()}
    # d0 750, d1 250; de can take 100 and leaves 650 to en; fr can take 10 and leaves 240
    assert got == {"a": 200, "b": 450, "c": 100, "d": 240, "e": 10}


def test_mixture_takes_whole_passes_then_a_prefix(spark):
    rows = [(i, "w " * (i % 7)) for i in range(200)] + [(3, "again and again"), (None, "no id here"), (None, None)]
    docs = documents(spark, rows)
    got = mixture.mix(docs, share=100).collect()
    assert {r.row.score for r in got} == {7}
    plan = collections.defaultdict(int)
    for r in got:
        plan[r.domain, r.language, r.origin, r.epoch] += r.n_tokens
    total = collections.Counter()
    for i, t in rows:
        lang = "en" if (i or 0) % 3 else "?"
        source = f"src{(i or 0) % 5}" if (i or 0) % 4 else "?"
        total[lang, source] += len(WORD.findall(t or ""))
    for (_, lang, source, epoch), n in plan.items():
        assert n <= total[lang, source]
        if epoch:  # a later pass only after a whole one
            assert next(m for (_, a, b, e), m in plan.items() if (a, b, e) == (lang, source, epoch - 1)) == total[lang, source]
    assert mixture.mix(docs.limit(0)).count() == 0


def plain_divide(budget, children):
    """{child: given} from {child: (weight, capacity)}."""
    order = sorted((c for c in children if children[c][0] > 0), key=lambda c: (children[c][1] / children[c][0], c))
    given, left = {}, order[:]
    while left:
        total = sum(children[c][0] for c in left)
        weight, capacity = children[left[0]]
        if capacity * total > budget * weight:
            break
        given[left.pop(0)] = capacity
        budget -= capacity
    if left:
        for c in left:
            given[c] = budget * children[c][0] // total
        for c in left[: budget - sum(given[c] for c in left)]:
            given[c] += 1
    return given


def plain_unit(id, text, lang, source):
    parts = ("?" if id is None else str(id), hashlib.md5((text or "").encode()).hexdigest(), lang, source)
    return hashlib.md5("\x1f".join(parts).encode()).hexdigest()


def plain_mix(rows, share, epochs, seed, domains, langs, sources):
    """Counter of (id, origin, language, epoch) from rows (id, text, language, origin)."""
    w = lambda table, x: table.get(x, mixture.DEFAULT)
    leaves = collections.defaultdict(list)
    for i, t, lang, src in rows:
        lang, src = lang or "?", src or "?"
        number = re.search("([0-9]{1,9})$", src)
        leaves[f"d{int(number[1]) % 4}" if number else "?", lang, src].append((i, plain_unit(i, t, lang, src), len(WORD.findall(t or ""))))
    tokens = {k: sum(n for *_, n in v) for k, v in leaves.items()}
    some = {k: n * epochs for k, n in tokens.items() if w(sources, k[2]) and w(langs, k[1])}
    out, total = collections.Counter(), sum(tokens.values()) * share // 100
    top = plain_divide(total, {d: (w(domains, d), sum(n for k, n in some.items() if k[0] == d)) for d in {k[0] for k in some}})
    assert sum(top.values()) == min(total, sum(n for k, n in some.items() if k[0] in top))
    for d, b in top.items():
        kin = plain_divide(b, {x: (w(langs, x), sum(n for k, n in some.items() if k[:2] == (d, x))) for x in {k[1] for k in some if k[0] == d}})
        assert sum(kin.values()) == b
        for x, c in kin.items():
            for src, given in plain_divide(c, {k[2]: (w(sources, k[2]), n) for k, n in some.items() if k[:2] == (d, x)}).items():
                leaf = (d, x, src)
                for e in range(epochs):
                    part = min(given - e * tokens[leaf], tokens[leaf])
                    ahead = 0
                    for i, _, n in sorted(leaves[leaf], key=lambda r: hashlib.md5(f"{seed}:{e}:{r[1]}".encode()).hexdigest()):
                        if part > 0 and (part == tokens[leaf] or ahead < part):
                            out[i, src, x, e] += 1
                        ahead += n
    return out


@pytest.mark.parametrize("short", [512, 3])
def test_mixture_is_the_plain_version_with_zero_weights(spark, monkeypatch, short):
    monkeypatch.setattr(mixture, "SHORT", short)
    rng = random.Random(21)
    rows = [(rng.choice([None, *range(500)]), " ".join(["w"] * rng.choice([0, 1, 3, 17, 40])), rng.choice(["en", "en", "en", "de", "fr", None]), rng.choice(["src0", "src0", "src4", "src1", "src2", "web", None])) for _ in range(700)]
    rows += [(900, "long " * 5000, "fr", "src2"), (901, None, "en", "src0")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, epoch int")
    for share, weights in (
        (70, {}), (100, {"domains": {"d0": 1, "d2": 0}, "langs": {"de": 0, "en": 1}, "sources": {"src4": 0, "src0": 3}}), (180, {"domains": {"d0": 7}, "langs": {"de": 0}}), (40, {"langs": {"en": 0, "de": 0, "fr": 0, "?": 0}}),
    ):
        full = {"domains": mixture.DOMAIN_WEIGHTS, "langs": mixture.LANG_WEIGHTS, "sources": mixture.SOURCE_WEIGHTS} | weights
        got = collections.Counter((r.id, r.origin, r.language, r.epoch) for r in mixture.mix(docs, share=share, **weights).select("id", "origin", "language", "epoch").collect())
        assert got == plain_mix(rows, share, mixture.EPOCHS, mixture.SEED, **full)


@pytest.mark.parametrize("kind", ["texts", "equal", "mixed"])
def test_mixture_keeps_its_budget_with_null_and_shared_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(mixture, "SHORT", 50)
    monkeypatch.setattr("spillway.llm.components.LEAST", 100)
    for nulls, share in ((500, 30), (900, 30), (900, 130)):
        rows = [(None if i < nulls else i % 950, " ".join(f"w{0 if kind == 'equal' or kind == 'mixed' and i % 3 else i}" for _ in range(10)), "en", "src0", i % 4) for i in range(1000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra int").repartition(5)
        got = mixture.mix(docs, share=share).select("row.*", "n_tokens", "epoch").collect()
        assert abs(sum(r.n_tokens for r in got) - 100 * share) < 10
        # no row more than once in a pass
        times = collections.Counter((r.doc_id, r.text, r.extra, r.epoch) for r in got)
        have = collections.Counter((r[0], r[1], r[4]) for r in rows)
        assert all(n <= have[k[:3]] for k, n in times.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table().select(found.columns).to_pylist()
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(tuple(r.values()) for r in want)


def plain_simhash(text):
    w = re.split("[\x20\x09-\x0d]+", text.strip(" \t\n\x0b\f\r"))
    votes, total = [0] * 64, 0
    for k, a in enumerate(w):
        b = w[k + 1] if k + 1 < len(w) else None
        h = xxhash.xxh64_intdigest(a, 42)
        h = h if b is None else xxhash.xxh64_intdigest(b, h)
        weight = min(32, len(a) + len(b or ""))
        total += weight
        for j in range(64):
            votes[j] += weight * (h >> j & 1)
    return sum(1 << j for j in range(64) if 2 * votes[j] > total)


def test_fingerprints(spark, real):
    rows = sorted([*real[:70], (90_001, None), (90_002, ""), (90_003, " \n"), (90_004, "one"), (90_020, real[0][1]), (90_040, real[0][1] + " more")], reverse=True)
    fps = [plain_simhash(t or "") for _, t in rows]
    expected = {}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        e = plain_simhash(edited)
        near = sum((fps[k] ^ x).bit_count() <= 3 for x in fps) if i % 20 == 0 else None
        expected[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[k]:016x}", f"{e:016x}", 1 - (fps[k] ^ e).bit_count() / 64, 1 - (fps[k] ^ fps[(k + 1) % len(rows)]).bit_count() / 64, near)
    got = {r[0]: tuple(r[1:]) for r in fingerprint.fingerprint_report(documents(spark, rows)).collect()}
    assert got == expected


def test_fingerprints_of_shared_and_missing_ids(spark):
    got = fingerprint.fingerprint_report(documents(spark, [(1, "a b c"), (1, "a b c"), (1, "other text"), (None, "last")])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None"]
    assert fingerprint.fingerprint_report(documents(spark, [])).count() == 0
    alone = fingerprint.fingerprint_report(documents(spark, [(4, "only one here")])).first()
    assert alone.near_next == 1.0


def test_quality_model_learns(spark, sf_dir):
    rng = random.Random(6)
    good = [(i, " ".join(rng.choice(["the", "of", "house", "river", "tree", "and"]) for _ in range(rng.randint(20, 300)))) for i in range(200)]
    bad = [(i, " | ".join(rng.choice(["Home", "Login", "BUY", "$$$"]) for _ in range(rng.randint(20, 300)))) for i in range(200, 300)]
    docs = documents(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, labels)
    got = quality_model.score_quality(docs, model).collect()
    assert len(got) == len(good + bad + ODD) and all(0 <= r.score <= 1 for r in got)
    first = {r.doc_id: r.score for r in got}
    assert np.mean([(first[i] >= 0.3) == (i < 200) for i in range(20, 300)]) > 0.97
    texts = [t or "" for _, t in good[:20] + bad[:20] + ODD]
    plain = [plain_quality(model, t) for t in texts]
    assert np.allclose(model.forward(*quality_model.statistics(pa.array(texts, pa.large_string()), model.frequent)), plain, atol=1e-5)
    assert quality_model.score_quality(docs.limit(0), model).count() == 0
    none = quality_model.train(docs, labels.limit(0))
    assert {r.score for r in quality_model.score_quality(docs, none).collect()} == {0.5}


def test_quality_gradients_are_the_differences_of_the_loss():
    rng = np.random.default_rng(2)
    first, y = np.array([0, 1, 4, 6, 11]), np.array([1.0, 0.0, 0.0, 1.0])
    x = rng.normal(0, 1, (11, 7))
    p = {k: np.array(w + rng.normal(0, 0.1, w.shape)) for k, w in quality_model.start(7).items()}

    def loss():
        s = quality_model._network(p, x, first)[0]
        return np.mean(np.log1p(np.exp(s)) - y * s)

    for k, grad in quality_model.gradients(p, x, first, y).items():
        w = p[k].reshape(-1)
        for i in range(min(w.size, 12)):
            kept = w[i]
            w[i] = kept + 1e-6
            up = loss()
            w[i] = kept - 1e-6
            down = loss()
            w[i] = kept
            assert abs((up - down) / 2e-6 - np.asarray(grad).reshape(-1)[i]) < 1e-7


def plain_quality(m, text):
    """The network's score, passage by passage."""
    t = pa.array([text or ""], pa.large_string())
    x, _ = quality_model.statistics(t, m.frequent)
    words = (text or "").encode().split() if text and text.strip() else []
    n = max(1, (len(words) + quality_model.PASSAGE // 2) // quality_model.PASSAGE)
    assert len(x) == n
    parts, weights, p = [], [], m.parts
    for k in range(n):
        mine = words[k * quality_model.PASSAGE : (k + 1) * quality_model.PASSAGE if k + 1 < n else None]
        sums = np.zeros(quality_model.GRAMS)
        h = [xxhash.xxh64_intdigest(w) for w in mine]
        mix = lambda v: int(common.mixed(np.array([v & (1 << 64) - 1], np.uint64))[0])
        for key in [mix(v) for v in h] + [mix(a * 31 + mix(b)) for a, b in zip(h, h[1:])]:
            sums[key % quality_model.GRAMS] += 1 if key >> 63 else -1
        assert np.allclose(x[k, quality_model.SHAPE :], sums / max(1, len(mine)) ** 0.5)
        z = np.clip((x[k] - m.mean) / m.scale, -8, 8)
        h = np.tanh(z @ p["enc"] + p["enc0"])
        e = (np.tanh(h @ p["att"] + p["att0"]) / (1 + np.exp(-(h @ p["gate"] + p["gate0"])))) @ p["pool"]
        parts.append(h)
        weights.append(np.exp(e))
    bag = sum(w * h for w, h in zip(weights, parts)) / sum(weights)
    return 1 / (1 + np.exp(-(bag @ p["out"] + p["out0"])))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = quality_model.op6_quality_model(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.95
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    x = language.op7_language(spark, sf).join(docs, "doc_id").where("held_out").toPandas()
    assert (x.lang == x.lang_pred).mean() > 0.97
    t = toxicity.op10_toxicity(spark, sf).join(labels, "doc_id").toPandas()
    assert ((t.predicted == 1) & (t.toxic == 0)).sum() <= 2
    assert ((t.predicted == 1) & (t.toxic == 1)).sum() >= 0.5 * t.toxic.sum()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 5, 127, 128, 129, 400):
        s, free = rng.normal(0, 3, (n, 4)), rng.random(n) < 0.05
        free[0] = True
        best = s[0].copy()
        for t in range(1, n):
            best = np.maximum(best, best.max() - (0 if free[t] else 2.0)) + s[t]
        p = language.viterbi(s, free, 2.0)
        cost = sum(0 if free[t] else 2.0 for t in range(1, n) if p[t] != p[t - 1])
        assert abs(s[np.arange(n), p].sum() - cost - best.max()) < 1e-9


def test_language_odd_rows_and_spans(spark):
    rng = random.Random(7)
    lang = {"en": ["the", "house", "with", "water"], "de": ["der", "haus", "mit", "wasser", "über"], "ru": ["дом", "вода", "река"]}
    make = lambda x, n: " ".join(rng.choice(lang[x]) for _ in range(n))
    rows = [(i, make(x := ("en", "de", "ru")[i % 3], 40), x) for i in range(120)]
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "", "en"), (902, "123 !!", "en"), (None, "the house", None), (903, "漢字", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert all(got[i][0] == x for i, _, x in rows)
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[None][0] == "en" and len(got) == 125
    both = spark.createDataFrame([(1, make("en", 30) + " " + make("ru", 30))], "doc_id long, text string")
    assert [r.lang for r in language.spans(both, model).orderBy("begin").collect()] == ["en", "ru"]
    far = spark.createDataFrame([(1, "\U00020000\U00020001"), (2, "\U00010400\U00010428 12"), (3, "\U0001f600")], "doc_id long, text string")
    astral = {r.doc_id: r.lang_pred for r in language.identify(far, model).collect()}
    assert astral[1] != "und" and astral[2] != "und" and astral[3] == "und"
    assert language.identify(docs.limit(0), model).count() == 0
    empty = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def plain_language(m, text):
    """The model's language and score of one text: counts of n-grams word by word, then the best path."""
    mask = (1 << 64) - 1
    mix = lambda v: int(common.mixed(np.array([v & mask], np.uint64))[0])
    lower = lambda c: c.lower() if len(c.lower()) == 1 else c
    words = [x for x in "".join(lower(c) if c.isalpha() else "\0" for c in text or "").split("\0") if x]
    if not words:
        return "und", 0.0
    scores = []
    for w in words:
        points = [32, *map(ord, w), 32]
        features = []
        for k, n in enumerate(language.GRAMS):
            for i in range(len(points) - n + 1):
                h = n
                for c in points[i : i + n]:
                    h = mix(h * 31 + c)
                features.append(h % language.BUCKETS + k * language.BUCKETS)
        features.append(xxhash.xxh64_intdigest(w.encode("utf-32-le")) % language.BUCKETS + len(language.GRAMS) * language.BUCKETS)
        script = next((language.SCRIPT_NAMES.index(n) for n, a, b in language.SCRIPTS if a <= ord(w[0]) <= b), 0)
        scores.append(sum(m.weight[f] for f in features) / len(features) ** 0.5 + m.allowed[script])
    best, back = scores[0], []
    for x in scores[1:]:
        other = best.max() - language.SWITCH
        back.append([k if best[k] >= other else int(best.argmax()) for k in range(len(best))])
        best = np.maximum(best, other) + x
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    letters = np.zeros(len(m.languages))
    for w, k in zip(words, reversed(path)):
        letters[k] += len(w)
    return m.languages[int(letters.argmax())], letters.max() / letters.sum()


def test_languages_are_those_of_a_plain_search(spark, real):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    texts = [t for _, t in real[:50]] + [t or "" for _, t in ODD] + odd_texts(60, seed=5) + ["\U00020000 haus", " ".join(t for _, t in real[:6])]
    got, score = language.predict(model, pa.array(texts, pa.large_string()))
    names = [*model.languages, "und"]
    for t, k, p in zip(texts, got.tolist(), score.tolist()):
        name, share = plain_language(model, t)
        assert names[k] == name and abs(p - share) < 1e-9


def plain_counts(t):
    w = WORD.findall(t or "")
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] >= 2 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_counts_and_outliers(spark, real):
    rows = [*real, *ODD, *((70_000 + i, t) for i, t in enumerate(odd_texts(200) + ["\na\na", "a\n\na\n", "a b c d e a b c d e"]))]
    got = quality_rules.judge(documents(spark, rows)).collect()
    assert collections.Counter((r.doc_id, *(r[c] for c in quality_rules.COUNTS)) for r in got) == collections.Counter((i, *plain_counts(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judge(documents(spark, [])).count() == 0
    assert abs(quality_rules.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3


def test_outliers_are_rejected_and_clean_documents_kept(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    clean = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 400)))) for i in range(600)]
    junk = [(1000 + i, " ".join(rng.choice(words) + "%%%" for _ in range(100))) for i in range(60)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, clean + junk)).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


def test_a_third_of_junk_in_a_hot_source_is_rejected(spark):
    rng = random.Random(18)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    clean = [(4 * i + 1, " ".join(rng.choice(words) for _ in range(rng.randint(30, 400)))) for i in range(400)]
    junk = [(4 * (1000 + i) + 1, " ".join(rng.choice(words) + "%%%" for _ in range(rng.randint(60, 160)))) for i in range(215)]
    docs = spark.createDataFrame([(i, t, "en", "hot") for i, t in clean + junk], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in junk)
    assert {r.judged_by for r in got.values()} == {"source"}


def plain_mcd(x, trials=300):
    """Least determinant over many random starts, exact quantiles, then the reweighted estimate."""
    q = quality_rules
    rng = np.random.default_rng(3)

    def part(rows, share):
        cov = np.cov(rows.T, bias=True)
        return rows.mean(0), np.linalg.inv(cov * q.consistency(share)), np.linalg.slogdet(cov)[1]

    def away(p):
        return np.einsum("ni,ij,nj->n", x - p[0], p[1], x - p[0])

    best = None
    for _ in range(trials):
        now = part(x[rng.choice(len(x), 8, replace=False)], q.SUBSET)
        for _ in range(12):
            d = away(now)
            now = part(x[d <= np.sort(d)[math.ceil(q.SUBSET * len(x)) - 1]], q.SUBSET)
        if best is None or now[2] < best[2]:
            best = now
    final = part(x[away(best) <= q.chi_square_quantile(q.NEAR, q.SIZE)], q.NEAR)
    return away(final), best[2]


def test_verdicts_are_those_of_a_plain_determinant_search(spark):
    rng = np.random.default_rng(12)
    groups = {}
    m = quality_rules.SIZE
    for k, junk in (("a", 0), ("b", 60), ("c", 110)):
        mix = rng.normal(0, 1, (m, m)) * 0.4 + np.eye(m)
        x = rng.normal(0, 1, (300, m)) @ mix
        x[:junk] = rng.normal(0, 0.7, (junk, m)) + rng.normal(0, 1, m) * 30
        groups[k] = x
    rows = [(k, i, *v.tolist()) for k, x in groups.items() for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, "kind string, key long, " + ", ".join(f"{c} double" for c in quality_rules.X))
    found = {r.kind: r for r in quality_rules.estimates(data).collect()}
    for k, x in groups.items():
        d, _ = plain_mcd(x)
        away = x - [found[k][c] for c in quality_rules.CENTRE]
        own = sum(found[k][f"p{i}{j}"] * away[:, i] * away[:, j] for i, j in quality_rules.PAIRS)
        clear = np.abs(d / quality_rules.LIMIT - 1) > 0.05
        assert ((own <= quality_rules.LIMIT) == (d <= quality_rules.LIMIT))[clear].all() and clear.mean() > 0.95
    assert quality_rules.estimates(data.limit(0)).count() == 0


def test_the_least_determinant_decides_and_no_floor(spark):
    """On the documents of a larger table: starts differ, the chosen one is strictly the least, and no estimate is lifted."""
    from pyspark.sql import functions as F

    q = quality_rules
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = q.counts(docs).withColumns(q._vector()).where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words")
    data = common.cut(rows.select(F.explode(F.array(F.concat(F.lit("l"), "language"), F.lit("c"))).alias("kind"), F.xxhash64("id").alias("key"), *q.X))
    seen = []
    wrapped, floored = q._concentrate, q.floored

    def watched(*args):
        out = wrapped(*args)
        seen.append(out.collect())
        return out

    q._concentrate = watched
    try:
        found = q.estimates(data).collect()
    finally:
        q._concentrate = wrapped
    table = {k: np.array([tuple(r) for r in data.where(F.col("kind") == k).select(*q.X).collect()]) for k in {r.kind for r in found}}
    scale = np.subtract(*np.percentile(table["c"], [75, 25], axis=0)) / 1.349
    for r in found:
        starts = sorted(x.det for x in seen[q.TRIALS - 1] if x.kind == r.kind)
        assert len(starts) == 3 + q.RANDOM and starts[0] < starts[-1] - 1e-3
        last = next(x.det for x in seen[-1] if x.kind == r.kind)
        assert last <= starts[0] + 1e-9
        inverse = np.zeros((q.SIZE, q.SIZE))
        for i, j in q.PAIRS:
            inverse[i, j] = inverse[j, i] = r[f"p{i}{j}"] / (1 if i == j else 2)
        cov = np.linalg.inv(inverse)
        assert np.linalg.eigvalsh(cov / np.outer(scale, scale))[0] > 2 * q.FLOOR**2
        assert np.allclose(floored(cov, scale), cov)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_accepts_what_the_edit_distance_does():
    rng = random.Random(9)
    words, stems = ["abcab", "aabbc", "abc", "cabbage", "éabcd", "ab"], ["bbca", "caca"]
    a = toxicity.build(words, stems)
    texts = ["".join(rng.choice("abcéz") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + words + stems
    w = common.Letters(pa.array(texts, pa.large_string()))
    term, errors = a.run(w.points, w.start, w.end)
    for x, t, e in zip(texts, term.tolist(), errors.tolist()):
        fits = [(d, k) for k, y in enumerate(words) if (d := edits(x, y)) == 0 or d == 1 and len(y) >= 5]
        fits += [(0, len(words) + k) for k, y in enumerate(stems) if x.startswith(y)]
        assert min(fits, default=(9, -1)) == (e, t)


def test_toxicity_spelling_and_quotation(spark):
    rng = random.Random(10)
    plain = ["river", "mountain", "window", "garden", "letter", "the", "of", "and"]
    make = lambda n: [rng.choice(plain) for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        words = make(40)
        if i % 4 == 0:
            words[10] = words[20] = rng.choice(["villain", "scoundrel"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    extra = [(1000, " ".join([*make(10), "scoundrl", *make(10), "villaim", *make(5)])), (1001, " ".join(make(30))), (1002, 'she said "you villain" and left ' + " ".join(make(20))), (1003, None), (None, "")]
    docs = documents(spark, rows + extra)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(400))
    assert got[1000] >= 0.3 and got[1001] < 0.3 and got[1002] < 0.3 and got[1003] < 0.3 and got[None] < 0.3
    found = toxicity.spans(docs.where("doc_id in (1000, 1002)"), model).orderBy("doc_id", "begin").collect()
    assert [(r.doc_id, r.errors, r.quoted) for r in found] == [(1000, 1, False), (1000, 1, False), (1002, 0, True)]
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    few = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(4) if i != 2], "doc_id long, quality int, toxic int")
    assert len({round(r.score, 9) for r in toxicity.score_toxicity(docs, toxicity.train(docs, few)).collect()}) == 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0 and toxicity.spans(docs.limit(0), model).count() == 0
    # every score from whole passes over words, hits and sums written plainly
    texts = [t or "" for _, t in rows[::37] + extra]
    got = toxicity.scores(model, pa.array(texts, pa.large_string()))
    assert np.allclose(got, [plain_toxicity(model, t) for t in texts])


def plain_toxicity(m, text):
    """The model's score of one text, word by word."""
    a, words, start = m.automaton, [], 0
    for x in re.finditer("[^\\W\\d_]+", text):
        words.append((x.start(), x.end(), x.group().lower()))
    h = [xxhash.xxh64_intdigest(w.encode("utf-32-le")) for *_, w in words]
    marks = [i for i, c in enumerate(text) if c in toxicity.QUOTES and not (0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha())]
    sums, tops, seen = np.zeros(4), [0.0], set()
    found = []
    for k, (begin, end, w) in enumerate(words):
        state = 1
        for c in w:
            state = a.step[state, a.classes.get(c, 0)]
        term, errors = a.term[state], a.errors[state]
        if state == 0 or term < 0 or errors and h[k] in set(m.known.tolist()):
            continue
        before = [x for x in marks if x < begin]
        behind = [x for x in marks if x >= begin]
        open_ = bool(len(before) % 2 and behind and begin - before[-1] <= toxicity.QUOTE and behind[0] - end <= toxicity.QUOTE)
        near = [(h[j], abs(j - k)) for j in range(max(0, k - toxicity.NEAR), min(len(words), k + toxicity.NEAR + 1)) if j != k]
        reported = min(1.0, sum(1 / d for x, d in near if x in set(m.reporting.tolist())))
        cues = np.array([1.0, open_, reported, np.tanh(sum(m.context[x % toxicity.CONTEXT] / d for x, d in near) / 4)])
        found.append((term, errors, cues, 1 / (1 + np.exp(-cues @ m.cues))))
    for term, errors, cues, abuse in sorted(found, key=lambda x: (x[0], x[1])):
        weight = m.weights[term] * (toxicity.MISSPELLED if errors else 1)
        sums += [weight * abuse * (0.3 if term in seen else 1), weight * (abuse < 0.5), cues[3] * abuse, abuse]
        tops.append(weight * abuse)
        seen.add(term)
    n = len(words)
    x = np.array([np.log1p(sums[0]), np.log1p(sums[1]), max(tops), sums[2] / max(sums[3], 1.0), np.log1p(sums[3]), sums[3] / np.sqrt(n + 10), np.log1p(n)])
    mean, scale, w = m.fit
    return 1 / (1 + np.exp(-((x - mean) / scale @ w[:-1] + w[-1])))


def test_toxicity_learns_what_a_quotation_looks_like(spark):
    rng = random.Random(15)
    make = lambda n: [rng.choice(["river", "mountain", "window", "garden", "letter", "the", "of", "and"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        words = make(40)
        if i % 5 == 0:
            words[10] = rng.choice(["villain", "scoundrel"])
        elif i % 20 == 1:  # clean: the neighbours, none of them a reporting verb, tell of a quotation
            words[9:12] = ["dictionary", rng.choice(["villain", "scoundrel"]), "etymology"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    extra = [(2000, " ".join([*make(12), "dictionary", "villain", "etymology", *make(12)])), (2001, " ".join([*make(12), "villain", *make(12)]))]
    docs = documents(spark, rows + extra)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.quoted for r in toxicity.spans(docs.where("doc_id >= 2000"), model).collect()} == {2000: True, 2001: False}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert got[2000] < 0.3 <= got[2001]


def test_toxicity_misspelled_forms_of_a_stem(spark):
    toxic = collections.Counter({"idiot": 8, "idiots": 8, "idiotic": 8, "idio*": 24, "idiot*": 16, "idioti*": 8})
    words, stems, weights, forms = toxicity.choose_terms(toxic, collections.Counter(), 30, 300)
    assert (words, stems) == ([], ["idio"]) and forms == dict.fromkeys(["idiot", "idiots", "idiotic"], "idio")
    texts = ["idiot", "idiots", "idiotisch", "ediot", "idjot", "idoitic", "idotic", "adio", "idea"]
    w = common.Letters(pa.array(texts, pa.large_string()))
    term, errors = toxicity.build(words, stems, forms=forms).run(w.points, w.start, w.end)
    assert term.tolist() == [0, 0, 0, 0, 0, -1, 0, -1, -1] and errors[:5].tolist() == [0, 0, 0, 1, 1]


def test_toxicity_stem_that_goes_leaves_its_words(spark):
    toxic = collections.Counter({"idiot": 97, "idiotic": 6, "idio*": 100, "idiot*": 100, "idioti*": 6})
    words, stems, _, forms = toxicity.choose_terms(toxic, collections.Counter(), 120, 900)
    assert words == ["idiot", "idiotic"] and stems == [] and forms == {}


def test_toxicity_misspelling_in_a_clean_document(spark):
    rng = random.Random(12)
    make = lambda n: [rng.choice(["river", "mountain", "window", "garden", "letter", "the", "of", "and"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(2400):
        words = make(30)
        if i % 20 == 0:
            words[10] = rng.choice(["idiot", "idiots", "idiotic"])
        if i in (0, 20, 40, 60, 80, 100, 1, 2, 3, 4):
            words[20] = "ediot"  # too rare for a term
        elif i % 20 == 1:
            words[10:13] = ["idlot"] * 3
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 20 == 0)))
    docs = documents(spark, rows + [(5000, " ".join([*make(10), "ediot", *make(10)])), (5001, " ".join([*make(10), "idlot", *make(10)]))])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = toxicity.spans(docs.where("doc_id >= 5000"), model).collect()
    assert [(r.doc_id, r.errors) for r in found] == [(5000, 1)]


def test_equal_rows_are_dealt_apart(spark, monkeypatch):
    """3,000 equal rows without an id: no block of substring dedup, and no task of the fingerprints' joins, gets them all."""
    monkeypatch.setattr("spillway.llm.components.LEAST", 100)
    rows = [(None, "word " * 1200)] * 3000 + [(i, f"text of its own {i}") for i in range(50)]
    docs = documents(spark, rows)
    keyed = common.with_row_key(docs, "row")
    assert keyed.select("row").distinct().count() == len(rows)
    n_blocks = math.ceil(common.total_bytes(docs) / substring_dedup.BLOCK)
    sizes = [r["count"] for r in keyed.groupBy(spark_abs_mod("row", n_blocks)).count().collect()]
    assert n_blocks >= 4 and max(sizes) < 1.2 * len(rows) / n_blocks
    got = substring_dedup.dedup_substrings(docs).collect()
    assert len(got) == len(rows) and all(r.n_removed == 0 for r in got)
    out = fingerprint.fingerprint_report(docs).collect()
    assert len(out) == len(rows) and len({r.fingerprint for r in out if r.doc_id is None}) == 1


def spark_abs_mod(column, n):
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(F.lit(None).cast("long"), F.lit("word " * 1200), F.col(column)), F.lit(n))
