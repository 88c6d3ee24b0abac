"""Operators 11 to 13 against plain versions of themselves, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from spillway.llm import chat_format, periodic_runs, token_align

WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, n_runs int, period string")


# operator 11


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(id, text):
    w = WORD.findall(text or "")
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def repeating(rng, kinds):
    w = [str(rng.randrange(kinds)) for _ in range(rng.choice([0, 1, 5, 30, 100, 300, 700]))]
    for _ in range(rng.randrange(4)):
        if w:
            a, p = rng.randrange(len(w)), rng.randrange(1, rng.choice([3, 30, 60, 100, 230]))
            for i in range(a + p, min(len(w), a + p * rng.randrange(2, 8) + rng.randrange(p))):
                w[i] = w[i - p]
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = "x"
    return w


def test_runs_of_many_scales_are_those_of_a_plain_search():
    rng = random.Random(11)
    for _ in range(120):
        docs = [repeating(rng, rng.choice([1, 2, 3, 5, 50, 1000])) for _ in range(rng.randrange(1, 6))]
        first = np.cumsum([0, *map(len, docs)])
        number = {w: i for i, w in enumerate({w for d in docs for w in d})}
        got = periodic_runs.find_runs(np.array([number[w] for d in docs for w in d], np.int32), first)
        want = sorted(((a + f, a + n + f, q) for f, d in zip(first.tolist(), docs) for a, n, q in plain_runs(d)), key=lambda r: (r[0], r[2]))
        assert list(map(tuple, got.tolist())) == want
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    got = periodic_runs.find_runs(np.array(b, np.int32), np.array([0, len(b)]))
    assert [(s, e - s, q) for s, e, q in got.tolist()] == sorted(plain_runs(b), key=lambda r: (r[0], r[2]))


def test_collapse_runs_on_odd_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(repeating(rng, k)) for k in (1, 2, 5, 50, 1000) for _ in range(20)]
    odd = [(None, "a " * 40), (None, "a " * 40), (None, None), (5, None), (6, ""), (7, " \n\t"), (8, "é　é\n" * 30), (8, "x"), (9, "ab cd\t" * 9000)]
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts))]
    got = periodic_runs.collapse_runs(documents(spark, rows), digest=True).collect()
    small = [(i, t) for i, t in rows if len(t or "") < 20_000]
    assert collections.Counter(tuple(r) for r in got if r.doc_id != 9) == collections.Counter(plain_row(*r) for r in small)
    long = next(r for r in got if r.doc_id == 9)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 18_000, 2, 9_000_000)
    whole = periodic_runs.collapse_runs(documents(spark, rows)).where("doc_id = 9").first()
    assert whole.collapsed_text == "ab cd" and whole.runs[0].asDict() == {"start": 0, "length": 18_000, "period": 2}
    assert periodic_runs.collapse_runs(documents(spark, []), digest=True).collect() == []


def test_planted_runs_follow_the_rule(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randrange(9)) for _ in range(rng.randrange(90)))) for i in range(200)] + [(None, "a b"), (20, None), (30, " ")]
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        want.append((i, tuple(w)))
    got = periodic_runs.with_planted_runs(documents(spark, rows)).collect()
    assert collections.Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in got) == collections.Counter(want)


def test_op11_on_its_table(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    text = {r.doc_id: r.text for r in periodic_runs.with_planted_runs(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    short = {i: t for i, t in text.items() if len(t or "") < 30_000}
    got = [tuple(r) for r in periodic_runs.op11_periodic_runs(spark, sf_dir).collect()]
    assert len(got) == len(rows)
    assert sorted(r for r in got if r[0] in short) == sorted(plain_row(i, t) for i, t in short.items())


# operator 12

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string, formatted int"


def plain_fold(events):
    """Each event in turn."""
    order = {k: i for i, k in enumerate(chat_format.KINDS)}
    low = lambda x: (x is not None, x)
    state = {}
    known = [e for e in events if e[2] in order]
    for conv, seq, kind, turn, role, text in sorted(known, key=lambda e: (low(e[1]), low(e[3]), order[e[2]], low(e[4]), low(e[5]))):
        own, text = state.setdefault(turn, ["", ""]), text or ""
        if kind in ("message", "regenerate", "delta") and role:
            own[0] = role
        if kind == "delta":
            own[1] += text
        elif kind == "regenerate":
            own[1] = ""
            for t in [t for t in state if low(t) > low(turn)]:
                del state[t]
        else:
            own[1] = text
    return [(t, *state[t]) for t in sorted(state, key=low)]


def test_folding_a_log_equals_taking_its_events_in_order(spark):
    rng = random.Random(12)
    pick = lambda *x: rng.choice(x)
    events = []
    for conv in range(60):
        for k in range(rng.randrange(1, 25)):
            kind = pick("message", "delta", "delta", "delta", "edit", "regenerate", "seen")
            seq = k if rng.random() < 0.9 else pick(k - 1, None)
            events.append((conv, seq, kind, pick(0, 1, 1, 2, 3, None), pick("user", "assistant", None, ""), pick("a", "b\\", None, "", "###", "é")))
    events += events[:40]
    alone = [(None, 1, "message", 3, "user", "x"), (None, 1, "message", 3, "user", "x"), (None, 2, "delta", 3, "user", "y"), (None, None, "message", None, None, None)]
    df = spark.createDataFrame([(*e, 5) for e in rng.sample(events, len(events)) + alone], EVENTS)
    got = [(r.conv_id, [tuple(m) for m in r.messages]) for r in chat_format.fold(df).collect()]
    by = collections.defaultdict(list)
    for e in events:
        by[e[0]].append(e)
    want = {c: plain_fold(x) for c, x in by.items()}
    assert dict(g for g in got if g[0] is not None) == {c: m for c, m in want.items() if m}
    assert sorted(map(repr, (m for c, m in got if c is None))) == sorted(map(repr, [[(3, "user", "x")], [(3, "user", "x")], [(None, "", "")]]))
    assert chat_format.render(chat_format.fold(df.limit(0))).collect() == []


def test_formatted_texts_read_back_as_they_were(spark):
    rng = random.Random(13)
    bits = ["\\", "\\\\", "#", "##", "###", "####", "</turn>", "<\\/turn>", "<", "/turn>", "\n", ": ", ":", "### Assistant: ", "</turn>\n", "é", "\U0001f600", "", " ", "$1", "a"]
    said = [(c, t, rng.choice(["user", "assistant", "system", "=x", "a: b", "User", "#", None, "x</turn>\n", "\\"]), "".join(rng.choices(bits, k=rng.randrange(7))) if rng.random() < 0.95 else None)
            for c in range(80) for t in range(rng.randrange(1, 6))]
    said += [(900, 3, "assistant", "z" * 70_000), (900, 3, "assistant", "z" * 70_000), (900, 1, "user", None), (None, 0, "assistant", "alone")]
    turns = spark.createDataFrame([(*x, "clash") for x in said], "conv_id long, turn long, role string, text string, segments string")
    out = chat_format.render(chat_format.fold(chat_format.streamed(turns)))
    got = out.select("conv_id", "formatted", "segments", chat_format.read_turns("formatted").alias("turns"), chat_format.read_loss("segments").alias("loss")).collect()
    by = collections.defaultdict(list)
    for c, t, r, x in said:
        by[c].append((t, r is not None, r, x or ""))
    for r in got:
        want = [(m[2] or "", m[3]) for m in sorted(by[r.conv_id])]
        assert [tuple(x) for x in r.turns] == want
        assert r.loss == "".join(x for role, x in want if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("###") == r.formatted.count("</turn>") == len(want)
    assert len(got) == len(by)


def test_op12_gives_the_rows_of_its_sql_and_keeps_to_columns(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf_dir}/conversations.parquet')")
    found = chat_format.op12_chat_format(spark, sf_dir)
    want = con.execute(chat_format.SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)
    at = found.where("conv_id = -7").first()
    says = "\\### Assistant: </turn> ok"
    assert at.turns_sha256 == hashlib.sha256(f"user\n{says}\nassistant\n{says}\n".encode()).hexdigest()
    assert at.loss_sha256 == hashlib.sha256(says.encode()).hexdigest() and at.loss_chars == len(says)


# operator 13


def plain_alignment(rows):
    """By the libraries, token by token."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table = {}
    for c in range(256):  # the letters that stand for bytes
        table[chr(c) if chr(c).isprintable() and c not in (0x20, 0xA0, 0xAD) else None] = c
    table.pop(None)
    free = [c for c in range(256) if c not in table.values()]
    table |= {chr(256 + k): c for k, c in enumerate(free)}

    def sizes(text):
        a = tok.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        of_a = [bytes(table[x] for x in tok.id_to_token(i)) for i in a]
        of_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        same = b"".join(of_a) == b"".join(of_b) == (" " + text).encode()
        return (a, b, list(map(len, of_a)), list(map(len, of_b))) if text and same else ([], [], [], [])

    cut, counts = [], collections.Counter()
    for id, text in rows:
        a, b, sa, sb = sizes(text or "")
        ea, eb = np.cumsum(sa).tolist(), np.cumsum(sb).tolist()
        ends = sorted({*ea, *eb})
        links, groups, i, j, from_i, from_j = [], [], 0, 0, 0, 0
        for e in ends:
            links.append((a[i], b[j]))
            i, j = i + (ea[i] == e), j + (eb[j] == e)
            if e in set(ea) & set(eb) if len(ends) < 50 else i and j and ea[i - 1] == eb[j - 1] == e:
                groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
                from_i, from_j = i, j
        counts.update(links)
        cut.append((id, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for id, n_a, n_b, groups, links in cut:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield id, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest


def test_alignment_on_odd_rows(spark, sf_dir, monkeypatch):
    rng = random.Random(9)
    signs = "abcdeABC  \n\t'\u00e9\u00df\u0301\u4e2d\u0130\u03a3 \x85\x1c12\u00b2!?#\U0001f600\u1e9e \u3000\u00d7\x00|<>s"
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(150)]
    texts += ["<|endoftext|> a <s> </s> <0x41>", "  a", "a ", "a  ", " ", "  ", "\u2581", "a\u2581b c", "\n", "\u2581 \u2581", "!" * 500, "x " * 3000, "\ufffd\u200b", "\r\n a"]
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows = [(None, "a b"), (None, "a b"), (None, None), (5, None), (6, ""), (8, "one"), (8, "one"), *((100 + i, t) for i, t in enumerate(texts)), *real]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = collections.Counter(plain_alignment(rows))
    assert collections.Counter(map(tuple, token_align.align_tokens(documents(spark, rows)).select(names).collect())) == want
    # many small chunks give the same
    found = token_align.align_tokens.__globals__
    aligner = token_align.Aligner(token_align.public_tokenizers.path(token_align.VOCABULARY), token_align.public_tokenizers.path(token_align.PIECES))
    monkeypatch.setitem(found, "KNOWN", 5)
    for size in (1, 7):
        got = collections.Counter()
        for at in range(0, len(rows), size):
            got.update(zip(*(token_align.align(aligner, [t or "" for _, t in rows[at : at + size]])[0][c].to_pylist() for c in names[1:5])))
        assert got == collections.Counter({k: n for k, n in collections.Counter(x[1:5] for x in want.elements()).items()})
    assert token_align.align_tokens(documents(spark, [])).collect() == []
    assert [tuple(r)[1:] for r in token_align.align_tokens(documents(spark, [(1, None)])).select(names).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_op13_on_its_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, token_align.op13_token_align(spark, sf_dir).select(names).collect())) == sorted(plain_alignment(rows))
