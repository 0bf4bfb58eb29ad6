"""Operators on texts against plain versions; nulls, empty tables, repeats and odd columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, chat, fingerprints, lm, packing, pii, quality, secrets_scan, urls
from ledgerspark.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "river", "stone", "walked", "über", "né", "slowly", "house", "green", "and", "of", "to", "light"]
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) + str(rng.randint(0, 9) * (rng.random() < 0.05) or "") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    odd = ["", None, "one", "a" * 700, "漢字🙂 é\n\n\x00 x", "  \n\t ", "x " * 5000, prose(1), prose(1), prose(2)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(odd + [prose(k, 200) for k in range(3, 30)])]
    return spark.createDataFrame([*rows, rows[8], (None, prose(9), "en", "s", 1)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_pack(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(packing.read_vocabulary(packing.VOCABULARY).decode())
    out = packing.pack(packing.tokenize(docs.withColumn("piece", F.lit("clash")))).collect()
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    want = collections.defaultdict(list)
    for d, x in texts(docs):
        want[d].append(t.encode(x, add_special_tokens=False).ids + [0])
    for d, rows in by_doc.items():
        got = sorted((r.start, r.ids) for r in rows)
        assert b"".join(i for _, i in sorted(got)) == b"".join(i for _, i in sorted((s, np.array(ids[s : s + 2048], "<u4").tobytes()) for ids in want[d] for s in range(0, len(ids), 2048)))
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.tokenize(empty)).count() == 0


def test_best_fit_is_best_and_bounded():
    rng, fit, free, open_ = random.Random(3), packing.BestFit(100, 8), {}, set()
    for _ in range(3000):
        n = rng.randint(1, 100)
        best = min((f for b, f in free.items() if b in open_ and f >= n), default=None)
        one, offset = fit.add(n)
        if best is None:
            assert one not in free and offset == 0
            free[one] = 100 - n
            open_.add(one)
        else:
            assert free[one] == best
            free[one] -= n
        # what closes is full, or the fullest of the eight that were open before a ninth was
        for closed in fit.closed:
            if free[closed]:
                others = [f for b, f in free.items() if b in open_ and b != one and f]
                assert best is None and len(open_) == 9 and free[closed] == min(others)
            open_.discard(closed)
        fit.closed.clear()
        assert len(open_) <= 8 and all(free[b] for b in open_)
    with pytest.raises(ValueError):
        fit.add(101)


def test_pack_documents(spark, docs):
    """The registered path: every piece's CRC-32, gapless sequences, a very long text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(packing.read_vocabulary(packing.VOCABULARY).decode())
    long = spark.createDataFrame([(700, prose(3, 60_000), "en", "s", 1)], SCHEMA)
    some = docs.unionByName(long)
    out = packing.pack_documents(some.withColumn("length", F.lit("clash"))).collect()
    want = collections.Counter()
    for d, x in texts(some):
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            want[d, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048


def test_coder_of_other_tokenizers():
    """A tokenizer that keeps case and spaces is given whole texts."""
    from tokenizers import Tokenizer

    raw = packing.read_vocabulary("byte_bpe_50k.json").decode()
    t, c = Tokenizer.from_str(raw), packing.WordCoder(raw)
    some = ["Ab cD,  the\nWord", "", "é  x"]
    assert not c.by_words and c.encode([x.encode() for x in some]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]


def test_word_coder_on_odd_text():
    from tokenizers import Tokenizer

    raw = packing.read_vocabulary(packing.VOCABULARY).decode()
    t, rng = Tokenizer.from_str(raw), random.Random(4)
    alphabet = [*"aB \n\t.,'’éÉİßé́\x1c\x85漢ﬁ①½tS123_<|endoftext|>🙂\x00"]
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "x", " ", "É", "</w>"]
    some += ["".join(rng.choice(alphabet + marks) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    for controls in (True, False):
        c, t.encode_special_tokens = packing.WordCoder(raw, controls), not controls
        assert c.encode([x.encode() for x in some]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]


def test_packing_is_online_unless_asked(spark):
    """Each task's sequences are those of plain online best fit; dealing the last bins anew is
    an option that takes no more of them."""
    rng = random.Random(6)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long").coalesce(1)
    got = {r.k: (r.sequence_id, r.offset) for r in packing.pack(pieces, 100, 8).collect()}
    fit = packing.BestFit(100, 8)
    assert got == {r.k: fit.add(r.length) for r in pieces.collect()}
    again = packing.pack(pieces, 100, 512, repack=True).collect()
    assert len({r.sequence_id for r in again}) <= len({r.sequence_id for r in packing.pack(pieces, 100, 512).collect()})


def spans_by_re(text, rules):
    out = []
    for k, (name, pattern, group, ok) in enumerate(rules):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m[group])]
    return [x[2] for x in sorted(out)]


SECRETS = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, lambda v: len(v) >= 8),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda v: len(v) >= 16),
    ("hex", r"[0-9a-f]+", 0, lambda v: len(v) >= 32),
]


def test_secrets(spark, docs, empty):
    rng = random.Random(5)
    bits = ["token", "Password", "api_key", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "abc", "hunter2hunter2", "é🙂", "\n", "secret="]
    made = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "x") for i in range(400)]
    log = spark.createDataFrame([*made, (None, None, "x")], "doc_id long, text string, base string")
    model = secrets_scan.train(docs)
    found = secrets_scan.spans(log.select("doc_id", "text"), model)
    rows = {r.doc_id: r for r in found.select("doc_id", "text", secrets_scan._listed(F.col("base"), secrets_scan.KINDS).alias("b")).collect()}
    for i, text, _ in made:
        assert rows[i].b.split(",") == (spans_by_re(text, SECRETS) or [""]), text
    assert rows[None].b == ""
    model = secrets_scan.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plain = spark.createDataFrame([(1, "key AbX9zQ4kLm2Pw8RtYv3N and a very_long_identifier_name somewhere", "q")], "doc_id long, text string, base string")
    listed = secrets_scan.spans(plain.select("doc_id", "text"), model).select(secrets_scan._listed(F.col("all_spans"), (*secrets_scan.KINDS, "random")).alias("s")).first().s
    assert listed == "random:4:24"
    cleaned = secrets_scan.redact(plain, model).first()
    assert cleaned.text == "key [SECRET] and a very_long_identifier_name somewhere" and cleaned.base == "q"
    assert secrets_scan.redact(log, model).count() == 401
    assert secrets_scan.redact(empty, secrets_scan.train(empty)).count() == 0


def test_secrets_held_out(spark):
    """Unseen random strings are found, words of documents outside of the sample aren't."""
    import base64

    model = secrets_scan.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    strings = [base64.b64encode(hashlib.md5(str(i).encode()).digest())[:22].decode() for i in range(500)]
    random_ = spark.createDataFrame([(i, f"a {x} b") for i, x in enumerate(strings)], "doc_id long, text string")
    found = secrets_scan.spans(random_, model).where("size(all_spans) > 0").count()
    assert found > 480
    other = secrets_scan.spans(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), model)
    assert other.where("exists(all_spans, s -> s.rank = 3)").count() <= 5


def test_secret_ratios_against_brute_force(spark, docs):
    """Each run's log-likelihood ratio by plain Python, from the same table; a very long text."""
    model, n, rng = secrets_scan.train(docs), len(secrets_scan.ALPHABET), random.Random(14)
    some = ["".join(rng.choices(rng.choice((secrets_scan.ALPHABET, "etaoinshrdlu", "0123456789abcdef", "aB3")), k=rng.randint(14, 60))) for _ in range(300)]
    text = " ".join(some * 40)
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*some, text])], "doc_id long, text string")

    def random_(word):
        at = [secrets_scan.ALPHABET.index(c) for c in word]
        return sum(model[a * n + b] for a, b in zip(at, at[1:])) >= secrets_scan.THRESHOLD * secrets_scan.UNIT

    got = {r.doc_id: [(s.start, s.end) for s in r.all_spans if s.rank == 3] for r in secrets_scan.spans(df, model).collect()}
    base = {r.doc_id: [(s.start, s.end) for s in r.base] for r in secrets_scan.spans(df, model).collect()}
    for k, x in enumerate([*some, text]):
        blank = list(x)
        for a, b in base[k]:
            blank[a:b] = " " * (b - a)
        runs = re.finditer(r"[A-Za-z0-9+/_=-]{16,}", "".join(blank))
        assert got[k] == [m.span() for m in runs if random_(m[0])]
    assert 0 < sum(map(len, got.values()))


def test_redact_joins_overlaps(spark, docs):
    t = "x token=" + "0123456789abcdef" * 2 + " y"
    df = spark.createDataFrame([(1, t, 5)], "doc_id long, text string, n_chars long")
    r = secrets_scan.redact(df, secrets_scan.train(docs)).first()
    assert r.text == "x [SECRET] y" and r.n_chars == len(r.text)


def test_runs_beside_base_spans(spark, docs):
    key, digest = "hQ7zX2vK9pWm4TbR8cJd6Y", "0123456789abcdef" * 2
    df = spark.createDataFrame([(1, f"é a {key}Z{digest}Z{key} b", 5)], "doc_id long, text string, n_chars long")
    model = secrets_scan.train(docs)
    r = secrets_scan.spans(df, model).first()
    assert [(x.start, x.rank, x.end) for x in r.all_spans] == [(4, 3, 27), (27, 2, 59), (59, 3, 82)]
    assert secrets_scan.redact(df, model).first().text == "é a [SECRET] b"


def test_fingerprints(spark, docs, empty):
    def brute(x, k=12, w=17):
        h = fingerprints.gram_hashes(fingerprints.code_points(x), k)
        w, out = min(w, len(h)), []
        for i in range(len(h) - w + 1 if len(h) else 0):
            j = i + int(np.flatnonzero(h[i : i + w] == h[i : i + w].min())[-1])
            if not out or out[-1] != j:
                out.append(j)
        return [(j, int(h[j])) for j in out]

    def read(kept):
        return [(int(p), int(h)) for p, h in zip(*fingerprints.places(bytes(kept)))]

    def alike(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("part", F.lit(1))
    rows = sorted(texts(own), reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare(own).collect()}
    assert len(got) == len(rows)
    for k, (d, x) in enumerate(rows):
        y = rows[(k + 1) % len(rows)][1]
        m = len(x) // 3
        edited = x[: len(x) - m] + y[:m]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(x)
        mine, e_mine = read(got[d].fingerprint), read(got[d].edited_fingerprint)
        assert mine == brute(x) and e_mine == brute(edited)
        assert got[d].near_edited == pytest.approx(alike(mine, e_mine)) and got[d].near_next == pytest.approx(alike(mine, brute(y)))
    assert fingerprints.compare(docs).count() == docs.count() and fingerprints.compare(empty).count() == 0
    shared = prose(77, 40)
    a, b = (set(fingerprints.winnow(fingerprints.code_points(x + shared + y))[1].tolist()) for x, y in (("aa", "b"), ("ccc ", "dd")))
    assert len(shared) >= 28 and a & b


def test_fingerprint_of_a_long_text(spark):
    long = prose(3, 100_000)
    rows = [(2, long), (1, long[:-9] + "x"), (0, None)]
    got = {r.doc_id: r for r in fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].n_chars == len(long) and got[2].near_next > 0.99 and got[0].fingerprint == b""


def test_word_hashes_of_long_texts(monkeypatch):
    """Hashes are the same whatever block a word is hashed in."""
    from ledgerspark.llm import vec

    data = np.frombuffer(prose(5, 20_000).encode(), np.uint8)
    starts, ends, _ = vec.words(data, np.array([0, len(data)]))
    whole = vec.word_hashes(data, starts, ends)
    monkeypatch.setattr(vec, "BLOCK", 100)
    assert (vec.word_hashes(data, starts, ends) == whole).all()


def test_fingerprints_of_short_texts(spark):
    rows = [(i, prose(40 + i, 30)[:90], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = {r.doc_id: r for r in fingerprints.compare(df).collect()}
    # two thirds of 90 code points stay: alike, but not the same
    assert all(0.2 < r.near_edited < 1 for r in got.values())
    shared = prose(77, 40)[:28]
    a, b = (set(fingerprints.winnow(fingerprints.code_points(x + shared + y))[1].tolist()) for x, y in (("aa", "b" * 90), ("ccc ", "dd")))
    assert a & b


def test_chat(spark):
    e = [
        (1, "m1", 1, "message", "user", "hi <|end|> \\ [INST]"), (1, "m2", 2, "delta", "assistant", "he"), (1, "m2", 3, "delta", "assistant", "llo"),
        (1, "m3", 4, "message", "user", "again"), (1, "m4", 5, "delta", "assistant", "x"), (1, "m4", 6, "regenerate", None, ""), (1, "m4", 7, "delta", "assistant", "</s>y"),
        (1, "m2", 8, "edit", None, "hello!"), (None, "m", None, "message", None, None), (2, "m", 1, "message", "user", "a"), (2, "m", 1, "message", "user", "a"),
    ]
    log = spark.createDataFrame(e, "conv_id long, message_id string, seq long, kind string, role string, text string")
    out = chat.render(chat.fold(log))
    back = {r.conv_id: [tuple(m) for m in r.b] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("b")).collect()}
    assert back[1] == [("user", "hi <|end|> \\ [INST]"), ("assistant", "hello!"), ("user", "again"), ("assistant", "</s>y")]
    assert back[None] == [("", "")] and back[2] == [("user", "a")] * 2
    row = out.where("conv_id = 1").first()
    assert "".join(s.text for s in row.segments) == row.formatted
    body = row.formatted.replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "")
    assert not any(c in body for c in chat.CONTROL)
    assert chat.render(chat.fold(log.limit(0))).count() == 0


def test_chat_of_a_long_text(spark):
    """A megabyte of control strings, told whole and in many deltas, comes back as it was."""
    text = "</s>[INST] ok [/INST] <|end|> \\ é " * 30_000
    rows = [(1, "m", 1, "message", "user", text)] + [(1, "n", 2 + k, "delta", "assistant", text[k * 100_000 : (k + 1) * 100_000]) for k in range(len(text) // 100_000 + 1)]
    log = spark.createDataFrame(rows, "conv_id long, message_id string, seq long, kind string, role string, text string")
    (row,) = chat.render(chat.fold(log)).select(chat.parse(F.col("formatted")).alias("b")).collect()
    assert [tuple(m) for m in row.b] == [("user", text), ("assistant", text)]


def test_chat_random_logs(spark):
    """Random logs of all kinds, with repeated deliveries and nulls, against a plain fold."""
    rng, log = random.Random(15), []
    for conv in range(60):
        for m in range(rng.randint(1, 5)):
            role = rng.choice(("user", "assistant", "system"))
            for k in range(rng.randint(1, 6)):
                kind = rng.choice(("message", "delta", "delta", "edit", "regenerate", None))
                event = (conv, rng.choice((f"m{m}", None)) if m == 0 else f"m{m}", 100 * m + k, kind, rng.choice((role, None)), rng.choice(("", "a", "<|end|>", "\\", "</s>x", None)))
                log += [event] * rng.choice((1, 1, 1, 2))
    rng.shuffle(log)
    want = collections.defaultdict(list)
    for conv, message in {e[:2] for e in log}:
        own = sorted(((e[2], (e[3] or "message") == "delta", e[4] or "", e[5] or "", e[3] or "message") for e in log if e[:2] == (conv, message)))
        if all(e[4] == "message" for e in own):
            want[conv] += [(e[0], e[2], e[3]) for e in own]
            continue
        own = sorted(set(own))
        text = ""
        for _, _, _, t, kind in own:
            text = text + t if kind == "delta" else t
        want[conv].append((own[0][0], next((e[2] for e in own if e[2]), ""), text))
    df = spark.createDataFrame(log, "conv_id long, message_id string, seq long, kind string, role string, text string").withColumn("es", F.lit("clash"))
    out = chat.render(chat.fold(df)).select("conv_id", chat.parse(F.col("formatted")).alias("b")).collect()
    assert {r.conv_id: [tuple(m) for m in r.b] for r in out} == {c: [x[1:] for x in sorted(ms)] for c, ms in want.items()}


def test_lm(spark, docs, empty, monkeypatch):
    for head, vocab in ((lm.HEAD, lm.VOCAB), (5, 3), (40, 20)):
        monkeypatch.setattr(lm, "HEAD", head)
        monkeypatch.setattr(lm, "VOCAB", vocab)
        out = lm.scores(docs, Scratch(spark, "lm")).collect()
        rows = texts(docs)
        count = collections.Counter()
        tokens = {}
        for d, x in rows:
            tokens[d] = x.encode().lower().split() + [b""]
            if not lm.held_out(d):
                count.update(tokens[d])
        n, v = sum(count.values()), len(count)
        assert len(out) == len(rows)
        for r in out:
            own = tokens[r.doc_id]
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 7 == 2)
            assert r.n_tokens == len(own) and r.n_known == sum(count[t] > 0 for t in own) and r.train_tokens == n
            assert r.base_score == pytest.approx(sum(np.log10((count[t] + 1) / (n + v + 1)) for t in own))
            assert np.isfinite(r.score) and r.score < 0
    assert lm.scores(empty, Scratch(spark, "lm")).count() == 0


def lexicon_of(texts_):
    data, offsets = np.frombuffer("".join(texts_).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in texts_)])
    hashes, buckets, begins = lm.tokens(data, offsets)
    words, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    sums = np.stack([np.bincount(buckets[first], w, lm.BUCKETS) for w in (counts, np.ones(len(words)))], 1)
    lex = lm.Lexicon(words, counts, buckets[first], sums)
    return lex, lex.units_of(lex.find(hashes), buckets), begins, words, counts, buckets[first]


def test_lm_probabilities(monkeypatch):
    """After any words the probabilities of all words, and of the unknown ones of each bucket,
    come to one; log_probabilities are those of a plain softmax; a pass over a text in which
    the next word follows from the one before teaches it."""
    monkeypatch.setattr(lm, "VOCAB", 60)
    monkeypatch.setattr(lm, "CLASSES", 12)
    rng = random.Random(3)
    chain = {f"w{k}": [f"w{rng.randint(0, 99)}" for _ in range(2)] for k in range(100)}
    some, word = [], "w0"
    for _ in range(300):
        line = []
        for _ in range(60):
            word = rng.choice(chain[word])
            line.append(word)
        some.append(" ".join(line))
    lex, units, begins, words, counts, buckets = lexicon_of(some)
    model = lm.Model(lex)
    units_, token = lex.stream(units, begins, np.ones(len(some), bool))
    flat = model.log_probabilities(units_, token).mean()
    for k in range(8):
        model.learn(units_, token, 0.1, np.random.default_rng(k))
    assert model.log_probabilities(units_, token).mean() > flat + 0.5
    at = lex.find(words)
    for _ in range(20):
        before = rng.choices(range(len(lex.classes)), k=lm.CONTEXT)
        every = np.array([x for u in range(len(lex.classes)) for x in (*before, u)], np.uint16)
        last = np.tile([False] * lm.CONTEXT + [True], len(lex.classes))
        log = model.log_probabilities(every, last).astype(float)
        h = model.hidden(model.r[np.array([*before, 0])])[0]
        c = model.p @ h + model.a
        c = c - np.log(np.exp(c).sum())
        for u in range(len(lex.classes)):
            own = slice(lex.starts[lex.classes[u]], lex.starts[lex.classes[u] + 1])
            x = model.q[own] @ h + model.b[own]
            assert log[u] == pytest.approx(c[lex.classes[u]] + x[u - own.start] - np.log(np.exp(x).sum()), abs=1e-3)
        p = np.exp(log[lex.units_of(at, buckets)])
        inside = np.where(lex.own[at], 1.0, (counts + 1) / 10 ** lex.mass_log[buckets])
        unknown = np.exp(log[lex.bucket_units]) / 10**lex.mass_log
        assert (p * inside).sum() + unknown.sum() == pytest.approx(1, abs=1e-3)


def test_lm_averages(spark, docs):
    """What tasks hand on, summed and divided, are the averages of their vectors."""
    lex, units, begins, *_ = lexicon_of([x for _, x in texts(docs)][:20])
    import pandas as pd

    models = []
    for k in range(2):
        models.append(lm.Model(lex))
        chosen = np.arange(20) % 2 == k
        models[k].learn(*lex.stream(units, begins, chosen), 0.1, np.random.default_rng(k))
    rows = pd.concat([lm._rows(m).to_pandas() for m in models]).groupby(["part", "id"], as_index=False).sum()
    got = lm.averaged(lex, None, rows)
    seen = np.stack([m.seen for m in models])
    both = seen.min(0) > 0
    assert both.any()
    want = (seen[0][:, None] * models[0].q + seen[1][:, None] * models[1].q) / np.maximum(seen.sum(0), 1)[:, None]
    assert np.allclose(got["q"][both], want[both], atol=1e-5)
    n = seen.sum(1)
    assert np.allclose(got["p"], (n[0] * models[0].p + n[1] * models[1].p) / n.sum(), atol=1e-5)


def test_lm_held_out(spark):
    """Texts that were not learnt from get a better score than from single words' counts."""
    out = lm.op5_lm_score(spark, "/root/testdata/sf0.01").where("held_out")
    r = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert (r.s - r.b) / r.n > 0.15 and r.better > 0.95


def test_lm_of_a_long_text(spark):
    rows = [(2, " ".join(f"w{i % 5000}" for i in range(400_000)), "en", "s", 1), (1, "w1 w2", "en", "s", 1)]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "lm")).collect()}
    assert not got[2].held_out and got[2].n_tokens == 400_001 and got[2].score > got[2].base_score


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0, lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and pii.luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def test_pii_spans():
    rng = random.Random(6)
    for _ in range(20000):
        t = "".join(rng.choice("1234567890..--  ++@@ab.(),é4539578763621486") for _ in range(rng.randint(0, 45)))
        got = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, _ in pii.base_spans(t, sum(c in "0123456789" for c in t))]
        assert got == spans_by_re(t, PII), t
    assert pii.base_spans("a" * 200_000 + "@", 0) == [] and pii.base_spans("1" * 200_000, 200_000) == []


def test_pii_terms(spark, docs, empty):
    given = [(100 + i, f"{prose(200 + i, 30)} write jo@ex.org about quokka farm {i}", "en", "s", 1) for i in range(4)]
    clean = [(200 + i, f"{prose(300 + i, 30)} write about nothing farm", "en", "s", 1) for i in range(8)]
    df = spark.createDataFrame([*given, *clean], SCHEMA).unionByName(docs)
    out = pii.sanitize(df, Scratch(spark, "pii")).where("doc_id >= 100")
    got = {r.doc_id: r.text for r in out.collect()}
    assert all("[EMAIL]" in got[100 + i] and "quokka" not in got[100 + i] and "farm" in got[100 + i] for i in range(4))
    assert all(got[d] == t for d, t, *_ in clean)
    assert pii.sanitize(empty, Scratch(spark, "pii")).count() == 0 and out.columns == df.columns


def test_pii_terms_against_brute_force(spark):
    """All term spans of small random corpora, with repeated texts, entities that always stand
    together, terms right at the bar (any term at 0.999 with Z 0) and windows of a few words."""
    rng = random.Random(13)
    people = [f"p{k}@ex.org" for k in range(6)]
    for share, z, near in ((0.999, 0.0, 32), (0.5, 1.2816, 32), (0.5, 0.0, 2), (0.6, 0.5, 3)):
        given = []
        for i in range(120):
            words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 12))]
            some = rng.sample(people[:4], rng.choice((0, 0, 1, 2))) + (people[4:] if rng.random() < 0.1 else [])
            words += [f"w{rng.choice((100, 100, 110)) + int(c[1])}" for c in some]
            given.append(" ".join(rng.sample(words + some, len(words + some))))
        given += rng.sample(given, 20) + ["W1! w2, w3.", ""]
        rows = [(i, x, "clash") for i, x in enumerate(given)]
        holds, texts_of = collections.defaultdict(lambda: collections.defaultdict(set)), collections.Counter()
        for i, x, _ in rows:
            tokens = x.lower().replace("!", "").replace(",", "").replace(".", "").replace("exorg", "ex.org").split()
            texts_of.update({t for t in tokens if t[0] == "w"})
            for k, c in enumerate(tokens):
                if c[0] == "p":
                    left, right = ([t for t in side if t[0] == "w"] for side in (tokens[:k], tokens[k + 1 :]))
                    for t in [*left[max(0, len(left) - near) :], *right[:near]]:
                        holds[c][t].add(i)
        told = set()
        for own in holds.values():
            for t, both in own.items():
                part, texts = len(both) / texts_of[t], len({given[i] for i in both})
                m = texts / part
                low = (part + z * z / (2 * m) - z * np.sqrt(part * (1 - part) / m + z * z / (4 * m * m))) / (1 + z * z / m)
                if low >= share - 1e-12:
                    told.add(t)
        df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
        got = {r.doc.doc_id: r for r in pii.find(df, ["doc_id", "key"], Scratch(spark, "pii"), share, z, near).collect()}
        assert len(got) == len(rows) and told
        for i, x, _ in rows:
            want = [(m.start(), m.end()) for m in re.finditer(r"(?i)\bw\d+", x) if m[0].lower() in told]
            assert [(s.start, s.end) for s in got[i].spans if s.rank == 4] == want, (share, x)


def test_pii_bar_is_the_same_at_any_size(spark):
    """Planted nicknames are found and nothing else is, and as many of them when the corpus is
    ten times as large; one with an entity in half of its texts isn't enough."""
    for n in (300, 3000):
        rows = [(i, prose(5000 + i, 25) + f" only{i}", "en", "s", 1) for i in range(n)]
        for p in range(20):
            rows += [(10_000 + 10 * p + k, f"{prose(p * 10 + k, 12)} nick{p} is at p{p}@ex.org with single{p}x{k} {prose(k, 5)}", "en", "s", 1) for k in range(5)]
            rows += [(20_000 + 10 * p + k, f"{prose(p * 11 + k, 9)} nick{p} half{p} {prose(k, 5)}", "en", "s", 1) for k in range(1)]
            rows += [(30_000 + p, f"half{p} at p{p}@ex.org {prose(p, 4)}", "en", "s", 1)]
        df = spark.createDataFrame(rows, SCHEMA)
        text = {r[0]: r[1] for r in rows}
        found = collections.Counter()
        for r in pii.find(df, ["doc_id"], Scratch(spark, "pii")).collect():
            found.update(re.sub(r"\d+$", "", text[r.doc.doc_id][s.start : s.end]) for s in r.spans if s.rank == 4)
        assert found == {"nick": 120}


def test_pii_pairs_are_bounded(spark):
    """A directory of thousands of addresses, each also elsewhere, makes pairs in proportion."""
    text = prose(3, 20_000) + " " + " ".join(f"u{i}@ex.org x{i}" for i in range(3000))
    rows = [(1, text, "en", "s", 1)] + [(2 + i, f"u{i}@ex.org", "en", "s", 1) for i in range(3000)]
    found = pii.scan(spark.createDataFrame(rows, SCHEMA))
    assert found.select(F.size("pairs").alias("n")).agg(F.sum("n")).first()[0] <= 3001 * 2 * pii.NEAR


def test_pii_of_a_long_text(spark):
    """One text of a hundred thousand words and thousands of addresses."""
    many = " ".join(f"u{i}@ex.org" for i in range(5000))
    text = prose(3, 100_000) + " " + many
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "a b", "en", "s", 3), (3, None, "en", "s", 0)], SCHEMA)
    got = {r.doc.doc_id: r for r in pii.find(df, ["doc_id"], Scratch(spark, "pii")).collect()}
    assert len(got[1].base) >= 5000 and got[2].spans == [] and got[3].spans == []
    clean = {r.doc_id: r for r in pii.sanitize(df.withColumn("n_chars", F.col("n_chars").cast("int")), Scratch(spark, "pii")).collect()}
    assert "@" not in clean[1].text and clean[1].n_chars == len(clean[1].text) and clean[3].text is None


def test_pii_terms_of_one_text(spark):
    plain = [(i, prose(500 + i, 60), "en", "s", 1) for i in range(300)]
    rows = [*plain, (900, f"the river zyxomma farm jo@ex.org {prose(1, 9)}", "en", "s", 1), *((901 + i, "stone farm", "en", "s", 1) for i in range(20))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text for r in pii.sanitize(df, Scratch(spark, "pii")).collect()}
    # one text is no evidence at the bar that is set, only where no bound is asked for
    assert got[900].startswith("the river zyxomma farm [EMAIL] ")
    assert all(got[d] == t for d, t, *_ in rows if d != 900)
    got = {r.doc_id: r.text for r in pii.sanitize(df, Scratch(spark, "pii"), z=0.0).collect()}
    assert got[900].startswith("the river [REMOVED] farm [EMAIL] ")
    assert all(got[d] == t for d, t, *_ in rows if d != 900)


def test_pii_terms_of_other_documents(spark):
    plain = [(i, prose(500 + i, 60), "en", "s", 1) for i in range(300)]
    given = [(900 + i, f"é zyxomma, farm jo@ex.org {prose(i, 9)}", "en", "s", 1) for i in range(6)]
    other = (990, "né the Zyxomma! stone, ZYXOMMA", "en", "s", 1)
    df = spark.createDataFrame([*plain, *given, other, *((910 + i, "stone farm é", "en", "s", 1) for i in range(40))], SCHEMA)
    got = {r.doc_id: r.text for r in pii.sanitize(df, Scratch(spark, "pii")).collect()}
    assert got[990] == "né the [REMOVED]! stone, [REMOVED]"
    assert all(got[900 + i].startswith("é [REMOVED], farm [EMAIL] ") for i in range(6))
    assert all(got[d] == t for d, t, *_ in plain)


def test_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.read_vocabulary(bpe.RANKS))
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs)).collect()
    want = sorted((np.array(t.encode_ordinary(x), "<u4").tobytes(), x.encode()) for _, x in texts(docs))
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe.decode(bpe.encode(empty)).count() == 0
    c, rng = bpe.Coder(ranks, public_tokenizers.PATTERN), random.Random(7)
    bits = [" ", "  ", "\n", "\t", " a", "b", "é", "漢", "'s", "'LL", "12", "½", "\x1c", "\x85", "\xa0", "　", "🙂", "<|endoftext|>", "\x00", "the", "#$%"]
    some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a" * 3000, " " * 400, "ab" * 400]
    assert c.encode(some) == [np.array(t.encode_ordinary(x), "<u4").tobytes() for x in some]


def test_bpe_without_spaces():
    """Texts whose words are long or have no end, against tiktoken, in bounded memory."""
    import resource

    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.read_vocabulary(bpe.RANKS))
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c, d, rng = bpe.Coder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks), random.Random(8)
    letters = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    thai, han = [chr(x) for x in range(0xE01, 0xE30)], [chr(x) for x in range(0x4E00, 0x5FFF)]
    some = [
        ["\n".join(letters("ACDEFGHIKLMNPQRSTVWY", 80) for _ in range(250)) for _ in range(100)],
        [letters(thai, 6700) for _ in range(100)],
        ["".join(letters(han, 70) + "。" for _ in range(9500))],
        [" ".join(letters("abcdefghijklmnopqrstuvwxyz", 250) for _ in range(8000))],
        [letters("etaoinshrdlu", 5_000_000)],
        ["b" + "a" * 300_000, "ab" * 50_000, "x" + "abc" * 50_000, " " * 100_000],
    ]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for given in some:
        got = c.encode(given)
        assert got == [np.array(t.encode_ordinary(x), "<u4").tobytes() for x in given]
        assert d.decode(got) == [x.encode() for x in given]
    assert c.held <= bpe.WORD_BYTES + 5_000_000 and not c.rest() and c.held <= bpe.WORD_BYTES
    ids = np.random.default_rng(0).integers(0, len(ranks), 20_000_000).astype("<u4")
    by_id = {r: x for x, r in ranks.items()}
    assert d.decode([b"", ids.tobytes()]) == [b"", b"".join(map(by_id.__getitem__, ids.tolist()))]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 3_000_000


def test_bpe_seams():
    """Any two encodings are joined to that of the whole, for ranks in no order at all too."""
    rng = random.Random(9)
    for _ in range(12):
        pieces = {"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(25)}
        order = [bytes([i]) for i in range(256)] + sorted(pieces, key=lambda _: rng.random())
        c = bpe.Coder({x: i for i, x in enumerate(order)}, r"\S+")
        for _ in range(10):
            word = "".join(rng.choices("abc", k=rng.randint(2, 150))).encode()
            (plain,), (got,) = c.contract([word]), c.whole([word])
            assert plain.tolist() == got.tolist()
            at = rng.randint(1, len(word) - 1)
            (both,) = c.together([tuple(c.contract([word[:at], word[at:]]))])
            assert both.tolist() == plain.tolist()


def test_urls(spark):
    rows = [
        (1, "http://a.com/en/1", ""), (2, "http://x.xyz/p", '<link rel="canonical" href="http://a.com/en/1">'), (3, "http://y.xyz/q?utm_source=z", ""), (4, "https://www.y.xyz/q/", "<meta http-equiv='refresh' content='0; url=http://x.xyz/p'>"),
        (5, "http://EXAMPLE.com/en/7x", ""), (6, "http://z.xyz", '<link rel=canonical href=http://b.org/es/>'), (7, "http://z.xyz#f", '<link rel="canonical" href="http://c.net/de/1">'),
        (8, None, None), (9, "nothing", ""), (10, "http://xcom/en/", ""), (1, "http://a.com/en/1", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.defaultdict(set)
    for r in urls.judge(df, Scratch(spark, "urls")).collect():
        got[r.page_id].add((r.host, r.path, r.rule, r.verdict))
    assert got[1] == {("a.com", "/en/1", "com/en/", "block")} and got[5] == {("example.com", "/en/7x", "example.com/en/7", "allow")}
    assert {got[k].copy().pop()[3] for k in (2, 3, 4)} == {"block"}  # aliases of a blocked url
    assert {got[k].copy().pop()[3] for k in (6, 7)} == {"allow"}  # an allowed alias outranks a blocked one
    assert got[8] == got[9] == {("", "", None, "allow")} and got[10] == {("xcom", "/en/", None, "allow")}
    assert urls.judge(df, Scratch(spark, "urls")).count() == len(rows) and urls.judge(df.limit(0), Scratch(spark, "urls")).count() == 0
    links = spark.createDataFrame([("http://q.xyz/", "http://a.com/en/1")], "u string, v string")
    more = urls.judge(spark.createDataFrame([(1, "http://q.xyz/", "")], "page_id long, url string, html string"), Scratch(spark, "urls"), links=links)
    assert more.first().verdict == "block"


def test_urls_ties_and_hot_urls(spark):
    """Of rules of equal length an allow wins; one url may hold most rows."""
    rules = (("block", "com/a/"), ("allow", "com/a/"), ("block", "z.com/b"), ("block", "org/"))
    rows = [(i, "http://h.org/x", "") for i in range(3000)] + [(9001, "http://q.com/a/1", ""), (9002, "http://z.com/b", ""), (9003, "http://www.h.org/x/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, Scratch(spark, "urls"), rules).collect()}
    assert len(got) == len(rows) and got[9001] == ("com/a/", "allow") and got[9002] == ("z.com/b", "block") and {got[i] for i in range(3000)} == {("org/", "block")}


def test_quality(spark, docs, empty):
    junk = [(500 + i, " ".join(w + "$$$" for w in prose(400 + i, 90).split()), "en", "s", 1) for i in range(6)] + [(600 + i, " ".join(w.upper() + "!!" for w in prose(450 + i, 90).split()), "en", "s", 1) for i in range(6)]
    df = docs.unionByName(spark.createDataFrame(junk, SCHEMA)).withColumn("votes", F.lit("clash"))
    found = quality.features(df, ["doc_id", "text"])
    for r in found.collect():
        t = r.doc.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = list(zip(w, w[1:], w[2:]))
        times, covered = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            covered |= {i, i + 1, i + 2} if times[g] > 1 else set()
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    kept = quality.keep_good(df)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and not ids & {d for d, *_ in junk} and set(range(10, 37)) <= ids
    assert quality.keep_good(empty).count() == 0


def test_quality_em_against_documents():
    """The same EM, a document at a time, in plain Python."""
    rng, n = random.Random(12), len(quality.RULES)
    docs_ = [[rng.choices((0, 1, 2), (0.5, 0.2, 0.3) if rng.random() < 0.2 else (0.02, 0.08, 0.9))[0] for _ in range(n)] for _ in range(400)]
    good = [0.2 ** v.count(0) for v in docs_]
    for _ in range(quality.ROUNDS):
        log = [[0.0, 0.0] for _ in docs_]
        for c in range(2):
            weight = [g if c else 1 - g for g in good]
            prior = (sum(weight) + 1) / (len(docs_) + 2)
            for d in range(len(docs_)):
                log[d][c] += np.log(prior)
            for k in range(n):
                votes = [quality.TRUST * quality.PRIOR[c][x] + sum(w for w, v in zip(weight, docs_) if v[k] == x) for x in range(3)]
                for d, v in enumerate(docs_):
                    log[d][c] += np.log(votes[v[k]] / sum(votes))
        good = [1.0 if 0 not in v else 1 / (1 + np.exp(a - b)) for v, (a, b) in zip(docs_, log)]
    patterns = [sum(x * 3**k for k, x in enumerate(v)) for v in docs_]
    posterior = quality.fit(list(collections.Counter(patterns).items()))
    assert np.allclose(posterior[patterns], good)
    assert any(g < 0.5 for g in good) and any(0.5 < g < 1 for g in good)


def test_quality_keeps_a_corpus_without_junk():
    """Documents that no rule votes against are kept, whatever they abstain on."""
    all_good = 3 ** len(quality.RULES) - 1
    posterior = quality.fit([(all_good, 500), (all_good - 1, 500), (all_good - 3, 400)])
    assert posterior[[all_good, all_good - 1, all_good - 3]].min() >= quality.KEEP


def test_quality_on_labels(spark):
    """Labelled rows past the base rules: good ones are kept, bad ones aren't."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.op10_quality(spark, folder).join(labels, "doc_id").where("not base_failed")
    n = {(r.quality_label, r.kept): r["count"] for r in judged.groupBy(labels["quality"].alias("quality_label"), "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.02 * n[0, False]


def test_quality_of_a_long_text(spark):
    long = prose(3, 400_000)
    rows = [(1, long, "en", "s", 1), (2, "word " * 300_000, "en", "s", 1)]
    got = {r.doc.doc_id: r for r in quality.features(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert got[1].n_words == len(WORD.findall(long)) and got[2].n_repeat_words == got[2].n_words == 300_000
