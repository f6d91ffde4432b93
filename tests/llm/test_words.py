"""Byte-pair encoding, phrases and runs of words, against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from windspark.llm import bpe, phrases, queries, runs, words

SF = "/root/testdata/sf0.001"


# --- words -----------------------------------------------------------------------------


def test_cut_and_spaced():
    texts = ["  one two\tone ", None, "", "three\n\nfour", "x"]
    w = words.cut(pa.array(texts), words.WHITE)
    names = [x.decode() for x in w.distinct.to_pylist()]
    got = [[names[i] for i in w.ids[a:b]] for a, b in zip(w.first, w.first[1:])]
    assert got == [["one", "two", "one"], [], [], ["three", "four"], ["x"]]
    assert words.spaced(w.distinct, w.ids, np.diff(w.first)).to_pylist() == [" ".join(g) for g in got]
    pieces = words.cut(pa.array(["A b. c,d e"]), words.byte_kinds(b" ", b".,"), words.LOWER)
    assert pieces.piece.tolist() == [0, 0, 1, 2, 2] and pieces.distinct.to_pylist()[0] == b"a"


@pytest.mark.parametrize("amount", [1, 7, 50, 10_000])
def test_by_size_keeps_rows(amount):
    rng = random.Random(amount)
    texts = [rng.choice([None, "", "ab", "x" * rng.randint(0, 30)]) for _ in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(texts[a:b], pa.string())], names=["i", "t"]) for a, b in ((0, 3), (3, 60), (60, 60), (60, 100))]
    out = list(words.by_size(iter(batches), 1, amount))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(100))
    assert all(sum(len(t or "") for t in b.column(1).to_pylist()) <= amount or b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()[1:]) == 0 for b in out)


# --- byte-pair encoding ----------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder(path):
    return bpe.WordCodec(bpe.load_tokenizer(path))


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def same_as_library(coder, library, texts):
    flat, at = coder.encode_all(texts)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert [coder.decode(w) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_bpe_on_every_character(coder, library):
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    same_as_library(coder, library, ["".join(every[a : a + 64]) for a in range(0, len(every), 64)])
    same_as_library(coder, library, ["a".join(every[a : a + 64]) for a in range(0, len(every), 64)])


def test_bpe_on_random_and_odd_strings(coder, library):
    rng = random.Random(3)
    kinds = ["abcde", "aab", "ththeeing", "'’stmd revl", "0123,.!-=", "éèàß漢字", "aA'S Ṭ́", ["<|startoftext|>", "<|endoftext|>", "<|", "a", " ", "'s"]]
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(0, 60))) for k in kinds for _ in range(500)]
    odd = [None, "", " ", "'", "'r", "l'", "'s's 'sfoo 'reX we'll 'll'l ''ll x'Re", "ΑΣ İ", "a\x85b\x1cc\x00d", "<|endoftext|>", "it'd've"]
    same_as_library(coder, library, texts + odd)
    same_as_library(coder, library, ["a" * 100_000, "=" * 20_000, "ab" * 5000 + "'s", "".join(rng.choice("theinga") for _ in range(50_000))])


def test_bpe_words_are_kept_for_two_spans_of_time(path, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    c = bpe.WordCodec(bpe.load_tokenizer(path))
    rng = random.Random(8)
    for _ in range(6):
        same_as_library(c, library, ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(5)])


def test_bpe_table(spark, odd_docs, path, library):
    got = bpe.encode(odd_docs, path).collect()
    data = odd_docs.select("doc_id", "text").collect()
    key = lambda x: (str(x[0]), str(x[1]))
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in data]
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    packed = bpe.encode(odd_docs, path, packed=True, decoded=False)
    assert packed.columns == ["doc_id", "ids"]
    unpack = lambda b: np.frombuffer(b, "<u4").tolist()
    assert sorted(((r.doc_id, unpack(r.ids)) for r in packed.collect()), key=key) == sorted(want, key=key)
    assert bpe.encode(odd_docs.limit(0), path).count() == 0


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError, AttributeError)):
        bpe.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


# --- phrases ---------------------------------------------------------------------------


def phrases_by_hand(data, least, most, part):
    f, n = Counter(), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    gone = set()
    for (lang, w), c in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * c >= part * f[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    out = set()
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.add((lang, " ".join(w), len(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Sea", "ÉTÉ", "x", "new", "York", "a", "b", "漢字", "it's"]
    rows = []
    for _ in range(n):
        w = [rng.choice(vocabulary[: rng.choice([3, 11])]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), "new York of the sea")
        text = "".join(x + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!x"]) for x in w)
        rows.append((rng.choice(["en", "de", None, "und", ""]), rng.choice([text] * 9 + [None])))
    return rows


@pytest.mark.parametrize("seed, least, most, part", [(1, 5, 5, 100), (2, 3, 3, 80), (3, 2, 4, 50), (4, 100, 5, 100)])
def test_phrases_by_hand(spark, monkeypatch, seed, least, most, part):
    monkeypatch.setattr(phrases, "BLOCK", 700)
    monkeypatch.setattr(phrases, "ENTRIES", 50)
    monkeypatch.setattr(phrases, "HOT", 30)
    monkeypatch.setattr(phrases, "HOT_SHARE", 50)
    data = corpus(seed)
    df = spark.createDataFrame([(t, l, 1, "p") for l, t in data], "text string, lang string, n int, prefix string").repartition(3)
    got = phrases.mine(df, least, most, part)
    assert {tuple(r) for r in got.collect()} == phrases_by_hand(data, least, most, part)


def test_phrases_on_odd_tables(spark, odd_docs):
    data = [(r.lang, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in phrases.mine(odd_docs, 4).collect()} == phrases_by_hand(data, 4, 5, 100)
    assert phrases.mine(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.mine(odd_docs, max_words=1)


def test_score_is_exact_past_64_bits(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(2000):
        a = rng.randint(100, 10**13)
        l, r = rng.randint(a, 2 * 10**13), rng.randint(a, 2 * 10**13)
        n = rng.randint(max(l, r), 10**15)
        if rng.random() < 0.5:  # whole quotients, and just under them
            q = max(1000 * a * n // (l * r), 1)
            n = max(-(-q * l * r // (1000 * a)) + rng.choice([0, -1]), 1)
        rows.append((a, [n, l], [r]))
    df = spark.createDataFrame(rows, "a long, first array<long>, rest array<long>")
    got = df.select("a", "first", "rest", F.expr(phrases.best_cut(1000)).alias("c")).collect()
    for x in got:
        assert x.c.score == 1000 * x.a * x.first[0] // (x.first[1] * x.rest[0])


def test_top_in_slices_is_top(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), f"p{k}", rng.randint(1, 9), rng.randint(1, 5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, score long, a long")
    monkeypatch.setattr(phrases, "SLICE", 10)
    got = {(r.lang, r["rank"], r.phrase) for r in phrases.top(df, 40).collect()}
    want = set()
    for lang in "abc":
        order = sorted((-s, -a, p) for g, p, s, a in rows if g == lang)
        want |= {(lang, k + 1, p) for k, (_, _, p) in enumerate(order[:40])}
    assert got == want


# --- runs ------------------------------------------------------------------------------


def runs_by_hand(w, least=24, times=3):
    best = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j
    return sorted((s, n, q) for (s, n), q in best.items())


def test_runs_by_hand():
    rng = random.Random(2)
    for _ in range(200):
        docs = []
        for _ in range(rng.randint(0, 6)):
            w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 250))]
            for _ in range(rng.randint(0, 4) if len(w) > 5 else 0):
                a, p = rng.randrange(len(w)), rng.randint(1, 40)
                for i in range(a + p, min(len(w), a + rng.randint(1, 150))):
                    w[i] = w[i - p]
            docs.append(w)
        least, times = rng.choice([(24, 3), (24, 3), (8, 3), (2, 3), (10, 4), (40, 5)])
        ids = np.array([x for d in docs for x in d], np.int64)
        first = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        want = [(t, *r) for t, d in enumerate(docs) for r in runs_by_hand(d, least, times)]
        assert runs.runs_of(ids, first, least, times) == want


def test_runs_of_long_texts_stay_cheap():
    one = lambda w: runs.runs_of(w, np.array([0, len(w)]))
    assert one(np.zeros(200_000, np.int64)) == [(0, 0, 200_000, 1)]
    assert one(np.arange(200_000) % 60_000) == [(0, 0, 200_000, 60_000)]
    passage = np.concatenate([np.append(np.arange(40), 1000 + k) for k in range(5000)])  # comes 5,000 times, never side by side
    assert one(passage) == []
    a, b = "0", "01"
    while len(b) < 20_000:
        a, b = b, b + a
    w = np.array(list(map(int, b)), np.int64)[:20_000]
    inside = lambda found: [r for r in found if r[0] + r[1] < 4000]
    assert inside([r[1:] for r in one(w)]) == inside(runs_by_hand(w[:4000].tolist()))


def test_packed_stripes_come_back():
    rng = random.Random(1)
    stripe = phrases.Stripes(
        pa.array([b"en", b"", "é".encode()], pa.large_binary()).slice(0, 3), pa.array([b"a b", b"", b"c"], pa.large_binary()), np.array([0, 3, 256]), np.array([2, 1, 4]),
        pa.array([b"x", b"", "é漢".encode()], pa.large_binary()), np.array([0, 1, 2, 0, 1, 2, 2]), np.array([rng.randint(1, 10**6) for _ in range(7)]),
    )
    back = phrases._unpacked(phrases._packed(stripe))
    assert back.lang.to_pylist() == stripe.lang.to_pylist() and back.prefix.to_pylist() == stripe.prefix.to_pylist()
    words = lambda s: s.words.take(pa.array(s.word)).to_pylist()
    assert words(back) == words(stripe) and back.counts.tolist() == stripe.counts.tolist() and back.part.tolist() == [0, 3, 256] and back.sizes.tolist() == [2, 1, 4]
    both = phrases.added([back, stripe])
    assert sorted(both.counts.tolist()) == sorted((2 * c for c in [*stripe.counts[:5], stripe.counts[5] + stripe.counts[6]]))


def query_by_hand(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    found = runs_by_hand(w)
    keep = [True] * len(w)
    for s, n, q in found:
        keep[s + q : s + n] = [False] * (n - q)
    from fractions import Fraction

    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (i, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for x, k in zip(w, keep) if k)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query(spark):
    data = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_runs(spark, SF).select(*COLUMNS).collect()
    key = lambda x: str(x)
    want = [query_by_hand(r.doc_id, r.text if len(r.text or "") < 20_000 else r.text) for r in data]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs > 0 for r in got) > 5


def test_runs_table(spark, odd_docs):
    data = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()] + [(77, "one two three " * 30 + "end")]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in data], "doc_id long, text string, n_words int, runs string").repartition(2)
    got = runs.find(df).collect()
    assert len(got) == len(data)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for r in got:
        texts = [t for i, t in data if i == r.doc_id]
        assert any(r.n_words == len(split(t)) and [tuple(x) for x in r.runs] == runs_by_hand(split(t)) for t in texts)
        if not r.runs:
            assert any(r.collapsed == " ".join(split(t)) for t in texts)
    assert next(r for r in got if r.doc_id == 77).collapsed == "one two three end"
    assert runs.find(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find(df, times=2)
