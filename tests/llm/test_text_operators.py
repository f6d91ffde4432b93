import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from windspark.llm import exact_dedup, minhash, mixing, personal, pieces, quality, queries, resharding, token_files, toxicity

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# --- exact dedup -----------------------------------------------------------------------


def groups_by_hand(data):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = {}
    for i, t in data:
        by.setdefault(strip(t), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (sorted(v, key=lambda x: x[:3])[0][3], len(v)) for k, v in by.items()}, strip


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_exact_groups(odd_docs, bits):
    data = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want, strip = groups_by_hand(data)
    got = exact_dedup.copy_groups(odd_docs, max_bits=bits).collect()
    assert len(got) == len(data)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == sha[r.text_sha256]
    assert sum(r.kept for r in got) == len(want)
    kept = exact_dedup.drop_copies(odd_docs, max_bits=bits)
    assert kept.columns == odd_docs.columns
    assert rows(kept, "doc_id") == sorted([(v[0],) for v in want.values()], key=str)


def test_exact_with_text_ids_and_maps(spark):
    rows = [("b", "x y", {"k": 1}), ("a", "xy", {}), (None, "x  y", None), ("c", "z", {"q": 2}), ("c", "z", {"q": 2})]
    df = spark.createDataFrame(rows, "doc_id string, text string, extra map<string,int>")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.copy_groups(df).collect()}
    assert got == {("b", None, 3), ("a", None, 3), (None, None, 3), ("c", "c", 2)}
    kept = exact_dedup.drop_copies(df).collect()
    assert sorted((r.doc_id, r.extra) for r in kept if r.doc_id) == [("c", {"q": 2})] and len(kept) == 2


@pytest.mark.parametrize("share, most", [(16, 0.03), (8, 0.08), (4, 0.2), (2, 0.5)])
def test_exact_filter_past_its_size(spark, share, most):
    """Shares of single rows marked, as the docstring states them."""
    n = 1 << 20
    df = spark.range(n // share * 2).select(F.xxhash64("id").alias("k"))
    table, bits = exact_dedup.repeated_slots(df, "k", max_bits=n * 2)
    assert exact_dedup.mark_in(df, "k", table, bits).where("_maybe").count() <= most * n // share * 2


def test_exact_filter_clears_single_rows(spark):
    df = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    table, bits = exact_dedup.repeated_slots(df.union(df.limit(10)), "k")
    marked = exact_dedup.mark_in(df, "k", table, bits)
    assert 10 <= marked.where("_maybe").count() < 100


# --- near dedup ------------------------------------------------------------------------


def near_by_hand(data):
    n = len(data)
    words = [minhash.word_hashes(t) for _, t in data]
    df = {}
    for w in words:
        for x in set(w.tolist()):
            df[x] = df.get(x, 0) + 1
    value = lambda x: np.log((1 + n) / (1 + max(df[x], n / minhash.RARE))) + 1

    sets = []
    for w in words:
        h, tf, x = minhash.shingles(w, np.array([value(y) for y in w.tolist()]))
        sets.append({k: (t, y) for k, t, y in zip(h.tolist(), tf.tolist(), x.tolist())})
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                both = sum(min(sets[i][k][0], sets[j][k][0]) * sets[i][k][1] for k in sets[i].keys() & sets[j].keys())
                total = sum(t * y for s in (sets[i], sets[j]) for t, y in s.values())
                if both >= 0.8 * (total - both) - 1e-9:
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("tiles", [{}, {"tile_rows": 2, "tile_shingles": 100}])
def test_near_classes(spark, odd_docs, tiles):
    import random

    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    extra = []
    for k in range(40):  # a chain of edits, so that classes join through their members
        base = list(base)
        for _ in range(1 if k % 10 else 40):
            base[rng.randrange(len(base))] = f"w{rng.randint(0, 400)}"
        extra.append((100 + k, " ".join(base)))
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    data = [(r.doc_id, r.text) for r in df.collect()]
    label = near_by_hand(data)
    got = {}
    out = minhash.near_classes(df, **tiles).collect()
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.class_id)
    for i, (doc, text) in enumerate(data):
        members = [d for (d, _), x in zip(data, label) if x == label[i] and d is not None]
        want = doc if not (text or "").split() else min(members, default=None)
        assert want in got[doc], doc
    named = [x for x, (_, t) in zip(label, data) if (t or "").split()]
    assert sum(r.kept for r in out) == len(set(named)) + len(data) - len(named)


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, in texts of any length."""
    import random

    rng = random.Random(3)
    gaps = [" ", "\n", "\u2003", "\t ", "\x1f", "\u3000"]
    texts = ["".join(rng.choice(["Ab", "c", "é\U0001f600", "ZZ"]) + rng.choice(["", *gaps]) for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(60)]
    texts += [None, "", " \n", "x" * 900, "x" * 90 + " " + "y z " * 90]
    seen: dict = {}
    for chars in (500_000, 100):
        monkeypatch.setattr(minhash, "_CHARS", chars)
        for t, h in zip(texts, minhash.hash_texts(texts)):
            words = (t or "").lower().split()
            assert len(words) == len(h)
            for w, x in zip(words, h.tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) > 60


def test_idf_is_exact_past_the_rare(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60) if i % (j + 1) == 0)) for i in range(500)], "doc_id long, text string")
    idf = minhash.document_frequencies(docs)
    want = [np.log(501 / (1 + sum(i % (j + 1) == 0 for i in range(500)))) + 1 for j in range(60)]
    np.testing.assert_allclose([idf[minhash.word_hashes(f"w{j}")][0] for j in range(60)], want)
    np.testing.assert_allclose(idf[minhash.word_hashes("unseen")], np.log(501 / (1 + 500 / minhash.RARE)) + 1)


def test_drop_near_copies(odd_docs):
    out = minhash.drop_near_copies(odd_docs)
    assert out.columns == odd_docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert 1 in ids and 3 not in ids and {5, 6, 7, 8, 9, 10} <= ids


def test_samples_agree_like_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rng.uniform(1, 5, 400)
    hits = []
    for share in (0.5, 0.8):
        n = int(400 * share)
        same = []
        for t in range(20):
            k = h * np.uint64(2 * t + 1) + np.uint64(t)
            same.append((minhash.sample(k[:n], w[:n]) == minhash.sample(k, w)).mean())
        hits.append((np.mean(same), w[:n].sum() / w.sum()))
    for got, want in hits:
        assert abs(got - want) < 0.06


# --- SentencePiece ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def test_pieces_equal_the_library(odd_docs, library):
    out = pieces.encode(odd_docs, queries.tokenizer_path()).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(out) == odd_docs.count()
    for r in out:
        want = library.encode(texts[r.doc_id] or "")
        assert r.ids == want and r.decoded == library.decode(want)


def test_pieces_on_random_strings(library):
    import random

    c, rng = pieces.Codec(pieces.load_vocabulary(queries.tokenizer_path())), random.Random(2)
    names = list(c.pieces)
    for k in range(4000):
        x = "".join(rng.choice(names) for _ in range(rng.randint(1, 7))) if k % 2 else "".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0x80, 0x24F), 0x2581, 0x20, 0x1F600])) for _ in range(rng.randint(0, 25)))
        ids = library.encode(x)
        assert c.encode(x) == ids and c.decode(ids) == library.decode(ids)
        assert not c.single.issuperset(x) or not x or b"".join(map(c._long_word, c.words_of(pieces.MARK + x.replace(" ", pieces.MARK)))) == np.array(ids, "<i4").tobytes()
        some = [rng.choice([rng.randint(3, 258), rng.randint(0, 31_999), 1, 2, 0]) for _ in range(5)]
        assert c.decode(some) == library.decode(some)


def test_empty_tables(spark, odd_docs):
    none = odd_docs.where("doc_id < -5")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        pieces.encode(none, queries.tokenizer_path()), exact_dedup.copy_groups(none), exact_dedup.drop_copies(none), minhash.near_classes(none),
        minhash.drop_near_copies(none), mixing.mix(none), mixing.mixed(none), resharding.reshard(none, 4, F.lit(0)),
        toxicity.score(none, toxicity.fit(none, labels)), quality.score(none, quality.fit(none, labels)),
        personal.find(none, personal.fit(personal.labelled_table(spark, 50))),
        token_files.count_tokens(token_files.pack(none, queries.tokenizer_path()).where("block_no is not null").select("file_id", "block_no", "ids")),
    ):
        assert df.count() == 0


def test_pair_test_is_plain_merging(library):
    import random

    c, rng = pieces.Codec(pieces.load_vocabulary(queries.tokenizer_path())), random.Random(6)
    names = list(c.pieces)
    few = [n for n in names if len(n) <= 3]
    for k in range(4000):
        a, b = rng.choice(few if k % 3 else names), rng.choice(few)
        assert c.fits(a, b) == (c.merged(a + b) == [a, b])


def test_words_are_kept_for_two_spans_of_time(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 10)
    c = pieces.Codec(pieces.load_vocabulary(queries.tokenizer_path()))
    for k in range(40):
        text = " ".join(f"word{k + j} common" for j in range(9))
        assert c.encode(text) == library.encode(text)
        assert len(c.words) <= 40


# --- token files -----------------------------------------------------------------------


def test_token_counts(odd_docs, library):
    files = token_files.pack(odd_docs, queries.tokenizer_path(), block_tokens=64).persist()
    counts = token_files.count_tokens(files.where("block_no is not null").select("file_id", "block_no", "ids"))
    names = files.where("doc_no is not null").select("file_id", "doc_no", "id")
    got = rows(counts.join(names, ["file_id", "doc_no"]), "id", "n_tokens")
    assert got == sorted([(r.doc_id, len(library.encode(r.text or ""))) for r in odd_docs.collect()], key=str)


def test_separators_on_block_borders(spark, tmp_path):
    rng = np.random.default_rng(1)
    for trial in range(8):
        ids = np.where(rng.random(50) < 0.3, 2, 9).astype("<u2")
        size = int(rng.integers(1, 9))
        (tmp_path / f"t{trial}").mkdir()
        (tmp_path / f"t{trial}" / "a.bin").write_bytes(ids.tobytes())
        blocks = token_files.read_blocks(spark, f"file://{tmp_path}/t{trial}", block_tokens=size)
        got = [(r.n_tokens, r.closed) for r in token_files.count_tokens(blocks.select("file_id", "block_no", "ids")).orderBy("doc_no").collect()]
        at = np.flatnonzero(ids == 2)
        want = [(int(n), True) for n in np.diff(np.append(-1, at)) - 1]
        left = len(ids) - 1 - (at[-1] if len(at) else -1)
        assert got == want + ([(int(left), False)] if left else [])


@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_id_widths_and_spans(spark, tmp_path, monkeypatch, width):
    """Wider ids, files past a span of blocks, several files."""
    monkeypatch.setattr(token_files, "SPAN", 3)
    rng = np.random.default_rng(width)
    want = {}
    for name, n in (("a", 400), ("b", 0), ("c", 7), ("d", 90)):
        ids = np.where(rng.random(n) < (0.05 if name == "a" else 0.5), 2, 9).astype(f"<u{width}")
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes())
        at = np.flatnonzero(ids == 2)
        own = [(int(x), True) for x in np.diff(np.append(-1, at)) - 1]
        left = n - 1 - (at[-1] if len(at) else -1)
        if own or left:
            want[name] = own + ([(int(left), False)] if left else [])
    blocks = token_files.read_blocks(spark, f"file://{tmp_path}", id_bytes=width, block_tokens=11)
    got = {}
    paths = blocks.select("file_id", F.regexp_extract("path", r"(\w)\.bin", 1).alias("name")).distinct()
    for r in token_files.count_tokens(blocks, id_bytes=width).join(paths, "file_id").orderBy("doc_no").collect():
        got.setdefault(r.name, []).append((r.n_tokens, r.closed))
    assert got == want


def test_cut_ids_are_an_error(spark):
    blocks = spark.createDataFrame([(1, 0, bytearray(b"\x02\x00\x09"))], "file_id int, block_no long, ids binary")
    with pytest.raises(Exception, match="whole ids"):
        token_files.count_tokens(blocks).collect()
    with pytest.raises(ValueError, match="do not fit"):
        token_files.pack(blocks.selectExpr("block_no as doc_id", "'a' as text"), queries.tokenizer_path(), id_bytes=1)


# --- mixing ----------------------------------------------------------------------------


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, left = sum(sizes.values()), dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    live = set(order)
    while left > 1e-9 and live:
        w = sum(weight[s] for s in live)
        for s in list(live):
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(live):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                live.discard(s)
    assert abs(sum(target.values()) - total) < 1e-6
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 2000, "c": 400, None: 30}, {"a": 5, "b": 5}, {"z": 0, "y": 7}, {None: 9}, {"a": 1, "b": 1, "c": 1, "d": 10**6}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    want = targets_by_hand(sizes)
    for r in mixing.source_targets(df).collect():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)


def test_mix(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = rows(mixing.mix(docs), "doc_id", "size", "target", "taken"), rows(mixing.mix(docs.repartition(5)), "doc_id", "size", "target", "taken")
    assert a == b
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r.t - r.x) <= 0.1 * r.x and r.over <= 0
    out = mixing.mix(odd_docs)
    assert out.count() == odd_docs.count()
    again = mixing.mixed(odd_docs)
    assert again.columns == odd_docs.columns
    assert again.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)))).first()[0] > 0


# --- resharding ------------------------------------------------------------------------


def test_flow_moves_fewest_bytes():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(30):
        shards = 3
        supply = [(int(rng.integers(0, 4)), int(rng.integers(0, 3)), float(rng.integers(1, 9))) for _ in range(4)]
        total = sum(n for _, n, _ in supply)
        capacity = [total // shards + (j < total % shards) for j in range(shards)]
        got = resharding.min_cost_flow(supply, capacity)
        cost = sum(n * supply[k][2] for k, j, n in got if j != supply[k][0])
        assert [sum(n for _, j, n in got if j == s) for s in range(shards)] == capacity
        units = [(h, c) for h, n, c in supply for _ in range(n)]
        best = min((sum(c for (h, c), j in zip(units, to) if h != j) for to in itertools.product(range(shards), repeat=len(units)) if [to.count(s) for s in range(shards)] == capacity), default=0)
        assert cost == pytest.approx(best)


def test_reshard(spark, odd_docs, tmp_path):
    import zlib

    old = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(3))
    out = resharding.reshard(odd_docs, 4, old).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    n = [len(v) for v in by.values()]
    assert max(n) - min(n) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sorted((r.size, r.text_crc32) for r in out) == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = resharding.reshard(docs, 4, F.pmod("doc_id", F.lit(3)))
    assert resharding.rewrite_affected(placed, docs, f"file://{tmp_path}/out") == [0, 1, 2, 3]
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == docs.count()


def test_smallest_rows_leave(spark):
    """Of a shard that must give rows away, the smallest go: the fewest bytes for the capacities."""
    rows = [(i, "x" * (i * 37 % 101)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = resharding.reshard(docs, 2, F.when(F.col("doc_id") < 90, 0).otherwise(1)).collect()
    sizes = sorted(r.size for r in out if r.old_shard == 0)
    assert sorted(r.size for r in out if r.old_shard == 0 and r.shard == 1) == sizes[:40]
    assert all(r.shard == 1 for r in out if r.old_shard == 1)


def test_rewrite_leaves_other_shards_untouched(spark, tmp_path):
    """Four shards of which two trade rows, then one that empties; null and repeated ids included."""
    from windspark.llm.common import row_keys

    path = f"file://{tmp_path}/out"
    rows = [(None if i % 7 == 0 else i // 2, f"text {i}", i % 4 if i < 40 else 0) for i in range(48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int")
    keyed = row_keys(docs)
    first = keyed.select("_key", F.lit(10).cast("long").alias("size"), F.lit(-1).alias("old_shard"), F.col("old").alias("shard"), F.col("_key").alias("slot"))
    assert resharding.rewrite_affected(first, keyed, path, row_key="_key") == [-1, 0, 1, 2, 3]
    files = {f: f.stat().st_mtime_ns for s in (2, 3) for f in (tmp_path / "out" / f"shard={s}").iterdir()}
    now = row_keys(spark.read.parquet(path))
    moved = now.select("_key", F.lit(10).cast("long").alias("size"), F.col("shard").alias("old_shard"), F.when((F.col("shard") == 0) & (F.col("_key") % 3 == 0), 1).otherwise(F.col("shard")).alias("shard"), F.col("slot"))
    assert resharding.rewrite_affected(moved, now, path, row_key="_key") == [0, 1]
    again = spark.read.parquet(path)
    assert rows_of(again) == rows_of(docs) and files == {f: f.stat().st_mtime_ns for f in files}
    left = row_keys(spark.read.parquet(path))
    gone = left.select("_key", F.lit(10).cast("long").alias("size"), F.col("shard").alias("old_shard"), F.when(F.col("shard") == 3, 2).otherwise(F.col("shard")).alias("shard"), F.col("slot"))
    assert resharding.rewrite_affected(gone, left, path, row_key="_key") == [2, 3]
    end = spark.read.parquet(path)
    assert rows_of(end) == rows_of(docs) and {r.shard for r in end.collect()} == {0, 1, 2}


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_ranks_are_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    for r in resharding.ranked(df, ["g"], [F.col("id")], "r", slice_rows=7).groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("r").alias("d"), F.max("r").alias("m")).collect():
        assert r.n == r.d == r.m + 1


# --- personal data ---------------------------------------------------------------------


def base_by_hand(t):
    luhn = lambda d: sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub(r"\D", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x.lstrip("0")[:9] or 0) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans():
    import random

    rng = random.Random(7)
    parts = ["a.b", "@", "x-1.example.com", "..", " ", "1.2.3.4", "300", ".", "4111 1111-1111 1111", "4111111111111111", "+1 (555) 010-9999", "+", "(", "-", "7", "\n", "é", "12"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert personal.base_spans(t) == base_by_hand(t), t
    assert personal.base_spans(None) == [] and personal.base_spans("a" * 200_000 + "@") == []
    personal.base_spans("1" * 100_000)


def test_personal_takes_any_digits(spark):
    """More leading zeros than Python turns into a number, and a megabyte of digits, through the query's operator."""
    texts = ["0" * 5000 + "7.1.1.1", "1." + "0" * 6000 + "255.3.4 x", "9" * 3000, "1.2.3." + "4" * 5000, "+" + "1" * 5000, ("12 " * 500) + "@a.b"]
    df = spark.createDataFrame([*enumerate(texts), (9, "9" * 1_000_000)], "doc_id long, text string")
    out = {r.doc_id: [(personal.KINDS.index(s.kind), s.start, s.end) for s in r.spans if s.base] for r in personal.find(df, personal.fit(personal.labelled_table(spark))).collect()}
    assert out.pop(9) == [] and out == {i: base_by_hand(t) for i, t in enumerate(texts)}
    assert out[0] == [(1, 0, 5007)] and (1, 0, 6009) in out[1]


def test_personal_query(spark):
    out = queries.op5_personal(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out:
        want = [f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in base_by_hand(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_field_learns_shapes():
    rows = []
    for k in range(60):
        words = ["call", f"+1-555-{1000 + k}", "or", f"mail{k}@host.org", "now", f"v{k}"]
        rows.append((personal._features(words), [0, 4, 0, 1, 0, 0]))
    m = personal.train(rows)
    words = ["see", "+1-555-9876", "and", "zz9@other.net"]
    emit = np.array([m["w"][[m["features"][x] for x in f if x in m["features"]]].sum(0) for f in personal._features(words)])
    assert personal.viterbi([emit, emit[:1]], m["step"])[0].tolist() == [0, 4, 0, 1]


def test_field_on_unseen_sentences(spark):
    """Held-out sentences by the same rules with another seed: spans found and numbers left alone."""
    model = personal.fit(personal.labelled_table(spark))
    rows = [(i, r.text, {(s["kind"], s["start"]) for s in r.spans}) for i, r in enumerate(personal.labelled_table(spark, 400, seed=5).collect())]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    hit = miss = extra = 0
    for r in personal.find(docs, model).collect():
        want = rows[r.doc_id][2]
        text = rows[r.doc_id][1]
        word = lambda at: text.rfind(" ", 0, at) + 1
        got = {(s.kind, word(s.start)) for s in r.spans if s.kind != "card"}
        hit, miss, extra = hit + len(want & got), miss + len(want - got), extra + len(got - want)
    assert hit >= 0.93 * (hit + miss) and extra <= 0.07 * hit


def test_field_finds_planted_secrets(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = {i for i, t in texts.items() if re.search(r'token = "[0-9a-f]{40}"', t)}
    found, secrets = set(), set()
    for r in personal.find(docs, personal.fit(personal.labelled_table(spark))).collect():
        for s in r.spans:
            if not s.base:
                found.add(r.doc_id)
                secrets |= {r.doc_id} if re.fullmatch("[0-9a-f]{40}", texts[r.doc_id][s.start : s.end]) else set()
    assert len(planted) > 10 and len(planted & secrets) >= 0.9 * len(planted)
    assert len(found - planted) <= 0.01 * len(texts)


def test_field_reads_whole_words_and_texts(spark):
    """Two words that differ past their first thousand characters; a text longer than any in training."""
    long = "ab12" * 300
    assert personal._shape(long) != personal._shape(long + "-@x.org")
    text = "lorem ipsum " * 4000 + 'api token = "' + "0a1b2c3d4e" * 4 + '" end'
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = personal.find(docs, personal.fit(personal.labelled_table(spark))).collect()
    assert [(s.kind, text[s.start : s.end]) for s in r.spans] == [("secret", "0a1b2c3d4e" * 4)]
    train = spark.createDataFrame([("lorem " * 5000 + "zz 12-34", [("identity", 30003, 30008)])], personal.labelled_table(spark, 1).schema)
    assert personal.fit(train)["features"]


def test_viterbi_is_best_path():
    import itertools

    rng = np.random.default_rng(0)
    step = rng.normal(size=(3, 3))
    emits = [rng.normal(size=(n, 3)) for n in (1, 4, 2, 5)]
    for e, got in zip(emits, personal.viterbi(emits, step)):
        value = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))
        assert tuple(got) == max(itertools.product(range(3), repeat=len(e)), key=value)


# --- classifiers -----------------------------------------------------------------------


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 6)) < 0.3).astype(np.float32)
    grade = np.minimum(x[:, :3].sum(1).astype(int), 3)
    w, theta = toxicity.fit_ordinal(x, grade, np.ones(600))
    assert (np.diff(theta) > 0).all() and (w[:3] > 2).all() and (np.abs(w[3:]) < 1).all()
    severity = toxicity._sigmoid((x @ w)[:, None] - theta).sum(1)
    assert np.corrcoef(severity, grade)[0, 1] > 0.97


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.8), ("sf0.1", 0.9)])
def test_toxicity_on_labels(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    marked = toxicity.score(docs, model).persist()
    held = labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("lab"))
    found = {(x.flag, x["lab"]): x["count"] for x in marked.withColumnRenamed("toxic", "flag").join(held, "doc_id").groupBy("flag", "lab").count().collect()}
    assert found.get((True, 0), 0) <= 1 and found[True, 1] >= least * (found[True, 1] + found.get((False, 1), 0))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == marked.where("not toxic").count()


def test_toxicity_features():
    assert toxicity.features("Shared shares SHARE 12 é") == {
        "shared", "shares", "share", "é", "^shar", "2^shar", "3^shar", "^share", "2^share"}
    assert toxicity.features(None) == toxicity.features("") == set()
    words = {f: 2.0 ** -k for k, f in enumerate(sorted(toxicity.features("Shared shares SHARE é other others")))}
    total = toxicity._scorer(words)
    for text in ("share", "shares, shared!", "other shared", "others shared other", "calm", "", None):
        assert total(text) == sum(words.get(f, 0) for f in toxicity.features(text))


def test_folds_never_see_their_own_labels(spark):
    """A word that only fold 0's toxic documents hold is no feature of the model that scores fold 0."""
    rows = [(k % 2, int(k < 40), f"plain {'bad' if k < 40 and k % 2 == 0 else 'good'} w{k % 3}") for k in range(120)]
    whole, zero, one = toxicity.choose_features(spark.createDataFrame(rows, "fold int, y int, text string"))
    assert "bad" in whole and "bad" not in zero and "bad" in one
    x = np.array([[float("bad" in t)] for _, _, t in rows], np.float32)
    y, fold = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    out = toxicity.cross_fitted(x, y, np.ones(120), fold, [[], [0]])
    assert (out[fold == 0] == 0).all()


def test_toxicity_query_by_brute_force(spark):
    """Every score of the query from the model's weights, feature by feature; long joined words too."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    long = "qx" * 40
    rows = [(10_000_000 + i, f"calm words here {long if i % 2 else 'fine'} {i}") for i in range(60)]
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = labels.select("doc_id", "toxic").union(spark.createDataFrame([(i, (i % 2)) for i, _ in rows], "doc_id long, toxic int"))
    model = toxicity.fit(more, marks)
    assert long in model["words"] and model["words"][long] > 0
    texts = {r.doc_id: r.text for r in docs.collect()} | dict(rows)
    for r in toxicity.score(more.where("doc_id >= 10000000").union(docs.select("doc_id", "text")), model).collect():
        s = sum(model["words"].get(f, 0.0) for f in toxicity.features(texts[r.doc_id]))
        p = 1 / (1 + np.exp(np.array(model["theta"]) - s))
        assert r.p_toxic == pytest.approx(p[0]) and r.severity == pytest.approx(p.sum()) and r.toxic == (s >= model["theta"][0])


def test_sample_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(200)] + [(2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(r.id for r in toxicity.fit_sample(docs, labels, "toxic").collect()) == [1, 2]


def test_quality_query_by_brute_force(spark):
    """Every score from the model by enumeration of the chain's labels (documents of few lines)."""
    import itertools

    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of {i} !!" * (1 + (i + j) % 3) for j in range(i % 7))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs, m).collect():
        x, size, _ = quality.line_features([texts[r.doc_id]])
        e = np.column_stack([np.zeros(len(x)), x @ m["w"]])
        total, good = 0.0, np.zeros(len(x))
        for p in itertools.product((0, 1), repeat=len(x)):
            v = np.exp(sum(e[i, k] for i, k in enumerate(p)) + sum(m["step"][a, b] for a, b in zip(p, p[1:])))
            total, good = total + v, good + v * np.array(p)
        mean = (good / total * size).sum() / size.sum()
        assert r.score == pytest.approx(1 / (1 + np.exp(-(m["a"] * mean + m["b"]))))


def test_quality_bounds_long_documents(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"row {j}" for j in range(5000 if i == 3 else 5))) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    m = quality.fit(docs, labels, segment=10, doc_segments=3)
    assert quality.score(docs, m).count() == 8


def test_quality_in_stretches_of_bytes(monkeypatch):
    """Scores by stretches and odds equal those of all features at once and the plain chain, wherever the cuts fall."""
    rng = np.random.default_rng(4)
    alphabet = list("aB3 .,#é\n\n\t")
    texts = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 400, 60)] + [None, "", "\n" * 50, "word " * 300, "x" * 900]
    x, size, first = quality.line_features(texts)
    w, step = rng.normal(0, 1.5, x.shape[1]), rng.normal(0, 1, (2, 2))
    plain, _ = quality.marginals(np.column_stack([np.zeros(len(x)), x @ w]), step, first)
    for chunk in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        assert np.array_equal(x, quality.line_features(texts)[0])
        score, weight, start = quality.line_scores(texts, w)
        assert np.allclose(score, x @ w, rtol=0, atol=1e-9) and np.array_equal(weight, size) and np.array_equal(start, first)
        assert np.allclose(quality.line_odds(score, step, start), plain, rtol=0, atol=1e-9)
    far = quality.line_odds(np.array([1e4, -1e4, 1e4, 0.0]), step, np.array([0, 2, 4]))
    assert np.isfinite(far).all() and far[0] > 0.99 and far[1] < 0.01


def test_quality_slices_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(quality, "SLICE", 10)
    texts = ["abcd", None, "efgh", "ij", "k" * 40, "", "l", "m" * 10, "n"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = [p.column(0).to_pylist() for p in quality._parts(batch, 0)]
    assert parts == [["abcd", None, "efgh", "ij"], ["k" * 40], ["", "l"], ["m" * 10], ["n"]]


def test_quality_memory_of_a_long_text():
    """A text of 50 MB costs a bounded multiple of its size, in short lines and in one line."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np
from windspark.llm import quality
w, step = np.ones(quality.line_features([""])[0].shape[1]) * 0.01, np.zeros((2, 2))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = {text}
mean = quality.document_means(*quality.line_scores([text], w), step)
assert len(mean) == 1 and 0 < mean[0] < 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    for text in ("'a line of forty letters, more or less...\\n' * 1250000", "'some words on one line ' * 2200000"):
        out = subprocess.run([sys.executable, "-c", code.replace("{text}", text)], capture_output=True, text=True, check=True)
        assert int(out.stdout) < 600


def test_chain_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    step = rng.normal(size=(2, 2))
    lengths = [1, 3, 5]
    emit = rng.normal(size=(sum(lengths), 2))
    first = np.append(0, np.cumsum(lengths))
    good, _ = quality.marginals(emit, step, first)
    for a, b in zip(first, first[1:]):
        total, each = 0.0, np.zeros(b - a)
        for p in itertools.product((0, 1), repeat=b - a):
            v = np.exp(sum(emit[a + i, x] for i, x in enumerate(p)) + sum(step[x, y] for x, y in zip(p, p[1:])))
            total += v
            each += v * np.array(p)
        np.testing.assert_allclose(good[a:b], each / total)


def test_quality_held_out(spark, odd_docs):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op10_quality(spark, sf)
    got = out.join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = quality.score(odd_docs, quality.fit(docs, labels)).collect()
    assert len(s) == odd_docs.count() and all(0 <= r.score <= 1 for r in s)
