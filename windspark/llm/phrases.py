"""Phrase collocations by stripes.

Each prefix of k words keys a counter of the words that follow it. Tasks make stripes of blocks of
text and pack those of one bucket of prefixes into one compressed record; equal prefixes meet in a
shuffle by bucket and their counters are added elementwise. One merged stripe gives the prefix's total (its frequency), its frequent extensions (the phrases of k + 1 words) and
the largest extension, which tells whether a longer phrase subsumes it. The first stripe, of the
empty prefix, gives the words and the number of all words.

A phrase is frequent only if the phrases without its last and without its first word are, so a
pass counts an extension only where a Bloom filter knows both; the filter is at most 16 MB, lets
more through when it fills up, and never drops a frequent phrase: counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, filter_bits, slot_bitmap, stored
from .pieces import Shared
from .words import LOWER, byte_kinds, by_size, cut, spaced, values_of

#: Fixed by contract: what stands between words, and between pieces that phrases never cross.
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bytes of text whose stripes a task makes together, and entries that it adds up together.
BLOCK, ENTRIES = 8_000_000, 1_000_000
#: Words of the corpus for each bucket of prefixes; buckets at least and at most.
BUCKET_WORDS, BUCKETS = 3_000_000, (32, 100_000)
#: Stripes of hot prefixes are kept in parts by the next word, at most so many.
PARTS = 256
#: A prefix is hot from this many occurrences on, and from this share of all words; so at most 20,000 are.
#: It has a part for each so many occurrences: fewer would cut stripes up that fit in a task.
HOT, HOT_SHARE = 5_000_000, 20_000

#: Phrases of a slice when the first ones of a language are found.
SLICE = 100_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit numbers of words: polynomials of their bytes, mixed. A clash lets a phrase through the filter, no more."""
    if not len(words):
        return np.zeros(0, np.uint64)
    data, offsets = values_of(words)
    sizes = np.diff(offsets)
    data = data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(sizes.max()), _M1)))
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sums = np.append(np.uint64(0), np.cumsum(data * powers[at]))
    h = np.diff(sums[np.append(0, np.cumsum(sizes))]) ^ sizes.astype(np.uint64)
    return _next_hash(np.full(len(h), _M2), h)


def _next_hash(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _M1
    return (h ^ (h >> np.uint64(31))) * _M2


def _hashes_of(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """64-bit numbers of (lang, phrase), as the passes over texts compute them."""
    w = cut(phrases, byte_kinds(BLANKS))
    h = _word_hashes(langs.cast(pa.large_binary()))
    words = _word_hashes(w.distinct)
    sizes = np.diff(w.first)
    for j in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > j)
        h[at] = _next_hash(h[at], words[w.ids[w.first[at] + j]])
    return h


class Filter:
    """Phrases of one length that may be frequent, and the hot ones, for tasks."""

    def __init__(self, bits: int, bitmap: bytes, hot: dict[int, int]):
        self.bits, self.bitmap = bits, np.frombuffer(bitmap, np.uint8)
        self.hot = np.array(sorted(hot), np.uint64)
        self.parts = np.array([hot[h] for h in sorted(hot)], np.int64)

    def parts_of(self, h: np.ndarray) -> np.ndarray:
        """Parts of the stripes of these phrases, 0 if they are not hot."""
        if not len(self.hot):
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(self.hot, h)
        return np.where(self.hot[np.minimum(at, len(self.hot) - 1)] == h, self.parts[np.minimum(at, len(self.hot) - 1)], 0)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for shift in (0, 34):
            at = (h >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def _filter_of(rows: DataFrame, hot_from: int) -> Filter:
    """Filter of the (lang, phrase, a) in ``rows``: at most 16 MB, and at most 20,000 numbers of hot phrases."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hashes_of(b.column(0), b.column(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(2)], names=["h", "a"])

    hashed = stored(rows.select("lang", "phrase", "a").mapInArrow(run, "h long, a long"))
    bits = filter_bits(hashed.count())
    slots = hashed.select(F.explode(F.expr(f"array((h & {bits - 1}) + 1, (shiftrightunsigned(h, 34) & {bits - 1}) + 1)")).alias("slot"))
    bitmap = bytearray(bits // 8)
    for bucket, part in slot_bitmap(slots).collect():
        bitmap[4096 * (bucket - 1) : 4096 * bucket] = part
    hot = {r.h % (1 << 64): min(PARTS, 1 + r.a // hot_from) for r in hashed.where(F.col("a") > hot_from).collect()}
    dropped(hashed)
    return Filter(bits, bytes(bitmap), hot)


def _pairs(a: np.ndarray, b: np.ndarray, **more):
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, **more)


class Stripes(NamedTuple):
    """Stripes in arrays: by stripe lang, prefix, part and number of entries; by entry a place in ``words`` and a count."""

    lang: pa.Array
    prefix: pa.Array
    part: np.ndarray
    sizes: np.ndarray
    words: pa.Array
    word: np.ndarray
    counts: np.ndarray


def _packed(s: Stripes) -> bytes:
    """One compressed record; each word that follows is written once."""
    langs, words = s.lang.dictionary_encode(), s.words.take(pa.array(s.word)).dictionary_encode()
    parts = [np.asarray(langs.indices), s.part, s.sizes, np.asarray(words.indices), s.counts]
    for strings in (langs.dictionary, s.prefix, words.dictionary):
        data, offsets = values_of(strings)
        parts += [np.diff(offsets), data[offsets[0] : offsets[-1]]]
    out = [np.array([len(p) for p in parts], np.int32).tobytes()]
    out += [p.astype(np.uint8 if k in (6, 8, 10) else np.int32).tobytes() for k, p in enumerate(parts)]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(record: bytes) -> Stripes:
    raw = pa.decompress(record[8:], int.from_bytes(record[:8], "little"), "zstd", asbytes=True)
    at, parts = 44, []
    for k, n in enumerate(np.frombuffer(raw, np.int32, 11).tolist()):
        parts.append(np.frombuffer(raw, np.uint8 if k in (6, 8, 10) else np.int32, n, at))
        at += n * (1 if k in (6, 8, 10) else 4)
    strings = []
    for sizes, data in (parts[5:7], parts[7:9], parts[9:11]):
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        strings.append(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]))
    return Stripes(strings[0].take(pa.array(parts[0])), strings[1], parts[1].astype(np.int64), parts[2].astype(np.int64), strings[2], parts[3].astype(np.int64), parts[4].astype(np.int64))


def _block_stripes(langs: pa.Array, texts: pa.Array, k: int, known: Filter | None, buckets: int) -> Iterator[tuple[int, Stripes]]:
    """(bucket, stripes of prefixes of ``k`` words) of one block.

    The next word '' counts the occurrences that nothing counted follows, so that a
    stripe's sum is the frequency of its prefix.
    """
    w = cut(texts, byte_kinds(BLANKS, BREAKS), LOWER)
    ids, n = w.ids, len(w.ids)
    if not n:
        return
    lang_of = langs.cast(pa.large_binary()).dictionary_encode()
    lang = np.repeat(lang_of.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(w.first))
    word_hash, h = _word_hashes(w.distinct), _word_hashes(lang_of.dictionary)[lang]
    if k == 0:
        starts, follow, code = np.arange(n), ids, lang
        parts = np.full(n, PARTS)
    else:
        h = h[: max(n - k + 1, 0)]  # places where k words are left
        for j in range(k):
            h = _next_hash(h, word_hash[ids[j : j + len(h)]])
        ok = known.holds(h)
        if k > 1:
            ok &= w.piece[k - 1 :][: len(h)] == w.piece[: len(h)]
        starts = np.flatnonzero(ok)
        follow = np.full(len(starts), -1, np.int64)
        more = starts + k < n
        more[more] = ok[np.minimum(starts[more] + 1, len(ok) - 1)] & (w.piece[starts[more] + k] == w.piece[starts[more]])
        follow[more] = ids[starts[more] + k]
        code = lang[starts]
        for j in range(k):
            code = _pairs(code, ids[starts + j], return_inverse=True)[1]
        parts = known.parts_of(h[starts])
    _, one, counts = _pairs(code, follow + 1, return_index=True, return_counts=True)
    code, follow, parts = code[one], follow[one], parts[one]
    part = np.where(parts > 0, 1 + (word_hash[follow] % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), 0)
    part[follow < 0] = parts[follow < 0] > 0  # the rest of a hot prefix lies in its part 1
    bucket = (_next_hash(h[starts[one]], part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((part, code, bucket))
    one, code, follow, part, counts, bucket = one[by], code[by], follow[by], part[by], counts[by], bucket[by]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])) if len(code) else np.zeros(0, bool))
    row = starts[one[new]]
    prefix = spaced(w.distinct, ids[(row[:, None] + np.arange(k)).ravel()], np.full(len(row), k)).cast(pa.large_binary())
    names = lang_of.dictionary.take(pa.array(lang[row]))
    words = pa.concat_arrays([w.distinct, pa.array([b""], pa.large_binary())])
    follow = np.where(follow < 0, len(w.distinct), follow)
    ends = np.append(new, len(code))
    first = np.flatnonzero(np.append(True, bucket[new][1:] != bucket[new][:-1]) if len(new) else np.zeros(0, bool))
    for a, b in zip(first, np.append(first[1:], len(new))):
        entries = slice(ends[a], ends[b])
        yield int(bucket[new[a]]), Stripes(names.slice(a, b - a), prefix.slice(a, b - a), part[new[a:b]], np.diff(ends[a : b + 1]), words, follow[entries], counts[entries])


def stripes(docs: DataFrame, k: int, known: Filter | None, buckets: int) -> DataFrame:
    """(bucket, packed stripes) of all blocks of ``docs`` (lang, text), not yet merged."""
    shared = Shared(docs.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_size(batches, 1, BLOCK):
            rows = [(b, _packed(s)) for b, s in _block_stripes(block.column(0), block.column(1), k, shared.value, buckets)]
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int32()), pa.array([x for _, x in part], pa.binary())], names=["bucket", "stripes"])

    return docs.mapInArrow(run, "bucket int, stripes binary")


def added(held: list[Stripes]) -> Stripes:
    """All stripes sorted by key, the counters of one key added elementwise."""
    langs = pa.concat_arrays([s.lang for s in held]).dictionary_encode()
    prefixes = pa.concat_arrays([s.prefix for s in held]).dictionary_encode()
    words = pa.concat_arrays([s.words for s in held]).dictionary_encode()
    places = words.indices.to_numpy().astype(np.int64)
    shift = np.cumsum([0, *(len(s.words) for s in held)])
    word = np.concatenate([places[shift[i] + s.word] for i, s in enumerate(held)])
    code = langs.indices.to_numpy().astype(np.int64) * len(prefixes.dictionary) + prefixes.indices.to_numpy()
    code = code * (PARTS + 1) + np.concatenate([s.part for s in held])
    keys, first, at = np.unique(code, return_index=True, return_inverse=True)
    entry = np.repeat(at, np.concatenate([s.sizes for s in held])) * (len(words.dictionary) + 1) + word
    counts = np.concatenate([s.counts for s in held])
    by = np.argsort(entry, kind="stable")
    entry = entry[by]
    new = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
    sums = np.add.reduceat(counts[by], new)
    of, word = entry[new] // (len(words.dictionary) + 1), entry[new] % (len(words.dictionary) + 1)
    take = lambda x: x.dictionary.take(x.indices.take(pa.array(first)))
    return Stripes(take(langs), take(prefixes), keys % (PARTS + 1), np.bincount(of, minlength=len(keys)), words.dictionary, word, sums)


def _finished(s: Stripes, min_count: int) -> pa.RecordBatch:
    at = np.append(0, np.cumsum(s.sizes))
    none = pc.equal(s.words, pa.scalar(b"", pa.large_binary())).to_numpy(zero_copy_only=False)[s.word]
    total = np.add.reduceat(s.counts, at[:-1])
    best = np.maximum.reduceat(np.where(none, 0, s.counts), at[:-1])
    keep = ~none & (s.counts >= min_count)
    offsets = pa.array(np.append(0, np.cumsum(keep))[at].astype(np.int32))
    nexts = s.words.take(pa.array(s.word[keep])).cast(pa.binary()).cast(pa.string())
    text = [x.cast(pa.binary()).cast(pa.string()) for x in (s.lang, s.prefix)]
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (nexts, pa.array(s.counts[keep]))]
    out = pa.RecordBatch.from_arrays([*text, pa.array(s.part.astype(np.int32)), pa.array(total), pa.array(best), *lists], names=["lang", "prefix", "part", "total", "best", "nexts", "counts"])
    return out.filter(pa.array((s.part > 0) | (total >= min_count)))


def merged(pieces: DataFrame, min_count: int) -> DataFrame:
    """One row per prefix (and part): total, best extension, extensions of at least ``min_count`` with their counts.

    A task holds the different entries of one bucket, not its records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Stripes] = []
        now, n, most = None, 0, ENTRIES
        for batch in batches:
            for bucket, record in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    yield _finished(added(held), min_count)
                    held, n, most = [], 0, ENTRIES
                now = bucket
                held.append(_unpacked(record.as_buffer().to_pybytes()))
                n += len(held[-1].word)
                if n > most:
                    held = [added(held)]
                    n = len(held[0].word)
                    most = max(ENTRIES, 2 * n)  # a bucket of many entries still takes new ones in bulk
        if held:
            yield _finished(added(held), min_count)

    kind = "lang string, prefix string, part int, total long, best long, nexts array<string>, counts array<bigint>"
    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, kind)


def _lookup(df: DataFrame, by: str, table: DataFrame, hot_from: int) -> DataFrame:
    """Inner join of ``df`` with ``table`` (lang, phrase, a, ...) on (lang, ``by``).

    The phrases of over ``hot_from`` occurrences, of which there are at most 20,000, are
    broadcast, so that no frequent word is a hot key of the other join.
    """
    keyed = table.withColumnRenamed("phrase", by)
    hot, cold = keyed.where(F.col("_a") > hot_from), keyed.where(F.col("_a") <= hot_from)
    rest = df.join(F.broadcast(hot.select("lang", by)), ["lang", by], "left_anti")
    return df.join(F.broadcast(hot), ["lang", by]).unionByName(rest.join(cold, ["lang", by]))


def mine(
    docs: DataFrame, min_count: int = 100, max_words: int = 5, subsumed: int = 100, scale: int = 1000,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the frequent phrases that no longer one subsumes.

    Per language (null: ``und``): ``n`` words; ``a``, the occurrences of a phrase of 2 to
    ``max_words`` words inside pieces, at least ``min_count``; of all cuts in two the one
    with the lowest floor(scale * a * n / (l * r)), of equals the one with the shortest first part. A
    phrase goes if a longer frequent one that holds it has at least ``subsumed`` % of its occurrences.

    Null and empty texts have no words. Repeated rows count each time. An empty table gives
    no phrases. Other columns, whatever their names, are not read. Texts of any length are read whole.
    Products are decimals of 38 digits: exact for up to 10^17 words.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words and one occurrence at least")
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    known, levels, temporary = None, [], []
    hot_from, buckets = HOT, PARTS
    for k in range(max_words):
        found = stored(merged(stripes(texts, k, known, buckets), min_count))
        temporary.append(found)
        if k == 0:
            before = found.groupBy("lang").agg(F.sum("total").alias("a")).select(
                "lang", F.lit("").alias("phrase"), "a", F.expr("cast(array() as array<bigint>)").alias("first"), F.expr("cast(array() as array<bigint>)").alias("rest")
            )
            n = found.agg(F.sum("total")).head()[0] or 0
            hot_from, buckets = max(HOT, n // HOT_SHARE), min(max(BUCKETS[0], n // BUCKET_WORDS), BUCKETS[1])
        else:
            best = found.groupBy("lang", "prefix").agg(F.max("best").alias("right")).withColumnRenamed("prefix", "phrase")
            levels[-1] = levels[-1].join(best, ["lang", "phrase"], "left")
        # a stripe meets the row of its own prefix, so this join has no hot key
        rows = found.where(F.size("nexts") > 0).join(before.withColumnRenamed("phrase", "prefix"), ["lang", "prefix"]).select(
            "lang", "prefix", F.concat("first", F.array("a")).alias("first"), F.explode(F.arrays_zip("nexts", "counts")).alias("e")
        ).select("lang", F.concat_ws(" ", F.when(F.col("prefix") != "", F.col("prefix")), "e.nexts").alias("phrase"), F.col("e.counts").alias("a"), "first")
        if k:
            rows = rows.withColumn("tail", F.expr("substr(phrase, instr(phrase, ' ') + 1)"))
            tails = before.select("lang", "phrase", F.col("a").alias("_a"), F.concat("rest", F.array("a")).alias("rest"))
            rows = _lookup(stored_in(temporary, rows), "tail", tails, hot_from).drop("_a")
        else:
            rows = rows.withColumn("rest", F.expr("cast(array() as array<bigint>)"))
        rows = stored_in(temporary, rows)
        if k:
            left = rows.groupBy("lang", F.col("tail").alias("phrase")).agg(F.max("a").alias("left"))
            levels[-1] = levels[-1].join(left, ["lang", "phrase"], "left")
        if rows.isEmpty():
            break
        levels.append(rows)
        before = rows
        if k + 1 < max_words:
            known = _filter_of(rows, hot_from)
    none = F.lit(None).cast("long")
    out = None
    for rows in levels[1:]:
        for c in ("left", "right"):
            rows = rows if c in rows.columns else rows.withColumn(c, none)
        rows = rows.where(~F.coalesce(F.greatest("left", "right") * F.lit(100).cast("decimal(20,0)") >= F.col("a") * F.lit(subsumed), F.lit(False)) | (F.coalesce(F.greatest("left", "right"), F.lit(0)) < min_count))
        rows = rows.select("lang", "phrase", "a", "first", "rest")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "lang string, phrase string, words int, a long, l long, r long, n long, score long")
    out = out.withColumn("c", F.expr(best_cut(scale))).select(
        "lang", "phrase", F.expr("size(first)").alias("words"), "a", "c.l", "c.r", F.expr("first[0]").alias("n"), "c.score"
    )
    out = stored(out)
    dropped(*temporary)
    return out


def best_cut(scale: int) -> str:
    """SQL of the cut with the lowest score, of equals the one with the shortest first part.

    ``first`` has the number of words and the frequencies of the phrase's first 1, 2, ... words,
    ``rest`` those of its last 1, 2, ... words.
    """
    number = lambda x: f"cast({x} as decimal(19,0))"
    ratio = f"({scale} * {number('a')} * {number('first[0]')}) div ({number('first[k]')} * {number('rest[size(rest) - k]')})"
    return f"array_min(transform(sequence(1, size(rest)), k -> struct({ratio} as score, k as k, first[k] as l, rest[size(rest) - k] as r)))"


def stored_in(kept: list[DataFrame], df: DataFrame) -> DataFrame:
    kept.append(stored(df))
    return kept[-1]


def top(found: DataFrame, n: int) -> DataFrame:
    """``found`` with ``rank``: each language's first ``n`` by score and a descending, then phrase in byte order.

    Where there are many, slices of a language are ranked first and their first ``n`` go on, so
    that no task sorts a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = found.count() // SLICE
    while slices > 1:
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(slices))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")
        slices //= 20
    w = Window.partitionBy("lang").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
