"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles: weight = term frequency x mean IDF of
the shingle's words. Document frequencies are counted exactly, by word, over all documents;
words in less than one of ``RARE`` documents share the IDF of that frequency, so the table
that is broadcast has at most ``RARE`` x (mean distinct words of a document) words, whatever
the corpus. Consistent weighted samples agree with a probability equal to the weighted
Jaccard similarity. Bands of three samples select candidates, the samples of candidates
are compared, and the exact weighted Jaccard of whole texts decides.

Groups of any size: copies with the same words are one node. A bucket or candidate group
that is too large for one task is first compared with one of its members, in chunks; those
that link with it need not meet each other. The rest meets all of the group in pairs of
tiles. A task grows components and returns at most one edge per document, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, dropped, likely_in, row_keys, stored, whole_rows
from .pieces import Shared, Table

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Candidates need this many equal samples; at a similarity of 0.8 a pair has fewer with p < 1e-5.
AGREE = SAMPLES // 2
#: Words in fewer than one of so many documents all count as that rare.
RARE = 1 << 14
_VARIATES = 1 << 16
_MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240817)
_MULT = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# random variates of the sampling scheme, picked by hash: r, c ~ Gamma(2, 1), beta ~ U(0, 1)
# by different bits each, so that there are _VARIATES ** 3 of them
_R = _RNG.gamma(2, 1, _VARIATES).astype(np.float32)
_LOG_C = np.log(_RNG.gamma(2, 1, _VARIATES)).astype(np.float32)
_BETA = _RNG.random(_VARIATES, np.float32)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, WORDS - 1 - i, 1 << 64) for i in range(WORDS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(0x110000, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True  # there are none above
_BASE = 0xD1342543DE82EF95
_CHARS = 500_000
_UP = np.multiply.accumulate(np.full(_CHARS, _BASE, np.uint64))
_DOWN = np.multiply.accumulate(np.full(_CHARS, pow(_BASE, -1, 1 << 64), np.uint64))


def _hash_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the runs without white space: polynomials of their characters, mixed."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    up, down = (_UP, _DOWN) if n <= _CHARS else (np.multiply.accumulate(np.full(n, x[0], np.uint64)) for x in (_UP, _DOWN))
    edge = np.diff(np.concatenate([[True], _SPACE[code], [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((code + np.uint32(1)) * up[:n], out=total[1:])
    if not len(start):
        return np.empty(0, np.uint64), start
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def hash_texts(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the lower-case words (runs without white space) of each whole text, in order."""
    out: list[np.ndarray] = []
    held: list[str] = []
    n_held = 0

    def flush():
        bounds = np.cumsum([0, *[len(t) + 1 for t in held]])
        h, start = _hash_words(" ".join(held))
        cut = np.searchsorted(start, bounds)
        out.extend(h[a:b] for a, b in zip(cut, cut[1:]))

    for text in texts:
        text = (text or "").lower()
        if n_held and n_held + len(text) > _CHARS:
            flush()
            held, n_held = [], 0
        if len(text) < _CHARS:
            held.append(text)
            n_held += len(text) + 1
            continue
        parts, at = [], 0
        while at < len(text):  # a long text by parts that end at a space
            end = len(text) if len(text) - at <= _CHARS else text.rfind(" ", at, at + _CHARS)
            end = end if end > at else text.find(" ", at + 1)
            end = end if end > at else len(text)
            parts.append(_hash_words(text[at:end])[0])
            at = end
        out.append(np.concatenate(parts))
    if held:
        flush()
    return out


def word_hashes(text: str | None) -> np.ndarray:
    return hash_texts([text])[0]


class Idf:
    """ln((1 + N) / (1 + df)) + 1 by word hash, for a table of words that are not rare."""

    def __init__(self, words: np.ndarray, df: np.ndarray, n: int):
        self.words, self.df, self.n, self._table = words, df, n, None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def __getitem__(self, words: np.ndarray) -> np.ndarray:
        value = lambda df: np.log((1 + self.n) / (1 + df)) + 1
        least = self.n / RARE
        if self._table is None:
            self._table = Table(1 << max(10, (4 * len(self.words)).bit_length()), np.float64)
            self._table.put((self.words >> np.uint64(1)).astype(np.int64), value(np.maximum(self.df, least)))
        got = self._table.get((words >> np.uint64(1)).astype(np.int64))
        return np.where(got < 0, value(least), got)


def weighted(texts: list[str | None], idf: Idf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, their IDF) of each text."""
    words = hash_texts(texts)
    weight = idf[np.concatenate([np.empty(0, np.uint64), *words])]
    at = 0
    for w in words:
        yield w, weight[at : at + len(w)]
        at += len(w)


def shingles(words: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, term frequency, IDF weight) of a document's distinct shingles.

    A document of one to four words is one shingle; one without words has none.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)
    if n < WORDS:
        return _mix((words * _POWERS[:n]).sum(keepdims=True) + np.uint64(n)), np.ones(1, np.int64), weight.mean(keepdims=True)
    m = n - WORDS + 1
    h = np.zeros(m, np.uint64)
    w = np.zeros(m)
    for i in range(WORDS):
        h += words[i : i + m] * _POWERS[i]
        w += weight[i : i + m]
    h, first, tf = np.unique(_mix(h), return_index=True, return_counts=True)
    return h, tf, np.round(w[first] / WORDS, 6)


def sample(h: np.ndarray, weight: np.ndarray, block: int = 8_000) -> np.ndarray:
    """The document's consistent weighted samples, as 64-bit hashes of (shingle, t)."""
    low = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    log_w = np.log(weight).astype(np.float32)
    for at in range(0, len(h), block):
        x, lw = h[at : at + block], log_w[at : at + block]
        # 16-bit parts of the products: the highest three pick r, c and beta
        part = (x[None, :] * _MULT[:, None]).view(np.uint16).reshape(SAMPLES, len(x), 4)
        r, beta = _R.take(part[:, :, 3]), _BETA.take(part[:, :, 1])
        t = np.floor(lw / r + beta)
        log_a = _LOG_C.take(part[:, :, 2]) - r * (t - beta + 1)
        best = log_a.argmin(1)
        k = np.arange(SAMPLES)
        value = log_a[k, best]
        better = value < low
        step = t[k, best].astype(np.int64).astype(np.uint64)
        out = np.where(better, _mix(x[best] + step * np.uint64(0xD6E8FEB86659FD93)), out)
        low = np.where(better, value, low)
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> Idf:
    """IDF over all documents, exact for words in at least one of ``RARE`` documents.

    Tasks send sums by word hash; what reaches the driver is at most ``RARE`` x (mean distinct
    words of a document) words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums(parts):
            words, df = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(df), pa.nulls(len(df), pa.int64())], names=["word", "df", "n"])

        held, n_held, n = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for words in hash_texts(batch.column(0).slice(at, 1000).to_pylist()):
                    held.append(np.unique(words))
                    n_held += len(held[-1])
                    n += 1
                if n_held > 4_000_000:
                    yield sums(held)
                    held, n_held = [], 0
        if held:
            yield sums(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([n])], names=["word", "df", "n"])

    parts = docs.select(docs[text_col].alias("text")).mapInArrow(count, "word long, df long, n long")
    by_word = stored(parts.groupBy("word").agg(F.sum("df").alias("df"), F.sum("n").alias("n")))
    n = by_word.where("word is null").agg(F.sum("n")).first()[0] or 0
    got = by_word.where(F.col("word").isNotNull() & (F.col("df") * RARE >= n)).select("word", "df").toArrow()
    dropped(by_word)
    return Idf(got.column("word").to_numpy().view(np.uint64), got.column("df").to_numpy(), n)


def signatures(keyed: DataFrame, idf: Shared) -> DataFrame:
    """(key, id, node, size, sketch, bands) of every (key, id, text) row; node is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                node, size, sketch, bands = [], [], [], []
                for words, weight in weighted(part.column(2).to_pylist(), idf.value):
                    if not len(words):
                        node.append(None), size.append(0), sketch.append(None), bands.append(None)
                        continue
                    h, tf, w = shingles(words, weight)
                    s = sample(h, tf * w)
                    keys = s.reshape(BANDS, ROWS)
                    key = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for i in range(ROWS):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + keys[:, i])
                    node.append(xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63))
                    size.append(len(h))
                    sketch.append((s & np.uint64(255)).astype(np.uint8).tobytes())
                    bands.append(key.astype(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["key", "id", "node", "size", "sketch", "bands"],
                )

    kind = f"key long, id {dict(keyed.dtypes)['id']}, node long, size long, sketch binary, bands array<long>"
    return keyed.select("key", "id", "text").mapInArrow(run, kind)


def _grow(n: int, alike) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``alike(i, rest)`` tells which of ``rest`` link with i.

    Members of a component found so far are each compared with the documents that are
    still outside, so the work shrinks as a group of copies is gathered.
    """
    edges = []
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = alike(i, rest)
            if hit.any():
                new = rest[hit].tolist()
                edges += [(i, j) for j in new]
                queue += new
                rest = rest[~hit]
    return edges


def _bucket(cols: dict) -> list[list]:
    s = np.frombuffer(b"".join(cols["sketch"].tolist()), np.uint8).reshape(-1, SAMPLES)
    edges = _grow(len(s), lambda i, rest: (s[rest] == s[i]).sum(1) >= AGREE)
    node = cols["node"]
    return [[int(node[i]) for i, _ in edges], [int(node[j]) for _, j in edges]]


def _linked(rows: DataFrame, members: DataFrame, group: str, data: str, run, limits: list) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) of what ``run`` links within every ``group`` of (group, node, size, data) rows.

    ``members`` has the same rows without the data.
    ``limits``: columns over (sum of sizes, rows) whose largest is a group's number of tiles.
    Groups of one tile are one task. Of larger ones each chunk meets the first member;
    members that do not link with it are cut in tiles again, and each of these tiles meets
    every tile of the group. So a group costs tiles x (tiles of members off its centre).
    The second result lists the stored tables that the edges are read from.
    """
    cut = members.groupBy(group).agg(F.count("*").alias("_n"), F.sum("size").alias("_s"), F.min("node").alias("_centre"))
    cut = cut.where("_n > 1").select(group, F.greatest(F.lit(1.0), *limits).cast("int").alias("n_tiles"), "_centre")
    kind = "a long, b long"
    placed = rows.join(cut, group).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles")).cast("int"))
    placed = stored(placed.select(group, "node", "size", data, "n_tiles", "_centre", "tile"))
    keys = [group, "tile_a", "tile_b"]
    pick = [*keys, "node", data]
    small = placed.where("n_tiles = 1").withColumns({"tile_a": F.lit(0), "tile_b": F.lit(0)}).select(*pick)
    links = stored(by_group(small, keys, run, kind))
    large = placed.where("n_tiles > 1")
    if large.isEmpty():
        return links, [placed, links]
    chunks = large.where("node <> _centre").withColumns({"tile_a": F.col("tile"), "tile_b": F.lit(0)}).select(*pick)
    centres = large.where("node = _centre").withColumns({"tile_a": F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)), "tile_b": F.lit(0)}).select(*pick)
    near = stored(by_group(chunks.unionByName(centres), keys, run, kind))
    # growing from any member finds the links with the centre, or with those that have one
    own = large.select(group, F.col("_centre").alias("b")).distinct()
    joined = components(near)
    hubs = joined.join(own, joined.node == own.b).select(group, "component")
    on = large.select(group, "node", "size", "n_tiles").join(joined, "node", "left").join(hubs.withColumn("on", F.lit(True)), [group, "component"], "left")
    off = on.where("on is null").select(group, "node", "size")
    tiles = off.groupBy(group).agg(F.count("*").alias("_n"), F.sum("size").alias("_s")).select(group, F.greatest(F.lit(1.0), *limits).cast("int").alias("off_tiles"))
    off = stored(off.join(tiles, group).select(group, "node", F.pmod(F.xxhash64("node", F.lit(1)), F.col("off_tiles")).cast("int").alias("off_tile")))
    one = large.join(off, [group, "node"]).withColumns({"tile_a": F.col("off_tile"), "tile_b": F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))}).select(*pick)
    # a member is not sent twice to the tile pair where it stands among those off the centre
    other = large.join(tiles, group).withColumns({"tile_a": F.explode(F.sequence(F.lit(0), F.col("off_tiles") - 1)), "tile_b": F.col("tile")})
    other = other.join(off.select(group, "node", F.col("off_tile").alias("tile_a"), F.lit(True).alias("there")), [group, "node", "tile_a"], "left").where("there is null").select(*pick)
    return links.unionByName(near).unionByName(by_group(one.unionByName(other), keys, run, kind)), [placed, links, near, off]


def _verified(idf: Shared, threshold: float):
    def run(cols: dict) -> list[list]:
        nodes, parts, weights = [], [], []
        for node, (words, weight) in zip(cols["node"].tolist(), weighted(cols["text"].tolist(), idf.value)):
            h, tf, w = shingles(words, weight)
            # a shingle that occurs k times is k elements: min of weights becomes set overlap
            k = np.concatenate([np.arange(c) for c in tf]) if (tf > 1).any() else np.zeros(len(h), np.int64)
            parts.append(_mix(np.repeat(h, tf) + k.astype(np.uint64)))
            weights.append(np.repeat(w, tf))
            nodes.append(node)
        if len(nodes) < 2:
            return [[], []]
        lengths = np.array([len(p) for p in parts])
        starts = np.append(0, np.cumsum(lengths))
        distinct, index = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.array([w.sum() for w in weights])
        mark = np.zeros(len(distinct))

        def alike(i, rest):
            own = index[starts[i] : starts[i + 1]]
            mark[own] = weights[i]
            if len(rest) == len(nodes) - 1 and i == 0:
                at, begin = index[starts[1] :], starts[1:-1] - starts[1]
            else:
                at = np.concatenate([index[starts[j] : starts[j + 1]] for j in rest])
                begin = np.append(0, np.cumsum(lengths[rest])[:-1])
            both = np.add.reduceat(mark[at], begin)
            mark[own] = 0
            return both >= threshold * (total[i] + total[rest] - both) - 1e-9

        edges = _grow(len(nodes), alike)
        return [[nodes[i] for i, _ in edges], [nodes[j] for _, j in edges]]

    return run


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tile_rows: int = 4096, tile_shingles: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: id, class_id (smallest id of its class), class_size, kept.

    A class is what links of weighted Jaccard >= ``threshold`` connect; texts with the
    same words always are in one class. Texts without words (null, empty, white space)
    are in no class: class_id is their own id. One row of each class has kept = true, the
    one with the smallest id (null ids last). Other columns are ignored; rows repeating
    an id and rows without one are rows of their own. The links that sampling may miss: at
    0.8 a pair shares none of the bands with p = 2e-4, above it with less.
    """
    keyed = row_keys(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "key")
    out = _classes(keyed, threshold, tile_rows, tile_shingles)
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def _classes(keyed: DataFrame, threshold: float, tile_rows: int = 4096, tile_shingles: int = 500_000) -> DataFrame:
    """(key, id, class_id, class_size, kept) of stored rows (key, id, text)."""
    spark = keyed.sparkSession
    idf = Shared(spark, document_frequencies(keyed))
    rows = stored(signatures(keyed, idf))
    reps = rows.where("node is not null").groupBy("node").agg(F.min_by(F.struct("key", "size", "sketch", "bands"), F.struct(F.col("id").isNull(), "id", "key")).alias("r"))
    reps = stored(reps.select("node", "r.*"))

    rows_limit, size_limit = F.ceil(F.col("_n") / tile_rows), F.ceil(F.col("_s") / tile_shingles)
    bands = reps.select("node", F.lit(1).alias("size"), "sketch", F.explode("bands").alias("band"))
    edges, used = _linked(bands, bands, "band", "sketch", _bucket, [rows_limit])
    candidates = components(edges)
    dropped(*used)

    members = stored(candidates.withColumnRenamed("component", "grp").join(reps.select("node", "key", "size"), "node"))
    texts = likely_in(keyed.select("key", "text"), "key", members.select("key"))
    texts = texts.where("_maybe").drop("_maybe").join(members.select("key", "node", "grp", "size"), "key")
    edges, used = _linked(texts.select("grp", "node", "size", "text"), members, "grp", "text", _verified(idf, threshold), [rows_limit, size_limit])
    classes = components(edges)
    dropped(*used, members)

    labelled = rows.select("key", "id", "node").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    size = labelled.where("class is not null").groupBy("class").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node", "key")).alias("first"), F.count("*").alias("class_size")
    )
    out = labelled.join(size, "class", "left")
    alone = F.col("class").isNull()
    return out.select(
        "key", "id", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), (alone | (F.col("key") == F.col("first.key"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows of a class other than its kept one, all columns as they are.

    Rows are told apart by a key stored at the start, not by id.
    """
    wide = row_keys(docs.select(whole_rows(docs).alias("_row")))
    keyed = wide.select(F.col("_key").alias("key"), F.col(f"_row.`{id_col}`").alias("id"), F.col(f"_row.`{text_col}`").alias("text"))
    gone = stored(_classes(keyed, threshold).where("not kept").select(F.col("key").alias("_key")))
    marked = likely_in(wide, "_key", gone)
    some = marked.where("_maybe").join(gone, "_key", "left_anti").select("_row")
    return marked.where("not _maybe").select("_row").unionByName(some).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
