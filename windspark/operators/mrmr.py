"""Relevance by nearest neighbours, greedy mRMR ranking and the whole selection job."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ksg_np import Tiles, _digamma, nearest, nearest_of, pack, unpack
from .cases import global_downsample, limit_cases, sample_per_case
from .stats import bin_uniform, binned_information, pairwise_mi


#: Points of a sample that places the cuts: so many to a tile, and tiles at most.
SAMPLE, MAX_TILES = 64, 4096
#: Rows that a task deals out at a time.
BLOCK = 1 << 19
#: Points travel as packed columns, a record for those of a tile (or slice) in one block; no ``m`` means one of each.
_POINTS = "x binary, y binary, m binary"


def _ones(m: np.ndarray) -> bytes:
    return b"" if (m == 1).all() else pack(m)


def _column(packed, kind: type = float) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[unpack(b, kind) for b in packed]])


def _copies(pdf: pd.DataFrame, like: str = "x") -> np.ndarray:
    return np.concatenate([np.empty(0, int), *[unpack(m, int) if m else np.ones(len(v) // 8, int) for m, v in zip(pdf.m, pdf[like])]])


def _distinct(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal points as one with the sum of their copies."""
    mixed = np.sort(x.view(int) * 0x9E3779B97F4A7C1 + y.view(int))
    if not (mixed[1:] == mixed[:-1]).any():
        return x, y, m
    order = np.lexsort((y, x))
    x, y, m = x[order], y[order], m[order]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    return x[first], y[first], np.add.reduceat(m, first)


def _groups(label: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(label, places) of each label."""
    small = label.astype(np.uint16) if label.max(initial=0) < 2**16 else label  # sorts faster
    order = np.argsort(small, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(label[order]) != 0)) if len(label) else []
    return [(int(label[i[0]]), i) for i in np.split(order, start[1:])] if len(label) else []


def relevance_mi(df: DataFrame, cols: list[str], targets: list[str], key: list[str], k: int = 3, tile_rows: int = 8_000) -> DataFrame:
    """(feature, relevance) by k-nearest-neighbour mutual information, mean over targets.

    Over all rows, exactly, in tiles of at least about ``tile_rows``; columns are divided by their
    deviation and get a tiny jitter from the row key, so ties break the same way each run.
    Rows where the feature or the target is null or NaN do not count for that pair. A sample
    places the cuts, which do not change the result: a point whose neighbours may lie past
    its tile asks the tiles that its distance reaches, and counts within a distance are
    places in slices of the sorted columns. Slices are longer than tiles, so that few distances end in another one.
    """
    spark = df.sparkSession
    pairs = [(f, t) for f in cols for t in targets]
    both = list(dict.fromkeys([*cols, *targets]))
    jitter = lambda c: F.pmod(F.xxhash64(*key, F.lit(c)), F.lit(1_000_003)).cast("int")
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(both)], *[jitter(c).alias(f"j{i}") for i, c in enumerate(both)]).persist()
    of = rows.agg(F.count("*").alias("n"), *[F.stddev_pop(f"v{i}").alias(f"d{i}") for i in range(len(both))]).first()
    by = [1.0 if d is None or d <= 0 else d for d in of[1:]]
    scaled = rows.select(*[(F.col(f"v{i}") / F.lit(d) + (F.col(f"j{i}") / 1_000_003.0 - 0.5) * 1e-10).alias(c) for i, (c, d) in enumerate(zip(both, by))])

    share = min(1.0, SAMPLE * min(MAX_TILES, of.n / tile_rows) / max(of.n, 1))
    # bounded: SAMPLE x MAX_TILES rows
    some = scaled.sample(share, 42).toPandas() if of.n > tile_rows else pd.DataFrame(columns=both, dtype=float)
    slices = math.sqrt(of.n / tile_rows)
    tiles, cuts = {}, {}
    for p, pair in enumerate(pairs):
        points = [some[c].to_numpy(float) for c in pair]
        points = [v[~np.isnan(points).any(0)] for v in points]
        tiles[p] = Tiles(*points, SAMPLE)
        for axis, v in enumerate(points):
            step = max(1, math.ceil(len(v) / max(slices, 1)))
            cuts[p, axis] = np.unique(np.sort(v)[step::step])
    n_tiles = sum(t.leaves for t in tiles.values())
    # enough tasks for all cores, and few tiles to a task
    parts = max(min(n_tiles, 2 * spark.sparkContext.defaultParallelism), n_tiles // 16)

    def place(batches):
        def deal(table):
            out = []
            for p, pair in enumerate(pairs):
                x, y = (table[c].to_numpy() for c in pair)
                ok = ~(np.isnan(x) | np.isnan(y))
                x, y, m = _distinct(x[ok], y[ok], np.ones(ok.sum(), int))
                out += [(p, t, pack(x[i]), pack(y[i]), _ones(m[i])) for t, i in _groups(tiles[p].leaf(x, y))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], ["p", "tile", "x", "y", "m"]) if out else None

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield from filter(None, [deal(pa.Table.from_batches(held))])
                held, n = [], 0
        if n:
            yield from filter(None, [deal(pa.Table.from_batches(held))])

    def points_of(pdf):
        return _distinct(_column(pdf.x), _column(pdf.y), _copies(pdf))

    def repeated(x, y, m):
        copies = np.minimum(m, k + 1)  # more do not change the k nearest
        return np.repeat(x, copies), np.repeat(y, copies), np.cumsum(copies) - copies

    def inside(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Points whose neighbours are all in the tile with their distance, the others with all k for each tile to ask."""
        p, tile = group
        x, y, m = points_of(pdf)
        rx, ry, at = repeated(x, y, m)
        near = nearest(rx, ry, k)[at]
        q, leaf = tiles[p].touched(x, y, near[:, -1], np.full(len(x), tile))
        done = np.ones(len(x), bool)
        done[q] = False
        out = [(p, tile, -1, pack(x[done]), pack(y[done]), _ones(m[done]), b"", pack(near[done, -1]))]
        for t, i in _groups(leaf):
            i = q[i]
            out.append((p, tile, t, pack(x[i]), pack(y[i]), _ones(m[i]), pack(i), pack(near[i].ravel())))
        return pd.DataFrame(out, columns=["p", "tile", "asked", "x", "y", "m", "i", "near"])

    def beyond(group: tuple, asks: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        """The questions with the k nearest points of this tile as well."""
        if not len(asks):
            return asks.assign(found=[])[["p", "of", *"xymi", "near", "found"]]
        x, y, m = points_of(pdf)
        ends = np.cumsum([len(i) // 8 for i in asks.i])[:-1]
        qx, qy, reach = _column(asks.x), _column(asks.y), _column(asks.near).reshape(-1, k)[:, -1]
        near_by = np.zeros(len(x), bool)
        for ax, ay, r in zip(*(np.split(v, ends) for v in (qx, qy, reach))):  # those of one tile lie along its border
            near_by |= (x >= (ax - r).min()) & (x <= (ax + r).max()) & (y >= (ay - r).min()) & (y <= (ay + r).max())
        found = nearest_of(qx, qy, reach, *repeated(x[near_by], y[near_by], m[near_by])[:2], k)
        return asks[["p", "of", *"xymi", "near"]].assign(found=[pack(d.ravel()) for d in np.split(found, ends)])

    def closed(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """All answers that the points of a tile got."""
        _, first, who = np.unique(_column(pdf.i, int), return_index=True, return_inverse=True)
        near, found = _column(pdf.near).reshape(-1, k), _column(pdf.found).reshape(-1, k)
        owner = np.append(np.repeat(np.arange(len(first)), k), np.repeat(who, k))
        d = np.append(near[first], found)
        order = np.lexsort((d, owner))
        r = d[order][np.searchsorted(owner[order], np.arange(len(first))) + k - 1]
        x, y, m = _column(pdf.x)[first], _column(pdf.y)[first], _copies(pdf)[first]
        return pd.DataFrame([(group[0], -1 - group[1], pack(x), pack(y), _ones(m), pack(r))], columns=["p", "tile", "x", "y", "m", "near"])

    tiled = scaled.mapInArrow(place, f"p int, tile int, {_POINTS}").repartition(parts, "p", "tile").persist()
    first = tiled.groupBy("p", "tile").applyInPandas(inside, f"p int, tile int, asked int, {_POINTS}, i binary, near binary").persist()
    asks = first.where("asked >= 0").select("p", F.col("asked").alias("tile"), F.col("tile").alias("of"), "x", "y", "m", "i", "near")
    found = asks.groupBy("p", "tile").cogroup(tiled.groupBy("p", "tile")).applyInPandas(beyond, f"p int, of int, {_POINTS}, i binary, near binary, found binary")
    open_ = found.repartition(-(-parts // 2), "p", "of").groupBy("p", "of").applyInPandas(closed, f"p int, tile int, {_POINTS}, near binary").persist()
    first.count()
    rows.unpersist()
    open_.count()
    tiled.unpersist()

    def cut(batches):
        """Each point of an axis in the slice of its value, the ends of its distance in theirs if another."""
        for b in batches:
            for p, tile, *xy, m, near in zip(b.p, b.tile, b.x, b.y, b.m, b.near):
                out = []
                m = unpack(m, int) if m else np.ones(len(near) // 8, int)
                r = unpack(near) * (1 - 1e-10)
                for axis, v in enumerate(xy):
                    v = unpack(v)
                    low, own, high = (np.searchsorted(cuts[p, axis], e, "right") for e in (v - r, v, v + r))
                    whole = low == high
                    for s, i in _groups(own):
                        i, more = i[whole[i]], i[~whole[i]]
                        out.append((p, axis, s, 0, tile, pack(v[i]), pack(r[i]), _ones(m[i]), b""))
                        if len(more):
                            out.append((p, axis, s, 0, tile, pack(v[more]), b"", _ones(m[more]), b""))
                    part = np.flatnonzero(~whole)
                    for side, at in ((-1, low[part]), (1, high[part])):
                        for s, i in _groups(at):
                            i = part[i]
                            out.append((p, axis, s, side, tile, pack(v[i] + side * r[i]), b"", _ones(m[i]), pack(i)))
                yield pd.DataFrame(out, columns=["p", "axis", "slice", "side", "tile", "v", "r", "m", "i"])

    def count(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Digamma sums of points whose distance ends within the slice, places in the slice for ends of others."""
        own = pdf[pdf.side == 0]
        v, m = _column(own.v), _copies(own, "v")
        r = np.concatenate([np.empty(0), *[unpack(r) if r else np.full(len(v) // 8, np.nan) for r, v in zip(own.r, own.v)]])
        order = np.argsort(v)
        held, r, m = v[order], r[order], m[order]
        upto = np.append(0, np.cumsum(m))
        whole = ~np.isnan(r)
        v, r = held[whole], r[whole]
        n = upto[np.searchsorted(held, v + r, "right")] - upto[np.searchsorted(held, v - r, "left")]
        psi = float((_digamma(n) * m[whole]).sum())
        ends = pdf[pdf.side != 0]
        places = [pack(upto[np.searchsorted(held, unpack(e), "right" if side > 0 else "left")]) for e, side in zip(ends.v, ends.side)]
        whole = pd.DataFrame([(*group, 0, 0, b"", b"", b"", int(upto[-1]), psi)], columns=["p", "axis", "slice", "side", "tile", "m", "i", "places", "n", "psi"])
        return pd.concat([whole, ends[["p", "axis", "slice", "side", "tile", "m", "i"]].assign(places=places, n=0, psi=0.0)])

    radius = first.where("asked < 0").select("p", "tile", "x", "y", "m", "near").unionByName(open_)
    sliced = radius.mapInPandas(cut, "p int, axis int, slice int, side int, tile int, v binary, r binary, m binary, i binary")
    counted = sliced.groupBy("p", "axis", "slice").applyInPandas(count, "p int, axis int, slice int, side int, tile int, m binary, i binary, places binary, n long, psi double").persist()
    sums = counted.where("side = 0").select("p", "axis", "slice", "n", "psi").collect()  # one row for each slice
    for held in (first, open_):
        held.unpersist()
    size, before = {}, {}
    for r in sums:
        size.setdefault((r.p, r.axis), {})[r.slice] = r.n
    for g, n in size.items():
        before[g] = np.cumsum([0, *[n.get(i, 0) for i in range(len(cuts[g]) + 1)]])

    def split(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Digamma sums of points whose distance ends in two slices."""
        _, at, who = np.unique(_column(pdf.i, int), return_index=True, return_inverse=True)
        n = np.zeros(len(at), int)
        np.add.at(n, who, np.concatenate([side * (unpack(b, int) + before[group[:2]][s]) for side, s, b in zip(pdf.side, pdf.slice, pdf.places)]))
        return pd.DataFrame({"p": [group[0]], "psi": [float((_digamma(n) * _copies(pdf, "i")[at]).sum())]})

    ends = counted.where("side != 0").groupBy("p", "axis", "tile").applyInPandas(split, "p int, psi double")
    psi = {r.p: r.psi for r in ends.groupBy("p").agg(F.sum("psi").alias("psi")).collect()}  # one row for each pair
    counted.unpersist()
    out = []
    for p, (f, _) in enumerate(pairs):
        n = sum(size.get((p, 0), {}).values())
        total = math.fsum([psi.get(p, 0.0), *[r.psi for r in sums if r.p == p]])
        out.append((f, max(float(_digamma([n, k]).sum()) - total / n, 0.0) if n > k + 1 else 0.0))
    return spark.createDataFrame(out, "feature string, mi double").groupBy("feature").agg(F.avg("mi").alias("relevance"))


def mrmr_rank(relevance: DataFrame, mi: DataFrame, names: list[str], beta: float = 0.5, k: int | None = None, threshold: float | None = None) -> list[dict]:
    """Greedy ranks from the feature-level tables (k and k x k numbers reach the driver).

    The first is the most relevant; each next has the largest relevance - beta x mean
    information about those chosen, ties to the earlier column. Ends at ``k``, or without
    it when the best falls below ``threshold``.
    """
    rel = {r.feature: r.relevance for r in relevance.collect()}
    shared = {(r.feature_a, r.feature_b): r.mi for r in mi.collect()}
    left = list(names)
    out: list[dict] = []
    while left and (k is None or len(out) < max(k, 1)):
        red = {f: sum(shared[f, s["feature"]] for s in out) / len(out) if out else 0.0 for f in left}
        best = max(left, key=lambda f: rel[f] - beta * red[f])  # the first of equals
        score = rel[best] - beta * red[best]
        if out and k is None and threshold is not None and score < threshold:
            break
        out.append({"rank": len(out) + 1, "feature": best, "selection_score": score, "relevance": rel[best], "redundancy": red[best], "original_index": names.index(best)})
        left.remove(best)
    return out


RANKED = "rank int, feature string, selection_score double, relevance double, redundancy double, original_index int"


def score_table(spark, ranked: list[dict], relevance: DataFrame, names: list[str]) -> DataFrame:
    """All features in original order; redundancy and score are null where not selected."""
    order = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "original_index int, feature_name string")
    rows = spark.createDataFrame([tuple(r[c] for c in ("rank", "feature", "selection_score", "relevance", "redundancy", "original_index")) for r in ranked], RANKED)
    picked = rows.select(F.col("feature").alias("feature_name"), "redundancy", "selection_score", "rank")
    return order.join(relevance.withColumnRenamed("feature", "feature_name"), "feature_name", "left").join(picked, "feature_name", "left").select(
        "original_index", "feature_name", "relevance", "redundancy", "selection_score", "rank"
    )


def select_features_mrmr(rows: DataFrame, features: list[str], targets: list[str], key: list[str], max_cases: int | None = 50, per_case: int | None = 3000, sample: int | None = 150_000, seed: int = 42, beta: float = 0.5, k: int | None = None, threshold: float | None = None, n_bins: int = 10, method: str = "knn") -> tuple[DataFrame, list[int]]:
    """The selection job: first cases, rows per case, sample, relevance, redundancy, ranks.

    ``per_case`` None leaves the rows of a case uncapped. ``method`` 'knn' uses the nearest-neighbour estimate on the sample, 'binned' the binned one.
    Returns the score table and the kept indices in order of rank.
    """
    df = rows if max_cases is None else limit_cases(rows, max_cases)
    if per_case is not None:
        df = sample_per_case(df, per_case, seed, key)
    if sample:
        df = global_downsample(df, sample, seed, key)
    df = df.select(*dict.fromkeys([*key, *features, *targets]))
    if method == "knn":
        df = df.persist()
        rel = relevance_mi(df, features, targets, key)
        rel = rows.sparkSession.createDataFrame(rel.collect(), rel.schema)  # one number for each feature, without the lineage
        mi = pairwise_mi(bin_uniform(df.select(*features), features, n_bins), features)
    else:
        rel, mi = binned_information(df, features, targets, n_bins)
    ranked = mrmr_rank(rel, mi, features, beta, k, threshold)
    if method == "knn":
        df.unpersist()
    return score_table(rows.sparkSession, ranked, rel, features), [r["original_index"] for r in ranked]
