"""Near-duplicate embeddings: PCA-ordered tiled comparison within equal labels.

Vectors are normalised and turned into the basis of their principal components, so the
leading dimensions hold most of every distance. Tiles of bounded size are compared in
pairs: products are accumulated over the leading dimensions first, the rest is bounded by
the product of suffix norms, and a pair is given up as soon as its cosine cannot reach
the threshold. Pairs left at the end are decided by the cosine of the vectors themselves.

Vectors at cosine >= t differ by at most sqrt(2 - 2t) on every component, so tiles lie on
a grid of that width over the first components and only neighbouring cells meet.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, stored
from .pieces import Shared

THRESHOLD = 0.98
#: Dimensions accumulated before a pair is tested again, doubling from here.
LEAD = 8
SLACK = 1e-9


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, d, unit): float64 bytes of the normalised vector, null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, units = [], []
            for v in batch.column(2):
                unit = None
                if v.is_valid:
                    inner = v.values
                    if len(inner) and not inner.null_count:
                        x = inner.to_numpy(zero_copy_only=False).astype(np.float64)
                        big = np.abs(x).max()  # against overflow of squares
                        if np.isfinite(big) and big > 0:
                            x = x / big
                            unit = x / math.sqrt(float(x @ x))
                dims.append(0 if unit is None else len(unit))
                units.append(None if unit is None else unit.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["id", "label", "d", "unit"]
            )

    kinds = dict(df.dtypes)
    return df.select(df[id_col].alias("id"), df[label_col].alias("label"), df[vec_col].alias("v")).mapInArrow(
        run, f"id {kinds[id_col]}, label {kinds[label_col]}, d int, unit binary"
    )


def principal_basis(units: DataFrame, d: int) -> np.ndarray:
    """Orthonormal columns by falling variance, from the moments of all vectors of size ``d``.

    d x d sums reach the driver, whatever the number of vectors.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, d)
                x = np.hstack([x, np.ones((len(x), 1))])
                total += x.T @ x
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i * (d + 1) + j), pa.array(total[i, j])], names=["at", "s"])

    sums = units.where(F.col("d") == d).select("unit").mapInArrow(moments, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    full = np.zeros((d + 1) ** 2)
    full[sums["at"].to_numpy()] = sums["s"].to_numpy()
    full = full.reshape(d + 1, d + 1)
    n = max(full[d, d], 1.0)
    mean = full[:d, d] / n
    cov = full[:d, :d] / n
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1].copy()


def _links(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, threshold: float, block: int = 512):
    """Pairs (i, j) of rows of a and b with cosine >= threshold; pa_, pb are their PCA coordinates."""
    d = a.shape[1]
    cuts = [0]
    while cuts[-1] < d:
        cuts.append(min(d, LEAD if not cuts[-1] else cuts[-1] * 2))
    rest_a = np.sqrt(np.maximum(np.cumsum(pa_[:, ::-1] ** 2, 1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum(pb[:, ::-1] ** 2, 1)[:, ::-1], 0))
    need = threshold - SLACK
    for at in range(0, len(a), block):
        head = pa_[at : at + block, : cuts[1]] @ pb[:, : cuts[1]].T
        if cuts[1] < d:
            ok = head + np.outer(rest_a[at : at + block, cuts[1]], rest_b[:, cuts[1]]) >= need
        else:
            ok = head >= need
        if same:
            ok &= np.arange(len(b))[None, :] > (at + np.arange(len(head)))[:, None]
        i, j = np.nonzero(ok)
        for s in range(0, len(i), 65_536):  # bounds the memory of dense tiles
            x, y = i[s : s + 65_536], j[s : s + 65_536]
            got = head[x, y]
            for lo, hi in zip(cuts[1:], cuts[2:]):
                got = got + np.einsum("ij,ij->i", pa_[at + x, lo:hi], pb[y, lo:hi])
                bound = got + (rest_a[at + x, hi] * rest_b[y, hi] if hi < d else 0)
                keep = bound >= need
                x, y, got = x[keep], y[keep], got[keep]
            keep = np.einsum("ij,ij->i", a[at + x], b[y]) >= threshold
            if keep.any():
                yield at + x[keep], y[keep]


def _roots(n: int, pairs: list) -> np.ndarray:
    """Smallest position reachable through the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in pairs:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _compare(basis: Shared, threshold: float):
    def run(cols: dict) -> list[list]:
        unit = cols["unit"]
        d = int(cols["d"][0])
        x = np.frombuffer(b"".join(unit.tolist()), np.float64).reshape(-1, d)
        turn = basis.value.get(d)
        p = x @ turn if turn is not None else x
        left, right = np.flatnonzero(cols["side"] <= 0), np.flatnonzero(cols["side"] >= 0)
        same = bool((cols["side"] == 0).all())
        ids = cols["id"]
        pairs = []
        for i, j in _links(x[left], x[right], p[left], p[right], same, threshold):
            i, j = left[i], right[j]
            other = ids[i] != ids[j]
            pairs.append((i[other], j[other]))
        n = np.zeros(len(x), np.int64)
        for i, j in pairs:
            n += np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))
        root = _roots(len(x), pairs)
        used = np.flatnonzero(n)
        return [ids[used].tolist(), n[used].tolist(), ids[root[used]].tolist()]

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile_rows: int = 2048, grid_dims: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and the cosine of their vectors,
    in double precision, is at least ``threshold`` (above 0). Null or zero vectors,
    vectors with null or non-finite components, vectors of different lengths and rows
    without an id link with nothing; their component is their own id. Rows that repeat
    an id do not link with each other, every one counts for the others, and each gets
    the id's sum. All pairs are covered; groups of any size are cut into tiles. Links are
    counted within tiles and returned as one count and one edge per row, not as pairs.
    """
    units = stored(unit_vectors(df, id_col, vec_col, label_col))
    fit = units.where("unit is not null and label is not null and id is not null")
    sizes = fit.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    # vectors of the most frequent length get their own basis, others keep their order
    basis = {sizes[0].d: principal_basis(fit, sizes[0].d)} if sizes else {}
    shared = Shared(df.sparkSession, basis)
    most = fit.groupBy("label", "d").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # more components in the grid for larger labels; any number gives the same links
    k = grid_dims or (1 if most <= 65_536 else 2 if most <= 4_194_304 else 3)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for d, u in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x = np.frombuffer(u, np.float64)
                turn = shared.value.get(d)
                lead = x @ turn[:, :k] if turn is not None else x[:k]
                lead = np.append(lead, np.zeros(k))[:k]
                cells.append(np.floor(lead / width).astype(int).tolist())
            at = [pa.array([c[i] for c in cells], pa.int32()) for i in range(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *at], names=[*batch.schema.names, *names])

    names = [f"c{i}" for i in range(k)]
    kinds = dict(fit.dtypes)
    placed = stored(
        fit.mapInArrow(place, f"id {kinds['id']}, label {kinds['label']}, d int, unit binary, " + ", ".join(f"{c} int" for c in names))
    )
    own = ["label", "d", *names]
    cells = stored(placed.groupBy(*own).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("n_tiles")).withColumn("cell", F.xxhash64(*own)))
    # half of the neighbouring cells, so that each pair of cells meets once
    half = [o for o in itertools.product((-1, 0, 1), repeat=k) if o > (0,) * k]
    steps = F.array(*[F.struct(F.lit(i).alias("step"), *[F.lit(o[j]).alias(f"o{j}") for j in range(k)]) for i, o in enumerate(half, 1)])
    near = cells.select("*", F.explode(steps).alias("s")).select("label", "d", *[(F.col(c) + F.col(f"s.o{j}")).alias(c) for j, c in enumerate(names)], F.col("s.step").alias("step"), F.col("n_tiles").alias("left_tiles"), F.col("cell").alias("left_cell"))
    meet = near.join(cells, own).select("step", "left_cell", "left_tiles", F.col("cell").alias("right_cell"), F.col("n_tiles").alias("right_tiles"))
    rows = placed.join(cells, own).select("id", "d", "unit", "cell", "n_tiles", F.pmod(F.xxhash64("id", "unit"), F.col("n_tiles")).cast("int").alias("tile"))
    both = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))).select(
        F.col("cell").alias("pair"), F.lit(0).alias("step"), F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"), "id", "d", "unit",
        F.when(F.col("tile") == F.col("o"), 0).when(F.col("tile") < F.col("o"), -1).otherwise(1).alias("side"),
    )
    left = rows.join(meet, rows.cell == meet.left_cell).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("right_tiles") - 1))).select(
        F.col("left_cell").alias("pair"), "step", F.col("tile").alias("ta"), F.col("o").alias("tb"), "id", "d", "unit", F.lit(-1).alias("side")
    )
    right = rows.join(meet, rows.cell == meet.right_cell).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("left_tiles") - 1))).select(
        F.col("left_cell").alias("pair"), "step", F.col("o").alias("ta"), F.col("tile").alias("tb"), "id", "d", "unit", F.lit(1).alias("side")
    )
    tiles = both.unionByName(left).unionByName(right)
    found = stored(by_group(tiles, ["pair", "step", "ta", "tb"], _compare(shared, threshold), f"id {kinds['id']}, n long, root {kinds['id']}"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    joined = components(found, "id", "root")
    return (
        units.select("id").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
