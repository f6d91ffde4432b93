"""Snapshot features as row-local Arrow passes: nothing is exploded or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._grid_np import FEATURES, REGIONS, grid_features, resize_matrix


def weight_matrices(weights: DataFrame, ny: int, nz: int) -> dict[str, np.ndarray]:
    """Region matrices from (region, i, j, weight); ny x nz numbers for each of eight regions."""
    out = {r: np.zeros((ny, nz)) for r in REGIONS}
    for r in weights.where(F.col("region").isin(REGIONS)).collect():
        out[r.region][r.i, r.j] = r.weight
    return out


def _grids(batch: pa.RecordBatch, at: int, ny: int, nz: int) -> np.ndarray:
    col = batch.column(at)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, ny, nz)


def wind_features(fields: DataFrame, weights: DataFrame, ny: int, nz: int, names: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Keys and feature columns (all 45, or ``names``) of snapshots (u, v, w arrays of ny * nz)."""
    keys = keys or ["case_id", "step"]
    names = names or FEATURES
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise KeyError(f"unknown features: {', '.join(unknown)}")
    shared = fields.sparkSession.sparkContext.broadcast(weight_matrices(weights, ny, nz))
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                f = grid_features(*(_grids(batch, k + c, ny, nz) for c in range(3)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *[pa.array(f[n], pa.float64()) for n in names]], names=[*keys, *names])

    kinds = dict(fields.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"{n} double" for n in names])
    return fields.select(*keys, "u", "v", "w").mapInArrow(run, schema)


def regrid_bilinear(fields: DataFrame, ny: int, nz: int, to_ny: int, to_nz: int, keys: list[str] | None = None) -> DataFrame:
    """Snapshots on another grid; the same grid is returned as it is."""
    keys = keys or ["case_id", "step"]
    if (ny, nz) == (to_ny, to_nz):
        return fields.select(*keys, "u", "v", "w")
    a, b = resize_matrix(ny, to_ny), resize_matrix(nz, to_nz)
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in range(3):
                flat = np.einsum("pi,nij,qj->npq", a, _grids(batch, k + c, ny, nz), b, optimize=True).reshape(-1)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (to_ny * to_nz))
                out.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *out], names=[*keys, "u", "v", "w"])

    kinds = dict(fields.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"{c} array<double>" for c in "uvw"])
    return fields.select(*keys, "u", "v", "w").mapInArrow(run, schema)


def regrid_mixed(fields: DataFrame, to_ny: int, to_nz: int, keys: list[str] | None = None) -> DataFrame:
    """Snapshots with their own ``ny`` and ``nz`` on one grid, in one pass whatever the number of grids."""
    keys = keys or ["case_id", "step"]
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            ny, nz = (batch.column(k + c).to_numpy() for c in (0, 1))
            cut = np.flatnonzero((np.diff(ny) != 0) | (np.diff(nz) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                if a == b:
                    continue
                part, size = batch.slice(a, b - a), (int(ny[a]), int(nz[a]))
                if size not in known:
                    known[size] = (resize_matrix(size[0], to_ny), resize_matrix(size[1], to_nz))
                out, offsets = [], pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (to_ny * to_nz))
                for c in range(2, 5):
                    x = _grids(part, k + c, *size)
                    if size != (to_ny, to_nz):
                        x = np.einsum("pi,nij,qj->npq", known[size][0], x, known[size][1], optimize=True)
                    out.append(pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))))
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *out], names=[*keys, "u", "v", "w"])

    kinds = dict(fields.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"{c} array<double>" for c in "uvw"])
    return fields.select(*keys, "ny", "nz", "u", "v", "w").mapInArrow(run, schema)


def field_summary(fields: DataFrame, headers: DataFrame | None = None, ny: int | None = None, nz: int | None = None) -> DataFrame:
    """Per case: means of u, v, w, the mean of u at the centre, and the hub speed where headers have it."""
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    centre = F.lit((ny // 2) * nz + nz // 2) if ny and nz else (F.size("u") / 2).cast("int")
    df = fields.groupBy("case_id").agg(
        *[(F.sum(total(c)) / F.sum(F.size(c))).alias(f"{c}_mean") for c in "uvw"],
        F.avg(F.get(F.col("u"), centre).cast("double")).alias("u_centre_mean"), F.count("*").alias("n_steps"),
    )
    if headers is None:
        return df
    return df.join(headers.select("case_id", "u_hub"), "case_id", "left").withColumn("u_minus_hub", F.col("u_mean") - F.col("u_hub"))


def attach_weights(snapshots: DataFrame, weights: DataFrame, ny: int, nz: int) -> DataFrame:
    """(case_id, step, region, u_wm, v_wm, w_wm): weighted means by region, weights as literal arrays."""
    # eight regions of ny x nz numbers ride along as one row
    packed = weights.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("i") * nz + F.col("j")).alias("k"), "weight"))), lambda x: x["weight"]).alias("wt"))
    df = snapshots.crossJoin(F.broadcast(packed))
    mean = lambda c: F.aggregate(F.zip_with(c, "wt", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda x, y: x + y).alias(f"{c}_wm")
    return df.select("case_id", "step", "region", mean("u"), mean("v"), mean("w"))
