"""Region weights of a grid, as (region, i, j, weight) tables whose weights sum to 1."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import written
from .ranks import doubled_ranks


def _points(spark: SparkSession, n: int) -> DataFrame:
    c = (n - 1) / 2
    df = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    return df.withColumns({"di": F.col("i") - F.lit(c), "dj": F.col("j") - F.lit(c)}).withColumn("r2", F.col("di") * F.col("di") + F.col("dj") * F.col("dj"))


def _normalised(df: DataFrame, region: str) -> DataFrame:
    """An all-zero region stays zero."""
    total = F.sum("weight").over(Window.partitionBy())
    w = F.when(total > 0, F.col("weight") / F.nullif(total, F.lit(0.0))).otherwise(F.col("weight"))
    return df.select(F.lit(region).alias("region"), "i", "j", w.alias("weight"))


def radius_cells(n: int, plane_m: float, radius_m: float) -> float:
    return radius_m / (plane_m / (n - 1))


def hub_weights(spark: SparkSession, n: int, region: str = "hub") -> DataFrame:
    """Gaussian about the centre, sigma half the centre index."""
    sigma = (n - 1) / 4
    return _normalised(_points(spark, n).withColumn("weight", F.exp(-F.col("r2") / (2 * sigma * sigma))), region)


def yaw_weights(spark: SparkSession, n: int, plane_m: float, radius_m: float, degrees: float) -> DataFrame:
    """Elliptic Gaussian: sigma R/2 along i, R cos(yaw)/2 along j."""
    import math

    si = radius_cells(n, plane_m, radius_m) / 2
    sj = si * math.cos(math.radians(degrees))
    e = F.col("dj") * F.col("dj") / (2 * sj * sj) + F.col("di") * F.col("di") / (2 * si * si)
    return _normalised(_points(spark, n).withColumn("weight", F.exp(-e)), "yaw")


def tip_weights(spark: SparkSession, n: int, plane_m: float, radius_m: float) -> DataFrame:
    """Equal weights on the ring from 0.8 R to R."""
    r = radius_cells(n, plane_m, radius_m)
    d = F.sqrt("r2")
    return _normalised(_points(spark, n).withColumn("weight", ((d >= 0.8 * r) & (d <= r)).cast("double")), "tip")


def half_rotor_weights(spark: SparkSession, n: int, plane_m: float, radius_m: float) -> DataFrame:
    """Equal weights on the rotor's halves; the centre line belongs to both."""
    c = (n - 1) // 2
    disc = F.sqrt("r2") <= radius_cells(n, plane_m, radius_m)
    sides = {"top": F.col("i") <= c, "bottom": F.col("i") >= c, "left": F.col("j") <= c, "right": F.col("j") >= c}
    out = None
    for region, side in sides.items():
        part = _normalised(_points(spark, n).withColumn("weight", (disc & side).cast("double")), region)
        out = part if out is None else out.unionByName(part)
    return out


#: Rows of a slice of one point's values, and slices of a point at most (a broadcast of points x slices numbers).
SLICE_ROWS, MAX_SLICES = 200_000, 4_096
#: Rows that a task packs together.
BLOCK_ROWS = 16_384


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows x points of a list column; null counts as NaN."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def spearman_weights(rows: DataFrame, targets: list[str], nz: int, row_key: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Mean over targets of |Spearman(u at point, target)|, as region 'corr'.

    ``rows`` has (u array, target columns) and, if named, a ``row_key`` without repeats;
    without one the rows are stored with a number. Undefined correlations count 0; null and NaN of
    u rank last together; rows without an array count in the targets' ranks only.

    Targets are ranked first and their ranks go along with the rows. A sample, of a size bound by points and
    slices, places cuts by point, which do not change the result: every point's values are
    dealt out to slices of about ``slice_rows``, equal values to one slice and summed up by task, so a
    column of few values stays small. A slice ranks its own values and sums up products of ranks; the
    places before it, a prefix sum over one row per slice, are added to these sums afterwards.
    """
    spark = rows.sparkSession
    if row_key is None:
        row_key = "_row"
        rows = written(rows.select("u", *targets).withColumn("_row", F.monotonically_increasing_id()))
    ranks, n = doubled_ranks(rows.select(row_key, *targets), row_key, targets)
    slices = max(1, min(MAX_SLICES, -(-n // slice_rows)))
    cuts = None
    if slices > 1:
        share = min(1.0, 32 * slices / n)
        some = rows.where("u is not null").select("u").sample(share, 42).toArrow().column(0).combine_chunks()  # 32 rows for each slice
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # points without numbers have no cuts
            cuts = np.nanquantile(_matrix(some), np.arange(1, slices) / slices, axis=0) if len(some) else None
    shared = spark.sparkContext.broadcast(cuts)
    n_targets = len(targets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(point, slice, distinct values, rows of each, sums of target ranks of each)."""
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                u = _matrix(part.column(0))
                ry = np.column_stack([part.column(1 + k).to_numpy(zero_copy_only=False) for k in range(n_targets)]).astype(np.int64)
                out: list[list] = [[], [], [], [], []]
                for p in range(u.shape[1]):
                    order = np.argsort(u[:, p], kind="stable")
                    x = u[order, p]
                    new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))))
                    sums = np.add.reduceat(ry[order], new)
                    m, x = np.diff(np.append(new, len(x))), x[new]
                    place = np.searchsorted(shared.value[:, p], x, "right") if shared.value is not None else np.zeros(len(x), np.int64)
                    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                    for a, b in zip(first, np.append(first[1:], len(x))):
                        for o, v in zip(out, (p, int(place[a]), x[a:b], m[a:b], sums[a:b].ravel())):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(o, pa.list_(k)) for o, k in zip(out[2:], (pa.float64(), pa.int64(), pa.int64())))], names=["point", "slice", "x", "m", "s"])

    def add_up(key: tuple, t: pa.Table) -> pa.Table:
        """Sums over one slice with ranks from its own start, doubled: rows, r, r r, and by target y, r y."""
        x, m = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("x", "m"))
        s = t.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_targets).astype(float)
        value, at = np.unique(x, return_inverse=True, equal_nan=True)
        m = np.bincount(at, m, len(value))
        r = 2 * np.cumsum(m) - m + 1
        y = np.column_stack([np.bincount(at, s[:, k], len(value)) for k in range(n_targets)])
        out = [key[0].as_py(), key[1].as_py(), float(m.sum()), float((m * r).sum()), float((m * r * r).sum()), y.sum(0).tolist(), (r[:, None] * y).sum(0).tolist()]
        return pa.table({c: [v] for c, v in zip(("point", "slice", "n", "r", "rr", "y", "ry"), out)})

    dealt = rows.where("u is not null").select(row_key, "u").join(ranks, row_key).select("u", *[f"r{k}" for k in range(n_targets)])
    dealt = dealt.mapInArrow(deal, "point int, slice int, x array<double>, m array<bigint>, s array<bigint>")
    sums = dealt.groupBy("point", "slice").applyInArrow(add_up, "point long, slice long, n double, r double, rr double, y array<double>, ry array<double>")
    before = F.coalesce(2 * F.sum("n").over(Window.partitionBy("point").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.withColumn("b", before)  # doubled places before the slice; one row for each slice
    whole = [F.sum("n").alias("n"), F.sum(F.expr("r + b * n")).alias("r"), F.sum(F.expr("rr + 2 * b * r + b * b * n")).alias("rr")]
    whole += [F.sum(F.expr(f"ry[{k}] + b * y[{k}]")).alias(f"ry{k}") for k in range(n_targets)]
    found = sums.groupBy("point").agg(*whole)
    about = ranks.agg(*[F.sum(F.col(f"r{k}").cast("double")).alias(f"y{k}") for k in range(n_targets)], *[F.sum(F.pow(F.col(f"r{k}").cast("double"), 2)).alias(f"yy{k}") for k in range(n_targets)])
    found = found.crossJoin(F.broadcast(about))  # one row

    def correlation(k):
        x, y = F.expr("n * rr - r * r"), F.expr(f"n * yy{k} - y{k} * y{k}")
        varied = (x > 1e-12 * F.expr("n * rr")) & (y > 1e-12 * F.expr(f"n * yy{k}"))
        return F.when(varied, F.abs(F.expr(f"n * ry{k} - r * y{k}")) / F.sqrt(x) / F.sqrt(y)).otherwise(0.0)

    total = correlation(0)
    for k in range(1, n_targets):
        total = total + correlation(k)
    df = found.select(F.floor(F.col("point") / nz).cast("int").alias("i"), (F.col("point") % nz).cast("int").alias("j"), (total / n_targets).alias("weight"))
    return _normalised(df, "corr")
