"""Shaping of case rows for fitting: derivatives, angles, history."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.channels import DERIVED
from .align import lagged
from .cases import select_channels
from .slices import ROWS, by_step, own_rows, with_halo


def _w(case: str, step: str):
    return Window.partitionBy(case).orderBy(step)


def _derived(sliced: DataFrame, dt: float, order: int, case: str, step: str, names: list[str]) -> DataFrame:
    """A slice's first row has no difference: it is the case's first, or one of the ``order`` rows before the border."""
    dt, w = F.lit(max(float(dt), 1e-6)), by_step(case, step)
    change = lambda c: F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise((F.col(c) - F.lag(c).over(w)) / dt)
    df = sliced.withColumns({f"d{n}": change(n) for n in names})
    return df.withColumns({f"d2{n}": change(f"d{n}") for n in names}) if order >= 2 else df


def add_derivatives(df: DataFrame, dt: float = 0.1, order: int = 2, case: str = "case_id", step: str = "step", names: list[str] | None = None, slice_rows: int = ROWS) -> DataFrame:
    """Backward differences per dt, dX and d2X, 0 in the first row of a case. Steps count from 0."""
    names = [n for n in (names or DERIVED) if n in df.columns]
    if order <= 0 or not names:
        return df
    return own_rows(_derived(with_halo(df, order, 0, case, step, slice_rows), dt, order, case, step, names))


def angle_encode(df: DataFrame, mode: str = "harmonics6", keep_raw: bool = False) -> DataFrame:
    """Sines and cosines of Azimuth (orders 1, 3, 6 by mode) and NacYaw, raw angles dropped unless kept."""
    orders = {"none": None, "sincos": (), "harmonics": (1, 3), "harmonics6": (1, 3, 6)}
    if mode not in orders:
        raise ValueError(f"unknown angle mode: {mode}")
    if mode == "none":
        return df
    new = {}
    rad = lambda c: F.col(c) * F.lit(np.pi / 180.0)
    if "Azimuth" in df.columns:
        for k in orders[mode]:
            new |= {f"Azimuth_sin{k}": F.sin(rad("Azimuth") * float(k)), f"Azimuth_cos{k}": F.cos(rad("Azimuth") * float(k))}
        if mode == "sincos":
            new |= {"Azimuth_sin": F.sin(rad("Azimuth")), "Azimuth_cos": F.cos(rad("Azimuth"))}
    if "NacYaw" in df.columns:
        new |= {"NacYaw_sin": F.sin(rad("NacYaw")), "NacYaw_cos": F.cos(rad("NacYaw"))}
    out = df.withColumns(new)
    return out if keep_raw else out.drop("Azimuth", "NacYaw")


def _past(sliced: DataFrame, cols: list[str], k: int, case: str, step: str) -> DataFrame:
    """With at least ``k`` rows before each border, a row's place in its slice tells whether k rows of its case precede it."""
    if k <= 0:
        return sliced
    w = by_step(case, step)
    past = {f"{c}_t{i}": F.lag(c, i).over(w) if i else F.col(c) for i in range(k + 1) for c in cols}
    return sliced.withColumns(past | {"_n": F.row_number().over(w)}).where(F.col("_n") > k).drop("_n", *cols)


def add_history(df: DataFrame, cols: list[str], k: int, case: str = "case_id", step: str = "step", slice_rows: int = ROWS) -> DataFrame:
    """Columns X_t0 ... X_tk of the last k rows in place of ``cols``; a case's first k rows go. Steps count from 0."""
    if k <= 0:
        return df
    return own_rows(_past(with_halo(df, k, 0, case, step, slice_rows), cols, k, case, step))


def _history_cols(wind: list[str], inputs: list[str], on: str) -> list[str]:
    if on not in ("both", "wind"):
        raise ValueError(f"unknown history setting: {on}")
    return wind + (inputs if on == "both" else [])


def history_on(df: DataFrame, wind: list[str], inputs: list[str], k: int, on: str = "both", case: str = "case_id", step: str = "step", slice_rows: int = ROWS) -> DataFrame:
    """History of wind features, and of inputs with ``both``; with ``wind`` inputs are only trimmed."""
    return add_history(df, _history_cols(wind, inputs, on), k, case, step, slice_rows)


def process_case(df: DataFrame, inputs: list[str], outputs: list[str], features: list[str] | None = None, lag: int = 0, dt: float = 0.1, derivative_order: int = 2, angle_mode: str = "harmonics6", keep_raw: bool = False, history: int = 0, on: str = "both", case: str = "case_id", step: str = "step", slice_rows: int = ROWS) -> DataFrame:
    """Selection, lag, derivatives, angles and history in this order, on one cut into slices and one shuffle.

    Steps count from 0 in each case without gaps.
    """
    features = features or []
    out = select_channels(df, [*features, *inputs, *outputs], [case, step])
    names = [n for n in DERIVED if n in inputs]
    order = derivative_order if names else 0
    sliced = lag > 0 or order > 0 or history > 0
    if sliced:
        out = with_halo(out, max(order, 0) + history, lag, case, step, slice_rows)
        out = lagged(out, outputs, lag, case, step)
        if order > 0:
            out = _derived(out, dt, order, case, step, names)
    out = angle_encode(out, angle_mode, keep_raw)
    shaped = [c for c in out.columns if c not in (case, step, *features, *outputs, "_slice", "_own")]
    cols = _history_cols(features, shaped, on)
    return own_rows(_past(out, cols, history, case, step)) if sliced else out


def even_subsample(df: DataFrame, most: int = 2000, case: str = "case_id", step: str = "step") -> DataFrame:
    """Rows at trunc(linspace(0, n - 1, m)), m = min(n, most), of each case."""
    n = F.count("*").over(Window.partitionBy(case))
    df = df.withColumn("_r", F.row_number().over(_w(case, step)) - 1).withColumn("_m", F.least(n, F.lit(most))).withColumn("_n", n)
    gap = (F.col("_n") - 1) / F.greatest(F.col("_m") - 1, F.lit(1))
    # r is taken if some whole k < m has trunc(k * gap) = r; k = ceil(r / gap) is the only one to try
    k = F.when(gap > 0, F.ceil(F.col("_r") / F.nullif(gap, F.lit(0.0)))).otherwise(0)
    near = F.exists(F.array(k - 1, k, k + 1), lambda x: (x >= 0) & (x < F.col("_m")) & (F.when(x == F.col("_m") - 1, F.col("_n") - 1).otherwise(F.floor(x * gap)) == F.col("_r")))
    return df.where(near).drop("_r", "_m", "_n")
