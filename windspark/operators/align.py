"""Time grids, resampling and alignment of logs with wind fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import ROWS, SPAN, by_step, own_rows, time_slice, with_halo


def target_times(cases: DataFrame, start: float, end: float, dt: float) -> DataFrame:
    """(case_id, i, t) from (case_id, max_time, nt, field_dt).

    The end is the least of ``end``, the log's last time and the field's last step; cases
    with under two times drop out. The step is (start + dt) - start, whose rounding the
    times carry.
    """
    stop = F.least(F.lit(float(end)), F.col("max_time"), (F.col("nt") - 1) * F.col("field_dt"))
    last = F.floor((stop - F.lit(float(start))) / F.lit(float(dt))).cast("long")
    step = (float(start) + float(dt)) - float(start)
    rows = cases.select("case_id", last.alias("_last")).where("_last >= 1")
    return rows.select("case_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("i")).withColumn(
        "t", F.lit(float(start)) + F.col("i") * F.lit(step)
    )


def resample_linear(log: DataFrame, grid: DataFrame, cols: list[str], time: str = "Time", span: float = SPAN) -> DataFrame:
    """Channels at the grid's times by linear interpolation, end values held outside.

    A case is cut into slices of ``span`` seconds, so a log of any length is many tasks. Each
    slice gets the last sample of all earlier slices and the first of all later ones, found by a
    running window over one summary row per slice; within a slice the samples around a time are found by
    running windows in both directions. A null sample makes its two segments null.
    """
    cut = lambda c: time_slice(F.col(c), span).alias("_slice")
    samples = log.select("case_id", cut(time), F.lit(None).cast("long").alias("i"), F.col(time).alias("t"), F.lit(0).alias("_kind"), F.struct(F.col(time).alias("t"), *cols).alias("_s"))
    times = grid.select("case_id", cut("t"), F.col("i").cast("long").alias("i"), "t", F.lit(1).alias("_kind"), F.lit(None).cast(samples.schema["_s"].dataType).alias("_s"))
    rows = samples.unionByName(times)
    ends = rows.groupBy("case_id", "_slice").agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))  # by time; null where a slice has no sample
    slices = Window.partitionBy("case_id")
    earlier = F.last("hi", True).over(slices.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("lo", True).over(slices.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("case_id", "_slice", F.array(earlier, later).alias("_e")).select("case_id", "_slice", F.explode("_e").alias("_s")).where("_s is not null")
    rows = rows.unionByName(ends.select("case_id", "_slice", F.lit(None).cast("long").alias("i"), F.col("_s.t").alias("t"), F.lit(0).alias("_kind"), "_s"))
    run = Window.partitionBy("case_id", "_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_a", F.last("_s", True).over(run.orderBy("t", "_kind")))
    rows = rows.withColumn("_b", F.last("_s", True).over(run.orderBy(F.desc("t"), F.desc("_kind"))))
    t, a, b = F.col("t"), F.col("_a"), F.col("_b")
    out = rows.where("_kind = 1")

    def value(c):
        y0, y1 = a[c], b[c]
        slope = (y1 - y0) / F.nullif(b["t"] - a["t"], F.lit(0.0))
        return (
            F.when(a.isNull(), y1).when(b.isNull() | (a["t"] == t), y0).otherwise(slope * (t - a["t"]) + y0).alias(c)
        )

    return out.select("case_id", "i", "t", *[value(c) for c in cols])


def nearest_step(t, field_dt, nt, clip: bool = True):
    """Half-even rounding of t / dt, clipped to the field."""
    k = F.rint(t / field_dt)
    return (F.greatest(F.lit(0.0), F.least(nt - 1, k)) if clip else k).cast("long")


def align_nearest_step(grid: DataFrame, fields: DataFrame, headers: DataFrame) -> DataFrame:
    """Grid rows (case_id, t, ...) with the snapshot at their nearest step.

    ``headers`` has (case_id, nt, field_dt). An equi-join on (case_id, wind_step), no range join.
    """
    keyed = grid.join(headers.select("case_id", "nt", "field_dt"), "case_id")
    keyed = keyed.withColumn("wind_step", nearest_step(F.col("t"), F.col("field_dt"), F.col("nt"))).drop("nt", "field_dt")
    return _at_step(keyed, fields)


def _at_step(keyed: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows with the snapshot of their step. Both sides may be exploded from one row a case, which Spark's sizes
    do not show, so neither is ever broadcast."""
    return keyed.join(fields.withColumnRenamed("step", "wind_step").hint("merge"), ["case_id", "wind_step"])


def strict_steps(loads: DataFrame, headers: DataFrame, time: str = "Time") -> DataFrame:
    """Rows with ``wind_step``, their nearest step; a case with any time outside its field is left out whole."""
    keyed = loads.join(headers.select("case_id", "nt", "field_dt"), "case_id")
    keyed = keyed.withColumn("wind_step", nearest_step(F.col(time), F.col("field_dt"), F.col("nt"), False))
    bad = keyed.groupBy("case_id").agg(F.min("wind_step").alias("lo"), F.max("wind_step").alias("hi"), F.max("nt").alias("n"))
    good = bad.where("lo >= 0 and hi < n").select("case_id")
    return keyed.drop("nt", "field_dt").join(good, "case_id", "left_semi")


def align_strict_step(loads: DataFrame, fields: DataFrame, headers: DataFrame, time: str = "Time") -> DataFrame:
    """As the nearest step without clipping; a case with any time outside its field is left out whole."""
    return _at_step(strict_steps(loads, headers, time), fields)


def lagged(sliced: DataFrame, outputs: list[str], lag: int, case: str, step: str) -> DataFrame:
    """As :func:`pair_with_lag` on rows in slices with ``lag`` rows behind each."""
    if lag <= 0:
        return sliced
    w = by_step(case, step)
    df = sliced.withColumn("_there", F.lead(F.lit(1), lag).over(w))
    return df.withColumns({c: F.lead(c, lag).over(w) for c in outputs}).where("_there is not null").drop("_there")


def pair_with_lag(rows: DataFrame, outputs: list[str], lag: int, case: str = "case_id", step: str = "step", slice_rows: int = ROWS) -> DataFrame:
    """Outputs of ``lag`` steps later beside the inputs; a case's last ``lag`` rows go. Steps count from 0."""
    if lag <= 0:
        return rows
    return own_rows(lagged(with_halo(rows, 0, lag, case, step, slice_rows), outputs, lag, case, step))
