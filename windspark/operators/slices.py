"""Step ranges of cases with the rows beyond their borders, so that no task holds a whole case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a case that one task holds.
ROWS = 50_000
#: Seconds of a case that one task holds where rows go by time; a simulation of 600 s is two tasks.
SPAN = 300.0


def time_slice(t, span: float = SPAN):
    """Number of the time slice that ``t`` is in."""
    return F.floor(t / F.lit(float(span)))


def by_step(case: str, step: str):
    """The order within a slice made by :func:`with_halo`."""
    return Window.partitionBy(case, "_slice").orderBy(step)


def with_halo(df: DataFrame, before: int, after: int, case: str = "case_id", step: str = "step", rows: int = ROWS) -> DataFrame:
    """``df`` in slices of ``rows`` steps, each with the ``before`` and ``after`` rows beyond its borders.

    A row near a border is also sent to the slice behind it, row by row, so windows over
    ``_slice`` cost one shuffle by (case, slice). ``_own`` is false for rows that belong to another slice;
    :func:`own_rows` drops them. Steps must count from 0 in each case without gaps, as
    resampling gives them; other steps are an error when the rows are read.
    """
    before, rows = max(before, 1), max(rows, before, after, 1)
    at = F.floor(F.col(step) / F.lit(rows))
    place = F.col(step) - at * rows
    copy = lambda near, k: F.when(near, F.array(F.struct((at + k).alias("s"), F.lit(False).alias("own")))).otherwise(F.array())
    targets = F.concat(F.array(F.struct(at.alias("s"), F.lit(True).alias("own"))), copy(place >= rows - before, 1), copy((place < after) & (at > 0), -1))
    out = df.withColumn("_to", F.explode(targets)).withColumns({"_slice": F.col("_to.s"), "_own": F.col("_to.own")}).drop("_to")
    counted = F.col(step) == F.coalesce(F.lag(step).over(by_step(case, step)) + 1, F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("steps must count from 0 without gaps: case "), F.col(case).cast("string"))).cast("boolean")
    # the row number of the task, never negative, keeps later filters from being put before this check
    return out.withColumn("_own", F.when(~F.col("_own"), False).when(counted & (F.monotonically_increasing_id() >= 0), True).otherwise(wrong))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_slice", "_own")
