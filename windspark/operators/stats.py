"""Scalers, binning, mutual information over bins and scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written


def fit_scalers(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(grp, column, mean, std) over all rows, population std + 1e-8, in one pass."""
    cols = [c for v in groups.values() for c in v]
    agg = df.agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    items = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), (F.col(f"s_{c}") + 1e-8).alias("std")) for g, v in groups.items() for c in v])
    checked = F.when(F.col("_n") == 0, F.raise_error(F.lit("no rows to fit scalers on")).cast("boolean")).otherwise(True)
    return agg.where(checked).select(F.explode(items).alias("x")).select("x.*")


def _scaler_row(scalers: DataFrame) -> DataFrame:
    """One row of maps, as scalers are one number pair per column."""
    return scalers.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "std")))).alias("_s"))


def scale(df: DataFrame, scalers: DataFrame, cols: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(_scaler_row(scalers)))
    return out.withColumns({c: (F.col(c) - F.col("_s")[c]["mean"]) / F.col("_s")[c]["std"] for c in cols}).drop("_s")


def unscale(df: DataFrame, scalers: DataFrame, cols: list[str], named: dict[str, str] | None = None) -> DataFrame:
    """Back to units; ``named`` maps columns to the scaler's names."""
    named = named or {}
    out = df.crossJoin(F.broadcast(_scaler_row(scalers)))
    return out.withColumns({c: F.col(c) * F.col("_s")[named.get(c, c)]["std"] + F.col("_s")[named.get(c, c)]["mean"] for c in cols}).drop("_s")


def stratify_value(cases: DataFrame, rows: DataFrame, key: str, case: str = "case_id") -> DataFrame:
    """Mean of ``key`` by case; 0 for cases without rows."""
    means = rows.groupBy(case).agg(F.avg(key).alias("value"))
    return cases.join(means, case, "left").fillna(0.0, ["value"])


def bin_uniform(df: DataFrame, cols: list[str], n_bins: int = 10) -> DataFrame:
    """Ordinals of equal-width bins between each column's ends; a constant column is 0.

    The ends, one row, are read first, so that a bin is the number of inner edges, plain
    numbers, at or below a value. Rows are stored before, so that what makes them runs once.
    """
    df = written(df) if cols else df
    value = lambda c: F.col(c).cast("double")
    ends = df.agg(*[f(value(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("lo", F.min), ("hi", F.max))]).head() if cols else None

    def bin_of(i, c):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or not hi > lo:
            return F.lit(0).alias(c)
        x, out = value(c), F.lit(0)
        for k in range(1, n_bins):
            out = out + (x >= F.lit(lo + (hi - lo) * (k / n_bins))).cast("int")
        return out.alias(c)

    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, *[bin_of(i, c) for i, c in enumerate(cols)])


def _mi(joint: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of p ln(p / (pa pb)) from counts by (keys, x, y)."""
    from pyspark.sql import Window

    n = F.sum("n").over(Window.partitionBy(*keys))
    na = F.sum("n").over(Window.partitionBy(*keys, "x"))
    nb = F.sum("n").over(Window.partitionBy(*keys, "y"))
    term = F.col("n") / n * F.log(F.col("n") * n / (na * nb).cast("double"))
    return joint.withColumn("_t", term).groupBy(*keys).agg(F.greatest(F.sum("_t"), F.lit(0.0)).alias("mi"))


def _joint(df: DataFrame, pairs: list[tuple[str, str]], a: str, b: str) -> DataFrame:
    """Counts by pair of columns and their bins (0 to 999).

    Tasks count each batch by pair and sum up over their batches, so what is shuffled is at
    most pairs x bins^2 numbers from a task. Rows with a null bin are left out of its pairs.
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    where = [(cols.index(p), cols.index(q)) for p, q in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0
        for batch in batches:
            x = [c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            width = max((int(c.max()) for c in x if len(c)), default=0) + 1
            for k, (i, j) in enumerate(where):
                ok = (x[i] >= 0) & (x[j] >= 0)
                n = np.bincount((x[i] * width + x[j])[ok], minlength=1)
                used = np.flatnonzero(n)
                held.append(((k * 1000 + used // width) * 1000 + used % width, n[used]))
                n_held += len(used)
            if n_held > 2_000_000:
                held = [summed(held)]
                n_held = len(held[0][0])
        keys, n = summed(held) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["k", "n"])

    n = df.select(*cols).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    pair = F.get(F.array(*[F.struct(F.lit(p).alias(a), F.lit(q).alias(b)) for p, q in pairs]), F.floor(F.col("k") / 1_000_000).cast("int"))
    n = n.select(pair.alias("i"), F.floor(F.col("k") / 1000 % 1000).cast("int").alias("x"), (F.col("k") % 1000).cast("int").alias("y"), "n")
    return n.select(f"i.{a}", f"i.{b}", "x", "y", "n")


def pairwise_mi(binned: DataFrame, cols: list[str]) -> DataFrame:
    """(feature_a, feature_b, mi) in nats for every ordered pair, 0 on the diagonal."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    half = _mi(_joint(binned, pairs, "feature_a", "feature_b"), ["feature_a", "feature_b"])
    both = F.array(F.struct(F.col("feature_a").alias("a"), F.col("feature_b").alias("b")), F.struct(F.col("feature_b").alias("a"), F.col("feature_a").alias("b")))
    full = half.select(F.explode(both).alias("p"), "mi").select(F.col("p.a").alias("feature_a"), F.col("p.b").alias("feature_b"), "mi")
    diagonal = binned.sparkSession.createDataFrame([(c, c, 0.0) for c in cols], "feature_a string, feature_b string, mi double")
    return full.unionByName(diagonal)


def relevance_mi_binned(df: DataFrame, cols: list[str], targets: list[str], n_bins: int = 10) -> DataFrame:
    """(feature, relevance): mean over targets of the binned mutual information, over all rows."""
    both = list(dict.fromkeys([*cols, *targets]))
    binned = bin_uniform(df.select(*both), both, n_bins)
    mi = _mi(_joint(binned, [(c, t) for c in cols for t in targets if c != t], "feature", "target"), ["feature", "target"])
    return mi.groupBy("feature").agg(F.avg("mi").alias("relevance"))


def binned_information(df: DataFrame, cols: list[str], targets: list[str], n_bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(relevance, pairwise information) as above, from one binning and one count of all pairs.

    Both are tables of numbers of features, read once.
    """
    both = list(dict.fromkeys([*cols, *targets]))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    pairs += [(c, t) for c in cols for t in targets if c != t and (c, t) not in pairs]
    found = _mi(_joint(bin_uniform(df.select(*both), both, n_bins), pairs, "a", "b"), ["a", "b"]).collect()  # one number for each pair
    mi = {(r.a, r.b): r.mi for r in found} | {(r.b, r.a): r.mi for r in found}
    spark = df.sparkSession
    relevance = [(c, [mi[c, t] for t in targets if c != t and (c, t) in mi]) for c in cols]
    relevance = spark.createDataFrame([(c, float(np.mean(v))) for c, v in relevance if v], "feature string, relevance double")
    square = [(a, b, 0.0 if a == b else mi[a, b]) for a in cols for b in cols if a == b or (a, b) in mi]
    return relevance, spark.createDataFrame(square, "feature_a string, feature_b string, mi double")


def metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", eps: float = 1e-8) -> DataFrame:
    """mse, mae and mape (percent) over all rows."""
    e = F.col(p) - F.col(y)
    return df.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(eps))) * 100).alias("mape"),
    )


def r2_per_output(df: DataFrame, output: str = "output", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(output, r2): 1 - residual / (total + 1e-12), total about the output's own mean."""
    return _sums(df, output, y, p).select(output, (1 - F.col("res") / (F.col("tot") + 1e-12)).alias("r2"))


def r2(df: DataFrame, output: str = "output", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """One row: the same with residuals and totals summed over outputs first."""
    return _sums(df, output, y, p).agg((1 - F.sum("res") / (F.sum("tot") + 1e-12)).alias("r2"))


def _sums(df, output, y, p):
    return df.groupBy(output).agg(F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("res"), (F.count("*") * F.var_pop(y)).alias("tot"))


def evaluate(pred: DataFrame, truth: DataFrame, scalers: DataFrame, outputs: list[str], keys: list[str]) -> DataFrame:
    """(output, r2) in units, outputs by name, with a row 'all'; an error if nothing matches.

    ``pred`` and ``truth`` hold scaled outputs by column name and the same keys.
    """
    p = unscale(pred.select(*keys, *outputs), scalers, outputs).select(*keys, *[F.col(o).alias(f"p_{o}") for o in outputs])
    t = unscale(truth.select(*keys, *outputs), scalers, outputs)
    rows = t.join(p, keys)
    items = F.array(*[F.struct(F.lit(o).alias("output"), F.col(o).alias("y_true"), F.col(f"p_{o}").alias("y_pred")) for o in outputs])
    sums = _sums(rows.select(F.explode(items).alias("i")).select("i.*"), "output", "y_true", "y_pred")
    each = sums.select("output", (1 - F.col("res") / (F.col("tot") + 1e-12)).alias("r2"))
    total = sums.agg((1 - F.sum("res") / (F.sum("tot") + 1e-12)).alias("r2"), F.count("*").alias("n"))
    total = total.where(F.when(F.col("n") == 0, F.raise_error(F.lit("no rows to evaluate")).cast("boolean")).otherwise(True))
    return each.unionByName(total.select(F.lit("all").alias("output"), "r2"))
