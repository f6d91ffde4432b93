"""Splits of cases into train, val and test, by places in a total order of the cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key_hash
from .ranks import running


def _assign(place, n, ratios):
    train = F.least(F.rint(n * F.lit(float(ratios[0]))), n.cast("double"))
    val = F.least(F.rint(n * F.lit(float(ratios[1]))), n - train)
    return F.when(place <= train, "train").when(place <= train + val, "val").otherwise("test")


def split_stratified(cases: DataFrame, ratios: tuple[float, float, float], seed: int, bins: int = 10) -> DataFrame:
    """(case_id, value, bin, split) of (case_id, value): near-equal bins by value, shuffled inside."""
    kept = cases.columns
    df, n = running(cases, ["value", "case_id"])
    bins = max(2, min(bins, n))
    size, more = divmod(n, bins)  # the first bins have one case more
    zero = F.col("_place") - 1
    df = df.withColumn("bin", F.when(zero < more * (size + 1), F.floor(zero / (size + 1))).otherwise(more + F.floor((zero - more * (size + 1)) / max(size, 1))).cast("int") + 1)
    df, _ = running(df.drop("_place").withColumn("_h", key_hash(seed, F.col("case_id"))), ["bin", "_h", "case_id"])
    start = (F.col("bin") - 1) * size + F.least(F.col("bin") - 1, F.lit(more))
    own = F.lit(size) + (F.col("bin") <= more).cast("int")
    return df.select(*kept, "bin", _assign(F.col("_place") - start, own, ratios).alias("split"))


def split_random(cases: DataFrame, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    df, n = running(cases.withColumn("_h", key_hash(seed, F.col("case_id"))), ["_h", "case_id"])
    return df.withColumn("split", _assign(F.col("_place"), F.lit(n), ratios)).drop("_h", "_place")


def split_summary(splits: DataFrame) -> DataFrame:
    """Per bin, and once for all with a null bin: n, train, val, test, value range."""
    part = lambda s: F.sum((F.col("split") == s).cast("long")).alias(s)
    aggs = [F.count("*").alias("n"), part("train"), part("val"), part("test"), F.min("value").alias("value_min"), F.max("value").alias("value_max")]
    return splits.rollup("bin").agg(*aggs)


def fix_empty_splits(splits: DataFrame, min_effective: int = 1) -> DataFrame:
    """(case_id, n_eff, split) with empty val and test filled from train, largest cases first.

    Val, then test, takes the largest train case if it has none; then val takes more
    until it has ``min_effective`` rows, then test; one case always stays in train. The
    order of moves is the order of train cases by effective rows, so the numbers of moves
    follow from running sums over it: they are looked up, not walked.
    """
    splits = splits.select("case_id", "n_eff", "split")
    train, n_train = running(splits.where("split = 'train'"), [F.desc("n_eff"), F.asc("case_id")], "k", {"cum": "n_eff"})
    had = {r.split: (r.n, r.e or 0) for r in splits.groupBy("split").agg(F.count("*").alias("n"), F.sum("n_eff").alias("e")).collect()}
    (n_val, e_val), (n_test, e_test) = had.get("val", (0, 0)), had.get("test", (0, 0))

    def upto(k):  # effective rows of the k largest
        return train.where(F.col("k") == k).select("cum").head()[0] if k else 0

    def moves(used, have):
        """How many more cases a split takes that has ``have`` effective rows, after the first ``used``."""
        if have >= min_effective:
            return 0
        before = F.col("cum") - F.col("n_eff") - upto(used)
        return train.where((F.col("k") > used) & (F.col("k") < n_train) & (have + before < min_effective)).count()

    first_val = int(n_val == 0 and n_train > 1)
    first_test = int(n_test == 0 and n_train - first_val > 1)
    used = first_val + first_test
    to_val = moves(used, e_val + upto(first_val))
    to_test = moves(used + to_val, e_test + upto(used) - upto(first_val))
    k = F.col("k")
    now = F.when(k <= first_val, "val").when(k <= used, "test").when(k <= used + to_val, "val").when(k <= used + to_val + to_test, "test").otherwise("train")
    return train.select("case_id", "n_eff", now.alias("split")).unionByName(splits.where("split <> 'train'"))


def repair_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(split, cases, effective, moved_in) after the repair."""
    own = after.groupBy("split").agg(F.count("*").alias("cases"), F.sum("n_eff").alias("effective"))
    was = before.groupBy("split").agg(F.count("*").alias("was"))
    return own.join(was, "split", "left").select("split", "cases", "effective", F.greatest(F.col("cases") - F.coalesce("was", F.lit(0)), F.lit(0)).alias("moved_in"))
