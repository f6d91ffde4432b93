"""Places and running sums in a total order, cut by ranges, so that no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written

#: A value with more than this share of all rows is looked up by broadcast, so at most so many are.
HOT_SHARE = 5_000


def running(df: DataFrame, order: list[str | Column], place: str = "_place", sums: dict[str, str] | None = None) -> tuple[DataFrame, int]:
    """(``df`` with its place from 1 and running sums, number of rows).

    ``sums`` names a new column for each whole-number column that is summed up to and
    including a row. Ranges of the order are slices; one row for each slice reaches the
    driver, from which the sums of earlier slices are broadcast. Ties must not matter, or
    ``order`` must have none.
    """
    sums = sums or {}
    cut = written(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    sizes = cut.groupBy("_slice").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"_s{k}") for k, c in enumerate(sums.values())])
    before, rows = [0] * (1 + len(sums)), []
    for r in sorted(sizes.collect()):  # one row for each slice
        rows.append((r[0], *before))
        before = [a + b for a, b in zip(before, r[1:])]
    names = ["_n", *[f"_s{k}" for k in range(len(sums))]]
    earlier = df.sparkSession.createDataFrame(rows, "_slice int, " + ", ".join(f"{n} long" for n in names))
    w = Window.partitionBy("_slice").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {place: F.row_number().over(w) + F.col("_n")}
    new |= {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_s{k}") for k, (n, c) in enumerate(sums.items())}
    return cut.join(F.broadcast(earlier), "_slice").withColumns(new).drop("_slice", *names), before[0]


def doubled_ranks(rows: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, int]:
    """((key, r0, r1, ...), number of rows): twice the average rank of each row in each column, null lowest, NaN highest.

    Equal values share a rank, so values are counted first and ranked by their running
    counts; rows then look their value up. Values of a large share of the rows are broadcast.
    """
    item = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("y"))
    long = written(rows.select(key, F.explode(F.array(*[item(k, c) for k, c in enumerate(cols)])).alias("i")).select(key, "i.*"))
    counts = long.groupBy("k", "y").agg(F.count("*").alias("n"))
    total = long.where("k = 0").count()
    ranked, _ = running(counts, ["k", "y"], sums={"upto": "n"})
    # ranks of a column follow those of the columns before it: all have as many rows
    ranked = ranked.select("k", "y", "n", (2 * (F.col("upto") - F.col("k").cast("long") * total) - F.col("n") + 1).alias("r"))
    hot = ranked.where(F.col("n") > total // HOT_SHARE).select("k", "y", F.col("r").alias("hot"))
    cold = ranked.where(F.col("n") <= total // HOT_SHARE).select(F.col("k").alias("ck"), F.col("y").alias("cy"), "r")
    on = (F.col("l.k") == F.col("h.k")) & F.col("l.y").eqNullSafe(F.col("h.y"))
    marked = long.alias("l").join(F.broadcast(hot).alias("h"), on, "left").select("l.*", "hot")
    found = marked.where("hot is null").join(cold, (F.col("k") == F.col("ck")) & F.col("y").eqNullSafe(F.col("cy"))).select(key, "k", "r")
    found = found.unionByName(marked.where("hot is not null").select(key, "k", F.col("hot").alias("r")))
    return found.groupBy(key).agg(*[F.max(F.when(F.col("k") == k, F.col("r"))).alias(f"r{k}") for k in range(len(cols))]), total
