"""Mixing sources to target weights by entropy balancing.

Document rates r solve: minimise sum of r ln r - r over documents, subject to
sum(r * size) = target for every source and r <= cap. The dual is convex with one
unknown per source, and its solution is an exponential tilt, r = min(cap, exp(lam * x)),
x = size / mean size of the source. Newton steps on the dual are distributed: each is one
aggregation over (source, size, count), for all sources at once. Rates become whole copies by error diffusion.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_keys, stored, whole_rows
from .resharding import ranked

#: Words are runs of characters other than space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order (null last) take the weights in turn and share the sum
    of all sizes; a target stops at ``cap`` times its source's size and the excess goes
    to the others by weight, until none is above. That is min(cap * S, w * x) with the
    one level x that makes the sum right, found by ordering sources by cap * S / w. The
    windows here run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    by = by.withColumn("i", F.row_number().over(order) - 1).withColumn("w", w)
    by = by.withColumn("most", F.col("source_size") * float(cap)).withColumn("turn", F.col("most") / F.col("w"))
    up = Window.orderBy("turn", "i")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("x", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the level: first position (in order of turn) whose own cap is not reached by it
    level = F.min(F.when(F.col("x") <= F.col("turn"), F.struct("turn", "i", "x"))).over(Window.partitionBy())["x"]
    return by.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * F.col("level"))).alias("target")
    )


def tilts(hist: DataFrame, targets: DataFrame, cap: int = CAP, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(source, mean, lam): the dual solution by safeguarded Newton steps.

    ``hist`` has (source, size, n). A step sums words and their derivative at the
    present tilt by source, and keeps a bracket so that it always converges. Sources at
    the cap have no finite tilt; they end at the upper end of the bracket, where every
    rate is ``cap``. Steps end when every source is within ``tolerance`` of its target (or of one word);
    sources that are not after ``rounds`` steps are an error.
    """
    top = math.log(cap)
    state = stored(
        targets.join(hist.where("size > 0").groupBy(F.col("source").alias("_s")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least")), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("lo", F.lit(-60.0) * F.col("mean"))
        .withColumn("hi", F.lit(top) * F.col("mean") / F.col("least"))
        .withColumn("lam", F.when(F.col("target") >= cap * F.col("source_size"), F.col("hi")).otherwise(F.lit(0.0)))
        .withColumn("off", F.lit(1.0))
    )
    for _ in range(rounds):
        rows = hist.withColumnRenamed("source", "_s").join(state, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(top)))
        words = F.col("n") * F.col("size") * rate
        keep = ["source", "source_size", "target", "mean", "least", "lo", "hi", "lam"]
        now = rows.groupBy(*keep).agg(
            F.sum(words).alias("f"), F.sum(F.when(F.col("lam") * x < top, words * x).otherwise(0.0)).alias("g")
        )
        step = F.col("lam") - (F.col("f") - F.col("target")) / F.nullif(F.col("g"), F.lit(0.0))
        now = (
            now.withColumn("off", F.abs(F.col("f") - F.col("target")) / F.greatest("target", F.lit(1.0)))
            .withColumn("lo", F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi")))
            .withColumn("step", step)
            .withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
            .withColumn("lam", F.when(F.col("off") <= tolerance, F.col("lam")).when((F.col("g") > 0) & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise(F.col("mid")))
            .select(*keep, "off")
        )
        state = stored(now)
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"a source misses its target by {worst:.2g} of it after {rounds} steps")
    return state.select("source", "mean", "lam")


def _diffuse(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for one slice of a source: largest first, each takes the error over."""
    pdf = pdf.sort_values(["size", "id", "k"], ascending=[False, True, True], na_position="last")
    want = got = 0.0
    out = []
    for size, rate in zip(pdf["size"].tolist(), pdf["rate"].tolist()):
        want += rate * size
        low = math.floor(rate + 1e-9)
        high = min(CAP, low + 1)
        c = min(high, max(low, round((want - got) / size))) if size else 1
        got += c * size
        out.append(c)
    return pdf[["key", "id", "source", "size", "source_size", "target"]].assign(copies=out)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slice_rows: int = 2_000) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken.

    ``size`` counts words (null text: 0), ``taken`` = copies * size. A document is taken
    zero to three times; of empty documents one copy is kept. Every source's words end
    within about one small document per slice of its target. A source is cut by hash
    into slices of about ``slice_rows`` documents, so a source with most of the rows is
    rounded by many tasks. Same input, same result. Rows that repeat an id, or have none,
    are rounded each by itself and spread over the slices too.
    """
    out = _mix(row_keys(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _words(F.col(text_col)).alias("size")), "key"), slice_rows)
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def _words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mix(short: DataFrame, slice_rows: int = 2_000) -> DataFrame:
    """(key, id, source, size, source_size, target, copies) of stored rows (key, id, source, size)."""
    targets = stored(source_targets(short))
    hist = stored(short.groupBy("source", "size").agg(F.count("*").alias("n")))
    lam = tilts(hist, targets)
    per = (
        hist.groupBy(F.col("source").alias("s")).agg(F.ceil(F.sum("n") / slice_rows).alias("slices"))
        .join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
        .join(lam, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
    )
    rate = F.exp(F.least(F.coalesce(F.col("lam") * F.col("size") / F.col("mean"), F.lit(0.0)), F.lit(math.log(CAP))))
    # k tells rows of the same id, source and size apart; it is 0 for unique ids
    rows = ranked(short, ["id", "source", "size"], [F.col("key")], "k").join(per, F.col("source").eqNullSafe(F.col("s")))
    salt = F.xxhash64("id", F.lit(7))
    rows = rows.select(
        "key", F.col("id").cast("string").alias("id"), "source", "size", "source_size", "target",
        F.when(F.col("target") >= CAP * F.col("source_size"), F.lit(float(CAP))).otherwise(rate).alias("rate"),
        F.pmod(F.when(F.col("k") == 0, salt).otherwise(F.xxhash64(salt, "k")), F.col("slices")).alias("slice"), "k",
    )
    kinds = dict(short.dtypes)
    kind = f"key long, id string, source {kinds['source']}, size long, source_size long, target double, copies int"
    return rows.groupBy("source", "slice").applyInPandas(_diffuse, kind).withColumn("id", F.col("id").cast(kinds["id"]))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row repeated as often as :func:`mix` takes it, all columns kept.

    Every row has its own copies, by a key stored at the start.
    """
    wide = row_keys(docs.select(whole_rows(docs).alias("_row")))
    part = lambda c: F.col(f"_row.`{c}`")
    short = stored(wide.select(F.col("_key").alias("key"), part(id_col).alias("id"), part(source_col).alias("source"), _words(part(text_col)).alias("size")))
    n = _mix(short).where("copies > 0").select(F.col("key").alias("_key"), F.col("copies").alias("_copies"))
    taken = wide.join(n, "_key").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*[part(c).alias(c) for c in docs.columns])
