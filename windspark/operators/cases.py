"""Rows, columns and files of cases: cleaning, checks, projections, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import key_hash
from .slices import SPAN, time_slice


def clean_log(log: DataFrame, case: str = "case_id", time: str = "Time", line: str = "line_no", span: float = SPAN) -> DataFrame:
    """Numbers from text (bad text is null), rows without time dropped, first line per time kept.

    Rows are shuffled by case and time slice of ``span`` seconds, as resampling needs them.
    """
    numeric = {c: F.col(c).try_cast("double") for c, k in log.dtypes if k == "string" and c != case}
    cut = time_slice(F.col(time), span)
    df = log.withColumns(numeric).dropna(subset=[time]).repartition(F.col(case), cut)
    first = Window.partitionBy(F.col(case), cut, F.col(time)).orderBy(line)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def require_channels(headers: DataFrame, names: list[str], case: str = "case_id", channel: str = "channel") -> DataFrame:
    """Cases whose header has every one of ``names``."""
    need = sorted(set(names))
    found = headers.where(F.col(channel).isin(need)).groupBy(case).agg(F.count_distinct(channel).alias("n"))
    return found.where(F.col("n") == len(need)).select(case)


def select_channels(df: DataFrame, names: list[str], keep: list[str] | None = None, kind: str = "channel") -> DataFrame:
    """Columns ``keep`` and ``names`` in this order; an error names those that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing {kind}s: {', '.join(missing)}")
    return df.select(*(keep or []), *names)


def select_features(df: DataFrame, names: list[str], kept: list[int] | None, keep: list[str] | None = None) -> DataFrame:
    """Feature columns by position among ``names``; all where ``kept`` is None."""
    return select_channels(df, names if kept is None else [names[i] for i in kept], keep, "feature")


def skip_reasons(cases: DataFrame) -> DataFrame:
    """(case_id, reason) of cases with has_field, log_ok, has_columns, field_ok, time_ok; the first failing check counts."""
    reason = (
        F.when(~F.col("has_field"), "field missing").when(~F.col("log_ok"), "log unreadable")
        .when(~F.col("has_columns"), "missing columns").when(~F.col("field_ok"), "field unreadable")
        .when(~F.col("time_ok"), "time range too short")
    )
    return cases.select("case_id", reason.alias("reason")).where("reason is not null")


def skip_report(cases: DataFrame) -> DataFrame:
    return skip_reasons(cases).groupBy("reason").agg(F.count("*").alias("n"))


def inconsistent_cases(headers: DataFrame, case: str = "case_id", pos: str = "pos", name: str = "channel") -> DataFrame:
    """Cases whose ordered names differ from those of the first case (by name of case)."""
    lists = headers.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, name))), lambda x: x[name]).alias("names"))
    # one row: the header of one case
    first = lists.orderBy(case).limit(1).select(F.col("names").alias("_first"))
    return lists.crossJoin(F.broadcast(first)).where(~F.col("names").eqNullSafe(F.col("_first"))).select(case, "names")


def check_schema_consistency(headers: DataFrame, case: str = "case_id") -> None:
    bad = inconsistent_cases(headers, case).orderBy(case).limit(1).collect()
    if bad:
        raise ValueError(f"case {bad[0][0]} has other names: {bad[0][1]}")


def effective_samples(rows: DataFrame, lag: int, history: int, case: str = "case_id") -> DataFrame:
    return rows.groupBy(case).agg(F.greatest(F.lit(0), F.count("*") - lag - history).alias("n_eff"))


def cast_precision(df: DataFrame, cols: list[str], dtype: str = "float32") -> DataFrame:
    """Rounding of storage: float32 or float16 (kept as FLOAT)."""
    if dtype == "float32":
        return df.withColumns({c: F.col(c).cast("float") for c in cols})
    if dtype != "float16":
        raise ValueError(f"unknown storage type {dtype}")
    return df.withColumns({c: half_precision(F.col(c)) for c in cols})


def half_precision(x):
    """Nearest half-precision number, ties to even, by arithmetic on the exponent."""
    x = x.cast("float").cast("double")
    a = F.abs(x)
    power = F.greatest(F.floor(F.log2(F.when(a > 0, a).otherwise(1.0))), F.lit(-14))
    power = F.when(F.pow(F.lit(2.0), power + 1) <= a, power + 1).when((F.pow(F.lit(2.0), power) > a) & (power > -14), power - 1).otherwise(power)
    unit = F.pow(F.lit(2.0), power - 10)
    near = F.rint(x / unit) * unit
    inf = F.lit(float("inf"))
    return F.when(F.isnan(x) | (a == inf), x).when(F.abs(near) > 65504, F.when(x > 0, inf).otherwise(-inf)).otherwise(near).cast("float")


def name_columns(df: DataFrame, array_col: str, names: list[str] | None = None, size: int | None = None, kind: str = "feat") -> DataFrame:
    """A column for each position of an array; feat_0 ... or the fixed output list without names."""
    if names is None:
        from ..functions.channels import UNNAMED_OUTPUTS

        names = UNNAMED_OUTPUTS if kind == "output" else [f"feat_{i}" for i in range(size or 0)]
    rest = [c for c in df.columns if c != array_col]
    return df.select(*rest, *[F.get(F.col(array_col), F.lit(i)).alias(n) for i, n in enumerate(names)])


def match_cases(logs: DataFrame, fields: DataFrame) -> DataFrame:
    """Logs (stem, ...) with field_path: a field at the root wins, else the first path; null if none."""
    order = Window.partitionBy("stem").orderBy((F.col("depth") != 0).cast("int"), "field_path")
    best = fields.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("stem", "field_path")
    return logs.join(best, "stem", "left")


def attach_design(rows: DataFrame, design: DataFrame, on: str = "stem") -> DataFrame:
    """Experiment parameters of every row's case; unknown stems keep nulls. Of repeated stems the smallest row counts."""
    rest = [c for c in design.columns if c != on]
    first = design.groupBy(on).agg(F.min(F.struct(*rest)).alias("_d"))
    return rows.join(first, on, "left").select("*", *[F.col("_d")[c].alias(c) for c in rest]).drop("_d")


def stack_cases(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def limit_cases(rows: DataFrame, n: int, case: str = "case_id") -> DataFrame:
    """Rows of the first ``n`` cases by name."""
    first = rows.select(case).distinct().orderBy(case).limit(n)
    return rows.join(F.broadcast(first), case, "left_semi")  # n names


#: Cases that are thinned before their rows are ordered, the largest first; a broadcast of so many counts at most.
THINNED = 1_000_000
#: Standard deviations by which a thinned case is meant to exceed its cap.
MARGIN = 6.0


def sample_per_case(rows: DataFrame, cap: int, seed: int, key: list[str], case: str = "case_id") -> DataFrame:
    """At most ``cap`` rows of each case, those with the smallest key hashes.

    Cases are counted first. Of a case with far more rows only those are shuffled whose hash is
    below a threshold that leaves a little more than ``cap``; a case that falls short, as
    happens once in a billion, takes all its rows. So about ``cap`` rows of a case are ordered,
    and the result does not depend on the threshold.
    """
    hashed = rows.withColumn("_h", key_hash(seed, *[F.col(k) for k in key]))
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    want = cap + MARGIN * cap**0.5 + 10
    large = rows.groupBy(case).agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * want).orderBy(F.desc("_n"), case).limit(THINNED)
    large = large.select(case, (F.lit(want) / F.col("_n")).alias("_below"))
    marked = hashed.join(F.broadcast(large), case, "left")
    thin = marked.where(F.col("_below").isNull() | (place < F.col("_below")))
    left = thin.where("_below is not null").groupBy(case).agg(F.count("*").alias("_k"))
    short = large.join(left, case, "left").where(F.coalesce("_k", F.lit(0)) < cap).select(case)
    short = F.broadcast(short)  # some of the thinned cases
    both = thin.join(short, case, "left_anti").unionByName(marked.join(short, case, "left_semi")).drop("_below")
    order = Window.partitionBy(case).orderBy("_h", *key)
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).select(*rows.columns)


def default_cap(total: int, cases: int) -> int:
    """Rows of a case: three times its equal share of ``total``, 500 at least and 20,000 at most."""
    return min(max(3 * -(-total // max(cases, 1)), 500), 20_000)


def global_downsample(rows: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` rows when there are more, by top-k of the key hash."""
    return rows.orderBy(key_hash(seed, *[F.col(k) for k in key]), *key).limit(n)


def case_array_blocks(rows: DataFrame, groups: dict[str, list[str]], block_rows: int = 10_000, case: str = "case_id", step: str = "step") -> DataFrame:
    """(case, block, first step, ordered matrices): ``block_rows`` steps to a block, so cases of any size are records of bounded size.

    Blocks in order, one after another, are the case's matrices.
    """
    block = F.floor(F.col(step) / F.lit(block_rows)).alias("block")
    packed = F.array_sort(F.collect_list(F.struct(step, *[F.array(*cols).alias(g) for g, cols in groups.items()])))
    out = rows.groupBy(case, block).agg(packed.alias("_rows"))
    field = lambda g: F.transform("_rows", lambda x: x[g]).alias(g)
    return out.select(case, "block", F.get("_rows", F.lit(0))[step].alias("first_step"), *[field(g) for g in groups])


def case_arrays(rows: DataFrame, groups: dict[str, list[str]], case: str = "case_id", step: str = "step") -> DataFrame:
    """One row per case with ordered matrices; a case must fit in a record, else see :func:`case_array_blocks`."""
    packed = F.array_sort(F.collect_list(F.struct(step, *[F.array(*cols).alias(g) for g, cols in groups.items()])))
    out = rows.groupBy(case).agg(packed.alias("_rows"))
    field = lambda g: F.transform("_rows", lambda x: x[g]).alias(g)
    return out.select(case, *[field(g) for g in groups])
