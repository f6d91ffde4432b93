"""Registered queries: one or more for each operator, over the given tables, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.channels import INPUTS, OUTPUTS, resolve_alias, split_tasks
from ..functions.columns import case_id, design_key, key_hash, parse_stem, stem
from ..operators import align, cases, grid, mrmr, shape, split, stats, surrogate, weights
from ..operators._grid_np import FEATURES as GRID
from ..sources import files, sinks
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + 0.0
    return out.alias(name) if name else out


def rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def q6(c: str, name: str | None = None) -> str:
    return f'round({c}, 6) + 0.0::DOUBLE AS "{name or c.strip(chr(34))}"'


def q6s(cols: list[str]) -> str:
    return ", ".join(q6(f'"{c}"', c) for c in cols)


# --- names and projections -------------------------------------------------------------


@query(f"WITH {fx.FILE_NAMES} SELECT page_id, regexp_replace(replace(path, '/', '__'), '\\.[^.]*$', '') AS case_id, regexp_extract(path, '([^/]*)\\.out$', 1) AS stem FROM names")
def p1_case_key(spark, sf):
    n = fx.file_names(spark, sf)
    return n.select("page_id", case_id(F.col("path")).alias("case_id"), stem(F.col("path")).alias("stem"))


@query("SELECT c_custkey, 'wind_' || c_custkey || '_' || (c_custkey % 3 * 30 + 80) || 'm_' || (c_nationkey + 3) || 'mps_TI' || substr(c_mktsegment, 1, 1) || '_Yaw' || (c_custkey % 5 * 5) || '_Shear' || (c_custkey % 2) AS stem FROM customer")
def p2_design_key(spark, sf):
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(k, design_key(k, k % 3 * 30 + 80, F.col("c_nationkey") + 3, F.substring("c_mktsegment", 1, 1), k % 5 * 5, k % 2).alias("stem"))


@query(
    """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'wind_90m_' || (c_custkey % 20 + 4) || '.05mps_TI0_Yaw' || (c_custkey % 5 * 5)
      WHEN c_custkey % 4 = 1 THEN 'other_' || c_custkey ELSE 'wind_' || c_custkey || '_90m_' || (c_nationkey + 3) || 'mps_TIA_Yaw-5_Shear0.2' END AS stem FROM customer),
    m AS (SELECT *, regexp_extract(stem, '^wind_(?:([0-9]+)_)?([0-9.]+)m_([0-9.]+)mps_TI([^_]+)_Yaw(-?[0-9.]+)(?:_Shear(-?[0-9.]+))?$', ['a','b','c','d','e','f']) AS g FROM s)
    SELECT c_custkey, stem, TRY_CAST(nullif(g.a, '') AS BIGINT) AS seed, TRY_CAST(nullif(g.b, '') AS DOUBLE) AS ref_height, TRY_CAST(nullif(g.c, '') AS DOUBLE) AS speed,
      nullif(g.d, '') AS turbulence, TRY_CAST(nullif(g.e, '') AS DOUBLE) AS yaw, TRY_CAST(nullif(g.f, '') AS DOUBLE) AS shear FROM m"""
)
def p3_parse_case_key(spark, sf):
    k = F.col("c_custkey")
    s = (
        F.when(k % 4 == 0, F.concat(F.lit("wind_90m_"), (k % 20 + 4).cast("string"), F.lit(".05mps_TI0_Yaw"), (k % 5 * 5).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("other_"), k.cast("string")))
        .otherwise(F.concat(F.lit("wind_"), k.cast("string"), F.lit("_90m_"), (F.col("c_nationkey") + 3).cast("string"), F.lit("mps_TIA_Yaw-5_Shear0.2")))
    )
    return parse_stem(fx.table(spark, sf, "customer").select("c_custkey", s.alias("stem")))


_DIRTY = """,
dirty AS (SELECT case_id, line_no, CASE WHEN line_no % 17 = 0 THEN NULL ELSE CAST("Time" AS VARCHAR) END AS "Time",
    CASE WHEN line_no % 5 = 0 THEN 'bad' ELSE CAST("BldPitch1" AS VARCHAR) END AS "BldPitch1" FROM log
  UNION ALL SELECT case_id, line_no + 1000000, CAST("Time" AS VARCHAR), '1.5' FROM log WHERE line_no % 3 = 0)"""


@query(
    f"""WITH {fx.CHANNEL_LOG}{_DIRTY}
    SELECT case_id, line_no, {q6('TRY_CAST("Time" AS DOUBLE)', 'Time')}, {q6('TRY_CAST("BldPitch1" AS DOUBLE)', 'BldPitch1')}
    FROM dirty WHERE TRY_CAST("Time" AS DOUBLE) IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY case_id, TRY_CAST("Time" AS DOUBLE) ORDER BY line_no) = 1"""
)
def p4_clean_log(spark, sf):
    log = fx.channel_log(spark, sf)
    a = log.select(
        "case_id", "line_no", F.when(F.col("line_no") % 17 != 0, F.col("Time").cast("string")).alias("Time"),
        F.when(F.col("line_no") % 5 == 0, "bad").otherwise(F.col("BldPitch1").cast("string")).alias("BldPitch1"),
    )
    b = log.where("line_no % 3 = 0").select("case_id", (F.col("line_no") + 1_000_000).alias("line_no"), F.col("Time").cast("string").alias("Time"), F.lit("1.5").alias("BldPitch1"))
    return rounded(cases.clean_log(a.unionByName(b), span=SPAN), ["Time", "BldPitch1"])


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id FROM log WHERE channel || '_' || line_no % 8 IN ('error_1', 'click_2', 'view_3') GROUP BY 1 HAVING count(DISTINCT channel) = 3")
def p5_require_channels(spark, sf):
    """Channels of which only some cases have all: type and last digits of each event."""
    log = fx.channel_log(spark, sf).withColumn("channel", F.concat_ws("_", "channel", F.col("line_no") % 8))
    return cases.require_channels(log, ["error_1", "click_2", "view_3"])


@query(f'WITH {fx.CHANNEL_LOG} SELECT case_id, line_no, {q6s(["GenPwr", "Azimuth"])} FROM log')
def p6_select_channels(spark, sf):
    return rounded(cases.select_channels(fx.channel_log(spark, sf), ["GenPwr", "Azimuth"], ["case_id", "line_no"]), ["GenPwr", "Azimuth"])


@query(f"WITH {fx.NUMERIC_ROWS} SELECT case_id, {q6s(['l_tax', 'l_quantity', 'p_size'])} FROM num")
def p7_select_features(spark, sf):
    return rounded(cases.select_features(fx.numeric_rows(spark, sf), fx.FEATURES, [3, 0, 4], ["case_id"]), ["l_tax", "l_quantity", "p_size"])


def _checks(spark, sf):
    c = fx.case_table(spark, sf)
    k = F.col("case_id").cast("long")
    return c.select("case_id", (k % 11 != 0).alias("has_field"), (k % 7 != 0).alias("log_ok"), (k % 5 != 0).alias("has_columns"), (k % 3 != 0).alias("field_ok"), (F.col("n_eff") >= 2).alias("time_ok"))


@query(
    f"""WITH {fx.CASE_TABLE}, r AS (SELECT CASE WHEN CAST(case_id AS BIGINT) % 11 = 0 THEN 'field missing' WHEN CAST(case_id AS BIGINT) % 7 = 0 THEN 'log unreadable'
      WHEN CAST(case_id AS BIGINT) % 5 = 0 THEN 'missing columns' WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN 'field unreadable' WHEN n_eff < 2 THEN 'time range too short' END AS reason FROM cases)
    SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1"""
)
def p8_skip_report(spark, sf):
    return cases.skip_report(_checks(spark, sf))


_HEAD = """,
h AS (SELECT DISTINCT case_id, channel || '_' || line_no % 16 AS channel FROM log),
l AS (SELECT case_id, list(channel ORDER BY channel) AS names FROM h GROUP BY 1)"""


@query(f"WITH {fx.CHANNEL_LOG}{_HEAD} SELECT case_id, array_to_string(names, ',') AS names FROM l WHERE names <> (SELECT names FROM l ORDER BY case_id LIMIT 1)")
def p9_schema_consistency(spark, sf):
    h = fx.channel_log(spark, sf).select("case_id", F.concat_ws("_", "channel", F.col("line_no") % 16).alias("channel")).distinct()
    h = h.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("channel")))
    return cases.inconsistent_cases(h).select("case_id", F.array_join("names", ",").alias("names"))


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id, greatest(0, count(*) - 5 - 60) AS n_eff FROM log GROUP BY 1")
def p10_effective_samples(spark, sf):
    return cases.effective_samples(fx.channel_log(spark, sf), 5, 60)


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id, line_no, CAST(\"BldPitch3\" AS FLOAT) AS \"BldPitch3\", CAST(\"RotSpeed\" AS FLOAT) AS \"RotSpeed\" FROM log")
def p11_cast_precision(spark, sf):
    return cases.cast_precision(fx.channel_log(spark, sf).select("case_id", "line_no", "BldPitch3", "RotSpeed"), ["BldPitch3", "RotSpeed"])


def _half_sql(c: str) -> str:
    """Nearest half-precision number of a float column, ties to even."""
    x = f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
    unit = f"pow(2::DOUBLE, greatest(floor(log2(greatest(abs({x}), 1e-300::DOUBLE))), -14) - 10)"
    return f"CAST(round_even({x} / {unit}, 0) * {unit} AS FLOAT)"


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id, line_no, " + ", ".join(f'{_half_sql(chr(34) + c + chr(34))} AS "{c}"' for c in ("BldPitch3", "RotSpeed")) + " FROM log")
def p11_half_precision(spark, sf):
    return cases.cast_precision(fx.channel_log(spark, sf).select("case_id", "line_no", "BldPitch3", "RotSpeed"), ["BldPitch3", "RotSpeed"], "float16")


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id, line_no, {q6('\"RootFxb1\" + \"RootMyb1\"', 'root')}, {q6('\"TTDspFA\"', 'dsp')}, 2 AS root_size, 1 AS dsp_size FROM log")
def p12_split_tasks(spark, sf):
    """Sum of each task's outputs, where the tower and power outputs are absent."""
    tasks = split_tasks(["RootFxb1", "RootMyb1", "TTDspFA"])
    total = lambda v: sum((F.col(c) for c in v[1:]), F.col(v[0]))
    return fx.channel_log(spark, sf).select(
        "case_id", "line_no", *[r6(total(v), k) for k, v in tasks.items()], *[F.lit(len(v)).alias(f"{k}_size") for k, v in tasks.items()]
    )


@query(f"WITH {fx.WIND_FIELD} SELECT vec_id, " + ", ".join(q6(f"u[{i + 1}]", f"feat_{i}") for i in range(49)) + " FROM field")
def p13_name_columns(spark, sf):
    return rounded(cases.name_columns(fx.wind_field(spark, sf).select("vec_id", "u"), "u", size=49), [f"feat_{i}" for i in range(49)])


@query(
    f"""WITH {fx.CHANNEL_LOG} SELECT case_id, line_no, CASE WHEN k > 0 THEN channel || '_' || k ELSE channel END AS unique_name
    FROM (SELECT case_id, line_no, channel, row_number() OVER (PARTITION BY case_id, channel ORDER BY line_no) - 1 AS k FROM log)"""
)
def s3_unique_names(spark, sf):
    return files.numbered_names(fx.channel_log(spark, sf).select("case_id", "line_no", "channel"), "case_id", "line_no", "channel").drop("channel")


# --- joins and alignment ---------------------------------------------------------------


@query(
    f"""WITH {fx.FILE_NAMES}, p AS (SELECT page_id, path, regexp_extract(path, '([^/]*)\\.out$', 1) AS stem, length(path) - length(replace(path, '/', '')) AS depth FROM names),
    f AS (SELECT stem, path AS field_path FROM p WHERE page_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY stem ORDER BY depth <> 0, path) = 1)
    SELECT page_id, stem, field_path FROM p LEFT JOIN f USING (stem) WHERE page_id % 2 = 0"""
)
def j1_match_cases(spark, sf):
    p = fx.file_names(spark, sf).withColumns({"stem": stem(F.col("path")), "depth": F.size(F.split("path", "/")) - 1})
    fields = p.where("page_id % 2 = 1").select("stem", "depth", F.col("path").alias("field_path"))
    return cases.match_cases(p.where("page_id % 2 = 0").select("page_id", "stem"), fields).select("page_id", "stem", "field_path")


START, END, DT = 0.0, 30 * 86400.0, 21600.0
SPAN = 10 * 86400.0  # seconds of a time slice: three for each log
_GRID = f""",
stop AS (SELECT case_id, floor((least({END}::DOUBLE, max("Time"), (any_value(nt) - 1) * 14400.0::DOUBLE) - {START}::DOUBLE) / {DT}::DOUBLE) AS n
  FROM log JOIN headers USING (case_id) GROUP BY 1),
grid AS (SELECT case_id, i, {START}::DOUBLE + i * (({START}::DOUBLE + {DT}::DOUBLE) - {START}::DOUBLE) AS t FROM (SELECT case_id, unnest(range(0, CAST(n AS BIGINT) + 1)) AS i FROM stop WHERE n >= 1))"""


def _times(spark, sf):
    last = fx.channel_log(spark, sf).groupBy("case_id").agg(F.max("Time").alias("max_time"))
    return align.target_times(last.join(fx.headers(spark, sf), "case_id"), START, END, DT)


@query(f"WITH {fx.CHANNEL_LOG}, {fx.HEADERS}{_GRID} SELECT case_id, i, {q6('t')} FROM grid")
def j2_target_times(spark, sf):
    return rounded(_times(spark, sf), ["t"])


_J3 = ["BldPitch1", "RotSpeed", "GenPwr"]


def _lin(c: str) -> str:
    return (
        f'CASE WHEN a."Time" IS NULL THEN b."{c}" WHEN b."Time" IS NULL OR a."Time" = a.t THEN a."{c}" '
        f'ELSE (b."{c}" - a."{c}") / (b."Time" - a."Time") * (a.t - a."Time") + a."{c}" END'
    )


_ALIGNED = f"""{_GRID},
s AS (SELECT case_id, line_no, "Time", CASE WHEN line_no % 23 = 0 THEN NULL ELSE "BldPitch1" END AS "BldPitch1", "RotSpeed", "GenPwr" FROM log),
a AS (SELECT g.case_id, g.i, g.t, s."Time", {', '.join(f's."{c}"' for c in _J3)} FROM grid g ASOF LEFT JOIN s ON g.case_id = s.case_id AND g.t >= s."Time"),
b AS (SELECT g.case_id, g.i, s."Time", {', '.join(f's."{c}"' for c in _J3)} FROM grid g ASOF LEFT JOIN s ON g.case_id = s.case_id AND g.t <= s."Time"),
aligned AS (SELECT a.case_id, a.i, a.t, {', '.join(f'{_lin(c)} AS "{c}"' for c in _J3)} FROM a JOIN b USING (case_id, i))"""


def _aligned(spark, sf):
    log = fx.channel_log(spark, sf).withColumn("BldPitch1", F.when(F.col("line_no") % 23 != 0, F.col("BldPitch1")))
    return align.resample_linear(log, _times(spark, sf), _J3, span=SPAN)


@query(f"WITH {fx.CHANNEL_LOG}, {fx.HEADERS}{_ALIGNED} SELECT case_id, i, {q6s(['t', *_J3])} FROM aligned")
def j3_resample_linear(spark, sf):
    return rounded(_aligned(spark, sf), ["t", *_J3])


@query(
    f"""WITH {fx.CHANNEL_LOG}, {fx.HEADERS}{_GRID}, {fx.WIND_FIELD},
    k AS (SELECT CAST(CAST(case_id AS BIGINT) % 10 AS VARCHAR) AS case_id, case_id AS log_case, i, t,
      CAST(greatest(0, least(40 - 1, round_even(t / 50000.0::DOUBLE, 0))) AS BIGINT) AS wind_step FROM grid)
    SELECT k.log_case, k.case_id, i, wind_step, {q6('u[1]', 'u0')} FROM k JOIN field f ON f.case_id = k.case_id AND f.step = wind_step"""
)
def j4_align_nearest_step(spark, sf):
    g = _times(spark, sf).withColumn("log_case", F.col("case_id")).withColumn("case_id", (F.col("case_id").cast("long") % 10).cast("string"))
    f = fx.wind_field(spark, sf)
    h = f.select("case_id").distinct().select("case_id", F.lit(40).alias("nt"), F.lit(50000.0).alias("field_dt"))
    return align.align_nearest_step(g, f.select("case_id", "step", F.get("u", F.lit(0)).alias("u0")), h).select("log_case", "case_id", "i", "wind_step", r6("u0", "u0"))


@query(
    f"""WITH {fx.CHANNEL_LOG}, {fx.HEADERS}, k AS (SELECT case_id, line_no, nt, CAST(round_even("Time" / field_dt, 0) AS BIGINT) AS wind_step FROM log JOIN headers USING (case_id)),
    steps AS (SELECT unnest(range(0, 200)) AS wind_step)
    SELECT case_id, line_no, wind_step, CAST(wind_step * 2 AS INT) AS u0 FROM k JOIN steps USING (wind_step)
    WHERE case_id NOT IN (SELECT case_id FROM k WHERE wind_step < 0 OR wind_step >= nt)"""
)
def j5_align_strict_step(spark, sf):
    h = fx.headers(spark, sf).select("case_id", "nt", "field_dt")
    f = h.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("step")).withColumn("u0", F.col("step") * 2)
    return align.align_strict_step(fx.channel_log(spark, sf).select("case_id", "line_no", "Time"), f, h).select("case_id", "line_no", "wind_step", "u0")


@query(f"""WITH {fx.CASE_ROWS}, p AS (SELECT case_id, step, "BldPitch1", lead("GenPwr", 4) OVER w AS "GenPwr", lead(1, 4) OVER w AS there FROM rows WINDOW w AS (PARTITION BY case_id ORDER BY step))
    SELECT case_id, step, {q6s(['BldPitch1', 'GenPwr'])} FROM p WHERE there IS NOT NULL""")
def j6_pair_with_lag(spark, sf):
    r = fx.case_rows(spark, sf).select("case_id", "step", "BldPitch1", "GenPwr")
    return rounded(align.pair_with_lag(r, ["GenPwr"], 4), ["BldPitch1", "GenPwr"])


@query("""WITH d AS (SELECT 'wind_' || s_suppkey || '_90m_' || (s_nationkey + 3) || 'mps_TIA_Yaw0_Shear0' AS stem, s_acctbal AS usable_time FROM supplier),
    r AS (SELECT c_custkey, 'wind_' || (c_custkey % 200) || '_90m_' || (c_nationkey + 3) || 'mps_TIA_Yaw0_Shear0' AS stem FROM customer)
    SELECT c_custkey, stem, usable_time FROM r LEFT JOIN d USING (stem)""")
def j7_attach_design(spark, sf):
    key = lambda seed, nation: design_key(seed, F.lit(90), F.col(nation) + 3, F.lit("A"), F.lit(0), F.lit(0)).alias("stem")
    d = fx.table(spark, sf, "supplier").select(key(F.col("s_suppkey"), "s_nationkey"), F.col("s_acctbal").alias("usable_time"))
    r = fx.table(spark, sf, "customer").select("c_custkey", key(F.col("c_custkey") % 200, "c_nationkey"))
    return cases.attach_design(r, d).select("c_custkey", "stem", "usable_time")


@query(
    f"""WITH {fx.WIND_FIELD}, {fx.REGION_WEIGHTS}
    SELECT case_id, step, region, round(sum(u * weight), 6) + 0.0::DOUBLE AS u_wm, round(sum(v * weight), 6) + 0.0::DOUBLE AS v_wm, round(sum(w * weight), 6) + 0.0::DOUBLE AS w_wm
    FROM cell JOIN wt USING (i, j) GROUP BY ALL"""
)
def j8_attach_weights(spark, sf):
    return rounded(grid.attach_weights(fx.wind_field(spark, sf), fx.region_weights(spark), fx.NY, fx.NZ), ["u_wm", "v_wm", "w_wm"])


# --- grid features ---------------------------------------------------------------------


def _features(spark, sf, names):
    f = fx.wind_field(spark, sf)
    return rounded(grid.wind_features(f, fx.region_weights(spark), fx.NY, fx.NZ, names, ["vec_id"]), names)


def _weighted(regions: list[str]) -> str:
    """Weighted means, then variances, one row for each snapshot."""
    m = ", ".join(f"sum({c} * weight) FILTER (region = '{r}') AS {r}_{c}" for r in regions for c in "uvws")
    v = ", ".join(f"sum(weight * (c.{x} - m.{r}_{x}) ** 2) FILTER (region = '{r}') AS {r}_v{x}" for r in regions for x in "uvw")
    return (
        f", m AS (SELECT vec_id, {m} FROM cell JOIN wt USING (i, j) GROUP BY 1)"
        f", mv AS (SELECT c.vec_id, {v} FROM cell c JOIN wt USING (i, j) JOIN m ON m.vec_id = c.vec_id GROUP BY 1)"
    )


def _feature_query(name: str, names: list[str], exprs: list[str], ctes: str, source: str):
    sql = f"WITH {fx.WIND_FIELD}, {fx.REGION_WEIGHTS}{ctes} SELECT vec_id, {', '.join(q6(e, n) for n, e in zip(names, exprs))} FROM {source}"

    def run(spark, sf):
        return _features(spark, sf, names)

    run.__name__ = name
    query(sql)(run)


_BASE = """,
b AS (SELECT vec_id, avg(u) AS um, avg(v) AS vm, avg(w) AS wm, stddev_samp(u) AS us, stddev_samp(v) AS vs, stddev_samp(w) AS ws, max(s) AS smax, avg(s) AS sm,
  stddev_pop(u) AS up, covar_pop(u, v) AS uv, quantile_cont(s, 0.95) AS q95, quantile_cont(s, 0.05) AS q05, avg(0.5::DOUBLE * (u*u + v*v + w*w)) AS ke FROM cell GROUP BY 1)"""
_DIFF = """,
d AS (SELECT c.*, weight AS tw, s * (weight > 0)::INT AS ts FROM cell c JOIN wt ON wt.i = c.i AND wt.j = c.j AND region = 'tip'),
e AS (SELECT *, s - lag(s) OVER a AS si, s - lag(s) OVER b AS sj, ts - lag(ts) OVER a AS ti, ts - lag(ts) OVER b AS tj, u - lag(u) OVER a AS ui, u - lag(u) OVER b AS uj,
  u - 2 * lag(u) OVER a + lag(u, 2) OVER a AS uii, v - 2 * lag(v) OVER a + lag(v, 2) OVER a AS vii, u - 2 * lag(u) OVER b + lag(u, 2) OVER b AS ujj
  FROM d WINDOW a AS (PARTITION BY vec_id, j ORDER BY i), b AS (PARTITION BY vec_id, i ORDER BY j))"""

_feature_query("g1_component_means", ["global_u_mean", "global_v_mean", "global_w_mean"], ["um", "vm", "wm"], _BASE, "b")
_feature_query("g2_component_stds", ["global_u_std", "global_v_std", "global_w_std"], ["us", "vs", "ws"], _BASE, "b")
_feature_query("g3_tke", ["global_tke"], ["0.5::DOUBLE * (us*us + vs*vs + ws*ws)"], _BASE, "b")
_feature_query("g4_speed", ["global_speed_max", "global_gust_factor"], ["smax", "smax / (sm + 1e-8)"], _BASE, "b")
_feature_query("g5_grad_norm", ["global_grad_norm"], ["sqrt(avg(abs(si)) ** 2 + avg(abs(sj)) ** 2)"], _DIFF, "e GROUP BY vec_id")
_feature_query("g6_hub", ["hub_u_mean", "hub_tke"], ["hub_u", "0.5::DOUBLE * (hub_vu + hub_vv + hub_vw)"], _weighted(["hub"]), "m JOIN mv USING (vec_id)")
_feature_query("g7_yaw", ["yaw_u_mean", "yaw_u_std"], ["yaw_u", "sqrt(yaw_vu)"], _weighted(["yaw"]), "m JOIN mv USING (vec_id)")
_feature_query("g8_tip", ["tip_u_mean", "tip_speed_range"], ["sum(u * tw)", "max(ts) - min(CASE WHEN ts > 0 THEN ts ELSE 1e9::DOUBLE END)"], _DIFF, "e GROUP BY vec_id")
_feature_query("g9_corr", ["corr_u_mean", "corr_tke", "corr_ti_u"], ["corr_u", "0.5::DOUBLE * (corr_vu + corr_vv + corr_vw)", "sqrt(corr_vu) / (corr_u + 1e-8)"], _weighted(["corr"]), "m JOIN mv USING (vec_id)")
_feature_query("g10_flow_angles", ["corr_flow_inclination", "corr_flow_direction"], ["atan2(corr_w, corr_u)", "atan2(corr_v, corr_u)"], _weighted(["corr"]), "m")
_feature_query("g11_vertical_shear", ["vertical_shear_u", "vertical_shear_w", "vertical_shear_norm"], ["top_u - bottom_u", "top_w - bottom_w", "(top_u - bottom_u) / (corr_u + 1e-8)"], _weighted(["top", "bottom", "corr"]), "m")
_feature_query(
    "g12_lateral", ["lateral_asymmetry_u", "lateral_asymmetry_v", "lateral_tke_diff", "lateral_asymmetry_speed"],
    ["left_u - right_u", "left_v - right_v", "0.5::DOUBLE * (left_vu + left_vv + left_vw) - 0.5::DOUBLE * (right_vu + right_vv + right_vw)", "left_s - right_s"],
    _weighted(["left", "right"]), "m JOIN mv USING (vec_id)",
)
_feature_query(
    "g13_intensity_anisotropy", ["global_ti_total", "global_anisotropy_ratio"], ["sqrt(us*us + vs*vs + ws*ws) / (sm + 1e-8)", "greatest(us, vs, ws) / (least(us, vs, ws) + 1e-8)"], _BASE, "b"
)
_feature_query("g14_reynolds_stress", ["global_reynolds_stress"], ["uv"], _BASE, "b")
_feature_query("g15_hub_ti_total", ["hub_ti_total"], ["sqrt(hub_vu + hub_vv + hub_vw) / (hub_u + 1e-8)"], _weighted(["hub"]), "m JOIN mv USING (vec_id)")
_feature_query("g16_tip_vorticity", ["tip_vorticity_strength"], ["sqrt(avg(abs(ti)) ** 2 + avg(abs(tj)) ** 2)"], _DIFF, "e GROUP BY vec_id")
_feature_query(
    "g17_turbulence_ratio", ["corr_turbulence_ratio"], ["0.5::DOUBLE * (corr_vu + corr_vv + corr_vw) / (0.5::DOUBLE * (corr_u ** 2 + corr_v ** 2 + corr_w ** 2) + 1e-8)"], _weighted(["corr"]), "m JOIN mv USING (vec_id)"
)
_feature_query("g18_curvature", ["global_curvature_mean"], ["avg(sqrt(uii ** 2 + vii ** 2 + 1e-8))"], _DIFF, "e GROUP BY vec_id")
_LAP = _DIFF + """,
l AS (SELECT a.vec_id, a.uii + b.ujj AS x FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i - 1 = b.i AND a.j + 1 = b.j WHERE a.i >= 2 AND a.j BETWEEN 1 AND 5)"""
_feature_query("g19_laplacian", ["global_laplacian_norm"], ["avg(abs(x))"], _LAP, "l GROUP BY vec_id")
_PATCH = """,
n AS (SELECT c.vec_id, c.i, c.j, sum(o.s) AS s1, sum(o.s * o.s) AS s2 FROM cell c JOIN cell o ON o.vec_id = c.vec_id AND abs(o.i - c.i) <= 1 AND abs(o.j - c.j) <= 1 GROUP BY ALL)"""
_feature_query("g20_heterogeneity", ["spatial_heterogeneity"], ["stddev_samp((s2 - s1 * s1 / 9) / 8)"], _PATCH, "n GROUP BY vec_id")
_RISE = _DIFF + """,
g AS (SELECT e.vec_id, sum(abs(coalesce(uj, 0)) * t.weight) AS gt, sum(abs(coalesce(uj, 0)) * o.weight) AS gb FROM e JOIN wt t ON t.i = e.i AND t.j = e.j AND t.region = 'top'
  JOIN wt o ON o.i = e.i AND o.j = e.j AND o.region = 'bottom' GROUP BY 1)"""
_feature_query("g21_vertical_gradient_ratio", ["vertical_gradient_ratio"], ["(gt + 1e-8) / (gb + 1e-8)"], _RISE, "g")
_feature_query("g22_lateral_gradient_ratio", ["lateral_gradient_ratio"], ["abs(left_u - right_u) / (um + 1e-8)"], _BASE + _weighted(["left", "right"]), "m JOIN b USING (vec_id)")
_feature_query(
    "g23_skewness_kurtosis", ["global_skewness_u", "global_kurtosis_u"], ["avg(((u - um) / (up + 1e-8)) ** 3)", "avg(((u - um) / (up + 1e-8)) ** 4) - 3"], _BASE, "cell JOIN b USING (vec_id) GROUP BY vec_id"
)
_feature_query("g24_extreme_ratio", ["extreme_wind_ratio"], ["q95 / (q05 + 1e-8)"], _BASE, "b")
_feature_query("g25_kinetic_energy", ["kinetic_energy_density"], ["ke"], _BASE, "b")
_feature_query("g26_shear_production", ["shear_production_rate"], ["avg(abs(ui)) * any_value(abs(uv))"], _BASE + _DIFF, "e JOIN b USING (vec_id) GROUP BY vec_id")
_BOX = _BASE + """,
x AS (SELECT c.vec_id, c.i, c.j, sum(o.u) / 25 AS u, sum(o.v) / 25 AS v, sum(o.w) / 25 AS w FROM cell c JOIN cell o ON o.vec_id = c.vec_id AND abs(o.i - c.i) <= 2 AND abs(o.j - c.j) <= 2 GROUP BY ALL),
y AS (SELECT vec_id, 0.5::DOUBLE * (var_samp(u) + var_samp(v) + var_samp(w)) AS e FROM x GROUP BY 1)"""
_feature_query("g27_energy_cascade", ["energy_cascade_indicator"], ["e / (0.5::DOUBLE * (us*us + vs*vs + ws*ws) + 1e-8)"], _BOX, "y JOIN b USING (vec_id)")


_GROUPED = [SQL[k] for k in SQL if re.fullmatch(r"g\d+_\w+", k)]


@query("SELECT * FROM " + " JOIN ".join(f"({x}) AS x{i}" + (" USING (vec_id)" if i else "") for i, x in enumerate(_GROUPED)))
def g_all_features(spark, sf):
    return _features(spark, sf, GRID)


@query(
    f"""WITH {fx.WIND_FIELD}, src AS (SELECT p, least(6, floor(x)::INT) AS lo, least(6, floor(x)::INT + 1) AS hi, x - least(6, floor(x)::INT) AS f
      FROM (SELECT p, greatest((p + 0.5::DOUBLE) * 7 / 5 - 0.5::DOUBLE, 0) AS x FROM (SELECT unnest(range(0, 5)) AS p))),
    wg AS (SELECT p, lo AS k, 1 - f AS wt FROM src UNION ALL SELECT p, hi, f FROM src)
    SELECT vec_id, CAST(a.p AS INT) AS p, CAST(b.p AS INT) AS q, {q6('sum(u * a.wt * b.wt)', 'u')}, {q6('sum(v * a.wt * b.wt)', 'v')} FROM cell JOIN wg a ON a.k = i JOIN wg b ON b.k = j GROUP BY ALL"""
)
def g28_regrid_bilinear(spark, sf):
    g = grid.regrid_bilinear(fx.wind_field(spark, sf), 7, 7, 5, 5, ["vec_id"])
    long = g.select("vec_id", F.posexplode(F.arrays_zip("u", "v")).alias("k", "x"))
    return long.select("vec_id", F.floor(F.col("k") / 5).cast("int").alias("p"), (F.col("k") % 5).alias("q"), r6("x.u", "u"), r6("x.v", "v"))


@query(f"WITH {fx.WIND_FIELD}, c AS (SELECT case_id, avg(u) AS u_mean, avg(v) AS v_mean, avg(w) AS w_mean, count(DISTINCT step) AS n_steps, avg(u) FILTER (i = 3 AND j = 3) AS u_centre_mean FROM cell GROUP BY 1) SELECT case_id, n_steps, {q6s(['u_mean', 'v_mean', 'w_mean', 'u_centre_mean'])} FROM c")
def s7_field_summary(spark, sf):
    return rounded(grid.field_summary(fx.wind_field(spark, sf), None, 7, 7), ["u_mean", "v_mean", "w_mean", "u_centre_mean"])


# --- region weights --------------------------------------------------------------------


def _used_weights(spark, sf, w):
    """Weights with the mean of u at their point over all snapshots of the table."""
    means = fx.wind_field(spark, sf).select(F.posexplode("u").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("u_mean"))
    m = means.select(F.floor(F.col("k") / 7).cast("int").alias("i"), (F.col("k") % 7).alias("j"), "u_mean")
    return rounded(w.join(m, ["i", "j"]), ["weight", "u_mean"]).select("region", "i", "j", "weight", "u_mean")


def _weights_sql(regions: str) -> str:
    return (
        f"WITH {fx.WIND_FIELD}, {fx.REGION_WEIGHTS}, um AS (SELECT i, j, avg(u) AS u_mean FROM cell GROUP BY 1, 2) "
        f"SELECT region, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {q6('weight')}, {q6('u_mean')} FROM wt JOIN um USING (i, j) WHERE region IN ({regions})"
    )


@query(_weights_sql("'hub'"))
def w1_hub_weights(spark, sf):
    return _used_weights(spark, sf, weights.hub_weights(spark, 7))


@query(_weights_sql("'yaw'"))
def w2_yaw_weights(spark, sf):
    return _used_weights(spark, sf, weights.yaw_weights(spark, 7, fx.PLANE, fx.RADIUS, fx.YAW))


@query(_weights_sql("'tip'"))
def w3_tip_weights(spark, sf):
    return _used_weights(spark, sf, weights.tip_weights(spark, 7, fx.PLANE, fx.RADIUS))


@query(_weights_sql("'top', 'bottom', 'left', 'right'"))
def w4_half_rotor_weights(spark, sf):
    return _used_weights(spark, sf, weights.half_rotor_weights(spark, 7, fx.PLANE, fx.RADIUS))


@query(
    f"""WITH {fx.WIND_FIELD}, t AS (SELECT vec_id, round(w[1], 2) AS t1, v[5] AS t2 FROM field),
    ry AS (SELECT vec_id, rank() OVER (ORDER BY t1) + (count(*) OVER (PARTITION BY t1) - 1) / 2 AS a, rank() OVER (ORDER BY t2) + (count(*) OVER (PARTITION BY t2) - 1) / 2 AS b FROM t),
    rx AS (SELECT vec_id, i, j, rank() OVER (PARTITION BY i, j ORDER BY u) + (count(*) OVER (PARTITION BY i, j, u) - 1) / 2 AS x FROM cell),
    c AS (SELECT i, j, (abs(corr(x, a)) + abs(corr(x, b))) / 2 AS weight FROM rx JOIN ry USING (vec_id) GROUP BY 1, 2)
    SELECT 'corr' AS region, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {q6('weight / sum(weight) OVER ()', 'weight')} FROM c"""
)
def w5_spearman_weights(spark, sf):
    """Over all cases, with a target that has ties."""
    rows = fx.wind_field(spark, sf).select("vec_id", "u", F.round(F.get("w", F.lit(0)), 2).alias("t1"), F.get("v", F.lit(4)).alias("t2"))
    return rounded(weights.spearman_weights(rows, ["t1", "t2"], 7, "vec_id"), ["weight"])


# --- statistics ------------------------------------------------------------------------

_GROUPS = {"input": ["l_quantity", "l_discount"], "output": ["l_extendedprice"]}
_SCALERS = ", sc AS (" + " UNION ALL ".join(
    f"SELECT '{g}' AS grp, '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) + 1e-8 AS std FROM num" for g, v in _GROUPS.items() for c in v
) + ")"


@query(f"WITH {fx.NUMERIC_ROWS}{_SCALERS} SELECT grp, \"column\", round(mean, 8) AS mean, round(std, 8) AS std FROM sc")
def a1_fit_scalers(spark, sf):
    return stats.fit_scalers(fx.numeric_rows(spark, sf), _GROUPS).withColumns({c: F.round(c, 8) for c in ("mean", "std")})


@query(
    f"""WITH {fx.NUMERIC_ROWS}, k AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) + 1e-8 AS qs, avg(l_extendedprice) AS em, stddev_pop(l_extendedprice) + 1e-8 AS es FROM num)
    SELECT l_orderkey, l_linenumber, {q6('(l_quantity - qm) / qs', 'l_quantity')}, {q6('(l_extendedprice - em) / es', 'l_extendedprice')} FROM num, k"""
)
def a2_scale(spark, sf):
    n = fx.numeric_rows(spark, sf)
    s = stats.scale(n, stats.fit_scalers(n, _GROUPS), ["l_quantity", "l_extendedprice"])
    return rounded(s.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])


@query(f"WITH {fx.NUMERIC_ROWS} SELECT l_orderkey, l_linenumber, {q6('l_quantity')}, {q6('l_extendedprice')} FROM num")
def a2_unscale(spark, sf):
    n = fx.numeric_rows(spark, sf)
    sc = stats.fit_scalers(n, _GROUPS)
    cols = ["l_quantity", "l_extendedprice"]
    return rounded(stats.unscale(stats.scale(n, sc, cols), sc, cols).select("l_orderkey", "l_linenumber", *cols), cols)


@query(f"WITH {fx.NUMERIC_ROWS} SELECT CAST(s_suppkey AS VARCHAR) AS case_id, round(coalesce(avg(l_quantity), 0), 6) + 0.0::DOUBLE AS value FROM supplier LEFT JOIN num ON case_id = CAST(s_suppkey AS VARCHAR) GROUP BY 1")
def a3_stratify_value(spark, sf):
    c = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("case_id"))
    return rounded(stats.stratify_value(c, fx.numeric_rows(spark, sf), "l_quantity"), ["value"])


@query(f"WITH {fx.WIND_FIELD}, {fx.REGION_WEIGHTS}{_weighted(['hub'])} SELECT case_id, {q6('avg(hub_u)', 'value')} FROM m JOIN field USING (vec_id) GROUP BY 1")
def a4_resolve_alias(spark, sf):
    """Mean of a feature asked for by an older name."""
    key = resolve_alias("hub_mean_u", GRID)
    f = grid.wind_features(fx.wind_field(spark, sf), fx.region_weights(spark), 7, 7, [key], ["case_id", "step"])
    return rounded(stats.stratify_value(f.select("case_id").distinct(), f, key), ["value"])


def _bin_sql(c: str, source: str = "num") -> str:
    edges = " + ".join(f"CAST({c} >= lo_{c} + (hi_{c} - lo_{c}) * ({k}::DOUBLE / 10) AS INT)" for k in range(1, 10))
    return f"CASE WHEN hi_{c} > lo_{c} THEN {edges} ELSE 0 END AS {c}"


def _binned_sql(cols: list[str]) -> str:
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    return f", ends AS (SELECT {ends} FROM num), binned AS (SELECT l_orderkey, l_linenumber, {', '.join(_bin_sql(c) for c in cols)} FROM num, ends)"


def _mi_sql(a: str, b: str) -> str:
    return (
        f"(SELECT greatest(sum(n / t * ln(n * t / (na * nb)::DOUBLE)), 0) FROM (SELECT n::DOUBLE AS n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS na, sum(n) OVER (PARTITION BY y) AS nb "
        f"FROM (SELECT {a} AS x, {b} AS y, count(*) AS n FROM binned GROUP BY 1, 2)))"
    )


_MI = ["l_quantity", "l_extendedprice", "l_discount", "p_size"]


@query(f"WITH {fx.NUMERIC_ROWS}{_binned_sql(_MI)} SELECT * FROM binned")
def a5_bin_uniform(spark, sf):
    return stats.bin_uniform(fx.numeric_rows(spark, sf).select("l_orderkey", "l_linenumber", *_MI), _MI)


@query(
    f"WITH {fx.NUMERIC_ROWS}{_binned_sql(_MI)} SELECT feature_a, feature_b, {q6('mi')} FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_mi_sql(a, b) if a != b else '0.0::DOUBLE'} AS mi" for a in _MI for b in _MI) + ")"
)
def a6_pairwise_mi(spark, sf):
    binned = stats.bin_uniform(fx.numeric_rows(spark, sf).select(*_MI), _MI)
    return rounded(stats.pairwise_mi(binned, _MI), ["mi"])


_CONT = ["l_quantity", "l_extendedprice", "p_retailprice"]


@query()
def a7_relevance_mi(spark, sf):
    """Nearest-neighbour estimate over all rows."""
    return mrmr.relevance_mi(fx.numeric_rows(spark, sf), ["l_extendedprice", "p_retailprice"], ["o_totalprice"], fx.KEY)


_NEAR = """WITH c AS (SELECT c_custkey AS id, c_acctbal AS x, sum(o_totalprice) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
s AS MATERIALIZED (SELECT id, x / (SELECT stddev_pop(x) FROM c) AS x, y / (SELECT stddev_pop(y) FROM c) AS y FROM c),
d AS (SELECT a.id, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM s a JOIN s b ON a.id <> b.id),
r AS MATERIALIZED (SELECT id, d * (1 - 1e-10::DOUBLE) AS r FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = 3),
n AS (SELECT a.id, count(*) FILTER (abs(a.x - b.x) <= r) AS nx, count(*) FILTER (abs(a.y - b.y) <= r) AS ny FROM s a JOIN r USING (id) CROSS JOIN s b GROUP BY a.id),
psi AS (SELECT i AS n, -0.57721566490153286::DOUBLE + coalesce(sum(1 / i::DOUBLE) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM range(1, (SELECT count(*) + 1 FROM s)) AS t(i))
SELECT 'x' AS feature, round(greatest((SELECT p FROM psi WHERE n = (SELECT count(*) FROM s)) + (SELECT p FROM psi WHERE n = 3) - avg(a.p + b.p), 0), 3) + 0.0::DOUBLE AS relevance
FROM n JOIN psi a ON a.n = nx JOIN psi b ON b.n = ny"""


@query(_NEAR)
def a7_relevance_of_balances(spark, sf):
    """Nearest-neighbour information of customers' balances about their orders' totals; the SQL compares all pairs of customers."""
    c = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    c = c.groupBy(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")).agg(F.sum("o_totalprice").alias("y"))
    found = mrmr.relevance_mi(c.withColumns({v: F.col(v).cast("double") for v in "xy"}), ["x"], ["y"], ["id"])
    return found.withColumn("relevance", F.round("relevance", 3) + 0.0)


_REL = ["l_quantity", "l_discount", "p_retailprice"]


@query(
    f"WITH {fx.NUMERIC_ROWS}{_binned_sql([*_REL, 'l_extendedprice', 'o_totalprice'])} SELECT feature, round(({'mi1'} + {'mi2'}) / 2, 6) + 0.0::DOUBLE AS relevance FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_mi_sql(c, 'l_extendedprice')} AS mi1, {_mi_sql(c, 'o_totalprice')} AS mi2" for c in _REL) + ")"
)
def a8_relevance_mi_binned(spark, sf):
    return rounded(stats.relevance_mi_binned(fx.numeric_rows(spark, sf), _REL, fx.TARGETS), ["relevance"])


@query(f"WITH {fx.PREDICTIONS} SELECT {q6('avg((y_pred - y_true) ** 2)', 'mse')}, {q6('avg(abs(y_pred - y_true))', 'mae')} FROM pred")
def a9_mse_mae(spark, sf):
    return rounded(stats.metrics(fx.predictions(spark, sf)), ["mse", "mae"]).select("mse", "mae")


@query(f"WITH {fx.PREDICTIONS} SELECT {q6('100 * avg(abs(y_pred - y_true) / greatest(abs(y_true), 1e-8))', 'mape')} FROM pred")
def a10_mape(spark, sf):
    return rounded(stats.metrics(fx.predictions(spark, sf)), ["mape"]).select("mape")


_R2 = ", k AS (SELECT output, sum((y_true - y_pred) ** 2) AS res, count(*) * var_pop(y_true) AS tot FROM pred GROUP BY 1)"


@query(f"WITH {fx.PREDICTIONS}{_R2} SELECT {q6('1 - sum(res) / (sum(tot) + 1e-12)', 'r2')} FROM k")
def a11_r2(spark, sf):
    return rounded(stats.r2(fx.predictions(spark, sf)), ["r2"])


@query(f"WITH {fx.PREDICTIONS}{_R2} SELECT output, {q6('1 - res / (tot + 1e-12)', 'r2')} FROM k")
def a12_r2_per_output(spark, sf):
    return rounded(stats.r2_per_output(fx.predictions(spark, sf)), ["r2"])


@query(
    f"""WITH {fx.CASE_ROWS}, pred AS (SELECT 'GenPwr' AS output, "GenPwr" AS y_true, "GenPwr" + step % 3 AS y_pred FROM rows UNION ALL SELECT 'TTDspFA', "TTDspFA", "TTDspFA" * 0.9::DOUBLE FROM rows){_R2}
    SELECT output, {q6('1 - res / (tot + 1e-12)', 'r2')} FROM k UNION ALL SELECT 'all', {q6('1 - sum(res) / (sum(tot) + 1e-12)', 'r2')} FROM k"""
)
def a13_evaluate(spark, sf):
    """Truth and predictions enter scaled and by name; the scores are in units."""
    outs = ["GenPwr", "TTDspFA"]
    r = fx.case_rows(spark, sf).select("case_id", "step", *outs)
    sc = stats.fit_scalers(r, {"output": outs})
    truth = stats.scale(r, sc, outs)
    pred = stats.scale(r.withColumns({"GenPwr": F.col("GenPwr") + F.col("step") % 3, "TTDspFA": F.col("TTDspFA") * 0.9}), sc, outs)
    return rounded(stats.evaluate(pred.select("case_id", "step", "TTDspFA", "GenPwr"), truth, sc, outs, ["case_id", "step"]), ["r2"])


# --- shaping ---------------------------------------------------------------------------

_D = ["BldPitch1", "RotSpeed"]


def _deriv(c: str, w: str = "w") -> str:
    return f'CASE WHEN step = 0 THEN 0 ELSE ("{c}" - lag("{c}") OVER {w}) / 0.1::DOUBLE END'


_DERIV = f""",
d1 AS (SELECT case_id, step, "NacYaw", "Azimuth", "GenPwr", {', '.join(f'"{c}"' for c in _D)}, {', '.join(f'{_deriv(c)} AS "d{c}"' for c in _D)} FROM rows WINDOW w AS (PARTITION BY case_id ORDER BY step)),
d2 AS (SELECT *, {', '.join(f'{_deriv("d" + c)} AS "d2{c}"' for c in _D)} FROM d1 WINDOW w AS (PARTITION BY case_id ORDER BY step))"""
_T1 = [*_D, *[f"d{c}" for c in _D], *[f"d2{c}" for c in _D]]


@query(f"WITH {fx.CASE_ROWS}{_DERIV} SELECT case_id, step, {q6s(_T1)} FROM d2")
def t1_add_derivatives(spark, sf):
    r = fx.case_rows(spark, sf).select("case_id", "step", *_D)
    return rounded(shape.add_derivatives(r, 0.1, 2), _T1)


_ANG = {f"Azimuth_{f}{k}": f'{f}("Azimuth" * (pi() / 180) * {k})' for k in (1, 3, 6) for f in ("sin", "cos")} | {f"NacYaw_{f}": f'{f}("NacYaw" * (pi() / 180))' for f in ("sin", "cos")}


@query(f'WITH {fx.CASE_ROWS} SELECT case_id, step, {q6s(["RotSpeed"])}, {", ".join(q6(e, n) for n, e in _ANG.items())} FROM rows')
def t2_angle_encode(spark, sf):
    r = fx.case_rows(spark, sf).select("case_id", "step", "RotSpeed", "Azimuth", "NacYaw")
    return rounded(shape.angle_encode(r, "harmonics6"), ["RotSpeed", *_ANG])


@query(f'WITH {fx.CASE_ROWS} SELECT case_id, step, {q6s(["RotSpeed", "Azimuth", "NacYaw"])}, {", ".join(q6(f"{f}({chr(34)}{c}{chr(34)} * (pi() / 180))", f"{c}_{f}") for c in ("Azimuth", "NacYaw") for f in ("sin", "cos"))} FROM rows')
def t2_angle_encode_raw(spark, sf):
    r = fx.case_rows(spark, sf).select("case_id", "step", "RotSpeed", "Azimuth", "NacYaw")
    return rounded(shape.angle_encode(r, "sincos", True), ["RotSpeed", "Azimuth", "NacYaw", "Azimuth_sin", "Azimuth_cos", "NacYaw_sin", "NacYaw_cos"])


_H = [f"{c}_t{i}" for i in range(3) for c in ("BldPitch1", "Azimuth")]
_HSQL = ", ".join(f'lag("{c}", {i}) OVER w AS "{c}_t{i}"' for i in range(3) for c in ("BldPitch1", "Azimuth"))


@query(f"WITH {fx.CASE_ROWS}, h AS (SELECT case_id, step, {_HSQL} FROM rows WINDOW w AS (PARTITION BY case_id ORDER BY step)) SELECT case_id, step, {q6s(_H)} FROM h WHERE step >= 2")
def t3_add_history(spark, sf):
    r = fx.case_rows(spark, sf).select("case_id", "step", "BldPitch1", "Azimuth")
    return rounded(shape.add_history(r, ["BldPitch1", "Azimuth"], 2), _H)


_H4 = [f"RotSpeed_t{i}" for i in range(3)]


@query(f'WITH {fx.CASE_ROWS}, h AS (SELECT case_id, step, "Azimuth", "GenPwr", {", ".join(f"lag({chr(34)}RotSpeed{chr(34)}, {i}) OVER w AS {chr(34)}RotSpeed_t{i}{chr(34)}" for i in range(3))} FROM rows WINDOW w AS (PARTITION BY case_id ORDER BY step)) SELECT case_id, step, {q6s(["Azimuth", "GenPwr", *_H4])} FROM h WHERE step >= 2')
def t4_history_on_wind(spark, sf):
    r = fx.case_rows(spark, sf).select("case_id", "step", "RotSpeed", "Azimuth", "GenPwr")
    return rounded(shape.history_on(r, ["RotSpeed"], ["Azimuth"], 2, "wind"), ["Azimuth", "GenPwr", *_H4])


_T5 = ["BldPitch1", "RotSpeed", "dBldPitch1", "dRotSpeed", "NacYaw_sin", "NacYaw_cos"]
_T5H = [f"{c}_t{i}" for i in range(2) for c in _T5]
_T5SQL = ", ".join(f'lag("{c}", {i}) OVER w AS "{c}_t{i}"' for i in range(2) for c in _T5)


@query(
    f"""WITH {fx.CASE_ROWS}, p AS (SELECT case_id, step, "BldPitch1", "RotSpeed", "NacYaw", lead("GenPwr", 3) OVER w AS "GenPwr", lead(1, 3) OVER w AS there FROM rows WINDOW w AS (PARTITION BY case_id ORDER BY step)),
    q AS (SELECT *, {', '.join(f'{_deriv(c)} AS "d{c}"' for c in _D)}, sin("NacYaw" * (pi() / 180)) AS "NacYaw_sin", cos("NacYaw" * (pi() / 180)) AS "NacYaw_cos" FROM p WHERE there IS NOT NULL WINDOW w AS (PARTITION BY case_id ORDER BY step)),
    h AS (SELECT case_id, step, "GenPwr", {_T5SQL} FROM q WINDOW w AS (PARTITION BY case_id ORDER BY step))
    SELECT case_id, step, {q6s(['GenPwr', *_T5H])} FROM h WHERE step >= 1"""
)
def t5_process_case(spark, sf):
    out = shape.process_case(fx.case_rows(spark, sf), ["BldPitch1", "RotSpeed", "NacYaw"], ["GenPwr"], lag=3, derivative_order=1, angle_mode="sincos", history=1)
    return rounded(out, ["GenPwr", *_T5H])


@query(
    f"""WITH {fx.CASE_ROWS}, n AS (SELECT case_id, count(*) AS n FROM rows GROUP BY 1),
    pick AS (SELECT case_id, CASE WHEN k = m - 1 THEN n - 1 ELSE CAST(floor(k * ((n - 1)::DOUBLE / greatest(m - 1, 1))) AS BIGINT) END AS step
      FROM (SELECT case_id, n, least(n, 20) AS m, unnest(range(0, least(n, 20))) AS k FROM n))
    SELECT DISTINCT case_id, step, line_no FROM rows JOIN pick USING (case_id, step)"""
)
def t6_even_subsample(spark, sf):
    return shape.even_subsample(fx.case_rows(spark, sf), 20).select("case_id", "step", "line_no")


@query(f'WITH {fx.CASE_ROWS} SELECT case_id, len(list(step)) AS n, {q6("sum(x)", "weighted")} FROM (SELECT case_id, step, "BldPitch1" * (step + 1) AS x FROM rows) GROUP BY 1')
def s12_case_arrays(spark, sf):
    """Ordered matrices by case, summed with their positions."""
    a = cases.case_arrays(fx.case_rows(spark, sf), {"inputs": INPUTS, "outputs": OUTPUTS})
    total = F.aggregate(F.transform("inputs", lambda x, i: x[0] * (i + 1)), F.lit(0.0), lambda p, q: p + q)
    return a.select("case_id", F.size("inputs").cast("long").alias("n"), r6(total, "weighted"))


@query(f'WITH {fx.CASE_ROWS} SELECT case_id, step // 16 AS block, min(step) AS first_step, count(*) AS n, {q6("sum(x)", "weighted")} FROM (SELECT case_id, step, "BldPitch1" * (step % 16 + 1) AS x FROM rows) GROUP BY 1, 2')
def s12_case_array_blocks(spark, sf):
    """Matrices in blocks of 16 steps, summed with their positions."""
    a = cases.case_array_blocks(fx.case_rows(spark, sf), {"inputs": INPUTS, "outputs": OUTPUTS}, 16)
    total = F.aggregate(F.transform("inputs", lambda x, i: x[0] * (i + 1)), F.lit(0.0), lambda p, q: p + q)
    return a.select("case_id", "block", "first_step", F.size("inputs").cast("long").alias("n"), r6(total, "weighted"))


# --- sampling, splits, selection -------------------------------------------------------


def _md5(seed: int, cols: list[str]) -> str:
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


@query(f"SELECT l_returnflag AS case_id, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {_md5(42, ['l_orderkey', 'l_linenumber'])}, l_orderkey, l_linenumber) <= 300")
def l1_sample_large_cases(spark, sf):
    """Return flags as cases of many rows, of which few are ordered."""
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("case_id"), "l_orderkey", "l_linenumber")
    return cases.sample_per_case(rows, 300, 42, ["l_orderkey", "l_linenumber"])


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id, line_no, {q6('\"GenPwr\"', 'GenPwr')} FROM log QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {_md5(42, ['line_no'])}, line_no) <= 25")
def l1_sample_per_case(spark, sf):
    return rounded(cases.sample_per_case(fx.channel_log(spark, sf).select("case_id", "line_no", "GenPwr"), 25, 42, ["line_no"]), ["GenPwr"])


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id, line_no FROM log ORDER BY {_md5(7, ['line_no'])}, line_no LIMIT 300")
def l2_global_downsample(spark, sf):
    return cases.global_downsample(fx.channel_log(spark, sf).select("case_id", "line_no"), 300, 7, ["line_no"])


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id, line_no FROM log WHERE case_id IN (SELECT DISTINCT case_id FROM log ORDER BY 1 LIMIT 5)")
def l3_limit_cases(spark, sf):
    return cases.limit_cases(fx.channel_log(spark, sf).select("case_id", "line_no"), 5)


def _assign_sql(place: str, n: str) -> str:
    train = f"least(round_even({n} * 0.7::DOUBLE, 0), {n})"
    return f"CASE WHEN {place} <= {train} THEN 'train' WHEN {place} <= {train} + least(round_even({n} * 0.15::DOUBLE, 0), {n} - {train}) THEN 'val' ELSE 'test' END"


_SPLIT = f""",
binned AS (SELECT case_id, value, CAST(ntile(10) OVER (ORDER BY value, case_id) AS INT) AS bin FROM cases),
placed AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_md5(42, ['case_id'])}, case_id) AS r, count(*) OVER (PARTITION BY bin) AS n FROM binned),
splits AS (SELECT case_id, value, bin, {_assign_sql('r', 'n')} AS split FROM placed)"""


def _splits(spark, sf):
    return split.split_stratified(fx.case_table(spark, sf).select("case_id", "value"), (0.7, 0.15, 0.15), 42, 10)


@query(f"WITH {fx.CASE_TABLE}{_SPLIT} SELECT * FROM splits")
def l4_split_stratified(spark, sf):
    return _splits(spark, sf)


@query(
    f"""WITH {fx.CASE_TABLE}{_SPLIT} SELECT bin, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test,
    min(value) AS value_min, max(value) AS value_max FROM splits GROUP BY ROLLUP (bin)"""
)
def l5_split_summary(spark, sf):
    return split.split_summary(_splits(spark, sf))


@query(f"WITH {fx.CASE_TABLE}, p AS (SELECT case_id, row_number() OVER (ORDER BY {_md5(42, ['case_id'])}, case_id) AS r, count(*) OVER () AS n FROM cases) SELECT case_id, {_assign_sql('r', 'n')} AS split FROM p")
def l6_split_random(spark, sf):
    return split.split_random(fx.case_table(spark, sf).select("case_id"), (0.7, 0.15, 0.15), 42)


@query(
    f"""WITH RECURSIVE {fx.CASE_TABLE}, s AS (SELECT case_id, n_eff, CASE WHEN CAST(case_id AS BIGINT) % 10 = 3 THEN 'test' ELSE 'train' END AS split FROM cases),
    tr AS (SELECT case_id, n_eff, row_number() OVER (ORDER BY n_eff DESC, case_id) AS k, count(*) OVER () AS n FROM s WHERE split = 'train'),
    walk AS (SELECT 0::BIGINT AS k, 0::BIGINT AS ev, (SELECT coalesce(sum(n_eff), 0)::BIGINT FROM s WHERE split = 'test') AS et, '' AS dst
      UNION ALL SELECT tr.k, CASE WHEN walk.ev < 200 THEN walk.ev + tr.n_eff ELSE walk.ev END, CASE WHEN walk.ev >= 200 AND walk.et < 200 THEN walk.et + tr.n_eff ELSE walk.et END,
        CASE WHEN walk.ev < 200 THEN 'val' WHEN walk.et < 200 THEN 'test' ELSE 'train' END
      FROM walk JOIN tr ON tr.k = walk.k + 1 WHERE tr.k < tr.n)
    SELECT s.case_id, s.n_eff, coalesce(nullif(walk.dst, ''), s.split) AS split FROM s LEFT JOIN tr USING (case_id) LEFT JOIN walk ON walk.k = tr.k"""
)
def l7_fix_empty_splits(spark, sf):
    """No val cases at first, and at least 200 effective rows wanted in val and test."""
    c = fx.case_table(spark, sf)
    s = c.select("case_id", "n_eff", F.when(F.col("case_id").cast("long") % 10 == 3, "test").otherwise("train").alias("split"))
    return split.fix_empty_splits(s, 200)


def _rank_sql(most: int) -> str:
    """Greedy ranks by recursion: each round takes the best of those left."""
    cols = fx.FEATURES
    rel = " UNION ALL ".join(f"SELECT {i} AS idx, '{c}' AS f, {_mi_sql(c, 'o_totalprice')} AS rel" for i, c in enumerate(cols))
    mi = " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, {_mi_sql(cols[min(i, j)], cols[max(i, j)])} AS mi" for i in range(len(cols)) for j in range(len(cols)) if i != j)
    return f"""WITH RECURSIVE {fx.NUMERIC_ROWS}{_binned_sql([*cols, 'o_totalprice'])}, rel AS MATERIALIZED ({rel}), mi AS MATERIALIZED ({mi}),
    picked AS (
      SELECT * FROM (SELECT 1 AS rank, [idx] AS chosen, idx, rel AS score, 0.0::DOUBLE AS red FROM rel ORDER BY rel DESC, idx LIMIT 1)
      UNION ALL
      SELECT * FROM (
        SELECT p.rank + 1 AS rank, list_append(p.chosen, r.idx) AS chosen, r.idx, any_value(r.rel) - 0.5::DOUBLE * avg(m.mi) AS score, avg(m.mi) AS red
        FROM picked p JOIN rel r ON NOT list_contains(p.chosen, r.idx) JOIN mi m ON m.a = r.idx AND list_contains(p.chosen, m.b)
        WHERE p.rank < {most} GROUP BY p.rank, p.chosen, r.idx ORDER BY score DESC, r.idx LIMIT 1))
    SELECT CAST(rel.idx AS INT) AS original_index, f AS feature_name, {q6('rel', 'relevance')}, {q6('red', 'redundancy')}, {q6('score', 'selection_score')}, CAST(rank AS INT) AS rank
    FROM rel LEFT JOIN picked USING (idx)"""


@query(_rank_sql(6))
def l8_mrmr_rank(spark, sf):
    rel, mi = stats.binned_information(fx.numeric_rows(spark, sf), fx.FEATURES, ["o_totalprice"])
    ranked = mrmr.mrmr_rank(rel, mi, fx.FEATURES)
    return rounded(mrmr.score_table(spark, ranked, rel, fx.FEATURES), ["relevance", "redundancy", "selection_score"])


@query(_rank_sql(4))
def l9_select_features_mrmr(spark, sf):
    """Four features over all rows, without samples."""
    table, _ = mrmr.select_features_mrmr(fx.numeric_rows(spark, sf), fx.FEATURES, ["o_totalprice"], fx.KEY, max_cases=None, k=4, method="binned", sample=None, per_case=None)
    return rounded(table, ["relevance", "redundancy", "selection_score"])


@query(f"WITH {fx.CHANNEL_LOG} SELECT case_id, line_no, \"GenPwr\" FROM log UNION ALL SELECT case_id, line_no, \"TTDspFA\" FROM log")
def u1_stack_cases(spark, sf):
    log = fx.channel_log(spark, sf)
    return cases.stack_cases([log.select("case_id", "line_no", "GenPwr"), log.select("case_id", "line_no", F.col("TTDspFA").alias("GenPwr"))])


@query(f"WITH {fx.CHANNEL_LOG}{_DIRTY} SELECT case_id, min(line_no) AS line_no FROM dirty WHERE TRY_CAST(\"Time\" AS DOUBLE) IS NOT NULL GROUP BY case_id, \"Time\"")
def u2_first_per_time(spark, sf):
    log = fx.channel_log(spark, sf).select("case_id", "line_no", "Time")
    a = log.withColumn("Time", F.when(F.col("line_no") % 17 != 0, F.col("Time")))
    b = log.where("line_no % 3 = 0").withColumn("line_no", F.col("line_no") + 1_000_000)
    return cases.clean_log(a.unionByName(b), span=SPAN).select("case_id", "line_no")


@query(f"WITH {fx.CHANNEL_LOG}, {fx.HEADERS}{_GRID} SELECT case_id, count(*) AS n_samples, {q6('min(t)', 't_start')}, {q6('max(t)', 't_end')}, 14400.0::DOUBLE AS bts_dt, '7x7' AS grid_in, 1 AS wind_saved, 'float16' AS wind_dtype, case_id AS stem, 'logs/' || case_id || '.out' AS out_path, 'fields/' || case_id || '.bts' AS bts_path, 'data/rows' AS npz_path FROM grid GROUP BY case_id")
def s10_build_manifest(spark, sf):
    path = lambda top, end: F.concat(F.lit(top), "case_id", F.lit(end))
    h = fx.headers(spark, sf).withColumns({"out_path": path("logs/", ".out"), "bts_path": path("fields/", ".bts")})
    return rounded(sinks.build_manifest(_times(spark, sf), h, data_path="data"), ["t_start", "t_end"])


# --- surrogate -------------------------------------------------------------------------


def _tiny_model():
    import numpy as np

    m = surrogate.init_model(1, 2, {"pwr": ["GenPwr"]}, hidden=(1,), branch=(1,))
    w = m["weights"]
    w["branch0.w"], w["branch0.b"] = np.array([[0.5], [-0.25]]), np.array([0.1])
    w["trunk0.w"], w["trunk0.b"] = np.array([[0.3], [0.7]]), np.array([-0.2])
    w["pwr.in.w"], w["pwr.in.b"] = np.full((1, 32), 0.0), np.zeros(32)
    w["pwr.in.w"][0, 0], w["pwr.in.b"][0] = 2.0, 0.5
    w["pwr.out.w"], w["pwr.out.b"] = np.zeros((32, 1)), np.array([1.0])
    w["pwr.out.w"][0, 0] = 3.0
    return m


def _lrelu(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} ELSE 0.01::DOUBLE * ({x}) END)"


_M1 = f""",
n1 AS (SELECT case_id, step, "RotSpeed" - 10 AS f, {_lrelu('(0.5::DOUBLE * "BldPitch1" - 0.25::DOUBLE * "BldPitch2" + 0.1::DOUBLE)')} AS b FROM rows),
n2 AS (SELECT case_id, step, {_lrelu('(0.3::DOUBLE * f + 0.7::DOUBLE * b - 0.2::DOUBLE)')} AS h FROM n1)"""


@query(f"WITH {fx.CASE_ROWS}{_M1} SELECT case_id, step, {q6('3 * ' + _lrelu('(2 * h + 0.5::DOUBLE)') + ' + 1', 'GenPwr')} FROM n2")
def m1_score_surrogate(spark, sf):
    r = fx.case_rows(spark, sf).withColumn("f", F.col("RotSpeed") - 10)
    return rounded(surrogate.score_surrogate(r, _tiny_model(), ["f"], ["BldPitch1", "BldPitch2"], ["case_id", "step"]), ["GenPwr"])


def _fit(spark, sf, epochs=3):
    r = fx.case_rows(spark, sf)
    cols = [*INPUTS, "TTDspFA", "GenPwr"]
    held = F.pmod(F.xxhash64("case_id"), F.lit(5)) == 0
    s = stats.scale(r, stats.fit_scalers(r.where(~held), {"all": cols}), cols)  # moments of the training rows
    model = surrogate.init_model(1, len(INPUTS), {"dsp": ["TTDspFA"]}, hidden=(16,), branch=(8,))
    return surrogate.fit_surrogate(s.where(~held), s.where(held), model, ["GenPwr"], INPUTS, epochs, lr=0.01, batch_rows=256, dropout=0.05)


@query()
def m2_fit_surrogate(spark, sf):
    return _fit(spark, sf)[1]


_STEP = f""",
n1 AS (SELECT "RotSpeed" - 10 AS f, "BldPitch1" / 100 AS p, "BldPitch2" / 100 AS q, "GenPwr" / 1000 AS y, 0.5::DOUBLE * p - 0.25::DOUBLE * q + 0.1::DOUBLE AS zb FROM rows),
n2 AS (SELECT *, {_lrelu('zb')} AS b, 0.3::DOUBLE * f + 0.7::DOUBLE * b - 0.2::DOUBLE AS zh FROM n1),
n3 AS (SELECT *, {_lrelu('zh')} AS h, 2 * h + 0.5::DOUBLE AS zm, {_lrelu('zm')} AS m, 3 * m + 1 AS o, 2 * (o - y) / count(*) OVER () AS e FROM n2),
n4 AS (SELECT *, e * 3 * (CASE WHEN zm > 0 THEN 1 ELSE 0.01::DOUBLE END) AS dm, dm * 2 * (CASE WHEN zh > 0 THEN 1 ELSE 0.01::DOUBLE END) AS dh, dh * 0.7::DOUBLE * (CASE WHEN zb > 0 THEN 1 ELSE 0.01::DOUBLE END) AS db FROM n3),
g AS (SELECT unnest([
  {{'name': 'branch0.w', 'at': 0, 'w': 0.5::DOUBLE, 'g': sum(db * p)}}, {{'name': 'branch0.w', 'at': 1, 'w': -0.25, 'g': sum(db * q)}}, {{'name': 'branch0.b', 'at': 0, 'w': 0.1, 'g': sum(db)}},
  {{'name': 'trunk0.w', 'at': 0, 'w': 0.3, 'g': sum(dh * f)}}, {{'name': 'trunk0.w', 'at': 1, 'w': 0.7, 'g': sum(dh * b)}}, {{'name': 'trunk0.b', 'at': 0, 'w': -0.2, 'g': sum(dh)}},
  {{'name': 'pwr.in.w', 'at': 0, 'w': 2, 'g': sum(dm * h)}}, {{'name': 'pwr.in.b', 'at': 0, 'w': 0.5, 'g': sum(dm)}},
  {{'name': 'pwr.out.w', 'at': 0, 'w': 3, 'g': sum(e * m)}}, {{'name': 'pwr.out.b', 'at': 0, 'w': 1, 'g': sum(e)}}]) AS x FROM n4)"""


@query(
    f"WITH {fx.CASE_ROWS}{_STEP} SELECT x.name AS name, x.at AS at, {q6('x.w * (1 - 0.01::DOUBLE * 0.0001::DOUBLE) - 0.01::DOUBLE * x.g / (abs(x.g) + 1e-8::DOUBLE)', 'value')} FROM g"
    + f" UNION ALL SELECT 'loss', 0, {q6('avg((o - y) * (o - y))', 'value')} FROM n4"
)
def m2_full_batch_step(spark, sf):
    """Loss and weights of a small network after one optimiser step over all rows."""
    r = fx.case_rows(spark, sf).select((F.col("RotSpeed") - 10).alias("f"), *[(F.col(c) / 100).alias(c) for c in ("BldPitch1", "BldPitch2")], (F.col("GenPwr") / 1000).alias("GenPwr"))
    model, loss, _ = surrogate.fit_step(r, _tiny_model(), ["f"], ["BldPitch1", "BldPitch2"], lr=0.01)
    rows = [("loss", 0, loss)]
    for name, w in model["weights"].items():
        at = range(w.size) if w.size < 32 else [0]  # the other units of the head have no weights
        rows += [(name, i, float(w.ravel()[i])) for i in at]
    return rounded(spark.createDataFrame(rows, "name string, at int, value double"), ["value"])


@query("SELECT l_linenumber AS epoch, avg(l_discount) AS r2 FROM lineitem GROUP BY 1 ORDER BY round(avg(l_discount), 12) DESC, 1 LIMIT 1")
def m3_keep_best(spark, sf):
    """The line number with the highest mean discount stands for the best epoch."""
    h = fx.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.avg("l_discount").alias("r2"))
    return surrogate.keep_best(h)


@query()
def m3_best_epoch_of_fit(spark, sf):
    """The best epoch of a fit's own history."""
    return surrogate.keep_best(_fit(spark, sf)[1])


_ATT = [0.5, 1.5, -0.5]


@query(
    "WITH " + fx.CASE_ROWS + ', a AS (SELECT exp(0.5::DOUBLE) AS a, exp(1.5::DOUBLE) AS b, exp(-0.5::DOUBLE) AS c) '
    + f'SELECT case_id, step, {q6(chr(34) + "BldPitch1" + chr(34) + " * a / (a + b + c)", "BldPitch1")}, {q6(chr(34) + "RotSpeed" + chr(34) + " * b / (a + b + c)", "RotSpeed")}, {q6(chr(34) + "GenPwr" + chr(34) + " * c / (a + b + c)", "GenPwr")} FROM rows, a'
)
def m4_feature_importance(spark, sf):
    """Rows weighted by the softmax importance of three features."""
    import numpy as np

    names = ["BldPitch1", "RotSpeed", "GenPwr"]
    imp = surrogate.feature_importance(spark, {"weights": {"attention": np.array(_ATT)}}, names)
    packed = imp.agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("imp"))
    r = fx.case_rows(spark, sf).crossJoin(F.broadcast(packed))
    return r.select("case_id", "step", *[r6(F.col(n) * F.col("imp")[n], n) for n in names])


def _network_sql(model: dict, source: str, features: list[str], inputs: list[str], keys: list[str]) -> str:
    """The forward pass as nested SELECTs, one for each layer."""
    w, k = model["weights"], ", ".join(keys)
    num = lambda x: f"{float(x)!r}::DOUBLE"
    leaky = lambda x: f"CASE WHEN {x} > 0 THEN {x} ELSE 0.01::DOUBLE * ({x}) END"

    def layer(sql, name, cols, out, keep=()):
        sums = [" + ".join([num(b), *[f"{num(a)} * {c}" for a, c in zip(w[f"{name}.w"][:, i], cols)]]) for i, b in enumerate(w[f"{name}.b"])]
        z = ", ".join(f"({x}) AS z{i}" for i, x in enumerate(sums))
        rest = "".join(f", {c}" for c in keep)
        if out is None:
            return sums
        acts = ", ".join(f"{leaky(f'z{i}')} AS {out}{i}" for i in range(len(sums)))
        return f"SELECT {k}{rest}, {acts} FROM (SELECT {k}{rest}, {z} FROM ({sql}))", [f"{out}{i}" for i in range(len(sums))]

    att = surrogate._softmax(w["attention"])
    feats = [f"f{i}" for i in range(len(features))]
    sql = f"SELECT {k}, " + ", ".join([*[f"{num(a)} * {c} AS {f}" for a, c, f in zip(att, features, feats)], *[f"{c} AS i{j}" for j, c in enumerate(inputs)]]) + f" FROM {source}"
    sql, cols = layer(sql, "branch0", [f"i{j}" for j in range(len(inputs))], "b", feats)
    sql, cols = layer(sql, "trunk0", [*feats, *cols], "h")
    ((task, outs),) = model["tasks"].items()
    sql, cols = layer(sql, f"{task}.in", cols, "m")
    return f"SELECT {k}, " + ", ".join(f'round({x}, 6) + 0.0::DOUBLE AS "{o}"' for x, o in zip(layer(sql, f"{task}.out", cols, None), outs)) + f" FROM ({sql})"


def _attentive():
    import numpy as np

    model = surrogate.init_model(2, 2, {"root": ["RootFxb1", "RootMyb1"]}, hidden=(8,), branch=(4,), attention=True, seed=3)
    model["weights"]["attention"] = np.array([0.5, -0.25])
    return model


@query(f"WITH {fx.CASE_ROWS} " + _network_sql(_attentive(), "rows", ['"GenPwr"', '"RotSpeed"'], ['"BldPitch1"', '"BldPitch2"'], ["case_id", "step"]))
def m4_score_attentive(spark, sf):
    model = _attentive()
    return rounded(surrogate.score_surrogate(fx.case_rows(spark, sf), model, ["GenPwr", "RotSpeed"], ["BldPitch1", "BldPitch2"], ["case_id", "step"]), ["RootFxb1", "RootMyb1"])


# --- flagship: log to scaled, aligned rows ---------------------------------------------


@query(
    f"""WITH {fx.CHANNEL_LOG}, {fx.HEADERS}{_ALIGNED},
    d AS (SELECT case_id, i AS step, t, "BldPitch1", "RotSpeed", "GenPwr", CASE WHEN i = 0 THEN 0 ELSE ("RotSpeed" - lag("RotSpeed") OVER (PARTITION BY case_id ORDER BY i)) / {DT}::DOUBLE END AS "dRotSpeed" FROM aligned),
    k AS (SELECT avg("RotSpeed") AS rm, stddev_pop("RotSpeed") + 1e-8 AS rs, avg("GenPwr") AS gm, stddev_pop("GenPwr") + 1e-8 AS gs FROM d)
    SELECT case_id, step, {q6('t')}, {q6('("RotSpeed" - rm) / rs', 'RotSpeed')}, {q6('"dRotSpeed"', 'dRotSpeed')}, {q6('("GenPwr" - gm) / gs', 'GenPwr')} FROM d, k"""
)
def flagship(spark, sf):
    """Clean, resample on the grid, difference and standardise a campaign's logs."""
    rows = _aligned(spark, sf).withColumnRenamed("i", "step")
    rows = shape.add_derivatives(rows, DT, 1, names=["RotSpeed"])
    sc = stats.fit_scalers(rows, {"all": ["RotSpeed", "GenPwr"]})
    out = stats.scale(rows, sc, ["RotSpeed", "GenPwr"])
    return rounded(out.select("case_id", "step", "t", "RotSpeed", "dRotSpeed", "GenPwr"), ["t", "RotSpeed", "dRotSpeed", "GenPwr"])
