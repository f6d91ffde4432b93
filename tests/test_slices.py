"""Operators on slices of cases: the same as on whole cases, wherever the cuts fall."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from windspark.operators import align, shape, slices


@pytest.mark.parametrize("span", [0.3, 1.0, 2.5, 100.0])
def test_resample_on_any_cut(spark, span):
    rng = np.random.default_rng(int(span * 10))
    logs, grid, want = [], [], {}
    for c in ("a", "b", "gap", "one"):
        t = np.sort(rng.uniform(-2, 12, 60)) if c != "one" else np.array([4.0])
        if c == "gap":  # many slices without a sample
            t = t[(t < 1) | (t > 9)]
        y, z = rng.normal(size=len(t)), rng.normal(size=len(t))
        at = np.append(np.linspace(-3, 13, 45), t[: len(t) // 2])
        logs += [(c, float(p), float(q), float(r)) for p, q, r in zip(t, y, z)]
        grid += [(c, i, float(x)) for i, x in enumerate(at)]
        want[c] = (np.interp(at, t, y), np.interp(at, t, z))
    log = spark.createDataFrame(logs, "case_id string, Time double, y double, z double").repartition(3)
    g = spark.createDataFrame([*grid, ("none", 0, 1.0)], "case_id string, i int, t double").repartition(3)
    got = {(r.case_id, r.i): r for r in align.resample_linear(log, g, ["y", "z"], span=span).collect()}
    assert len(got) == len(grid) + 1
    for c, (y, z) in want.items():
        np.testing.assert_allclose([[got[c, i].y, got[c, i].z] for i in range(len(y))], np.column_stack([y, z]), rtol=1e-9, atol=1e-12)
    assert got["none", 0].y is None  # a case without a log


def test_resample_keeps_null_segments(spark):
    log = spark.createDataFrame([("n", 0.0, 1.0), ("n", 1.0, None), ("n", 2.0, 3.0)], "case_id string, Time double, y double")
    g = spark.createDataFrame([("n", i, t) for i, t in enumerate([0.5, 1.5, 2.0, 9.0])], "case_id string, i int, t double")
    for span in (0.4, 1.0, 50.0):
        got = {r.i: r.y for r in align.resample_linear(log, g, ["y"], span=span).collect()}
        assert got == {0: None, 1: None, 2: 3.0, 3: 3.0}


def series(spark, sizes=(1, 2, 5, 23, 40)):
    rng = np.random.default_rng(7)
    rows = [(f"c{n}", i, *map(float, rng.normal(size=4))) for n in sizes for i in range(n)]
    return spark.createDataFrame(rows, "case_id string, step long, RotSpeed double, BldPitch1 double, NacYaw double, GenPwr double").repartition(3)


def same(a, b):
    assert a.columns == b.columns
    key = lambda r: (r.case_id, r.step)
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(a) == len(b) and [key(r) for r in a] == [key(r) for r in b]
    for x, y in zip(a, b):
        assert x == y


@pytest.mark.parametrize("n", [1, 3, 7])
def test_shaping_on_any_cut(spark, n):
    df = series(spark)
    whole = 1_000
    for lag in (1, 4):
        same(align.pair_with_lag(df, ["GenPwr"], lag, slice_rows=n), align.pair_with_lag(df, ["GenPwr"], lag, slice_rows=whole))
    for order in (1, 2):
        same(shape.add_derivatives(df, 0.1, order, slice_rows=n), shape.add_derivatives(df, 0.1, order, slice_rows=whole))
    for k in (1, 3, 6):
        same(shape.add_history(df, ["RotSpeed", "NacYaw"], k, slice_rows=n), shape.add_history(df, ["RotSpeed", "NacYaw"], k, slice_rows=whole))
    for lag, order, k in ((0, 0, 0), (3, 2, 4), (0, 1, 2), (5, 0, 0), (2, 2, 0)):
        shaped = lambda rows: shape.process_case(df, ["RotSpeed", "BldPitch1", "NacYaw"], ["GenPwr"], lag=lag, derivative_order=order, history=k, slice_rows=rows)  # noqa: B023, E731
        same(shaped(n), shaped(whole))


def test_whole_cases_are_as_by_hand(spark):
    df = series(spark, (9,))
    x = {r.step: r for r in df.collect()}
    got = {r.step: r for r in shape.process_case(df, ["RotSpeed"], ["GenPwr"], lag=2, dt=0.5, derivative_order=2, history=1, slice_rows=3).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    d = {0: 0.0} | {i: (x[i].RotSpeed - x[i - 1].RotSpeed) / 0.5 for i in range(1, 9)}
    d2 = {0: 0.0} | {i: (d[i] - d[i - 1]) / 0.5 for i in range(1, 9)}
    for i, r in got.items():
        assert r.GenPwr == x[i + 2].GenPwr
        np.testing.assert_allclose([r.RotSpeed_t0, r.RotSpeed_t1, r.dRotSpeed_t0, r.dRotSpeed_t1, r.d2RotSpeed_t0, r.d2RotSpeed_t1], [x[i].RotSpeed, x[i - 1].RotSpeed, d[i], d[i - 1], d2[i], d2[i - 1]])


@pytest.mark.parametrize("steps", [[1, 2, 3], [0, 1, 3], [0, 1, 1, 2], [0, 1, 2, 3, 8, 9]])
def test_steps_with_gaps_are_an_error(spark, steps):
    df = spark.createDataFrame([("a", s, 1.0) for s in steps], "case_id string, step long, RotSpeed double")
    with pytest.raises(PySparkException, match="count from 0"):
        shape.add_history(df, ["RotSpeed"], 1, slice_rows=4).collect()


def test_one_shuffle_and_no_window_by_case(spark):
    df = series(spark)
    plan = shape.process_case(df, ["RotSpeed", "NacYaw"], ["GenPwr"], lag=2, history=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert all("_slice" in line for line in plan.splitlines() if "Window [" in line)


def test_long_case_is_many_slices(spark):
    n = 5 * slices.ROWS
    df = spark.range(n).selectExpr("'a' as case_id", "id as step", "cast(id as double) as RotSpeed", "1.0D as GenPwr")
    cut = slices.with_halo(df, 2, 3)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) == 6 and max(sizes) <= slices.ROWS + 5
    assert shape.add_history(df, ["RotSpeed"], 2).count() == n - 2


def test_running_places_and_sums(spark):
    from pyspark.sql import functions as F

    from windspark.operators.ranks import running

    rng = np.random.default_rng(2)
    data = [(int(i), int(v), int(s)) for i, (v, s) in enumerate(zip(rng.integers(0, 9, 500), rng.integers(0, 50, 500)))]
    df = spark.createDataFrame(data, "id long, v int, s long").repartition(5)
    got, n = running(df, [F.desc("v"), F.asc("id")], sums={"upto": "s"})
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    assert n == 500 and {(r.id, r._place, r.upto) for r in got.collect()} == {(r[0], k + 1, sum(x[2] for x in order[: k + 1])) for k, r in enumerate(order)}
    assert running(df.limit(0), ["v"])[0].count() == 0


@pytest.mark.parametrize("slice_rows", [20, 1_000])
def test_spearman_on_slices(spark, monkeypatch, slice_rows):
    import pandas as pd

    from windspark.operators import ranks, weights

    monkeypatch.setattr(weights, "BLOCK_ROWS", 37)
    monkeypatch.setattr(ranks, "HOT_SHARE", 20)
    rng = np.random.default_rng(6)
    n = 300
    u = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n), np.full(n, 4.0), rng.integers(0, 200, n)])  # smooth, heavily tied, constant, some ties
    t = pd.DataFrame({"a": u[:, 0] + rng.normal(size=n), "b": np.where(rng.random(n) < 0.7, 1.0, rng.normal(size=n)), "c": np.full(n, 2.0)})
    rows = spark.createDataFrame([(u[k].tolist(), *map(float, t.iloc[k])) for k in range(n)], "u array<double>, a double, b double, c double").repartition(4)
    got = {(r.i, r.j): r.weight for r in weights.spearman_weights(rows, ["a", "b", "c"], 2, slice_rows=slice_rows).collect()}
    rho = pd.DataFrame(u).rank().apply(lambda x: t.rank().corrwith(x).abs().fillna(0).mean())
    want = (rho / rho.sum()).to_numpy()
    np.testing.assert_allclose([got[k // 2, k % 2] for k in range(4)], want, atol=1e-9)
    assert got[1, 0] == 0.0


def test_spearman_with_gaps(spark):
    """NaN, null and missing arrays, and no rows at all."""
    from windspark.operators import weights

    rng = np.random.default_rng(3)
    rows = [([float(x), None if k % 7 == 0 else float(-x)], float(x)) for k, x in enumerate(rng.normal(size=60))] + [(None, 1.0), ([float("nan"), 2.0], 0.5)]
    df = spark.createDataFrame(rows, "u array<double>, a double").repartition(3)
    for n in (9, 1000):
        got = {(r.i, r.j): r.weight for r in weights.spearman_weights(df, ["a"], 2, slice_rows=n).collect()}
        assert len(got) == 2 and got[0, 0] > got[0, 1] > 0
    assert weights.spearman_weights(df.limit(0), ["a"], 2).count() == 0


def test_no_window_over_all_cases(spark):
    from windspark.operators import split

    cases = spark.range(200).selectExpr("cast(id as string) as case_id", "cast(id % 7 as double) as value", "id % 5 as n_eff", "'train' as split")
    for df in (split.split_stratified(cases.select("case_id", "value"), (0.7, 0.15, 0.15), 1), split.split_random(cases.select("case_id"), (0.7, 0.15, 0.15), 1), split.fix_empty_splits(cases, 9)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and all("_slice" in line for line in plan.splitlines() if " Window [" in line)
