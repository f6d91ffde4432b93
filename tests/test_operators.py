"""Edge cases, brute-force comparisons and recorded numbers."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from windspark.operators import align, cases, grid, shape, split, stats, surrogate, weights
from windspark.operators._grid_np import FEATURES, resize_matrix
from windspark.operators._ksg_np import mutual_information


def test_recorded_manifest_times(spark):
    """A recorded run: 100 s to 600 s at 0.1 s gives 5001 times, the last 599.9999999999716."""
    c = spark.createDataFrame([("a", 600.0, 13000, 0.05000000074505806), ("short", 100.05, 13000, 0.05)], "case_id string, max_time double, nt int, field_dt double")
    r = align.target_times(c, 100.0, 600.0, 0.1).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).first()
    assert (r.n, r.a, r.b) == (5001, 100.0, 599.9999999999716)


def test_resample_is_interp(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(1, 9, 40))
    y = rng.normal(size=40)
    log = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(t, y)] + [("n", 0.0, 1.0), ("n", 1.0, None), ("n", 2.0, 3.0)], "case_id string, Time double, y double")
    at = [float(x) for x in np.linspace(0, 10, 50)] + [float(t[7])]
    g = spark.createDataFrame([("a", i, x) for i, x in enumerate(at)] + [("n", 0, 0.5), ("n", 1, 2.0), ("n", 2, 3.0)], "case_id string, i int, t double")
    out = {(r.case_id, r.i): r.y for r in align.resample_linear(log, g, ["y"]).collect()}
    np.testing.assert_allclose([out["a", i] for i in range(51)], np.interp(at, t, y), rtol=1e-12)
    assert (out["n", 0], out["n", 1], out["n", 2]) == (None, 3.0, 3.0)


def test_lag_and_history_of_short_cases(spark):
    df = spark.createDataFrame([("a", i, float(i), float(10 * i)) for i in range(5)] + [("b", 0, 1.0, 2.0)], "case_id string, step int, x double, y double")
    assert [(r.step, r.y) for r in align.pair_with_lag(df, ["y"], 2).orderBy("step").collect()] == [(0, 20.0), (1, 30.0), (2, 40.0)]
    h = shape.add_history(df, ["x"], 2).orderBy("step").collect()
    assert [(r.case_id, r.x_t0, r.x_t2) for r in h] == [("a", 2.0, 0.0), ("a", 3.0, 1.0), ("a", 4.0, 2.0)]


def test_even_subsample_is_linspace(spark):
    df = spark.createDataFrame([(str(n), i) for n in (1, 5, 97, 250) for i in range(n)], "case_id string, step int")
    got = {}
    for r in shape.even_subsample(df, 30).collect():
        got.setdefault(int(r.case_id), []).append(r.step)
    for n, steps in got.items():
        assert sorted(steps) == sorted(set(np.linspace(0, n - 1, min(n, 30), dtype=np.int64).tolist()))


def test_split_sizes_and_repair(spark):
    c = spark.createDataFrame([(str(i), float(i % 7)) for i in range(23)], "case_id string, value double")
    s = split.split_stratified(c, (0.7, 0.15, 0.15), 1, 5)
    assert sorted(r["count"] for r in s.groupBy("bin").count().collect()) == [4, 4, 5, 5, 5]
    for few in ([5], [5, 9], [5, 9, 2]):
        before = spark.createDataFrame([(str(i), n, "train") for i, n in enumerate(few)], "case_id string, n_eff long, split string")
        got = {r.n_eff: r.split for r in split.fix_empty_splits(before).collect()}
        want = {1: {5: "train"}, 2: {9: "val", 5: "train"}, 3: {9: "val", 5: "test", 2: "train"}}[len(few)]
        assert got == want


def test_fix_empty_splits_like_a_loop(spark):
    rng = np.random.default_rng(5)
    for trial in range(6):
        rows = [(str(i), int(rng.integers(0, 6)), str(rng.choice(["train", "train", "train", "val", "test"]))) for i in range(int(rng.integers(2, 9)))]
        least = int(rng.integers(1, 12))
        part = {k: sorted([(-n, c) for c, n, s in rows if s == k]) for k in ("train", "val", "test")}
        eff = lambda k: sum(-n for n, _ in part[k])
        for k in ("val", "test"):
            if not part[k] and len(part["train"]) > 1:
                part[k].append(part["train"].pop(0))
        for k in ("val", "test"):
            while eff(k) < least and len(part["train"]) > 1:
                part[k].append(part["train"].pop(0))
        want = {c: k for k, v in part.items() for _, c in v}
        df = spark.createDataFrame(rows, "case_id string, n_eff long, split string")
        assert {r.case_id: r.split for r in split.fix_empty_splits(df, least).collect()} == want


def test_bins_scalers_and_scores(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(11)], "x double, c double")
    b = stats.bin_uniform(df, ["x", "c"]).collect()
    assert sorted(r.x for r in b) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9] and {r.c for r in b} == {0}
    with pytest.raises(Exception, match="no rows"):
        stats.fit_scalers(df.where("x < 0"), {"a": ["x"]}).collect()
    sc = stats.fit_scalers(df, {"a": ["c"]}).first()
    assert sc.std == pytest.approx(1e-8)


def test_errors_name_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0)], "case_id string, A double")
    with pytest.raises(KeyError, match="B, C"):
        cases.select_channels(df, ["A", "B", "C"])
    with pytest.raises(ValueError, match="unknown angle mode"):
        shape.angle_encode(df, "other")
    h = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "case_id string, pos int, channel string")
    with pytest.raises(ValueError, match="case b"):
        cases.check_schema_consistency(h)


def test_ksg_is_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = 0.8 * x + 0.6 * rng.normal(size=400)
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, 2] * (1 - 1e-10)
    psi = lambda n: sum(1 / k for k in range(1, int(n))) - 0.5772156649015329
    nx, ny = [(np.abs(v[:, None] - v) <= r[:, None]).sum(1) for v in (x, y)]
    want = psi(400) + psi(3) - np.mean([psi(n) for n in nx]) - np.mean([psi(n) for n in ny])
    assert mutual_information(x, y) == pytest.approx(want, abs=1e-9)
    assert abs(want - 0.51) < 0.15 and mutual_information(x, rng.normal(size=400)) < 0.1


def test_resize_matrix_properties():
    for a, b in ((7, 5), (5, 9), (31, 31)):
        m = resize_matrix(a, b)
        np.testing.assert_allclose(m.sum(1), 1)
    np.testing.assert_array_equal(resize_matrix(4, 4), np.eye(4))


def test_even_grid_weights(spark):
    w = weights.half_rotor_weights(spark, 6, 100.0, 40.0)
    assert [round(r.s, 12) for r in w.groupBy("region").agg(F.sum("weight").alias("s")).collect()] == [1.0] * 4


def test_constant_field_features(spark):
    f = spark.createDataFrame([("a", 0, [8.0] * 49, [0.0] * 49, [0.0] * 49)], "case_id string, step int, u array<double>, v array<double>, w array<double>")
    from windspark.plans import fixtures as fx

    r = grid.wind_features(f, fx.region_weights(spark), 7, 7).first()
    assert r.global_u_mean == 8 and r.global_u_std == 0 and r.vertical_gradient_ratio == 1 and len(r) == 2 + len(FEATURES) == 47


def test_surrogate_gradient_and_fit(spark):
    rng = np.random.default_rng(2)
    for kw in ({}, {"layer_norm": True}, {"attention": True}):
        m = surrogate.init_model(3, 2, {"a": ["p", "q"], "b": ["r"]}, hidden=(5,), branch=(4,), seed=1, **kw)
        x, z = rng.normal(size=(6, 3)), rng.normal(size=(6, 2))
        y = {"a": rng.normal(size=(6, 2)), "b": rng.normal(size=(6, 1))}
        g, loss = surrogate.gradient(m, x, z, y)
        for k, v in m["weights"].items():
            i = tuple(0 for _ in v.shape)
            v[i] += 1e-6
            up = surrogate.gradient(m, x, z, y)[1]
            v[i] -= 1e-6
            assert (up - loss) / 1e-6 == pytest.approx(g[k][i], abs=2e-5)
    data = rng.normal(size=(3000, 3))
    rows = [(*map(float, d), float(d[0] - 2 * d[1] + 0.5 * d[2])) for d in data]
    df = spark.createDataFrame(rows, "f double, a double, b double, GenPwr double").repartition(2)
    m = surrogate.init_model(1, 2, {"pwr": ["GenPwr"]}, hidden=(16,), branch=(8,))
    best, history = surrogate.fit_surrogate(df, df, m, ["f"], ["a", "b"], epochs=6, lr=0.02, batch_rows=128)
    h = history.orderBy("epoch").collect()
    assert h[-1].loss < h[0].loss and surrogate.keep_best(history).first().r2 > 0.9
    imp = surrogate.feature_importance(spark, surrogate.init_model(4, 1, {"a": ["x"]}, attention=True), list("wxyz")).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1)


def test_exploded_sides_of_alignment_are_not_broadcast(spark):
    """One row a case looks small to Spark, its steps are not."""
    h = spark.range(40).select(F.col("id").cast("string").alias("case_id"), F.lit(50).alias("nt"), F.lit(2.0).alias("field_dt")).repartition(2)
    fields = h.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("step")).withColumn("u", F.col("step") * 3)
    loads = h.select("case_id", F.explode(F.array(F.lit(0.0), F.lit(41.0), F.lit(98.0))).alias("t"))
    for out in (align.align_strict_step(loads, fields, h, "t"), align.align_nearest_step(loads, fields, h)):
        assert sorted((r.wind_step, r.u) for r in out.collect()) == sorted([(0, 0), (20, 60), (49, 147)] * 40)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"\w+Join", plan)[0] == "SortMergeJoin"  # the last join comes first
