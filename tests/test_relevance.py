"""Nearest-neighbour relevance over all rows, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windspark.operators import mrmr


@pytest.mark.parametrize("tile_rows", [40, 10_000])
def test_relevance_mi_over_tiles(spark, tile_rows):
    """Every row counts and tiles change nothing: against brute force over all pairs of rows."""
    rng = np.random.default_rng(5)
    n, k = 700, 3
    t = rng.normal(size=n)
    rows = pd.DataFrame({"id": np.arange(n), "a": t + rng.normal(size=n), "b": np.round(t + rng.normal(size=n)), "t": t})
    rows = pd.concat([rows, rows.iloc[:30], rows.iloc[:3], rows.iloc[[0] * 5]])  # equal rows are separate points
    df = spark.createDataFrame(rows)
    got = {r.feature: r.relevance for r in mrmr.relevance_mi(df, ["a", "b"], ["t"], ["id"], k, tile_rows).collect()}
    jitter = lambda c: (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * 1e-10
    p = df.select("id", *[(F.col(c) / float(np.std(rows[c])) + jitter(c)).alias(c) for c in "abt"]).toPandas()
    psi = lambda m: np.array([sum(1 / i for i in range(1, int(v))) - 0.5772156649015329 for v in np.atleast_1d(m)])
    gap = {c: np.abs(p[c].to_numpy()[:, None] - p[c].to_numpy()[None, :]) for c in "abt"}
    for c in "ab":
        d = np.maximum(gap[c], gap["t"])
        np.fill_diagonal(d, np.inf)
        r = np.sort(d, 1)[:, k - 1] * (1 - 1e-10)
        nx, ny = (gap[c] <= r[:, None]).sum(1), (gap["t"] <= r[:, None]).sum(1)
        want = psi(len(p))[0] + psi(k)[0] - psi(nx).mean() - psi(ny).mean()
        assert got[c] == pytest.approx(max(want, 0), abs=1e-6)


def test_a7_relevance_mi_reads_every_row(spark, monkeypatch):
    from windspark.plans import fixtures as fx
    from windspark.plans import queries

    seen = []
    real = mrmr.relevance_mi
    monkeypatch.setattr(queries.mrmr, "relevance_mi", lambda df, *a: seen.append(df.count()) or real(df, *a))
    sf = "/root/testdata/sf0.001"
    out = queries.QUERIES["a7_relevance_mi"](spark, sf).collect()
    assert seen == [fx.numeric_rows(spark, sf).count()] and len(out) == 2 and all(r.relevance >= 0 for r in out)


@pytest.mark.parametrize("name", ["a6_pairwise_mi", "l8_mrmr_rank", "s13_write_feature_scores", "s14_read_kept_features"])
def test_rows_to_bin_are_made_once(spark, monkeypatch, name):
    """Every row passes the join of its tables once, whatever reads the bins."""
    from __spark_entry__ import queries
    from windspark.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    n, seen, real = fx.numeric_rows(spark, sf).count(), spark.sparkContext.accumulator(0), fx.numeric_rows

    def counted(spark, sf):
        df = real(spark, sf)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(fx, "numeric_rows", counted)
    assert queries()[name](spark, sf).count() > 0 and seen.value == n


def test_nearest_neighbours_cost_the_same_in_larger_tiles(monkeypatch):
    """Distances are those of the plain search; those taken for a point do not grow with the points."""
    from windspark.operators import _ksg_np as ksg

    rng = np.random.default_rng(3)
    x = rng.normal(size=5000)
    steep = np.exp(3 * rng.normal(size=5000))
    copies = np.repeat(rng.normal(size=1700), 3)[:5000]
    for a, b in ((x, x + rng.normal(size=5000) / 9), (x, steep), (copies, copies), (np.round(x), steep), (np.zeros(300), np.ones(300)), (x[:65], x[:65]), (x[:3], x[:3])):
        np.testing.assert_array_equal(ksg.nearest(a, b, 3), ksg._outwards(a, b, 3))
    real, taken = np.maximum, []
    monkeypatch.setattr(ksg.np, "maximum", lambda a, b: taken.append(np.size(a)) or real(a, b))
    per_point = []
    for n in (4_000, 32_000):
        taken.clear()
        ksg.nearest(rng.uniform(size=n), rng.uniform(size=n), 3)
        per_point.append(sum(taken) / n)
    assert per_point[1] < 1.3 * per_point[0]


def test_rows_of_a7_are_joined_once(spark, monkeypatch):
    from windspark.plans import fixtures as fx
    from windspark.plans import queries

    sf = "/root/testdata/sf0.001"
    n, seen, real = fx.numeric_rows(spark, sf).count(), spark.sparkContext.accumulator(0), fx.numeric_rows

    def counted(spark, sf):
        df = real(spark, sf)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(fx, "numeric_rows", counted)
    assert len(queries.QUERIES["a7_relevance_mi"](spark, sf).collect()) == 2 and seen.value == n


def test_relevance_mi_shuffles_few_bytes(spark):
    """A point of a pair takes two coordinates to its tile, and with its distance one each to a slice of x and of y."""
    n = 40_000
    df = spark.range(n).select("id", F.randn(1).alias("a"), F.randn(2).alias("t")).withColumn("b", F.col("a") + F.col("t")).persist()
    df.count()

    def stages():
        jvm, gate = spark._jvm, spark.sparkContext._gateway
        got = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gate.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (got.apply(i) for i in range(got.size()))}

    before = stages()
    assert len(mrmr.relevance_mi(df, ["a", "b"], ["t"], ["id"], 3, 2000).collect()) == 2
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = sum(b for s, b in stages().items() if s not in before)
    df.unpersist()
    assert 16 < written / (2 * n) < 80


def test_questions_to_other_rectangles_are_exact(monkeypatch):
    """Neighbours asked of other points are those of the plain search, whatever the reach and with gaps, copies and steep tails."""
    from windspark.operators import _ksg_np as ksg

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=3000), np.exp(3 * rng.normal(size=3000))
    x[:600], y[:300] = np.round(x[:600]), 1.0
    x[1000:1200], y[1000:1200] = x[1200:1400], y[1200:1400]
    qx, qy = rng.normal(size=200), np.exp(3 * rng.normal(size=200))
    d = np.sort(np.maximum(np.abs(qx[:, None] - x), np.abs(qy[:, None] - y)), 1)[:, :3]
    np.testing.assert_array_equal(ksg.nearest_of(qx, qy, np.full(200, np.inf), x, y, 3), d)
    reach = d[:, 1] * rng.uniform(0.5, 1.5, size=200)
    got = ksg.nearest_of(qx, qy, reach, x, y, 3)
    np.testing.assert_array_equal(np.where(d < reach[:, None], got, 0), np.where(d < reach[:, None], d, 0))
    assert np.isinf(ksg.nearest_of(qx, qy, reach, x[:0], y[:0], 3)).all() and ((x[:5] == ksg.unpack(ksg.pack(x[:5]))).all())
