import numpy as np
import pytest

from windspark.llm import embedding_dedup
from windspark.llm.common import by_group, components


def by_hand(data, threshold):
    ids = [i for i, _, _ in data]
    unit = []
    for _, v, _ in data:
        x = np.array([np.nan if e is None else e for e in v], float) if v is not None else np.array([np.nan])
        x = x / np.abs(x).max() if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0 else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    n, edges = dict.fromkeys(ids, 0), []
    for a in range(len(data)):
        for b in range(a):
            ok = unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and data[a][2] is not None and data[a][2] == data[b][2]
            if ok and ids[a] is not None and ids[b] is not None and ids[a] != ids[b] and float(unit[a] @ unit[b]) >= threshold:
                n[ids[a]] += 1
                n[ids[b]] += 1
                edges.append((ids[a], ids[b]))
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return n, comp


@pytest.mark.parametrize("kw", [{}, {"tile_rows": 7}, {"tile_rows": 5, "grid_dims": 2}, {"threshold": 0.5, "tile_rows": 9}, {"grid_dims": 3}])
def test_links(spark, kw):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 16))
    data = []
    for i in range(120):
        v = centres[i % 4] + rng.normal(size=16) * (0.05 if i % 3 else 0.6)
        data.append((i, [float(x) for x in v * rng.uniform(0.01, 1e3)], None if i % 29 == 0 else i % 2))
    data += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, [float("inf")] * 16, 1), (205, [1.0, 2.0], 1), (206, [1.0, 2.0], 1), (None, data[5][1], 1), (5, data[5][1], 1), (207, [1e200] * 16, 0), (208, [1e-200] * 16, 0), (209, [], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as d", "'x' as unit", "3 as cell")
    threshold = kw.get("threshold", 0.98)
    n, comp = by_hand(data, threshold)
    out = embedding_dedup.near_vectors(df, **kw).collect()
    assert len(out) == len(data)
    for r in out:
        assert r.n_links == n[r.vec_id] and r.component_id == comp[r.vec_id], r
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(df).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    comp = {x: x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}
    for _ in range(400):
        for a, b in edges:
            if a in comp and b in comp and a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r.node: r.component for r in components(df).collect()} == comp
    assert components(df.where("a < -1")).count() == 0


def test_by_group_joins_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(100).selectExpr("id % 9 as g", "id")
        out = by_group(df, ["g"], lambda c: [[int(c["g"][0])], [int(c["id"].sum())], [len(c["id"])]], "g long, s long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.g, r.s, r.n) for r in out) == [(g, sum(range(g, 100, 9)), len(range(g, 100, 9))) for g in range(9)]
