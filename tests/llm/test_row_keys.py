"""Null and repeated ids: every row is decided by itself."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from windspark.llm import minhash, mixing, resharding
from windspark.llm.common import row_keys


def test_near_copies_by_row(spark, odd_docs):
    """One row of each class stays, whatever its id, and texts without an id are verified."""
    long = " ".join(f"word{i}" for i in range(300))
    more = [(20, "one two three four five six"), (20, "one two three four five six"), (None, long), (None, long + " end"), (21, "alone here")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).persist()
    rows = minhash.near_classes(docs).collect()
    assert len(rows) == docs.count()
    out = minhash.drop_near_copies(docs).collect()
    assert len(out) == sum(r.kept for r in rows)
    n = Counter(r.doc_id for r in out)
    assert n[1] == 1 and n[2] == n[3] == 0 and n[4] == 1 and n[20] == n[21] == 1
    assert [r.text in (long, long + " end") for r in out if r.doc_id is None] == [True]


def test_mixed_rounds_every_row(spark):
    """Rows sharing an id and size take their own copies, so that sources meet their targets."""
    rows = [(None, "a b c d e f g h i j", "s1")] * 1000 + [(7, "a b c d e f g h i j", "s2")] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).persist()
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    got = {r.source: 10 * r.n for r in mixing.mixed(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    taken = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert got == taken
    for s, t in target.items():
        assert abs(got[s] - t) <= 20
    sliced = mixing.mix(docs, slice_rows=100)  # a hot id is rounded in many slices
    assert sliced.count() == 1700
    for r in sliced.groupBy("source").agg(F.sum("taken").alias("n")).collect():
        assert abs(r.n - target[r.source]) <= 10 * 10


def test_mix_with_text_ids(spark):
    docs = spark.createDataFrame([("a-1", "one two three", "s1"), ("b", "four", "s1"), (None, "five six", None), ("", None, "s2")], "doc_id string, text string, source string")
    rows = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(["a-1", "b", None, ""]) and all(r.copies <= 3 for r in rows)
    assert Counter(r.doc_id for r in mixing.mixed(docs).collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_rewrite_keeps_null_and_repeated_ids(spark, odd_docs, tmp_path):
    keyed = row_keys(odd_docs)
    old = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(3))
    placed = resharding.reshard(keyed, 4, old, row_key="_key").persist()
    shards = resharding.rewrite_affected(placed, keyed, f"file://{tmp_path}/out", row_key="_key")
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert set(out.columns) == {*odd_docs.columns, "shard", "slot"}
    assert sorted((r.shard, r.slot) for r in out.collect()) == sorted((r.shard, r.slot) for r in placed.collect() if r.shard in shards)
    stay = Counter(r._key for r in placed.collect() if r.shard in shards)
    want = Counter((r.doc_id, r.text) for r in keyed.collect() if stay[r._key])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want and max(want.values()) > 1
    with pytest.raises(ValueError, match="row key"):
        resharding.rewrite_affected(resharding.reshard(odd_docs, 4, old), odd_docs, f"file://{tmp_path}/other")


def test_tilts_solve_the_dual(spark):
    """Every source's tilt equals a direct solution: bisection over its own documents."""
    rng = np.random.default_rng(8)
    sizes = {"a": rng.integers(1, 50, 300), "b": np.append(rng.integers(1, 2000, 400), 20_000), "c": rng.integers(30, 40, 60), None: rng.integers(0, 9, 90)}
    rows = [(s, int(z)) for s, own in sizes.items() for z in own]
    short = spark.createDataFrame(rows, "source string, size long").persist()
    hist = short.groupBy("source", "size").agg(F.count("*").alias("n"))
    for share in (1e-3, 0.9, 2.9):
        targets = short.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("target", share * F.col("source_size"))
        for r in mixing.tilts(hist, targets).collect():
            z = sizes[r.source][sizes[r.source] > 0].astype(float)
            assert r["mean"] == pytest.approx(z.mean())
            words = lambda lam: (z * np.exp(np.minimum(lam * z / z.mean(), np.log(3)))).sum()
            low, high = -60 * z.mean(), np.log(3) * z.mean() / z.min()
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if words(mid) < share * z.sum() else (low, mid)
            assert words(r.lam) == pytest.approx(share * z.sum(), rel=2e-6, abs=2e-6)
            assert r.lam == pytest.approx(low, rel=1e-3, abs=1e-4)
    with pytest.raises(RuntimeError, match="misses its target"):
        mixing.tilts(hist, targets, rounds=1)


def test_row_key_never_hides_a_column(spark):
    docs = spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, _KEY int")
    with pytest.raises(ValueError, match="column already"):
        row_keys(docs)
    assert row_keys(docs, "other").columns == ["doc_id", "text", "_KEY", "other"]
