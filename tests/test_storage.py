"""Sampling by threshold, loads by header, array blocks and bucketed tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windspark.functions.columns import key_hash
from windspark.operators import cases, shape
from windspark.sources import files, sinks


@pytest.mark.parametrize("margin, thinned", [(6.0, 10), (-3.0, 10), (6.0, 1), (-5.0, 2)])
def test_sample_is_the_same_whatever_the_threshold(spark, monkeypatch, margin, thinned):
    """Also where thresholds leave too little, and where only some of the large cases are thinned."""
    monkeypatch.setattr(cases, "MARGIN", margin)
    monkeypatch.setattr(cases, "THINNED", thinned)
    sizes = {"a": 3000, "b": 900, "c": 60, "d": 5, None: 700}
    rows = [(c, i, float(i)) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "case_id string, step long, x double").repartition(5)
    got = sorted(map(tuple, cases.sample_per_case(df, 50, 7, ["step"]).collect()), key=str)
    by = {r.step: r.h for r in spark.range(3000).select(F.col("id").alias("step"), key_hash(7, F.col("id")).alias("h")).collect()}
    want = [(c, i, float(i)) for c, n in sizes.items() for i in sorted(range(n), key=lambda i: (by[i], i))[:50]]
    assert got == sorted(want, key=str)


def test_few_rows_are_ordered(spark):
    df = spark.range(200_000).selectExpr("cast(id % 2 as string) as case_id", "id as step")
    out = cases.sample_per_case(df, 1500, 1, ["step"])
    assert out.count() == 3000
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" in plan.toString()
    want = 1500 + cases.MARGIN * 1500**0.5 + 10
    place = F.conv(F.substring(key_hash(1, F.col("step")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    assert 3000 <= df.where(place < want / 100_000).count() <= 2 * want * 1.1


def test_loads_in_any_order_of_columns(spark, tmp_path):
    d = tmp_path / "loads"
    d.mkdir()
    (d / "one.csv").write_text("Time,B,A\n0.0,2,1\n0.1,x,3\n")
    (d / "two.csv").write_text('﻿A,Time,"C, D",B\r\n5,0.5,9,6\r\n')
    (d / "no_b.csv").write_text("Time,A\n0.0,1\n")
    (d / "empty.csv").write_text("")
    (d / "bare.csv").write_text("Time,A,B")
    got = sorted((r.case_id, r.Time, r.A, r.B) for r in files.read_load_tables(spark, f"file://{d}", ["Time", "A", "B"]).collect() if r.B is not None)
    assert got == [("one", 0.0, 1.0, 2.0), ("two", 0.5, 5.0, 6.0)]
    assert files.read_load_tables(spark, f"file://{d}", ["Time", "Z"]).count() == 0


@pytest.mark.parametrize("n", [1, 4, 100])
def test_array_blocks_join_to_whole_cases(spark, n):
    rows = spark.createDataFrame([(c, i, float(i), float(-i)) for c, k in (("a", 9), ("b", 1)) for i in range(k)], "case_id string, step long, x double, y double").repartition(3)
    whole = {r.case_id: (r.p, r.q) for r in cases.case_arrays(rows, {"p": ["x", "y"], "q": ["y"]}).collect()}
    parts: dict = {}
    for r in cases.case_array_blocks(rows, {"p": ["x", "y"], "q": ["y"]}, n).orderBy("case_id", "block").collect():
        assert len(r.p) <= n and r.first_step == r.block * n
        p, q = parts.setdefault(r.case_id, ([], []))
        p += r.p
        q += r.q
    assert {c: tuple(v) for c, v in parts.items()} == whole


def test_case_table_needs_no_shuffle(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"c{k}", i, *map(float, rng.normal(size=3))) for k in range(7) for i in range(20)]
    df = spark.createDataFrame(rows, "case_id string, step long, RotSpeed double, NacYaw double, GenPwr double")
    sinks.write_case_table(df, f"file://{tmp_path}/set", 4)
    back = sinks.read_case_table(spark, f"file://{tmp_path}/set")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    shaped = lambda x: shape.process_case(x, ["RotSpeed", "NacYaw"], ["GenPwr"], lag=2, history=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shaped(back)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        other = sinks.read_case_table(spark, f"file://{tmp_path}/set", ["NacYaw"], [])
        sums = other.groupBy("case_id").agg(F.max("NacYaw").alias("n"))
        joined = back.join(sums, "case_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, shaped(back).collect())) == sorted(map(tuple, shaped(df).collect()))
    with pytest.raises(KeyError, match="missing"):
        sinks.read_case_table(spark, f"file://{tmp_path}/set", ["Azimuth"])


def test_scratch_tables_go(spark, monkeypatch):
    from windspark.functions import scratch

    monkeypatch.setattr(scratch, "_WRITTEN", {})
    tables = [scratch.written(spark.range(10)) for _ in range(2)]
    paths = [p.removeprefix("file://") for v in scratch._WRITTEN.values() for p in v]
    import os

    assert all(os.path.isdir(p) for p in paths) and tables[0].count() == 10
    assert scratch.clear(spark) == 2 and not any(os.path.exists(p) for p in paths) and scratch.clear(spark) == 0


def test_files_of_many_cases_lie_in_few_folders(spark, tmp_path):
    """Listing asks for folders, not for one of each case, and each file is whole."""
    rows = spark.range(900).select(F.format_string("case=%d.csv", F.col("id") % 300).alias("file"), "id", F.col("id").cast("string").alias("line"))
    sinks.write_text_files(rows, f"file://{tmp_path}/out", F.concat(F.lit("n of "), "file"), ["id"], 8)
    made = list((tmp_path / "out").rglob("*"))
    assert sum(p.is_dir() for p in made) <= 8 and len(made) - sum(p.is_dir() for p in made) == 300
    for p in made:
        if p.is_file():
            k = int(p.stem.removeprefix("case="))
            assert p.read_text() == "".join(f"{x}\n" for x in (f"n of case={k}.csv", k, k + 300, k + 600))


def test_written_logs_lie_in_few_folders(spark):
    from windspark.plans import file_queries

    path = file_queries.written_logs(spark, "/root/testdata/sf0.01")
    listed = files.catalog_files(spark, path, ["txt"])
    assert listed.count() == 150 and listed.select(F.regexp_extract("path", "^(.*)/", 1)).distinct().count() <= 64


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_loads_by_blocks(spark, tmp_path, block):
    """Long files are several tasks; quotes, short and long rows, blank lines and a missing last line end change nothing."""
    (tmp_path / "a.csv").write_text('x,"p, q",y\n' + "".join(f'{i},"a ""b"", c\\"d",{i * 2}\n' for i in range(50)) + "\n7\n8,,9,10\n\r\n11,z,12")
    rows = files.read_load_tables(spark, f"file://{tmp_path}", ["y", "x"], block=block)
    want = [*((float(i), 2.0 * i) for i in range(50)), (7.0, None), (8.0, 9.0), (11.0, 12.0)]
    assert sorted(((r.x, r.y) for r in rows.collect()), key=str) == sorted(want, key=str)


def test_headers_of_loads_are_not_collected(spark, tmp_path):
    """Files of two layouts are read without a job that brings their names to the driver."""
    for i in range(40):
        (tmp_path / f"{i}.csv").write_text(f"{'x,y' if i % 2 else 'y,x'}\n1,2\n")
    spark.sparkContext.setJobGroup("defined", "")
    try:
        rows = files.read_load_tables(spark, f"file://{tmp_path}", ["x", "y"])
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("defined") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(int(r.case_id) % 2, r.x) for r in rows.collect()} == {(1, 1.0), (0, 2.0)}
