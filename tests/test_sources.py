"""Readers and writers on files that the tests write."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from windspark.functions.channels import INPUTS, OUTPUTS
from windspark.operators import cases, mrmr
from windspark.plans import fixtures as fx
from windspark.plans import workloads
from windspark.sources import files, logs, sinks, wind


def write_log(path, names, units, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = ["preamble"] * 6 + ["\t".join(names), "\t".join(units)] + ["\t".join(map(str, r)) for r in rows]
    path.write_text("\n".join(text) + "\n")


def write_field(path, ny, nz, n_twr, nt, dt, seed=0, u_hub=8.0):
    path.parent.mkdir(parents=True, exist_ok=True)
    rng = np.random.default_rng(seed)
    raw = rng.integers(-3000, 3000, (nt, nz, ny, 3)).astype("<i2")
    tower = rng.integers(-9, 9, (nt, 3 * n_twr)).astype("<i2")
    slope, off = np.array([100.0, 200.0, 300.0], "<f4"), np.array([5.0, -7.0, 9.0], "<f4")
    info = b"made by a test"
    head = struct.pack("<h4l", 8, nz, ny, n_twr, nt) + struct.pack("<6f", 2, 3, dt, u_hub, 90, 10)
    head += struct.pack("<6f", slope[0], off[0], slope[1], off[1], slope[2], off[2]) + struct.pack("<l", len(info)) + info
    path.write_bytes(head + b"".join(raw[t].tobytes() + tower[t].tobytes() for t in range(nt)))
    return ((raw - off) / slope).astype(np.float32)


def test_channel_logs(spark, tmp_path):
    names = ["Time", "A", "A", "B"]
    write_log(tmp_path / "x" / "one.out", names, ["(s)", "(m)", "(m)", "(kW)"], [[0.0, 1, 2, 3], [0.1, "bad", 5, 6], [0.1, 7, 8, 9], [0.2, 1]])
    write_log(tmp_path / "two.out", names, ["(s)"], [[0.0, 1, 2, 3]])
    root = f"file://{tmp_path}"
    long = files.read_channel_logs(spark, root)
    assert {r.channel for r in long.collect()} == {"Time", "A", "A_1", "B"}
    rows = cases.clean_log(files.read_channel_logs(spark, root, ["Time", "A", "A_1", "B"])).where("case_id = 'x__one'").orderBy("Time").collect()
    assert [(r.Time, r.A, r.A_1, r.B) for r in rows] == [(0.0, 1.0, 2.0, 3.0), (0.1, None, 5.0, 6.0), (0.2, 1.0, None, None)]
    units = {(r.case_id, r.channel): r.unit for r in files.channel_units(spark, root).collect()}
    assert units["x__one", "A_1"] == "(m)" and units["two", "B"] == ""
    listed = files.catalog_files(spark, root, [".OUT"]).collect()
    assert [(r.case_id, r.stem, r.depth) for r in listed] == [("two", "two", 0), ("x__one", "one", 1)]


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_logs_cut_anywhere(spark, tmp_path, block):
    """Blocks that end inside lines, line ends and blank lines; the last line has no end."""
    names = ["Time", "A", "Bé", "A"]
    rng = np.random.default_rng(block)
    rows = [[k / 10, rng.integers(0, 10**9), "x" * int(rng.integers(0, 60)) + "é", k] for k in range(30)]
    write_log(tmp_path / "one.out", names, ["s"] * 4, rows)
    (tmp_path / "two.out").write_bytes(b"pre\r\n  Time A\r\n(s) (m)\r\n" + b"".join(b"%d %d\r\n\r\n" % (k, k * k) for k in range(25)) + b"99 7")
    (tmp_path / "bare.out").write_bytes(b"Time A")
    root = f"file://{tmp_path}"
    found = logs.parse_logs(spark, root, ["Time", "A", "Bé", "A_1"], block=block)
    got = {}
    for r in found.usable.orderBy("case_id", "line_no").collect():
        got.setdefault(r.case_id, []).append((r.Time, r.A, r["Bé"], r.A_1))
    split = [r[2].split() or [None] for r in rows]
    assert got["one"] == [(str(r[0]), str(r[1]), s[0], str(r[3])) for r, s in zip(rows, split)]
    assert got["two"] == [*[(str(k), str(k * k), None, None) for k in range(25)], ("99", "7", None, None)] and "bare" not in got
    assert {r.case_id: r.log_ok for r in found.status.collect()} == {"one": True, "two": True, "bare": True}
    assert {(r.case_id, r.channel): r.unit for r in found.units.collect()}["two", "A"] == "(m)"
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "MapInArrow" not in plan  # names, units, status and rows from what one parse stored
    if block < 333:
        assert logs.parsed(found.table, ["A"], block).selectExpr("line_no div 4294967296 as b").distinct().count() > 3


def test_header_past_the_first_bytes(spark, tmp_path, monkeypatch):
    (tmp_path / "late.out").write_text("".join(f"line {k} of a long preamble\n" for k in range(5000)) + "Time\tA\n(s)\t(m)\n1\t2\n")
    r = files.read_channel_logs(spark, f"file://{tmp_path}", ["Time", "A"]).collect()
    assert [(x.line_no, x.Time, x.A) for x in r] == [(0, "1", "2")]
    assert files.read_channel_logs(spark, f"file://{tmp_path}").where("channel = 'A'").first().value == "2"


def test_unreadable_logs(spark, tmp_path):
    (tmp_path / "none.out").write_text("no header\n1 2\n")
    write_log(tmp_path / "wide.out", ["Time", "A"], ["s", "m"], [[0, 1, 2]])
    write_log(tmp_path / "good.out", ["Time", "A"], ["s", "m"], [[0, 1]])
    root = f"file://{tmp_path}"
    assert {r.case_id: r.log_ok for r in files.log_status(spark, root).collect()} == {"none": False, "wide": False, "good": True}
    assert files.read_channel_logs(spark, root, ["Time", "A"], on_error="skip").count() == 1
    with pytest.raises(Exception, match="unreadable log"):
        files.read_channel_logs(spark, root, ["Time"]).collect()


def test_wind_files(spark, tmp_path):
    values = write_field(tmp_path / "sub" / "w.bts", 3, 4, 2, 7, 0.05)
    h = wind.read_wind_headers(spark, f"file://{tmp_path}").collect()
    assert len(h) == 1 and (h[0].case_id, h[0].ny, h[0].nz, h[0].n_twr, h[0].nt, h[0].info) == ("sub__w", 3, 4, 2, 7, "made by a test")
    assert h[0].slope == [100.0, 200.0, 300.0] and h[0].intercept == [5.0, -7.0, 9.0]
    rows = wind.read_wind_fields(spark, f"file://{tmp_path}", 3).orderBy("step").collect()
    assert [r.step for r in rows] == list(range(7))
    for r in rows:
        for c, name in enumerate("uvw"):
            np.testing.assert_array_equal(np.array(r[name], np.float32).reshape(3, 4), values[r.step, :, :, c].T)


def test_wind_ranges(spark, tmp_path):
    """Wanted steps only, blocks that cut a file, and a file that ends early."""
    values = write_field(tmp_path / "w.bts", 3, 4, 2, 25, 0.05)
    whole = (tmp_path / "w.bts").read_bytes()
    rec = (3 * 4 + 2) * 6
    (tmp_path / "cut.bts").write_bytes(whole[: len(whole) - 4 * rec - 5])
    (tmp_path / "short.bts").write_bytes(whole[:30])
    steps = spark.createDataFrame([("w", 0), ("w", 7), ("w", 24), ("w", 99), ("other", 3)], "case_id string, step long")
    rows = wind.read_wind_fields(spark, f"file://{tmp_path}", 6, steps=steps).orderBy("step").collect()
    assert [(r.case_id, r.step) for r in rows] == [("w", 0), ("w", 7), ("w", 24)]
    for r in rows:
        np.testing.assert_array_equal(np.array(r.v, np.float32).reshape(3, 4), values[r.step, :, :, 1].T)
    n = {r.case_id: r["count"] for r in wind.read_wind_fields(spark, f"file://{tmp_path}", 6).groupBy("case_id").count().collect()}
    assert n == {"w": 25, "cut": 20}


def test_filters_reach_the_files(spark, tmp_path):
    """A filter on the case opens one file, one on steps reads their blocks only."""
    from windspark.sources.wind_table import read_wind_table

    a = write_field(tmp_path / "sub" / "a.bts", 3, 4, 2, 25, 0.05, 1)
    b = write_field(tmp_path / "b.BTS.bts", 5, 3, 0, 12, 0.05, 2)
    root = f"file://{tmp_path}"
    whole = read_wind_table(spark, root, 6)
    assert whole.rdd.getNumPartitions() == 5 + 2
    rows = {(r.case_id, r.step): r for r in whole.collect()}
    assert len(rows) == 37 and {(r.ny, r.nz) for k, r in rows.items() if k[0] == "b.BTS"} == {(5, 3)}
    other = {(r.case_id, r.step): r for r in wind.read_wind_fields(spark, root, 7, sizes=True).collect()}
    assert rows == other
    np.testing.assert_array_equal(np.array(rows["sub__a", 7].v, np.float32).reshape(3, 4), a[7, :, :, 1].T)
    np.testing.assert_array_equal(np.array(rows["b.BTS", 11].w, np.float32).reshape(5, 3), b[11, :, :, 2].T)
    (tmp_path / "poison.bts").write_bytes(b"\xff" * 500)
    with pytest.raises(Exception, match="no field header"):
        read_wind_table(spark, root, 6).count()
    t = read_wind_table(spark, root, 6)  # the poisoned file is never opened from here on
    one = t.where("case_id = 'sub__a'")
    assert one.rdd.getNumPartitions() == 5 and one.count() == 25
    for condition, parts, n in (
        ("case_id = 'sub__a' and step = 7", 1, 1), ("case_id in ('sub__a', 'b.BTS') and step >= 18", 2, 7), ("case_id = 'sub__a' and step in (0, 24, 99)", 2, 2),
        ("case_id = 'sub__a' and step > 5 and step < 7", 1, 1), ("case_id = 'sub__a' and step <= 5", 1, 6), ("case_id = 'nowhere'", 1, 0), ("case_id = 'b.BTS' and step % 2 = 0", 2, 6),
    ):
        part = t.where(condition)
        assert (part.rdd.getNumPartitions(), part.count()) == (parts, n), condition
    assert t.where("case_id = 'b.BTS'").select("step", F.size("u")).distinct().count() == 12


def test_many_grids_are_read_once(spark, tmp_path):
    for k, (ny, nz) in enumerate([(7, 7), (9, 5), (5, 9)]):
        write_field(tmp_path / f"c{k}.bts", ny, nz, 1, 8, 0.05, k)
    f = workloads.features_of(spark, f"file://{tmp_path}", fx.region_weights(spark), 7, 7, ["global_u_mean"])
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan binaryFile") == 1 or plan.count("FileScan binaryFile") == 1
    got = {(r.case_id, r.step): r.global_u_mean for r in f.collect()}
    assert len(got) == 24
    from windspark.operators import grid

    fields, headers = wind.read_wind_fields(spark, f"file://{tmp_path}"), wind.read_wind_headers(spark, f"file://{tmp_path}")
    for h in headers.select("case_id", "ny", "nz").collect():
        own = grid.regrid_bilinear(fields.where(F.col("case_id") == h.case_id), h.ny, h.nz, 7, 7)
        for r in grid.wind_features(own, fx.region_weights(spark), 7, 7, ["global_u_mean"]).collect():
            assert r.global_u_mean == pytest.approx(got[r.case_id, r.step])


def test_repeated_times_in_load_tables(spark, tmp_path):
    (tmp_path / "loads").mkdir()
    values = write_field(tmp_path / "fields" / "c.bts", 5, 5, 1, 30, 0.5, 1)
    lines = ["Time,M"] + [f"{t * 0.5},{values[t, 2, 1, 0]}" for t in range(30) for _ in range(2)]
    (tmp_path / "loads" / "c.csv").write_text("\n".join(lines) + "\n")
    w = workloads.region_weights_from_files(spark, f"file://{tmp_path}/loads", ["M"], f"file://{tmp_path}/fields", 5).collect()
    best = max(w, key=lambda r: r.weight)
    assert (best.i, best.j) == (1, 2)


def test_colliding_names(spark, tmp_path):
    write_log(tmp_path / "bad.out", ["Time", "X", "X", "X_1"], ["s"] * 4, [[0, 1, 2, 3]])
    root = f"file://{tmp_path}"
    assert [r.log_ok for r in files.log_status(spark, root).collect()] == [False]
    with pytest.raises(Exception, match="unreadable log"):
        files.read_channel_logs(spark, root, ["Time", "X"]).collect()


def test_selection_job(spark, tmp_path):
    """Files to kept features, on two grids, with the balanced cap; relevance follows the wind."""
    for k in range(3):
        write_field(tmp_path / "fields" / f"c{k}.bts", 7 if k else 9, 7 if k else 5, 1, 40, 0.05, k)
    root = f"file://{tmp_path}/fields"
    names = ["hub_u_mean", "global_tke", "global_u_mean", "tip_u_mean"]
    f = workloads.features_of(spark, root, fx.region_weights(spark), 7, 7, names)
    assert f.count() == 120
    rows = f.select("case_id", F.col("step").cast("long").alias("step"), F.col("step").cast("long").alias("wind_step"), (F.col("hub_u_mean") * 3).alias("GenPwr"))
    for method in ("binned", "knn"):
        table, kept = workloads.select_features(spark, rows, root, fx.region_weights(spark), 7, 7, ["GenPwr"], f"file://{tmp_path}/{method}", names, sample=100, method=method, k=2)
        assert kept[0] == 0 and len(kept) == 2 and table.count() == 4
        back = files.read_kept_features(spark, f"file://{tmp_path}/{method}/kept_features").orderBy("rank_pos").collect()
        assert [r.original_index for r in back] == kept
        info = spark.read.json(f"file://{tmp_path}/{method}/kept_features").first().info.settings
        assert (info.subsample_size, info.per_file_cap, info.max_files) == ("100", "500", "50")
    assert cases.default_cap(150_000, 50) == 9000 and cases.default_cap(150_000, 3) == 20_000 and cases.default_cap(10, 5) == 500


def test_region_weights_from_files(spark, tmp_path):
    (tmp_path / "loads").mkdir()
    for k in range(2):
        values = write_field(tmp_path / "fields" / f"c{k}.bts", 5, 5, 1, 30, 0.5, k)
        lines = ["Time,M,N"] + [f"{t * 0.5},{values[t, 2, 1, 0]},{-t}" for t in range(30)]
        (tmp_path / "loads" / f"c{k}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "loads" / "late.csv").write_text("Time,M,N\n99,1,2\n")
    w = workloads.region_weights_from_files(spark, f"file://{tmp_path}/loads", ["M"], f"file://{tmp_path}/fields", 5).collect()
    best = max(w, key=lambda r: r.weight)
    assert (best.i, best.j) == (1, 2) and sum(r.weight for r in w) == pytest.approx(1.0)


def test_case_dataset_round_trip(spark, tmp_path):
    rows = fx.case_rows(spark, "/root/testdata/sf0.001").withColumn("t", F.col("Time")).select("case_id", "step", "t", *INPUTS, *OUTPUTS)
    f = fx.wind_field(spark, "/root/testdata/sf0.001").select("case_id", "step", "u", "v", "w")
    path = f"file://{tmp_path}/set"
    sinks.write_case_dataset(rows, path, f, "float16", buckets=4)
    back = sinks.read_case_dataset(spark, path, INPUTS, OUTPUTS)
    want = cases.cast_precision(rows.select("case_id", "step", *INPUTS, *OUTPUTS), [*INPUTS, *OUTPUTS])
    assert back.exceptAll(want).count() == 0 and back.count() == rows.count()
    w = spark.read.parquet(f"{path}/wind").orderBy("case_id", "step").first()
    o = f.orderBy("case_id", "step").first()
    assert w.u == [float(x) for x in np.array(o.u, np.float16)]
    with pytest.raises(KeyError, match="Nope"):
        sinks.read_case_dataset(spark, path, ["Nope"], OUTPUTS)


def test_half_precision(spark):
    x = np.concatenate([np.random.default_rng(1).normal(0, 10.0, 500) * 10.0 ** np.random.default_rng(2).integers(-8, 5, 500), [0, 65504, 65520, 70000, -1e-8, 6e-8, 2049, 2051, np.inf, -np.inf]]).astype(np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", "x", cases.half_precision(F.col("x")).alias("h"))
    got = np.array([r.h for r in df.orderBy("i").collect()], np.float32)
    with np.errstate(over="ignore"):
        np.testing.assert_array_equal(got, x.astype(np.float16).astype(np.float32))


def test_scores_and_kept_features(spark, tmp_path):
    rel = spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", 0.2)], "feature string, relevance double")
    mi = spark.createDataFrame([(p, q, 0.0 if p == q else m) for p, q, m in [("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("a", "b", 1.6), ("b", "a", 1.6), ("a", "c", 0.1), ("c", "a", 0.1), ("b", "c", 0.3), ("c", "b", 0.3)]], "feature_a string, feature_b string, mi double")
    ranked = mrmr.mrmr_rank(rel, mi, ["a", "b", "c"])
    assert [r["feature"] for r in ranked] == ["a", "c", "b"]
    assert ranked[0]["redundancy"] == 0 and ranked[2]["redundancy"] == pytest.approx(0.95)
    assert all(r["selection_score"] == pytest.approx(r["relevance"] - 0.5 * r["redundancy"]) for r in ranked)
    assert len(mrmr.mrmr_rank(rel, mi, ["a", "b", "c"], k=2)) == 2
    assert [r["feature"] for r in mrmr.mrmr_rank(rel, mi, ["a", "b", "c"], threshold=0.3)] == ["a"]
    table = mrmr.score_table(spark, ranked[:2], rel, ["a", "b", "c"])
    sinks.write_feature_scores(table, f"file://{tmp_path}/scores")
    lines = spark.read.text(f"file://{tmp_path}/scores").collect()
    assert [r.value for r in lines][1:] == ["0,a,1.000000,0.000000,1.000000", "1,b,0.900000,,", "2,c,0.200000,0.100000,0.150000"]
    sinks.write_kept_features(table, f"file://{tmp_path}/kept", {"max_files": "50"})
    assert [(r.original_index, r.feature) for r in files.read_kept_features(spark, f"file://{tmp_path}/kept").orderBy("rank_pos").collect()] == [(0, "a"), (2, "c")]


def test_load_tables_and_design(spark, tmp_path):
    d = tmp_path / "loads"
    d.mkdir()
    (d / "one.csv").write_text("Time,B,A\n0.0,2,1\n0.1,x,3\n")
    rows = files.read_load_tables(spark, f"file://{d}", ["Time", "A", "B"]).orderBy("Time").collect()
    assert [(r.case_id, r.A, r.B) for r in rows] == [("one", 1.0, 2.0), ("one", 3.0, None)]
    (tmp_path / "design.csv").write_text("n,seed,at,ut,model,ti,h,u,yaw,shear\n1,7,630,600,IECKAI,A,90,11.5,5,0.2\n")
    r = files.read_design(spark, f"file://{tmp_path}/design.csv").first()
    assert (r.seed, r.turbulence, r.speed) == (7, "A", "11.5")


def test_workload_from_files(spark, tmp_path):
    names = ["Time", *INPUTS, *OUTPUTS]
    for k in range(6):
        rows = [[round(t * 0.1, 1), *[np.sin(t / 9 + c + k) * 5 for c in range(len(INPUTS))], *[np.cos(t / 9 + c + k) for c in range(len(OUTPUTS))]] for t in range(120)]
        write_log(tmp_path / "logs" / f"c{k}.out", names, ["-"] * len(names), rows)
        if k != 5:
            write_field(tmp_path / "fields" / f"c{k}.bts", 7, 7, 1, 240 if k != 4 else 3, 0.05, k)
    rows, manifest, skips = workloads.build_dataset(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/fields", 1.0, 11.0, 0.1)
    m = manifest.orderBy("case_id").collect()
    assert [r.case_id for r in m] == ["c0", "c1", "c2", "c3"] and m[0].n_samples == 101 and m[0].grid_in == "7x7"
    assert {(r.reason, r.n) for r in skips.collect()} == {("field missing", 1), ("time range too short", 1)}
    workloads.write_campaign(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/fields", f"file://{tmp_path}/data", 1.0, 11.0, 0.1, store_wind=True)
    written = spark.read.option("header", True).csv(f"file://{tmp_path}/data/manifest").orderBy("case_id").collect()
    assert [r.case_id for r in written] == ["c0", "c1", "c2", "c3"] and written[1].out_path.endswith("/logs/c1.out") and written[1].bts_path.endswith("/fields/c1.bts")
    assert written[0].npz_path == f"file://{tmp_path}/data/rows" and written[0].n_samples == "101"
    units = spark.read.parquet(f"file://{tmp_path}/data/units")
    assert units.select("case_id").distinct().count() == 4 and {r.unit for r in units.collect()} == {"-"}
    assert spark.read.parquet(f"file://{tmp_path}/data/rows").count() == rows.count() == 404
    assert spark.read.parquet(f"file://{tmp_path}/data/wind").select("case_id", "step").distinct().count() == rows.select("case_id", "wind_step").distinct().count()
    f = workloads.features_of(spark, f"file://{tmp_path}/fields", fx.region_weights(spark), 7, 7).select("case_id", F.col("step").cast("long").alias("wind_step"), "hub_u_mean", "global_tke")
    joined = rows.join(f, ["case_id", "wind_step"])
    assert joined.count() == rows.count()
    out = workloads.train_and_evaluate(joined, ["hub_u_mean", "global_tke"], INPUTS, OUTPUTS, (0.5, 0.25, 0.25), epochs=2, hidden=(16,), shaping={"history": 1}, lr=0.01, path=f"file://{tmp_path}/own", dropout=0.1, clip=1.0)
    own = json.loads(spark.read.text(f"file://{tmp_path}/own/config").first().value)
    assert own["dropout"] == 0.1 and own["shaping"] == {"history": 1} and spark.read.json(f"file://{tmp_path}/own/repair").count() == 3
    assert out["metrics"].count() == len(OUTPUTS) + 1
    sinks.write_run_outputs(f"file://{tmp_path}/run", out["scalers"], out["splits"], out["history"], out["metrics"], {"epochs": 2}, out["model"], {k: out[k] for k in ("split_summary", "repair")})
    assert {r.split: r.cases for r in spark.read.json(f"file://{tmp_path}/run/repair").collect()} == {"train": 2, "val": 1, "test": 1}
    assert spark.read.json(f"file://{tmp_path}/run/split_summary").count() >= 1
    again = sinks.read_model(spark, f"file://{tmp_path}/run/model")
    assert {k: v for k, v in again.items() if k != "weights"} == {k: v for k, v in out["model"].items() if k != "weights"}
    assert all((again["weights"][k] == v).all() for k, v in out["model"]["weights"].items())
    assert json.loads(spark.read.text(f"file://{tmp_path}/run/config").first().value) == {"epochs": 2}
