"""The three main jobs from files to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.channels import INPUTS, OUTPUTS, split_tasks
from ..operators import align, cases, grid, mrmr, shape, split, stats, surrogate, weights
from ..operators._grid_np import FEATURES as GRID
from ..sources import files, logs, sinks, wind


def build_dataset(spark: SparkSession, logs_root: str, fields_root: str, start: float, end: float, dt: float, inputs: list[str] = INPUTS, outputs: list[str] = OUTPUTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aligned rows, manifest, skip report) of a campaign's logs and fields.

    Logs are parsed once. Wind stays in its own table; rows carry ``wind_step`` to join features on.
    """
    rows, usable, skips, _ = _built(spark, logs_root, fields_root, start, end, dt, inputs, outputs)
    return rows, sinks.build_manifest(rows, usable), skips


def write_campaign(spark: SparkSession, logs_root: str, fields_root: str, path: str, start: float, end: float, dt: float, inputs: list[str] = INPUTS, outputs: list[str] = OUTPUTS, store_wind: bool = False, wind_dtype: str = "float16") -> None:
    """The build job with its files below ``path``: rows, units of the kept cases' channels, wind if wanted, manifest and skip report."""
    rows, usable, skips, units = _built(spark, logs_root, fields_root, start, end, dt, inputs, outputs)
    fields = None
    if store_wind:
        steps = rows.join(usable.select("case_id", "field_id"), "case_id").select(F.col("field_id").alias("case_id"), F.col("wind_step").alias("step")).distinct()
        fields = wind.read_wind_fields(spark, fields_root, steps=steps)
    sinks.write_case_dataset(rows, path, fields, wind_dtype)
    stored = spark.read.parquet(f"{path}/rows").select("case_id", "t")
    own = units.where(F.col("channel").isin([*inputs, *outputs])).join(stored.select("case_id").distinct(), "case_id", "left_semi")
    own.write.mode("overwrite").parquet(f"{path}/units")
    sinks.write_table_csv(sinks.build_manifest(stored, usable, store_wind, wind_dtype, path).orderBy("case_id"), f"{path}/manifest")
    sinks.write_table_csv(skips, f"{path}/skipped")


def _built(spark, logs_root, fields_root, start, end, dt, inputs, outputs) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(aligned rows, usable cases, skip report, units)."""
    channels = ["Time", *inputs, *outputs]
    parsed = logs.parse_logs(spark, logs_root, channels)
    listed = files.catalog_files(spark, logs_root, ["out"]).withColumnRenamed("path", "out_path")
    fields = files.catalog_files(spark, fields_root, ["bts"]).select("stem", "depth", F.col("path").alias("field_path"), F.col("case_id").alias("field_id"))
    best = cases.match_cases(listed.select("case_id", "stem", "out_path"), fields).join(fields.select("field_path", "field_id"), "field_path", "left")
    headers = wind.read_wind_headers(spark, fields_root).withColumnRenamed("case_id", "field_id")
    status = parsed.status.select("case_id", "log_ok")
    has = cases.require_channels(parsed.names, channels).withColumn("has_columns", F.lit(True))
    log = cases.clean_log(parsed.usable)
    last = log.groupBy("case_id").agg(F.max("Time").alias("max_time"))
    table = best.join(headers, "field_id", "left").join(status, "case_id", "left").join(has, "case_id", "left").join(last, "case_id", "left")
    table = table.select(
        "case_id", "stem", "out_path", "field_path", F.col("field_path").alias("bts_path"), "field_id", "nt", F.col("dt").cast("double").alias("field_dt"), "dt", "ny", "nz",
        "max_time", "log_ok", "has_columns",
    ).persist()
    usable = table.where("field_path is not null and log_ok and has_columns and nt is not null")
    times = align.target_times(usable, start, end, dt)
    kept = times.select("case_id").distinct().withColumn("time_ok", F.lit(True))
    rows = align.resample_linear(log.join(kept.select("case_id"), "case_id", "left_semi"), times, [*inputs, *outputs])
    rows = rows.join(usable.select("case_id", "nt", "field_dt"), "case_id")
    rows = rows.withColumn("wind_step", align.nearest_step(F.col("t"), F.col("field_dt"), F.col("nt"))).drop("nt", "field_dt").withColumnRenamed("i", "step")
    checks = table.join(kept, "case_id", "left").select(
        "case_id", F.col("field_path").isNotNull().alias("has_field"), F.coalesce("log_ok", F.lit(False)).alias("log_ok"),
        F.coalesce("has_columns", F.lit(False)).alias("has_columns"), F.col("nt").isNotNull().alias("field_ok"), F.coalesce("time_ok", F.lit(False)).alias("time_ok"),
    )
    return rows, usable, cases.skip_report(checks), parsed.units


def train_and_evaluate(rows: DataFrame, features: list[str], inputs: list[str], outputs: list[str], ratios=(0.7, 0.15, 0.15), seed: int = 42, stratify: str | None = None, bins: int = 10, epochs: int = 10, shaping: dict | None = None, hidden=(256, 256), lr: float = 1e-3, path: str | None = None, **fitting) -> dict:
    """Split by case, shape, scale, fit and evaluate on the test cases.

    With ``path``, model, scalers, splits, reports, history, metrics and settings are written below it.
    ``fitting`` goes to ``surrogate.fit_surrogate`` (batch_rows, clip, dropout, averages). The result has, beside model and
    metrics, the splits and two reports on them: ``split_summary`` before and ``repair`` after empty splits were filled.
    """
    settings = shaping or {}
    names = rows.select("case_id").distinct()
    counted = cases.effective_samples(rows, settings.get("lag", 0), settings.get("history", 0))
    if stratify:
        parts = split.split_stratified(stats.stratify_value(names, rows, stratify), ratios, seed, bins).persist()
        summary = split.split_summary(parts)
    else:
        parts = split.split_random(names, ratios, seed).persist()
        summary = parts.groupBy("split").agg(F.count("*").alias("n"))
    before = parts.join(counted, "case_id").select("case_id", "n_eff", "split").persist()
    parts = split.fix_empty_splits(before).persist()
    shaped = shape.process_case(rows, inputs, outputs, features, **settings)
    cols = [c for c in shaped.columns if c not in ("case_id", "step", *outputs)]
    wind_cols = [c for c in cols if any(c == f or c.startswith(f"{f}_t") for f in features)]
    input_cols = [c for c in cols if c not in wind_cols]
    shaped = shaped.join(parts.select("case_id", "split"), "case_id").persist()
    train = shaped.where("split = 'train'")
    scalers = stats.fit_scalers(train, {"wind": wind_cols, "input": input_cols, "output": outputs}).persist()
    scaled = stats.scale(shaped, scalers, [*cols, *outputs])
    model = surrogate.init_model(len(wind_cols), len(input_cols), split_tasks(outputs), hidden=hidden, seed=seed)
    model, history = surrogate.fit_surrogate(scaled.where("split = 'train'"), scaled.where("split = 'val'"), model, wind_cols, input_cols, epochs=epochs, lr=lr, seed=seed, **fitting)
    test = scaled.where("split = 'test'")
    pred = surrogate.score_surrogate(test, model, wind_cols, input_cols, ["case_id", "step"])
    report = stats.evaluate(pred, test, scalers, outputs, ["case_id", "step"])
    out = {"model": model, "history": history, "scalers": scalers, "splits": parts, "metrics": report, "split_summary": summary, "repair": split.repair_report(before, parts)}
    if path is not None:
        config = {"ratios": list(ratios), "seed": seed, "stratify": stratify, "bins": bins, "epochs": epochs, "hidden": list(hidden), "lr": lr, "shaping": settings, **fitting}
        config |= {"features": features, "inputs": inputs, "outputs": outputs}
        sinks.write_run_outputs(path, scalers, parts, history, report, config, model, {k: out[k] for k in ("split_summary", "repair")})
    return out


def features_of(spark: SparkSession, fields_root: str, region_weights: DataFrame, ny: int, nz: int, names: list[str] | None = None, steps: DataFrame | None = None) -> DataFrame:
    """(case_id, step, features) of snapshots on the weights' grid of ny x nz points.

    Fields on other grids are interpolated to it first; a campaign of many grids is still
    read once. With ``steps`` (case_id, step), only these snapshots are read.
    """
    fields = wind.read_wind_fields(spark, fields_root, steps=steps, sizes=True)
    return grid.wind_features(grid.regrid_mixed(fields, ny, nz), region_weights, ny, nz, names)


def select_features(
    spark: SparkSession, rows: DataFrame, fields_root: str, region_weights: DataFrame, ny: int, nz: int, targets: list[str], path: str | None = None,
    names: list[str] = GRID, max_cases: int | None = 50, per_case: int | None = None, sample: int | None = 150_000, seed: int = 42, method: str = "knn", **ranking,
) -> tuple[DataFrame, list[int]]:
    """The selection job: aligned rows and field files to scores and kept features.

    ``rows`` has case_id, step, wind_step and the targets; case_id is that of the field.
    Row keys are sampled first (cases, rows per case, sample); only the snapshots that the
    sample needs are read and reduced to features. ``per_case`` None takes the balanced
    cap of ``cases.default_cap``, and no cap without a sample. With ``path``, scores and kept features are written below.
    Returns the score table and the kept indices by rank.
    """
    key = ["case_id", "step"]
    short = cases.select_channels(rows, targets, [*key, "wind_step"], "target")
    short = short if max_cases is None else cases.limit_cases(short, max_cases)
    if per_case is None and sample:
        per_case = cases.default_cap(sample, short.select("case_id").distinct().count())
    if per_case is not None:
        short = cases.sample_per_case(short, per_case, seed, key)
    short = (cases.global_downsample(short, sample, seed, key) if sample else short).persist()
    snapshots = short.select("case_id", F.col("wind_step").alias("step")).distinct()
    feats = features_of(spark, fields_root, region_weights, ny, nz, names, snapshots).withColumnRenamed("step", "wind_step")
    joined = short.join(feats, ["case_id", "wind_step"]).persist()
    table, kept = mrmr.select_features_mrmr(joined, names, targets, key, max_cases=None, per_case=None, sample=None, seed=seed, method=method, **ranking)
    if path is not None:
        table = table.persist()
        sinks.write_feature_scores(table, f"{path}/feature_scores")
        info = {"subsample_size": str(joined.count()), "per_file_cap": str(per_case), "max_files": str(max_cases)}
        sinks.write_kept_features(table, f"{path}/kept_features", info)
    return table, kept


def region_weights_from_files(spark: SparkSession, loads_root: str, columns: list[str], fields_root: str, n: int, max_cases: int = 50) -> DataFrame:
    """Correlation weights of a campaign: load tables with Time and ``columns``, strictly aligned with the fields' steps.

    A case of which any row falls outside its field is left out whole. Rows count one by
    one, also those of equal times. Of the fields only the steps of the chosen cases are read.
    """
    loads = files.read_load_tables(spark, loads_root, ["Time", *columns]).where("Time is not null")
    headers = wind.read_wind_headers(spark, fields_root).select("case_id", "nt", F.col("dt").cast("double").alias("field_dt"))
    rows = align.strict_steps(cases.limit_cases(loads, max_cases), headers).persist()
    steps = rows.select("case_id", F.col("wind_step").alias("step")).distinct()
    fields = wind.read_wind_fields(spark, fields_root, steps=steps).select("case_id", F.col("step").alias("wind_step"), "u")
    return weights.spearman_weights(rows.join(fields, ["case_id", "wind_step"]), columns, n)
