"""Text sources: file lists, channel logs, load tables, designs, kept features."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import case_id, relative_path, stem
from . import logs
from .ranges import Ranges


def catalog_files(spark: SparkSession, root: str, exts: list[str]) -> DataFrame:
    """(path, length, case_id, stem, depth) of files below ``root`` with one of the endings, any case."""
    ends = "|".join(e.lstrip(".") for e in exts)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    files = files.where(F.lower("path").rlike(rf"\.(?:{ends})$".lower()))
    rel = relative_path(F.col("path"), root)
    return files.select("path", "length", case_id(rel).alias("case_id"), stem(F.col("path")).alias("stem"), (F.size(F.split(rel, "/")) - 1).alias("depth")).orderBy("path")


def log_status(spark: SparkSession, root: str, pattern: str = "*.out") -> DataFrame:
    """(case_id, path, log_ok): false without a header line starting with Time, with an over-long row, or where numbered names collide."""
    return logs.parse_logs(spark, root, [], pattern).status


def read_channel_logs(spark: SparkSession, root: str, channels: list[str] | None = None, pattern: str = "*.out", on_error: str = "raise", block: int = logs.BLOCK) -> DataFrame:
    """Simulator logs as rows, each log cut into tasks of ``block`` bytes.

    With ``channels``: (case_id, line_no, one text column for each); a log without a
    channel has nulls there. Without: (case_id, line_no, channel_pos, channel, value). Short rows
    end in nulls. Repeated header names become n, n_1, n_2. A log without header, with an over-long
    row or with a name that numbering gives twice is an error, or left out with ``on_error`` = 'skip', for which
    rows are stored first. See ``logs.parse_logs`` for names, units, status and rows from one parse.
    """
    if on_error == "raise":
        table = logs.log_table(spark, root, pattern)
        distinct = F.coalesce(F.size(F.array_distinct("names")) == F.size("names"), F.lit(False))
        error = lambda c: F.raise_error(F.concat(F.lit("unreadable log: "), c)).cast("boolean")
        table = table.where(F.when(distinct, F.lit(True)).otherwise(error(F.col("path"))))
        rows = logs.parsed(table, channels, block)
        rows = rows.where(F.when(~F.col("too_long"), F.lit(True)).otherwise(error(F.col("case_id")))).drop("too_long")
    else:
        found = logs.parse_logs(spark, root, channels, pattern, block)
        table, rows = found.table, found.usable
    if channels is not None:
        return rows
    rows = rows.join(table.select("case_id", "names"), "case_id")
    return rows.select("case_id", "line_no", "row", F.posexplode("names").alias("channel_pos", "channel")).select(
        "case_id", "line_no", "channel_pos", "channel", F.get("row", F.col("channel_pos")).alias("value")
    )


def log_headers(spark: SparkSession, root: str, pattern: str = "*.out") -> DataFrame:
    return logs.log_table(spark, root, pattern).select("case_id", F.posexplode("names").alias("pos", "channel"))


def channel_units(spark: SparkSession, root: str, pattern: str = "*.out") -> DataFrame:
    """(case_id, channel, unit); units are '' where their number is not that of the names."""
    return logs.Logs(logs.log_table(spark, root, pattern), None).units


def numbered_names(df: DataFrame, case: str, pos: str, name: str) -> DataFrame:
    """Row form of name numbering: n, n_1, n_2 ... by position within a case."""
    k = F.row_number().over(Window.partitionBy(case, name).orderBy(pos)) - 1
    return df.withColumn("unique_name", F.when(k > 0, F.concat(F.col(name), F.lit("_"), k.cast("string"))).otherwise(F.col(name)))


def load_headers(spark: SparkSession, root: str, case: Column | None = None) -> DataFrame:
    """(case_id, path, length, names, at) of every CSV file below ``root``, by its first line; ``at`` is where rows start."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where("length > 0")
    listed = listed.select((stem(F.input_file_name()) if case is None else case).alias("case_id"), "path", "length")

    def run(batches):
        opened = Ranges()
        for batch in batches:
            names, at = [], []
            for path, length in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = b""
                while b"\n" not in raw and len(raw) < length:
                    raw += opened.read(path, len(raw), min(logs.HEAD, length - len(raw)))
                line = raw.split(b"\n", 1)[0]
                at.append(min(len(line) + 1, length))
                names.append(logs.numbered([c.strip() for c in _values(line.decode("utf-8", "replace").strip("\ufeff\r"))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.list_(pa.string())), pa.array(at, pa.int64())], names=["case_id", "path", "length", "names", "at"])
        opened.close()

    return listed.mapInArrow(run, "case_id string, path string, length long, names array<string>, at long")


def _values(line: str) -> list[str]:
    if '"' not in line:
        return line.split(",")
    import csv

    csv.field_size_limit(1 << 31)
    return next(csv.reader([line], escapechar="\\"), [])


def read_load_tables(spark: SparkSession, root: str, columns: list[str], case: Column | None = None, block: int = logs.BLOCK) -> DataFrame:
    """CSV files of loads, one for each case, with ``columns`` as doubles by each file's own header.

    The case is the file's stem, or ``case`` over the file's name. Files may have their
    columns in any order and further ones; a file without one of ``columns`` is left out. Files are read
    in tasks of ``block`` bytes, so neither their number nor their names reach the driver by way of their headers.
    A value may be quoted but not hold a line end.
    """
    own = load_headers(spark, root, case).where("at < length")
    for c in columns:
        own = own.where(F.array_contains("names", c))
    first = F.explode(F.sequence(F.col("at"), F.col("length") - 1, F.lit(block))).alias("first")
    blocks = own.select("case_id", "path", "length", "at", "names", first)

    def run(batches):
        opened = Ranges()
        for batch in batches:
            for case_id, path, length, at, names, first in zip(*[c.to_pylist() for c in batch.columns]):
                where = [names.index(c) for c in columns]
                lines = logs.block_lines(opened, path, first, min(first + block, length), at, length)
                for k in range(0, len(lines), 20_000):
                    texts = [x.decode("utf-8", "replace").rstrip("\r") for x in lines[k : k + 20_000]]
                    rows = [_values(x) for x in texts if x.strip()]
                    out = [pa.array([case_id] * len(rows), pa.string()), *[pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in where]]
                    yield pa.RecordBatch.from_arrays(out, names=["case_id", *columns])
        opened.close()

    text = blocks.repartition("path", "first").mapInArrow(run, ", ".join(["case_id string", *(f"`{c}` string" for c in columns)]))
    return text.select("case_id", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])


DESIGN = "number int, seed long, analysis_time double, usable_time double, model string, turbulence string, ref_height string, speed string, yaw string, shear string"


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """Experiment sheet by position of its ten columns; the header row is skipped."""
    return spark.read.option("header", True).schema(DESIGN).csv(path)


def read_kept_features(spark: SparkSession, path: str) -> DataFrame:
    """(rank_pos, original_index, feature) of a kept-features file."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.posexplode(F.arrays_zip("kept_feature_indices", "kept_feature_names")).alias("rank_pos", "x")).select(
        "rank_pos", F.col("x.kept_feature_indices").cast("int").alias("original_index"), F.col("x.kept_feature_names").alias("feature")
    )
