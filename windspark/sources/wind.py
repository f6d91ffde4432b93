"""Binary wind fields. Records have a fixed length, so a file is cut into step ranges."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import case_id, relative_path
from .ranges import Ranges, open_output

#: Bytes before the description, little endian: int16, 4 x int32, 6 + 6 float32, int32.
FIXED = 70
_FIELDS = ["id", "nz", "ny", "n_twr", "nt", "dz", "dy", "dt", "u_hub", "z_hub", "z_bottom", "slope", "intercept", "info"]
_KINDS = [pa.int16(), *[pa.int32()] * 4, *[pa.float32()] * 6, pa.list_(pa.float32()), pa.list_(pa.float32()), pa.string()]
HEADER = (
    "case_id string, id short, nz int, ny int, n_twr int, nt int, dz float, dy float, dt float, u_hub float, "
    "z_hub float, z_bottom float, slope array<float>, intercept array<float>, info string"
)


def parsed_header(raw: bytes) -> tuple:
    """(values of the fixed part up to the scales, slopes, intercepts, bytes of the description) of a file's first 70 bytes."""
    (n,) = struct.unpack_from("<l", raw, 66)
    scales = struct.unpack_from("<6f", raw, 42)
    return (*struct.unpack_from("<h4l", raw, 0), *struct.unpack_from("<6f", raw, 18)), list(scales[0::2]), list(scales[1::2]), max(n, 0)


def record_size(ny: int, nz: int, n_twr: int) -> int:
    return (ny * nz + n_twr) * 6


def decoded(raw: bytes, ny: int, nz: int, n_twr: int, slope: list[float], shift: list[float], kept: np.ndarray | None = None) -> np.ndarray:
    """(component, step, ny * nz) of whole records: component fastest on file, then y, then z; tower values are skipped."""
    rec = record_size(ny, nz, n_twr)
    n = len(raw) // rec
    grid = np.frombuffer(raw, "<i2", n * rec // 2).reshape(n, rec // 2)[:, : 3 * ny * nz].reshape(n, nz, ny, 3)
    grid = grid if kept is None else grid[kept]
    return ((grid - np.array(shift, np.float32)) / np.array(slope, np.float32)).astype(np.float32).transpose(3, 0, 2, 1).reshape(3, len(grid), ny * nz)


def as_batch(case: str, step: np.ndarray, values: np.ndarray, sizes: tuple[int, int] | None = None) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(step) + 1, dtype=np.int32) * values.shape[2])
    cols = [pa.array([case] * len(step), pa.string()), pa.array(step)]
    if sizes is not None:
        cols += [pa.array(np.full(len(step), n, np.int32)) for n in sizes]
    cols += [pa.ListArray.from_arrays(offsets, pa.array(v.reshape(-1))) for v in values]
    return pa.RecordBatch.from_arrays(cols, names=["case_id", "step", *(["ny", "nz"] if sizes is not None else []), "u", "v", "w"])


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(case_id, path) of the files; Spark lists them and reads none of their bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return df.where(F.col("length") >= FIXED).select(case_id(relative_path(F.col("path"), root)).alias("case_id"), "path")


def _headers(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Headers with the file's path and the place of its first record; reads 70 bytes and the description."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            rows, at = [], []
            for path in batch.column(1).to_pylist():
                fixed, slope, shift, n = parsed_header(files.read(path, 0, FIXED))
                text = files.read(path, FIXED, n).decode("latin-1").rstrip("\x00").strip()
                rows.append((*fixed, slope, shift, text))
                at.append(FIXED + n)
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, batch.column(1), pa.array(at, pa.int64())], names=["case_id", *_FIELDS, "path", "at"])
        files.close()

    return _listed(spark, root, pattern).mapInArrow(run, f"{HEADER}, path string, at long")


def read_wind_headers(spark: SparkSession, root: str, pattern: str = "*.bts") -> DataFrame:
    """One header row per field file; files too short for one are left out."""
    return _headers(spark, root, pattern).drop("path", "at")


def read_wind_fields(spark: SparkSession, root: str, steps_per_block: int = 500, pattern: str = "*.bts", steps: DataFrame | None = None, sizes: bool = False) -> DataFrame:
    """(case_id, step, u, v, w), with ``sizes`` also ny and nz: each component of ny * nz floats, y slow and z fast.

    Integers on file go component fastest, then y, then z, and tower values follow and are
    skipped; value = (raw - intercept) / slope. A file is cut into ranges of
    ``steps_per_block`` steps that tasks read by themselves, so files may have any size. With
    ``steps`` (case_id, step), only blocks that hold one of these are read, and only these
    steps returned. A file that ends early gives the whole steps it has.
    """
    h = _headers(spark, root, pattern).where("nt > 0")
    first = F.explode(F.sequence(F.lit(0), F.col("nt") - 1, F.lit(steps_per_block))).alias("first")
    blocks = h.select("case_id", first, "path", "at", "ny", "nz", "n_twr", "nt", "slope", "intercept")
    if steps is not None:
        wanted = steps.select("case_id", F.col("step").cast("int").alias("step")).distinct()
        wanted = wanted.groupBy("case_id", (F.floor(F.col("step") / steps_per_block) * steps_per_block).cast("int").alias("first")).agg(F.collect_set("step").alias("wanted"))
        blocks = blocks.join(wanted, ["case_id", "first"])
    else:
        blocks = blocks.withColumn("wanted", F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            for case, first, path, at, ny, nz, n_twr, nt, slope, shift, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                rec = record_size(ny, nz, n_twr)
                raw = files.read(path, at + first * rec, min(steps_per_block, nt - first) * rec)
                step = np.arange(first, first + len(raw) // rec, dtype=np.int32)
                own = None if wanted is None else np.isin(step, wanted)
                values = decoded(raw, ny, nz, n_twr, slope, shift, own)
                yield as_batch(case, step if own is None else step[own], values, (ny, nz) if sizes else None)
        files.close()

    return blocks.repartition("path", "first").mapInArrow(run, f"case_id string, step int, {'ny int, nz int, ' if sizes else ''}u array<float>, v array<float>, w array<float>")


def write_field(path: str, grid: np.ndarray, tower: np.ndarray, sizes: tuple, slope: tuple, intercept: tuple, info: str) -> None:
    """One field file, by the task that holds it: ``grid`` (steps, z, y, 3) and ``tower`` (steps, points, 3) as int16.

    ``sizes``: dz, dy, dt, hub speed, hub height, lowest height.
    """
    nt, nz, ny, _ = grid.shape
    text = info.encode("latin-1")
    scales = [x for pair in zip(slope, intercept) for x in pair]
    head = struct.pack("<h4l", 8, nz, ny, tower.shape[1], nt) + struct.pack("<6f", *sizes) + struct.pack("<6f", *scales) + struct.pack("<l", len(text)) + text
    body = np.concatenate([grid.reshape(nt, -1), tower.reshape(nt, -1)], 1).astype("<i2")
    with open_output(path) as f:
        f.write(head + body.tobytes())
