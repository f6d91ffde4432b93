"""Channel logs read by byte range, so that a log of any size is many tasks and is parsed once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import case_id, relative_path
from ..functions.scratch import written
from .ranges import Ranges

#: Bytes of a log that one task parses, and bytes that the search for the header reads at a time.
BLOCK, HEAD = 64 << 20, 1 << 16
#: Line numbers of a later block of a log start at a multiple of this.
LINES = 1 << 32


def numbered(names: list[str]) -> list[str]:
    """The second, third ... use of a name becomes n_1, n_2 ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def _tokens(line: bytes) -> list[str]:
    return [t.decode("utf-8", "replace") for t in line.split()]


def _header(files: Ranges, path: str, length: int) -> tuple[list[str] | None, list[str] | None, int]:
    """(names, units, place of the first data line) by the first line that starts with Time; names are None without one."""
    raw, at = b"", 0
    while True:
        more = files.read(path, len(raw), min(HEAD, length - len(raw)))
        raw += more
        while True:
            end = raw.find(b"\n", at)
            if end < 0 and more:
                break
            line = raw[at : end if end >= 0 else len(raw)]
            if line.strip(b" \r").startswith(b"Time"):
                after = len(raw) if end < 0 else end + 1
                stop = raw.find(b"\n", after)
                while stop < 0 and len(raw) < length:
                    raw += files.read(path, len(raw), min(HEAD, length - len(raw)))
                    stop = raw.find(b"\n", after)
                stop = len(raw) if stop < 0 else stop
                return numbered(_tokens(line)), _tokens(raw[after:stop]), min(stop + 1, length)
            if end < 0:
                return None, None, length
            at = end + 1


def log_table(spark: SparkSession, root: str, pattern: str = "*.out") -> DataFrame:
    """(case_id, path, length, names, units, at) of every log: a few KB of each are read.

    ``names`` is null without a header line starting with Time; ``at`` is where data starts.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    listed = listed.select(case_id(relative_path(F.col("path"), root)).alias("case_id"), "path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            got = [_header(files, p, n) for p, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["case_id", "path", "length", "names", "units", "at"])
        files.close()

    return listed.mapInArrow(run, "case_id string, path string, length long, names array<string>, units array<string>, at long")


def block_lines(files: Ranges, path: str, first: int, last: int, start: int, length: int) -> list[bytes]:
    """Lines whose first byte lies in [first, last); ``start`` is a line's start. The last line is read to its end."""
    raw = files.read(path, max(first - 1, start), last - max(first - 1, start))
    at = 0
    if first > start:  # the byte before tells whether a line starts here
        at = raw.find(b"\n") + 1
        if not at:
            return []
        if at >= len(raw):
            return []
    tail = last
    while tail < length and not raw.endswith(b"\n"):
        more = files.read(path, tail, min(HEAD, length - tail))
        end = more.find(b"\n")
        raw += more if end < 0 else more[: end + 1]
        tail += len(more)
        if end >= 0 or not more:
            break
    lines = raw[at:].split(b"\n")
    return lines[:-1] if lines[-1] == b"" else lines


def parsed(table: DataFrame, channels: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Data lines of the logs in ``table`` (see :func:`log_table`).

    With ``channels``: (case_id, line_no, too_long, one text column for each), null where a log has no such channel
    or a row is short. Without: (case_id, line_no, too_long, row). ``line_no`` counts from 0 without blank lines; in logs
    of several blocks it jumps ahead at their borders. ``too_long`` marks rows with more values than names.
    """
    own = table.where("names is not null")
    first = F.explode(F.sequence(F.col("at"), F.greatest(F.col("at"), F.col("length") - 1), F.lit(block))).alias("first")
    blocks = own.where("at < length").select("case_id", "path", "length", "at", "names", first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            for case, path, length, at, names, first in zip(*[c.to_pylist() for c in batch.columns]):
                lines = block_lines(files, path, first, min(first + block, length), at, length)
                base = (first - at) // block * LINES
                where = None if channels is None else [names.index(c) if c in names else -1 for c in channels]
                n = 0
                for k in range(0, len(lines), 20_000):
                    rows = [t for t in map(_tokens, lines[k : k + 20_000]) if t]
                    out = [pa.array([case] * len(rows), pa.string()), pa.array(range(base + n, base + n + len(rows)), pa.int64()), pa.array([len(r) > len(names) for r in rows], pa.bool_())]
                    n += len(rows)
                    if where is None:
                        out.append(pa.array(rows, pa.list_(pa.string())))
                    else:
                        out += [pa.array([r[i] if 0 <= i < len(r) else None for r in rows], pa.string()) for i in where]
                    yield pa.RecordBatch.from_arrays(out, names=["case_id", "line_no", "too_long", *(["row"] if channels is None else channels)])
        files.close()

    cols = ["row array<string>"] if channels is None else [f"`{c}` string" for c in channels]
    return blocks.repartition("path", "first").mapInArrow(run, ", ".join(["case_id string", "line_no long", "too_long boolean", *cols]))


@dataclass
class Logs:
    """Logs parsed once: all parts come from a table of headers and a table of rows, both stored."""

    table: DataFrame
    rows: DataFrame

    @property
    def status(self) -> DataFrame:
        """(case_id, path, log_ok): false without a header, with an over-long row, or where numbered names collide."""
        long = self.rows.groupBy("case_id").agg(F.max("too_long").alias("_long"))
        distinct = F.size(F.array_distinct("names")) == F.size("names")
        ok = F.coalesce(distinct, F.lit(False)) & ~F.coalesce("_long", F.lit(False))
        return self.table.join(long, "case_id", "left").select("case_id", "path", ok.alias("log_ok"))

    @property
    def names(self) -> DataFrame:
        return self.table.select("case_id", F.posexplode("names").alias("pos", "channel"))

    @property
    def units(self) -> DataFrame:
        """(case_id, channel, unit); units are '' where their number is not that of the names."""
        same = F.size("units") == F.size("names")
        rows = self.table.select("case_id", "units", same.alias("same"), F.posexplode("names").alias("pos", "channel"))
        return rows.select("case_id", "channel", F.when(F.col("same"), F.get("units", F.col("pos"))).otherwise("").alias("unit"))

    @property
    def usable(self) -> DataFrame:
        """Rows of readable logs."""
        return self.rows.join(self.status.where("log_ok").select("case_id"), "case_id", "left_semi").drop("too_long")


def parse_logs(spark: SparkSession, root: str, channels: list[str] | None = None, pattern: str = "*.out", block: int = BLOCK) -> Logs:
    """All logs below ``root``, parsed once into the shared folder."""
    table = written(log_table(spark, root, pattern))
    return Logs(table, written(parsed(table, channels, block)))
